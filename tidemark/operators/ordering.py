"""Ordered processing without a hot task.

Most operators here depend on row order: positions, lags, rolling statistics,
runs, episodes. A plain `Window.partitionBy(source)` puts a whole source into
one task, and a window without partitions puts everything into one task.
`arrange` instead cuts the ordered data into contiguous key ranges of bounded
size ("chunks"), even inside one source or one timestamp:

1. a small deterministic sample of sort keys gives range bounds,
2. one narrow aggregate counts rows per range,
3. each row finds its chunk by a binary search over the bounds, in the JVM.

Wide rows are then shuffled once, on (chunk, group). Rows near a chunk edge can
be copied into the neighbouring chunk (a halo), so bounded frames see the same
rows as an undivided window. Positions cross chunk edges by the counts from
step 2, which sit on the driver: one number per chunk, never per row. Running
values that are not row-local carry one partial value per chunk.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import rows_per_chunk, settle

CHUNK = "__chunk"
OWN = "__own"
_BIN = "__bin"
_FINE = 8
_SAMPLES_PER_BIN = 8
_MAX_CHUNKS = 20_000
_FIRST, _TO_HERE = Window.unboundedPreceding, Window.currentRow


def _constant(values: list, element_type: str) -> Column:
    """An array literal; `from_json` over a literal is folded at plan time."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{element_type}>")


def comparable(df: DataFrame, name: str) -> Column:
    """The column as a type that survives the trip through a JSON literal."""
    kind = df.schema[name].dataType.typeName()
    column = F.col(f"`{name}`")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(column.cast("timestamp"))
    if kind == "date":
        return F.unix_date(column)
    if kind == "boolean":
        return column.cast("int")
    return column


def _key(df: DataFrame, names: Sequence[str], prefix: str) -> Column:
    return F.struct(*[comparable(df, n).alias(f"{prefix}{i}") for i, n in enumerate(names)])


@dataclass(frozen=True)
class _Chunks:
    """What the driver knows about the cut: a few values for each chunk."""

    bounds: list = field(default_factory=list)
    key_type: str = ""
    group_type: str = ""
    targets: list = field(default_factory=list)
    home: list = field(default_factory=list)
    first_group: list = field(default_factory=list)
    last_group: list = field(default_factory=list)
    before: dict = field(default_factory=dict)
    after: dict = field(default_factory=dict)
    count: int = 1


_TREE_LIMIT = 64


def search_bounds(bounds: list, element_type: str, key: Column) -> Column:
    """Number of (sorted) bounds not greater than the key, by binary search.

    A few bounds become a tree of comparisons inside generated code; many are
    kept in one array literal that a fold halves step by step.
    """
    if not bounds:
        return F.lit(0)
    listed = _constant(bounds, element_type)
    if len(bounds) <= _TREE_LIMIT:
        def halve(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.get(listed, F.lit(middle)) <= key, halve(middle + 1, high)).otherwise(halve(low, middle))

        return halve(0, len(bounds))
    steps = _constant([1 << b for b in reversed(range(len(bounds).bit_length()))], "int")

    def walk(value: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(listed, low + step - F.lit(1)) <= value, low + step).otherwise(low))

    # The one-element transform binds the key once for all steps.
    return F.get(F.transform(F.array(key), walk), F.lit(0))


_FAN = 8


def with_bin(df: DataFrame, name: str, bounds: list, element_type: str, key: Column) -> DataFrame:
    """The frame with the number of (sorted) bounds not greater than the key, in a column.

    Each step picks one of 8 parts of what the step before left, in a projection
    of its own: seven comparisons of generated code a step, however many bounds
    there are. One tree over dozens of wide keys makes a method that the JVM
    does not compile.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    listed = _constant(bounds, element_type)
    widths = [1]
    while widths[-1] * _FAN <= len(bounds):
        widths.append(widths[-1] * _FAN)
    found = df.withColumns({"__sought": key, name: F.lit(0)})
    for width in reversed(widths):
        def halve(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low * width)
            middle = (low + high) // 2
            passed = F.get(listed, F.col(name) + F.lit((middle + 1) * width - 1)) <= F.col("__sought")
            return F.when(passed, halve(middle + 1, high)).otherwise(halve(low, middle))

        found = found.withColumn(name, F.col(name) + halve(0, _FAN - 1))
    return found.drop("__sought")


def _cut(df: DataFrame, by: list[str], order: list[str], back: int, ahead: int,
         tallies: Mapping[str, Column], size: int) -> _Chunks:
    total = df.count()
    wanted = min(-(-total // size), _MAX_CHUNKS)
    if wanted <= 1:
        return _Chunks()

    names = [*by, *order]
    keyed = df.select(_key(df, names, "k").alias("key"), _key(df, by, "g").alias("grp") if by else F.lit(0).alias("grp"),
                      *[c.alias(f"t_{t}") for t, c in tallies.items()])
    key_type = keyed.schema["key"].dataType.simpleString()
    group_type = keyed.schema["grp"].dataType.simpleString() if by else "int"

    # Equal keys are counted before they reach the driver, so the sample holds
    # a bounded number of distinct keys whatever the duplication.
    bins = wanted * _FINE
    modulus = max(total // (bins * _SAMPLES_PER_BIN), 1)
    sample = (keyed.where(F.pmod(F.xxhash64("key"), F.lit(modulus)) == 0)
              .groupBy("key").count().orderBy("key").collect())
    weight, step, seen, bounds = sum(r["count"] for r in sample), 0, 0, []
    for row in sample:
        if seen * bins >= (step + 1) * weight:
            bounds.append(row["key"].asDict())
            step = seen * bins // weight
        seen += row["count"]
    if not bounds:
        return _Chunks()

    binned = with_bin(keyed, _BIN, bounds, key_type, F.col("key"))
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(f"t_{t}")).alias(t) for t in tallies]
    measures = F.struct("rows", *tallies)
    per_bin = (binned.groupBy(_BIN, "grp").agg(*counts).groupBy(_BIN)
               .agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"),
                    F.min_by(measures, F.col("grp")).alias("c0"), F.max_by(measures, F.col("grp")).alias("c1"),
                    F.sum("rows").alias("rows"))
               .orderBy(_BIN).collect())

    # Bins join into chunks of about the wanted size.
    ids = [r[_BIN] for r in per_bin]
    chunk_of, current, filled = [], 0, 0
    target = max(size, -(-total // _MAX_CHUNKS))
    for row in per_bin:
        if filled and filled + row["rows"] > target:
            current, filled = current + 1, 0
        chunk_of.append(current)
        filled += row["rows"]
    chunks = current + 1
    if chunks == 1:
        return _Chunks()

    first_bin = _starts(chunk_of)
    last_bin = [*(b - 1 for b in first_bin[1:]), len(ids) - 1]
    low, high = [], []
    for c in range(chunks):
        lo, hi, need = first_bin[c], last_bin[c], back
        while need > 0 and lo > 0:
            lo -= 1
            need -= per_bin[lo]["rows"]
        need = ahead
        while need > 0 and hi < len(ids) - 1:
            hi += 1
            need -= per_bin[hi]["rows"]
        low.append(lo)
        high.append(hi)

    targets = [[] for _ in ids]
    for c in range(chunks):
        for b in range(low[c], high[c] + 1):
            targets[b].append(c)

    # Rows of the group open at the end (start) of each bin, counted from the
    # group's own start (end).
    measures_names = ["rows", *tallies]
    left = {m: [0] * len(ids) for m in measures_names}
    right = {m: [0] * len(ids) for m in measures_names}
    for m in measures_names:
        for b, row in enumerate(per_bin):
            same = row["g0"] == row["g1"]
            joined = b > 0 and same and per_bin[b - 1]["g1"] == row["g0"]
            left[m][b] = row["c1"][m] + (left[m][b - 1] if joined else 0)
        for b in reversed(range(len(ids))):
            row = per_bin[b]
            same = row["g0"] == row["g1"]
            joined = b < len(ids) - 1 and same and per_bin[b + 1]["g0"] == row["g1"]
            right[m][b] = row["c0"][m] + (right[m][b + 1] if joined else 0)

    def plain(group):
        return group.asDict() if by else group

    before, after = {m: [] for m in measures_names}, {m: [] for m in measures_names}
    for c in range(chunks):
        lo, hi = low[c], high[c]
        opens = lo > 0 and per_bin[lo - 1]["g1"] == per_bin[lo]["g0"]
        closes = hi < len(ids) - 1 and per_bin[hi + 1]["g0"] == per_bin[hi]["g1"]
        for m in measures_names:
            before[m].append(left[m][lo - 1] if opens else 0)
            after[m].append(right[m][hi + 1] if closes else 0)

    span = ids[-1] + 1
    spread_targets, spread_home = [[0]] * span, [0] * span
    for b, bin_id in enumerate(ids):
        spread_targets[bin_id], spread_home[bin_id] = targets[b], chunk_of[b]
    return _Chunks(bounds, key_type, group_type, spread_targets, spread_home,
                   [plain(per_bin[b]["g0"]) for b in low], [plain(per_bin[b]["g1"]) for b in high],
                   before, after, chunks)


def _starts(chunk_of: list[int]) -> list[int]:
    return [i for i, c in enumerate(chunk_of) if i == 0 or chunk_of[i - 1] != c]


class Ordered:
    """Rows laid out in chunks, ready for window expressions."""

    def __init__(self, frame: DataFrame, by: list[str], order: list[str],
                 chunks: _Chunks, tallies: Mapping[str, Column], columns: list[str], laid: bool = False):
        self.frame, self.by, self.order = frame, by, order
        self._chunks, self._tallies, self._columns, self._laid = chunks, tallies, columns, laid

    # --- windows -----------------------------------------------------------
    def window(self, start: int | None = None, end: int | None = None):
        """Window in order inside one group; frames must stay within the halo."""
        spec = self._partition().orderBy(*[F.col(f"`{c}`").asc() for c in self.order])
        return spec if start is None else spec.rowsBetween(start, end)

    def _partition(self):
        return Window.partitionBy(CHUNK, *[f"`{c}`" for c in self.by])

    def _backwards(self):
        return self._partition().orderBy(*[F.col(f"`{c}`").desc() for c in self.order])

    def with_columns(self, columns: Mapping[str, Column]) -> Ordered:
        return self._with(self.frame.withColumns(dict(columns)), list(columns))

    def _with(self, frame: DataFrame, added: list[str], laid: bool | None = None) -> Ordered:
        names = self._columns + [c for c in added if c not in self._columns]
        return Ordered(frame, self.by, self.order, self._chunks, self._tallies, names, self._laid if laid is None else laid)

    def rows(self) -> DataFrame:
        """Every input row once, with the added columns."""
        return self.frame.where(F.col(OWN)).select(*[f"`{c}`" for c in self._columns])

    # --- positions from the driver-held counts -----------------------------
    def _edge(self, amounts: list, groups: list) -> Column:
        if self._chunks.count == 1 or not any(amounts):
            return F.lit(0)
        amount = F.get(_constant(amounts, "bigint"), F.col(CHUNK))
        if not self.by:
            return amount
        group = F.get(_constant(groups, self._chunks.group_type), F.col(CHUNK))
        return F.when(_key(self.frame, self.by, "g").eqNullSafe(group), amount).otherwise(0)

    def _hit(self, tally: str) -> Column:
        return F.lit(1) if tally == "rows" else F.when(self._tallies[tally], 1).otherwise(0)

    def running(self, tally: str = "rows") -> Column:
        """Rows (or rows meeting a tally's condition) up to and with this one."""
        local = (F.row_number().over(self.window()) if tally == "rows"
                 else F.sum(self._hit(tally)).over(self.window(_FIRST, _TO_HERE)))
        c = self._chunks
        return (local + self._edge(c.before.get(tally, []), c.first_group)).cast("bigint")

    def position(self, tally: str = "rows") -> Column:
        """Zero-based dense position inside the group."""
        return self.running(tally) - F.lit(1)

    def total(self, tally: str = "rows") -> Column:
        """Rows of the whole group (or of those meeting a tally's condition)."""
        c = self._chunks
        return (F.sum(self._hit(tally)).over(self._partition())
                + self._edge(c.before.get(tally, []), c.first_group)
                + self._edge(c.after.get(tally, []), c.last_group)).cast("bigint")

    # --- running values that carry over chunk edges -------------------------
    def accumulate(self, **values: tuple[str, Column]) -> Ordered:
        """Running values along the order, up to and with each row.

        Each keyword is `name=(kind, value)`: `sum`, `max`, `last` (latest
        non-null value) run forwards, `next` (earliest non-null value at or
        after the row) runs backwards, `total` sums over the whole group. Values may use window columns added
        before. All of them share one per-chunk summary.

        With more than one chunk the first call writes the laid-out rows once.
        What follows, summaries and further carries included, reads them in
        their chunks: the input is read and shuffled once however many carries
        there are.
        """
        here = {}
        for name, (kind, value) in values.items():
            mine = F.when(F.col(OWN), value)
            forwards = self.window(_FIRST, _TO_HERE)
            if kind == "sum":
                here[name] = F.sum(F.coalesce(mine, F.lit(0))).over(forwards)
            elif kind == "max":
                here[name] = F.max(mine).over(forwards)
            elif kind == "total":
                here[name] = F.sum(F.coalesce(mine, F.lit(0))).over(self._partition())
            elif kind == "last":
                here[name] = F.last(mine, ignorenulls=True).over(forwards)
            else:
                here[name] = F.last(mine, ignorenulls=True).over(self._backwards().rowsBetween(_FIRST, _TO_HERE))
        if self._chunks.count == 1:
            return self._with(self.frame.withColumns(here), list(values))
        if not self._laid:
            # Windows have put the rows into their chunks, in order; the written table keeps both.
            spare = {f"__v_{name}": value for name, (_, value) in values.items()}
            written = self._with(settle(self.frame.withColumns(spare).withColumns(here)), [], laid=True)
            return written._carried({name: (kind, F.col(f"__v_{name}")) for name, (kind, _) in values.items()}, {}, list(spare))
        return self._carried(values, here, [])

    def _carried(self, values: Mapping[str, tuple[str, Column]], here: Mapping[str, Column], spare_values: list[str]) -> Ordered:
        """Add to each chunk's own running values (`here`, or in the frame already) what earlier or later chunks bring."""
        rank = F.struct(*[F.col(f"`{c}`") for c in self.order])
        partial = {
            "sum": lambda v: F.sum(v),
            "total": lambda v: F.sum(v),
            "max": lambda v: F.max(v),
            "last": lambda v: F.max_by(v, F.when(v.isNotNull(), rank)),
            "next": lambda v: F.min_by(v, F.when(v.isNotNull(), rank)),
        }
        groups = [f"`{c}`" for c in self.by]
        parts = (self.frame.where(F.col(OWN)).groupBy(CHUNK, *groups)
                 .agg(*[partial[kind](value).alias(f"__p_{name}") for name, (kind, value) in values.items()]))
        along = Window.partitionBy(*(groups or [F.lit(0)]))
        earlier = along.orderBy(F.col(CHUNK).asc()).rowsBetween(_FIRST, -1)
        later = along.orderBy(F.col(CHUNK).desc()).rowsBetween(_FIRST, -1)
        merged = {}
        for name, (kind, _) in values.items():
            part = F.col(f"__p_{name}")
            merged[name] = {
                "sum": lambda p: F.sum(p).over(earlier),
                # Null where no other chunk holds the group: such rows need no carry.
                "total": lambda p: F.coalesce(F.sum(p).over(earlier) + F.sum(p).over(later), F.sum(p).over(earlier), F.sum(p).over(later)),
                "max": lambda p: F.max(p).over(earlier),
                "last": lambda p: F.last(p, ignorenulls=True).over(earlier),
                "next": lambda p: F.last(p, ignorenulls=True).over(later),
            }[kind](part)
        # Chunks are contiguous, so a group has rows here only for the chunks it
        # shares with others: together at most two rows per chunk.
        carry = (parts.select(F.col(CHUNK).alias("__c"), *[F.col(g).alias(f"__b{i}") for i, g in enumerate(groups)],
                              *[c.alias(f"__in_{name}") for name, c in merged.items()])
                 .where(F.coalesce(*[F.when(F.col(f"__in_{name}").isNotNull(), True) for name in values])))
        on = F.col(CHUNK) == F.col("__c")
        for i, group in enumerate(groups):
            on = on & F.col(group).eqNullSafe(F.col(f"__b{i}"))
        joined = self.frame.withColumns(here).join(F.broadcast(carry), on, "left")
        final = {}
        for name, (kind, _) in values.items():
            mine, brought = F.col(name), F.col(f"__in_{name}")
            final[name] = (mine + F.coalesce(brought, F.lit(0)) if kind in ("sum", "total")
                           else F.greatest(mine, brought) if kind == "max" else F.coalesce(mine, brought))
        spare = ["__c", *[f"__b{i}" for i in range(len(groups))], *[f"__in_{name}" for name in values], *spare_values]
        return self._with(joined.withColumns(final).drop(*spare), list(values))


def arrange(df: DataFrame, *, by: Sequence[str] = (), order: Sequence[str], back: int = 0, ahead: int = 0,
            tallies: Mapping[str, Column] | None = None, chunk_rows: int | None = None) -> Ordered:
    """Lay rows out in `(by, order)` sequence for window work.

    `order` must be total inside a group: end it with a tie-break column.
    `back` / `ahead` are the rows a frame may reach over a chunk edge, and
    `tallies` are row-local conditions to count along the order.
    """
    by, order, tallies = list(by), list(order), dict(tallies or {})
    chunks = _cut(df, by, order, back, ahead, tallies, chunk_rows or rows_per_chunk(df.sparkSession))
    columns = df.columns
    if chunks.count == 1:
        frame = df.withColumns({CHUNK: F.lit(0), OWN: F.lit(True)})
        return Ordered(frame, by, order, chunks, tallies, columns)
    frame = with_bin(df, _BIN, chunks.bounds, chunks.key_type, _key(df, [*by, *order], "k"))
    if back or ahead:
        frame = (frame.withColumn(CHUNK, F.explode(F.get(_constant(chunks.targets, "array<int>"), F.col(_BIN))))
                 .withColumn(OWN, F.get(_constant(chunks.home, "int"), F.col(_BIN)) == F.col(CHUNK)))
    else:
        frame = frame.withColumns({CHUNK: F.get(_constant(chunks.home, "int"), F.col(_BIN)), OWN: F.lit(True)})
    return Ordered(frame.drop(_BIN), by, order, chunks, tallies, columns)


def spread_keep(position: Column, count: Column, limit: Column | int | None) -> Column:
    """True for the rows an evenly spaced take of `limit` out of `count` keeps.

    Kept positions are floor(i * (count-1) / (limit-1)) for i < limit-1, and
    the last row. Row-local: a row checks the few i that could land on it.
    """
    if limit is None:
        return F.lit(True)
    limit = (F.lit(limit) if isinstance(limit, int) else limit).cast("bigint")
    stride = (count - 1).cast("double") / F.greatest(limit - 1, F.lit(1)).cast("double")
    guess = F.floor(position / stride)
    lands = F.exists(F.sequence(guess - 1, guess + 1), lambda i: (i >= 0) & (i < limit) & (
        F.when(i == limit - 1, count - 1).otherwise(F.floor(i * stride)) == position))
    return (F.when(limit >= count, True).when(limit <= 0, False)
            .when(limit == 1, position == 0).otherwise(lands))


def evenly_spaced_take(df: DataFrame, limit: int | None, *, by: Sequence[str] = (), order: Sequence[str]) -> DataFrame:
    """Evenly spaced rows in order, over the frame or inside each group."""
    if limit is None:
        return df
    seq = arrange(df, by=by, order=order)
    seq = seq.with_columns({"__pos": seq.position(), "__n": seq.total()})
    return seq.rows().where(spread_keep(F.col("__pos"), F.col("__n"), limit)).drop("__pos", "__n")


def with_position(df: DataFrame, *, by: Sequence[str] = (), order: Sequence[str],
                  name: str = "row_index", total: str | None = None) -> DataFrame:
    """Dense zero-based row position, per group or over the whole frame."""
    seq = arrange(df, by=by, order=order)
    columns = {name: seq.position()}
    if total:
        columns[total] = seq.total()
    return seq.with_columns(columns).rows()
