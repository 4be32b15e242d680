"""Exact quantiles by bracketing.

A mergeable sketch, of a part of the rows where they are many, brackets each wanted
row position between two values; one counting pass over all rows tells how many rows lie below and inside each bracket; and only
the rows inside are looked at by value. Where they are still many, brackets are
cut again by sketches of their own. No pass shuffles rows by value: sketches and
counts merge map-side, and what moves is one row per bracket and task, plus the
few rows inside the last brackets.

The sketch only decides where to look. Counts are exact, so a sketch that is off
costs another pass, never a wrong result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: Rows inside the last brackets that are looked at by value; the driver holds no more.
INSIDE_ROWS = 50_000
#: Relative rank error of the sketch is one over this.
ACCURACY = 10_000
#: Rows the first sketch is made of, about; where there are more, it stands on a random part of them.
SKETCH_ROWS = 250_000
#: Bounds that one more level may add to all open brackets together.
LEVEL_BOUNDS = 4_096


def quantiles_of(df: DataFrame, asked: Mapping[str, tuple[Column, Sequence[float]]], *, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several numbers at once: name -> one value per fraction.

    Nulls are left out; NaN sorts after all numbers. A number without values
    gives None. All questions share each pass over `df`, which is read four
    times where the brackets are narrow at once: settle it if it is expensive.
    """
    names = list(asked)
    values = [asked[n][0].cast("double") + F.lit(0.0) for n in names]  # -0.0 and 0.0 are one value
    plain = lambda v: F.when((F.abs(v) < math.inf) & ~F.isnan(v), v)
    each = F.array(*[F.struct(F.lit(i).alias("s"), v.alias("v")) for i, v in enumerate(values)])
    finite = plain(F.col("v"))
    counted = (df.select(F.explode(each).alias("k")).select("k.*").where("v IS NOT NULL").groupBy("s")  # few aggregates, so in generated code
               .agg(F.count_if(F.col("v") == -math.inf).alias("below"), F.count(finite).alias("n"), F.count("v").alias("all"),
                    F.count_if(F.col("v") == math.inf).alias("above"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    seen = {r["s"]: r for r in counted.collect()}  # one row a number, none for those without values

    wanted: dict[int, list[int]] = {}
    for i, row in seen.items():
        total, below = row["all"], row["below"]
        spots = {p - below for q in asked[names[i]][1] for p in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}
        inner = sorted(p for p in spots if 0 <= p < row["n"])
        if inner:
            wanted[i] = inner
    found: dict[tuple[int, int], float] = {}
    if wanted:
        frame = df.select(*[plain(values[i]).alias(f"v{i}") for i in wanted])
        cuts = _sketched(frame, {i: (seen[i]["n"], asked[names[i]][1]) for i in wanted}, accuracy)
        found = _resolved(frame, wanted, {i: _around([*cuts[i], seen[i]["lo"], seen[i]["hi"]]) for i in wanted})

    def at_position(i: int, p: int) -> float:
        p -= seen[i]["below"]
        if p < 0:
            return -math.inf
        if p < seen[i]["n"]:
            return found[i, p]
        return math.inf if p < seen[i]["n"] + seen[i]["above"] else math.nan

    def value(i: int, q: float) -> float | None:
        if i not in seen:
            return None
        at = (seen[i]["all"] - 1) * q
        low = math.floor(at)
        return at_position(i, low) if at == low else at_position(i, low) * (1.0 - (at - low)) + at_position(i, low + 1) * (at - low)

    return {name: [value(i, q) for q in asked[name][1]] for i, name in enumerate(names)}


def _sketched(frame: DataFrame, asked: Mapping[int, tuple[int, Sequence[float]]], accuracy: int) -> dict[int, list[float]]:
    """Values on both sides of each wanted fraction of each series i, where nothing goes amiss; i -> (its values, its fractions).

    They only say where to look: all rows are counted against them afterwards.
    A series of few values keeps all of them in its sketch, beside long ones too.
    """
    cuts, parts = [], {i: min(1.0, SKETCH_ROWS / count) for i, (count, _) in asked.items()}
    for i, (_, fractions) in asked.items():
        part = parts[i]
        eps = 2.0 / accuracy + (2.0 / math.sqrt(SKETCH_ROWS) if part < 1.0 else 0.0)  # four deviations of a share in the part
        probes = sorted({min(max(q + d, 0.0), 1.0) for q in fractions for d in (-eps, eps)})
        value = F.col(f"v{i}") if part == 1.0 else F.when(F.col("__chance") < part, F.col(f"v{i}"))
        cuts.append(F.percentile_approx(value, probes, accuracy).alias(f"p{i}"))
    seen = frame.withColumn("__chance", F.rand(21)).where(F.col("__chance") < max(parts.values())).agg(*cuts).first()
    return {i: seen[f"p{i}"] or [] for i in asked}


def _around(values: Sequence[float]) -> set[float]:
    """Bounds that give each value a bracket of its own."""
    return {x for v in values for x in (v, math.nextafter(v, math.inf)) if x < math.inf}


def _resolved(frame: DataFrame, wanted: dict[int, list[int]], bounds: dict[int, set[float]]) -> dict[tuple[int, int], float]:
    """Finite values at the wanted positions of each series i, whose values are the column v<i>."""
    series = sorted(wanted)
    while True:
        splits = {i: [-math.inf, *sorted(bounds[i]), math.inf] for i in series}
        cut = Bucketizer(splitsArray=[splits[i] for i in series], inputCols=[f"v{i}" for i in series], outputCols=[f"b{i}" for i in series], handleInvalid="keep")
        each = [F.struct(F.lit(i).alias("s"), F.col(f"b{i}").cast("int").alias("b"), F.col(f"v{i}").alias("v")) for i in series]
        binned = cut.transform(frame).select(F.explode(F.array(*each)).alias("k")).select("k.*").where("v IS NOT NULL")
        counts = {(r["s"], r["b"]): r["count"] for r in binned.groupBy("s", "b").count().collect()}  # one row a bracket
        found, inside = {}, {}
        for i, positions in wanted.items():
            bins = sorted(b for s, b in counts if s == i)
            ends = list(accumulate(counts[i, b] for b in bins))
            for p in positions:
                at = bisect_right(ends, p)
                low, high = splits[i][bins[at]], splits[i][bins[at] + 1]
                if high == math.nextafter(low, math.inf):
                    found[i, p] = low
                else:
                    inside.setdefault((i, bins[at]), []).append((p, ends[at] - counts[i, bins[at]]))
        if not inside:
            return found
        open_bins = {i: [b for s, b in inside if s == i] for i in series}
        within = binned.where(reduce(lambda x, y: x | y, [(F.col("s") == i) & F.col("b").isin(found_bins) for i, found_bins in open_bins.items() if found_bins]))
        if sum(counts[k] for k in inside) <= INSIDE_ROWS:
            here: dict[tuple[int, int], list] = {k: [] for k in inside}
            for r in within.groupBy("s", "b", "v").count().collect():
                here[r["s"], r["b"]].append((r["v"], r["count"]))
            for key, spots in inside.items():
                line = sorted(here[key])
                ends = list(accumulate(n for _, n in line))
                for p, before in spots:
                    found[key[0], p] = line[bisect_right(ends, p - before)][0]
            return found
        # Still many rows: each open bracket is cut by a sketch of its own rows.
        grid = max(4, min(256, LEVEL_BOUNDS // len(inside)))
        for r in within.groupBy("s", "b").agg(F.percentile_approx("v", [j / grid for j in range(grid + 1)], 4 * grid).alias("cuts")).collect():
            bounds[r["s"]] |= _around(r["cuts"])


def exact_quantiles(df: DataFrame, value: Column, fractions: Sequence[float], *, by: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles, per group of a small key domain.

    Result: `by`, `fraction`, `quantile`; groups without values have no row. The
    group key (a split, a column name) must have few values. `df` is settled
    first, as one narrow column beside the key.
    """
    narrow = settle(df.select(*([F.col(f"`{by}`")] if by else []), value.cast("double").alias("value")))
    found = grouped_quantiles(narrow, "value", fractions, by=by)
    kind = f"`{by}` {df.schema[by].dataType.simpleString()}, " if by else ""
    made = [(*([key] if by else []), float(q), x) for key, xs in found.items() for q, x in zip(fractions, xs) if x is not None]
    return df.sparkSession.createDataFrame(made, f"{kind}fraction double, quantile double")


def grouped_quantiles(narrow: DataFrame, value: str, fractions: Sequence[float], *, by: str | None = None) -> dict:
    """The same from a settled frame, as a dictionary: key -> one value per fraction."""
    keys = [r[0] for r in narrow.select(by).distinct().collect()] if by else [None]  # few by contract
    asked = {f"k{i}": (F.when(F.col(f"`{by}`").eqNullSafe(F.lit(k)), F.col(value)) if by else F.col(value), fractions) for i, k in enumerate(keys)}
    found = quantiles_of(narrow, asked) if asked else {}
    return {k: found[f"k{i}"] for i, k in enumerate(keys)}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of several columns, all columns in each pass; columns without values are left out."""
    narrow = settle(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    found = quantiles_of(narrow, {c: (F.col(f"c{i}"), [0.5]) for i, c in enumerate(columns)}, accuracy=1_000)
    return {c: xs[0] for c, xs in found.items() if xs[0] is not None}
