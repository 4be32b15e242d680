"""Nearest-time joins between instruments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import arrange
from tidemark.profiles import MERGE_ORDER
from tidemark.session import settle


@dataclass(frozen=True)
class Side:
    """A right side of an as-of join: its rows, their tie-break and the columns to take (name there -> name in the result)."""

    rows: DataFrame
    tie: str
    columns: Mapping[str, str]
    gap: str | None = None


def nearest_joins(left: DataFrame, sides: Sequence[Side], *, time: str, by: Sequence[str] = (), left_tie: str, tolerance_seconds: float) -> DataFrame:
    """Each left row with the nearest row in time of every right side, or nulls.

    The tolerance is inclusive; equal distances take the earlier right row;
    among right rows of one time at or before the left row the last counts,
    after it the first. All sides are laid out along time together, once, and
    each left row looks at the row of each side just before and just after it.
    The cost depends neither on how many right rows lie within the tolerance nor
    does any input move twice when there are more sides. `gap` of a side names an
    extra column with the distance in microseconds.
    """
    by = list(by)
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    keys = [F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)]
    mine = F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)])
    every = left.select(*keys, micros.alias("__t"), F.lit(1).alias("__side"), F.col(f"`{left_tie}`").alias("__tie"), F.lit(-1).alias("__from"), mine.alias("__left"))
    for k, side in enumerate(sides):
        payload = F.struct(micros.alias("t"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(side.columns)])
        every = every.unionByName(
            side.rows.where(F.col(f"`{time}`").isNotNull()).select(*keys, micros.alias("__t"), F.lit(0).alias("__side"), F.col(f"`{side.tie}`").alias("__tie"),
                                                                   F.lit(k).alias("__from"), payload.alias(f"__right{k}")), allowMissingColumns=True)
    seq = arrange(every, by=[f"__by{i}" for i in range(len(by))], order=["__t", "__side", "__tie", "__from"])
    seq = seq.accumulate(**{f"__{name}{k}": (kind, F.col(f"__right{k}")) for k in range(len(sides)) for name, kind in (("before", "last"), ("after", "next"))})
    found, picked = seq.rows().where(F.col("__side") == 1), [F.col(f"__left.l{i}").alias(c) for i, c in enumerate(left.columns)]
    for k, side in enumerate(sides):
        earlier, later = F.col(f"__before{k}"), F.col(f"__after{k}")
        back, ahead = F.col("__t") - earlier["t"], later["t"] - F.col("__t")
        nearest = F.when(ahead.isNull() | (back <= ahead), earlier).otherwise(later)
        found = found.withColumn(f"__near{k}", F.when(F.abs(nearest["t"] - F.col("__t")) <= int(tolerance_seconds * 1_000_000), nearest))
        picked += [F.col(f"__near{k}.v{i}").alias(name) for i, name in enumerate(side.columns.values())]
        if side.gap:
            picked.append(F.abs(F.col(f"__near{k}.t") - F.col("__t")).alias(side.gap))
    return found.select(*picked)


def nearest_join(left: DataFrame, right: DataFrame, *, time: str, by: Sequence[str] = (), left_tie: str,
                 right_tie: str, columns: Sequence[str], tolerance_seconds: float, suffix: str = "",
                 gap: str | None = None) -> DataFrame:
    """`nearest_joins` with one right side, its columns named with a suffix."""
    side = Side(right, right_tie, {c: f"{c}{suffix}" for c in columns}, gap)
    return nearest_joins(left, [side], time=time, by=by, left_tie=left_tie, tolerance_seconds=tolerance_seconds)


def companion_names(primary: Sequence[str], device: str, columns: Sequence[str]) -> dict[str, str]:
    """Names of companion columns after the merge: collisions get the device."""
    return {c: f"{c} [{device}]" if c in primary else c for c in columns}


def merged_columns(primary: Sequence[str], companions: Sequence[tuple[str, Sequence[str]]],
                   fixed: Sequence[str] = ("Time UTC", "source_file")) -> list[str]:
    """Column order of the merged table, known from the headers alone."""
    merged = [fixed[0], *[c for c in primary if c not in fixed], fixed[1]]
    for device, columns in companions:
        for name in companion_names(merged, device, [c for c in columns if c not in fixed]).values():
            if name not in merged:
                merged.append(name)
    return merged


def join_companions(primary: DataFrame, companions: Sequence[tuple[str, DataFrame]], *, time: str, by: Sequence[str],
                    tie: str, tolerance_seconds: float, fixed: Sequence[str] = ()) -> DataFrame:
    """The nearest rows of all companion devices, in their fixed order, by one sweep along time."""
    taken, sides = list(primary.columns), []
    rank = {device: i for i, device in enumerate(MERGE_ORDER)}
    for device, frame in sorted(companions, key=lambda c: rank.get(c[0], len(rank))):
        kept = [c for c in frame.columns if c not in {time, tie, *by, *fixed}]
        names = companion_names(taken, device, kept)
        taken += names.values()
        sides.append(Side(frame, tie, names))
    return nearest_joins(primary, sides, time=time, by=by, left_tie=tie, tolerance_seconds=tolerance_seconds)


def range_nodes(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Files laid into the nodes of a binary tree over the candidates' order of starts.

    `held` are candidates with their rank from 1 (`upto`), `asked` are primaries
    with the number of candidates that start no later (`upto`) and whether one
    of those reaches their end (`covered`). A node is a run of 2^level ranks, so
    a candidate lies in one node a level. Ranks up to a number are the even
    nodes at its set bits, ranks beyond it the odd nodes at its unset bits: a
    covered primary asks the first, any other the second, at most one a level.
    The number of candidates in the series (`size`) bounds its levels and tells
    which nodes are empty.
    Inside a node the order decides who counts: candidates that end no earlier
    come before a covered primary, those that end no later before any other.
    """
    level = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("size") + 1)) - 1)).alias("level")
    node = F.expr("shiftright(upto, level)")
    even = F.col("node") % 2 == 0
    last, first = F.col("until"), F.col("at")
    columns = ["series_key", "level", "node", "side", "name", "at", "until"]
    kept = held.select("series_key", "side", "name", "at", "until", "upto", level).withColumn("node", node).select(
        *columns, F.when(even, -last).otherwise(last).alias("end"),
        # The latest start, then the earliest end; or the longest, then the earliest.
        F.when(even, F.struct(first.alias("x"), (-last).alias("y"), F.col("name").alias("z"))).otherwise(F.struct((last - first).alias("x"), (-first).alias("y"), F.col("name").alias("z"))).alias("value"))
    wanted = asked.select("series_key", "side", "name", "at", "until", "covered", "size", (F.col("upto") + F.col("covered").cast("int")).alias("upto"), level)
    wanted = (wanted.withColumn("node", node).where((F.col("node") % 2 == 1) == F.col("covered"))
              .withColumn("node", F.when(F.col("covered"), F.col("node") - 1).otherwise(F.col("node") + 1))
              .where(F.expr("shiftleft(node, level)") <= F.col("size")))
    return kept.unionByName(wanted.select(*columns, F.when(F.col("covered"), -last).otherwise(last).alias("end")), allowMissingColumns=True)


def overlap_pairs(swept: DataFrame) -> DataFrame:
    """For each primary a few candidates, the best by overlap among them: (name, ps, pe, cs, ce, companion).

    `swept` holds candidates (side 0) and primaries (side 1) with what one sweep
    by start tells: `upto`, the `size` of the series and `reach`, the latest end
    among the candidates that start no later. Four kinds of candidates can be best, each an extreme that
    a running value finds: of those that start no later and end first, the one
    with the latest end (`reach`); of those that cover the primary, the latest
    start; of those inside, the longest; of those that start inside and end
    later, the earliest start. The second and third have two bounds and are
    asked of the nodes of a tree. No file meets all files it overlaps: rows
    grow with files times the logarithm of their number.
    """
    held = swept.where("side = 0 AND until > at")
    asked = swept.where("side = 1 AND until > at").withColumn("covered", F.coalesce(F.col("reach.ce") >= F.col("until"), F.lit(False)))
    pair = lambda cs, ce, who: [F.col("name"), F.col("at").alias("ps"), F.col("until").alias("pe"), cs.alias("cs"), ce.alias("ce"), who.alias("companion")]
    before = asked.where("reach IS NOT NULL").select(*pair(F.col("reach.cs"), F.col("reach.ce"), F.col("reach.companion")))

    ends = held.unionByName(asked, allowMissingColumns=True).withColumn("end", -F.col("until"))
    seq = arrange(ends, by=["series_key"], order=["end", "side", "name", "at"])
    seq = seq.accumulate(over=("max", F.when(F.col("side") == 0, F.struct((-F.col("at")).alias("x"), F.col("end").alias("y"), F.col("name").alias("z")))))
    after = seq.rows().where("side = 1 AND over IS NOT NULL").select(*pair(-F.col("over.x"), -F.col("over.y"), F.col("over.z")))

    seq = arrange(range_nodes(held, asked), by=["series_key", "level", "node"], order=["end", "side", "name", "at"])
    seq = seq.accumulate(best=("max", F.col("value")))
    found = seq.rows().where("side = 1 AND best IS NOT NULL")
    # A covered primary asked even nodes.
    x, y, covers = F.col("best.x"), F.col("best.y"), F.col("node") % 2 == 0
    nested = found.select(*pair(F.when(covers, x).otherwise(-y), F.when(covers, -y).otherwise(x - y), F.col("best.z")))
    return before.unionByName(after).unionByName(nested)


def best_companions(primary: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each primary file the best companion file of the same series.

    Both frames hold `name, series_key, start_time, end_time`, one row per
    file. An exact time range wins, then the longest overlap, the smaller start
    gap, the smaller end gap and the name. Files of a series are not paired
    with each other at large: sweeps along time leave a few candidates for each
    (`overlap_pairs`), and a file without any overlap looks only at the
    candidate starts next to its own.
    """
    micros = lambda c: F.unix_micros(F.col(c))
    # Candidates of one range differ by name only: the first name stands for them.
    pick = settle(candidates.groupBy("series_key", micros("start_time").alias("cs"), micros("end_time").alias("ce"))
                  .agg(F.min("name").alias("companion")))
    files = primary.select("name", "series_key", micros("start_time").alias("ps"), micros("end_time").alias("pe"))
    timed, untimed = files.where("ps IS NOT NULL AND pe IS NOT NULL"), files.where("ps IS NULL OR pe IS NULL")
    ranged, rangeless = pick.where("cs IS NOT NULL AND ce IS NOT NULL"), pick.where("cs IS NULL OR ce IS NULL")
    columns = ["name", "companion", "exact", "overlap_seconds"]
    overlap = F.greatest(F.lit(0), F.least("pe", "ce") - F.greatest("ps", "cs")) / 1e6
    exact = (F.col("ps") == F.col("cs")) & (F.col("pe") == F.col("ce"))

    def best(pairs: DataFrame) -> DataFrame:
        rank = F.struct((~exact).alias("inexact"), (-overlap).alias("lost"), F.abs(F.col("cs") - F.col("ps")).alias("sg"),
                        F.abs(F.col("ce") - F.col("pe")).alias("eg"), F.col("companion"))
        return (pairs.groupBy("name").agg(F.min(rank).alias("r"))
                .select("name", F.col("r.companion").alias("companion"), (~F.col("r.inexact")).alias("exact"), (-F.col("r.lost") + 0.0).alias("overlap_seconds")))

    # Nothing beats an exact range, so a file that has one needs no sweep.
    same = (timed.withColumns({"cs": F.col("ps"), "ce": F.col("pe")}).join(ranged, ["series_key", "cs", "ce"])
            .select("name", "ps", "pe", "cs", "ce", "companion"))
    same = settle(best(same))
    timed = timed.join(same.select("name"), "name", "left_anti")

    # One sweep by start: rank and reach for the overlaps, the starts beside a file for those without.
    both = (ranged.select("series_key", F.lit(0).alias("side"), F.col("companion").alias("name"), F.col("cs").alias("at"), F.col("ce").alias("until"))
            .unionByName(timed.select("series_key", F.lit(1).alias("side"), "name", F.col("ps").alias("at"), F.col("pe").alias("until"))).where("series_key IS NOT NULL"))
    lasting = (F.col("side") == 0) & (F.col("until") > F.col("at"))
    seq = arrange(both, by=["series_key"], order=["at", "side", "name", "until"], tallies={"lasting": lasting})
    seq = seq.with_columns({"upto": seq.running("lasting"), "size": seq.total("lasting")})
    start = F.when(F.col("side") == 0, F.col("at"))
    seq = seq.accumulate(reach=("max", F.when(lasting, F.struct(F.col("until").alias("ce"), F.col("at").alias("cs"), F.col("name").alias("companion")))),
                         earlier=("last", start), later=("next", start))
    swept = settle(seq.rows())
    found = settle(same.unionByName(best(overlap_pairs(swept).where(overlap > 0))))

    # No overlap: all candidates of the series tie, so the nearest start decides.
    gap = lambda c: F.abs(F.col(c) - F.col("at"))
    least = F.least(gap("earlier"), gap("later"))
    nearby = F.array_compact(F.array(*[F.when(gap(c) == least, F.col(c)) for c in ("earlier", "later")]))
    beside = (swept.where("side = 1").join(found.select("name"), "name", "left_anti").select("name", "series_key", F.col("at").alias("ps"), F.col("until").alias("pe"), F.explode(F.array_distinct(nearby)).alias("cs"))
              .join(ranged, ["series_key", "cs"]))
    found = settle(found.unionByName(best(beside)))

    # Names without a time range: equal to each other, else last in line.
    plain = rangeless.groupBy("series_key").agg(F.min("companion").alias("companion"))
    alone = timed.join(found.select("name"), "name", "left_anti").join(plain, "series_key").select("name", "companion", F.lit(False).alias("exact"), F.lit(0.0).alias("overlap_seconds"))
    equal = untimed.join(plain, "series_key").select("name", "companion", F.lit(True).alias("exact"), F.lit(0.0).alias("overlap_seconds"))
    first = ranged.groupBy("series_key").agg(F.min_by("companion", F.struct(F.abs("cs"), F.abs("ce"), "companion")).alias("companion"))
    rest = (untimed.join(plain.select("series_key"), "series_key", "left_anti").join(first, "series_key")
            .select("name", "companion", F.lit(False).alias("exact"), F.lit(0.0).alias("overlap_seconds")))
    return found.select(*columns).unionByName(alone).unionByName(equal).unionByName(rest)
