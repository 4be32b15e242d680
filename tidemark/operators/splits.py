"""Leakage-aware train / validation / test splits.

Each strategy returns the input rows with a `split` column. Rows removed by a
purge gap are absent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import is_issue
from tidemark.operators.cleaning import attach_small, union_all
from tidemark.operators.intervals import issue_episodes
from tidemark.operators.ordering import arrange, with_position
from tidemark.profiles import Profile
from tidemark.session import settle

SPLITS = ("train", "validation", "test")
STRATEGIES = ("global_contiguous", "per_source_contiguous", "interleaved_blocks", "episode_aware")


def contiguous_cut(position: Column, total: Column, train: float, validation: float) -> Column:
    return (F.when(position < F.floor(total * F.lit(train)), "train")
            .when(position < F.floor(total * F.lit(train + validation)), "validation").otherwise("test"))


def contiguous(df: DataFrame, profile: Profile, train: float, validation: float, *, per_source: bool = False,
               placed: tuple[str, str] | None = None) -> DataFrame:
    """Early, middle and late part of the whole timeline or of each source.

    `placed`: columns that hold the position in that order and the total already,
    as `model_features` adds them; rows are not laid out again, and both are dropped.
    """
    if placed is None:
        by = [profile.source] if per_source else []
        order = profile.source_order if per_source else profile.global_order
        placed = ("__pos", "__n")
        df = with_position(df, by=by, order=order, name="__pos", total="__n")
    position, total = placed
    return df.withColumn("split", contiguous_cut(F.col(position), F.col(total), train, validation)).drop(*placed)


def slot_counts(train: float, validation: float, cycle: int) -> dict[str, int]:
    """Slots of each split in a cycle: whole parts of the shares, at least one; the largest remainders get what is left."""
    if cycle < 3:
        raise ValueError("a cycle needs at least three slots")
    ideal = dict(zip(SPLITS, (train * cycle, validation * cycle, (1.0 - train - validation) * cycle), strict=True))
    counts = {s: max(1, math.floor(share)) for s, share in ideal.items()}
    left = cycle - sum(counts.values())
    for s in sorted(SPLITS, key=lambda s: counts[s] - ideal[s])[: max(left, 0)]:
        counts[s] += 1
    if left < 0:
        counts[max(SPLITS, key=counts.get)] += left
    return counts


def slot_schedule(train: float, validation: float, *, cycle: int = 20, kind: str = "spread") -> list[str]:
    """Split names of one cycle of blocks: the k-th of c slots stands at (k - 1/2) / c of the cycle, or splits in runs."""
    counts = slot_counts(train, validation, cycle)
    slots = [((k - 0.5) / counts[s] if kind == "spread" else 0.0, place, s) for place, s in enumerate(SPLITS) for k in range(1, counts[s] + 1)]
    return [s for _, _, s in sorted(slots)]


def slot_split(index: Column, schedule: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in schedule]), (index % len(schedule) + 1).cast("int"))


def source_ranks(df: DataFrame, profile: Profile) -> DataFrame:
    """Sources with row counts, ordered by first appearance in time."""
    sources = df.groupBy(profile.source).agg(F.min(profile.time).alias("first_time"), F.count(F.lit(1)).alias("source_rows"))
    return with_position(settle(sources), order=["first_time", profile.source], name="source_rank")


def interleaved_blocks(df: DataFrame, profile: Profile, train: float, validation: float, *, block_rows: int = 1024,
                       cycle: int = 20, schedule: str = "spread") -> DataFrame:
    """Short blocks of each source dealt to the splits in a repeating schedule."""
    sources = settle(source_ranks(df, profile)).withColumn("__blocks", F.ceil(F.col("source_rows") / block_rows))
    seq = arrange(sources, order=["source_rank"]).accumulate(__upto=("sum", F.col("__blocks")))
    offsets = seq.rows().select(profile.source, (F.col("__upto") - F.col("__blocks")).alias("__offset"))
    placed = with_position(df, by=[profile.source], order=profile.source_order, name="__pos")
    placed = attach_small(placed, offsets, [profile.source])
    block = F.col("__offset") + F.floor(F.col("__pos") / block_rows)
    slots = slot_schedule(train, validation, cycle=cycle, kind=schedule)
    return placed.withColumn("split", slot_split(block, slots)).select(*[f"`{c}`" for c in df.columns], "split")


# --- episode-aware -----------------------------------------------------------

def place_issues(df: DataFrame, profile: Profile, issue: Column) -> DataFrame:
    """Rows with `row_index`, `source_rows` and `__issue`, in source order."""
    placed = with_position(df, by=[profile.source], order=profile.source_order, name="row_index", total="source_rows")
    return placed.withColumn("__issue", issue)


def split_units(placed: DataFrame, profile: Profile, *, context_rows: int, merge_gap_rows: int) -> tuple[DataFrame, DataFrame]:
    """Episodes and the clean row ranges between them, per source."""
    source = profile.source
    issues = placed.where("__issue").select(source, "row_index", "source_rows")
    episodes = settle(issue_episodes(settle(issues), by=[source], position="row_index", total="source_rows",
                                     context_rows=context_rows, merge_gap_rows=merge_gap_rows))
    seq = arrange(episodes, by=[source], order=["start"], back=1, ahead=1)
    around = seq.with_columns({"__lead_in": F.coalesce(F.lag("end").over(seq.window()), F.lit(0)),
                               "__last": F.lead("start").over(seq.window()).isNull()}).rows()
    inside = around.select(source, F.col("__lead_in").alias("start"), F.col("start").alias("end"))
    tails = around.where("__last").select(source, F.col("end").alias("start"), F.col("total").alias("end"))
    totals = placed.groupBy(source).agg(F.max("source_rows").alias("end"))
    quiet = totals.join(episodes.select(source).distinct(), source, "left_anti").select(source, F.lit(0).cast("bigint").alias("start"), "end")
    clean = union_all([inside, tails, quiet]).where(F.col("start") < F.col("end"))
    return episodes.select(source, "start", "end"), clean


def clean_blocks(clean: DataFrame, profile: Profile, block_rows: int, *, keep: Sequence[str] = ()) -> DataFrame:
    """Clean ranges cut into blocks of `block_rows`, the last one shorter.

    Cut twice, so that no row holds more starts than about the root of a range's blocks.
    """
    blocks = F.ceil((F.col("end") - F.col("start")) / block_rows)
    span = (F.ceil(F.sqrt(blocks)) * block_rows).cast("bigint")
    parts = clean.select(profile.source, *keep, "end", span.alias("__span"), F.explode(F.sequence(F.col("start"), F.col("end") - 1, span)).alias("__from"))
    starts = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + F.col("__span"), F.col("end")) - 1, F.lit(block_rows).cast("bigint")))
    return (parts.select(profile.source, *keep, "end", starts.alias("__s"))
            .select(profile.source, *keep, F.col("__s").alias("start"), F.least(F.col("__s") + block_rows, F.col("end")).alias("end")))


def assign_units(episodes: DataFrame, clean: DataFrame, ranks: DataFrame, profile: Profile, train: float, validation: float,
                 *, block_rows: int) -> DataFrame:
    """Units `(source, start, end, kind, split)`.

    Episodes follow the slot schedule. Clean blocks fill what the episodes leave
    of each split's target: taken in the order of their reversed binary number,
    which spreads any stretch of them evenly over time, the blocks whose middle
    lies in the first stretch of rows go to train, then validation, then test. So
    each split is within one block of its target, and all of it is counting.
    """
    source = profile.source
    order_of = ranks.select(source, "source_rank")
    placed = settle(with_position(episodes.join(order_of, source), order=["source_rank", "start"], name="__i"))
    slots = slot_schedule(train, validation, cycle=max(3, min(placed.count(), 20)))
    dealt = placed.select(source, "start", "end", F.lit("episode").alias("kind"), slot_split(F.col("__i"), slots).alias("split"))

    rows_in = {r["split"]: r["n"] for r in dealt.groupBy("split").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    total = float(ranks.agg(F.sum("source_rows")).first()[0] or 0)
    targets = (total * train, total * validation, max(total * (1.0 - train - validation), 0.0))
    lacking = [max(t - float(rows_in.get(s, 0)), 0.0) for s, t in zip(SPLITS, targets, strict=True)]
    size = F.col("end") - F.col("start")
    blocks = settle(with_position(clean_blocks(clean.join(order_of, source), profile, block_rows, keep=["source_rank"]), order=["source_rank", "start"], name="__i"))
    clean_rows = float(blocks.agg(F.sum(size)).first()[0] or 0)
    whole = sum(lacking)
    first, second = (clean_rows * (lacking[0] / whole), clean_rows * ((lacking[0] + lacking[1]) / whole)) if whole else (clean_rows, clean_rows)
    spread = blocks.withColumn("__order", F.reverse(F.lpad(F.bin("__i"), 48, "0")))
    filled = arrange(spread, order=["__order"]).accumulate(__upto=("sum", size)).rows()
    middle = F.col("__upto") - size / 2
    split = F.when(middle < first, SPLITS[0]).when(middle < second, SPLITS[1]).otherwise(SPLITS[2])
    return dealt.unionByName(filled.select(source, "start", "end", F.lit("clean").alias("kind"), split.alias("split")))


def trim_units(units: DataFrame, profile: Profile, purge_gap_rows: int) -> DataFrame:
    """Shorten units where the neighbouring unit of the source has another split."""
    left = max(purge_gap_rows, 0) // 2
    right = max(purge_gap_rows, 0) - left
    seq = arrange(units, by=[profile.source], order=["start"], back=1, ahead=1)
    here = seq.window()
    trimmed = seq.with_columns({
        "__cut_left": F.when(F.lag("split").over(here) != F.col("split"), left).otherwise(0),
        "__cut_right": F.when(F.lead("split").over(here) != F.col("split"), right).otherwise(0),
    }).rows()
    return (trimmed.withColumns({"kept_start": F.col("start") + F.col("__cut_left"), "kept_end": F.col("end") - F.col("__cut_right")})
            .drop("__cut_left", "__cut_right"))


def rows_with_units(placed: DataFrame, units: DataFrame, profile: Profile, bucket_rows: int) -> DataFrame:
    """Rows inside the kept part of a unit, with the unit's split.

    Units of a source are gathered per bucket of row positions (at most
    `bucket_rows` of them) and each row meets its bucket's list by key: one
    match per row, and no bucket is larger than `bucket_rows` rows.
    """
    source = profile.source
    kept = units.where(F.col("kept_start") < F.col("kept_end"))
    first, last = F.floor(F.col("kept_start") / bucket_rows), F.floor((F.col("kept_end") - 1) / bucket_rows)
    lists = (kept.select(source, F.explode(F.sequence(first, last)).alias("__bucket"),
                         F.struct("kept_start", "kept_end", "split").alias("unit"))
             .groupBy(source, "__bucket").agg(F.collect_list("unit").alias("__units")))
    rows = placed.withColumn("__bucket", F.floor(F.col("row_index") / bucket_rows)).join(lists, [source, "__bucket"])
    hit = F.get(F.filter("__units", lambda u: (u["kept_start"] <= F.col("row_index")) & (F.col("row_index") < u["kept_end"])), F.lit(0))
    return rows.withColumn("split", hit["split"]).where(F.col("split").isNotNull()).drop("__bucket", "__units")


def episode_aware(df: DataFrame, profile: Profile, train: float, validation: float, *, block_rows: int = 1024,
                  context_rows: int = 0, merge_gap_rows: int = 0, purge_gap_rows: int = 0,
                  issue: Column | None = None) -> DataFrame:
    """Whole issue episodes, with their context, in one split each."""
    if issue is None:
        issue = (F.coalesce(F.col("issue").cast("int") == 1, F.lit(False)) if "issue" in df.columns
                 else is_issue(F.col(f"`{profile.target}`"), profile.issue))
    placed = place_issues(df, profile, issue)
    episodes, clean = split_units(placed, profile, context_rows=context_rows, merge_gap_rows=merge_gap_rows)
    units = settle(assign_units(episodes, clean, source_ranks(df, profile), profile, train, validation, block_rows=block_rows))
    trimmed = trim_units(units, profile, purge_gap_rows)
    return rows_with_units(placed, trimmed, profile, block_rows).select(*[f"`{c}`" for c in df.columns], "split")


def split_by_strategy(df: DataFrame, profile: Profile, strategy: str, train: float = 0.70, validation: float = 0.15,
                      placed: tuple[str, str] | None = None, **options) -> DataFrame:
    """Split rows by a named strategy; `placed` as in `contiguous`, for the two strategies that it serves."""
    if strategy == "global_contiguous":
        return contiguous(df, profile, train, validation, placed=placed)
    if strategy == "per_source_contiguous":
        return contiguous(df, profile, train, validation, per_source=True, placed=placed)
    if placed:
        raise ValueError(f"{strategy} finds its own positions")
    if strategy == "interleaved_blocks":
        return interleaved_blocks(df, profile, train, validation, **options)
    if strategy == "episode_aware":
        return episode_aware(df, profile, train, validation, **options)
    raise ValueError(f"unknown split strategy: {strategy}")
