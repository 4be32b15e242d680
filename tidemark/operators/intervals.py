"""Runs of equal labels, interval merging, issue episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import arrange
from tidemark.session import settle


def label_runs(df: DataFrame, *, time: str, label: Column, order: Sequence[str], by: Sequence[str] = (),
               fill_value: int | None = None, keep: Column | None = None) -> DataFrame:
    """Consecutive rows of equal label, one row per run.

    `start`/`end` reach to the midpoint with the neighbouring row, while
    `first_time`/`last_time` and `first_row`/`last_row` (zero-based) stay on the
    run's own rows. Null labels become `fill_value`, or are left out first.
    `keep` filters finished runs. A long run is reduced inside its chunks.
    """
    by = list(by)
    work = df.select(*[f"`{c}`" for c in dict.fromkeys([*by, *order, time])], label.alias("__label"))
    work = work.where(F.col(f"`{time}`").isNotNull())
    work = (work.withColumn("__label", F.coalesce("__label", F.lit(fill_value))) if fill_value is not None
            else work.where(F.col("__label").isNotNull()))
    seq = arrange(work, by=by, order=order, back=1, ahead=1)
    here = seq.window()
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    before = F.lag("__label").over(here)
    seq = seq.with_columns({
        "__t": micros,
        "__prev": F.lag(micros).over(here),
        "__next": F.lead(micros).over(here),
        "__starts": F.when(before.isNull() | (before != F.col("__label")), 1).otherwise(0),
        "__row": seq.position(),
    }).accumulate(__run=("sum", F.col("__starts")))
    runs = seq.rows().groupBy(*[f"`{c}`" for c in by], "__run").agg(
        F.min("__label").alias("label"),
        F.count(F.lit(1)).alias("rows"),
        F.min("__row").alias("first_row"), F.max("__row").alias("last_row"),
        F.min("__t").alias("__first"), F.max("__t").alias("__last"),
        F.min_by("__prev", "__row").alias("__prev"), F.max_by("__next", "__row").alias("__next"))
    half = lambda gap: F.floor(gap / 2).cast("bigint")
    runs = runs.select(
        *[f"`{c}`" for c in by], "label", "rows", "first_row", "last_row",
        F.timestamp_micros("__first").alias("first_time"), F.timestamp_micros("__last").alias("last_time"),
        F.timestamp_micros(F.coalesce(F.col("__prev") + half(F.col("__first") - F.col("__prev")), "__first")).alias("start"),
        F.timestamp_micros(F.coalesce(F.col("__last") + half(F.col("__next") - F.col("__last")), "__last")).alias("end"))
    return runs if keep is None else runs.where(keep)


def merge_labelled_intervals(intervals: DataFrame, *, by: Sequence[str] = (), max_gap_seconds: float = 0.0) -> DataFrame:
    """Join neighbouring intervals of equal label that touch or overlap."""
    by = list(by)
    work = intervals.select(*[f"`{c}`" for c in by], "label", F.unix_micros("start").alias("__s"), F.unix_micros("end").alias("__e"))
    seq = arrange(settle(work), by=by, order=["__s", "__e", "label"], back=1)
    here = seq.window()
    seq = seq.with_columns({
        "__last_end": F.lag("__e").over(here),
        "__changes": F.when(F.lag("label").over(here).eqNullSafe(F.col("label")), 0).otherwise(1),
    })
    seq = seq.accumulate(__series=("sum", F.col("__changes")))
    # The reach of earlier intervals in the same label series: the largest
    # (series, end) pair so far belongs to the current series.
    seq = seq.accumulate(__reach=("max", F.struct((F.col("__series") - F.col("__changes")).alias("n"),
                                                  F.col("__last_end").alias("e"))))
    gap = int(max_gap_seconds * 1_000_000)
    opens = (F.col("__changes") == 1) | (F.col("__s") > F.col("__reach.e") + F.lit(gap))
    seq = seq.with_columns({"__opens": F.when(opens, 1).otherwise(0)}).accumulate(__island=("sum", F.col("__opens")))
    return (seq.rows().groupBy(*[f"`{c}`" for c in by], "__island")
            .agg(F.timestamp_micros(F.min("__s")).alias("start"), F.timestamp_micros(F.max("__e")).alias("end"),
                 F.min("label").alias("label"), F.count(F.lit(1)).alias("merged"))
            .drop("__island"))


def merge_row_intervals(intervals: DataFrame, *, by: Sequence[str] = (), gap_rows: int = 0) -> DataFrame:
    """Merge half-open `[start, end)` row intervals that overlap or lie within `gap_rows`."""
    by = list(by)
    seq = arrange(settle(intervals.select(*[f"`{c}`" for c in by], "start", "end")), by=by, order=["start", "end"], back=1)
    seq = seq.with_columns({"__before": F.lag("end").over(seq.window())})
    seq = seq.accumulate(__reach=("max", F.col("__before")))
    opens = F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap_rows)
    seq = seq.with_columns({"__opens": opens.cast("int")}).accumulate(__island=("sum", F.col("__opens")))
    return (seq.rows().groupBy(*[f"`{c}`" for c in by], "__island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island"))


def issue_episodes(issue_rows: DataFrame, *, by: Sequence[str], position: str, total: str,
                   context_rows: int = 0, merge_gap_rows: int = 0) -> DataFrame:
    """Padded issue episodes as half-open row intervals of each group.

    Input: the issue rows only, with their position in the group and the
    group's row count. Runs closer than `merge_gap_rows` merge; then each is
    padded by `context_rows`, clipped, and merged where the padding touches.
    Both merges compare only neighbouring issue rows, so one pass does both: a
    new episode opens where the clean gap exceeds both distances.
    """
    by = list(by)
    reach = max(merge_gap_rows, 2 * context_rows, 0)
    seq = arrange(issue_rows.select(*[f"`{c}`" for c in by], position, total), by=by, order=[position], back=1)
    gap = F.col(position) - F.lag(position).over(seq.window()) - 1
    seq = seq.with_columns({"__opens": F.when(gap <= reach, 0).otherwise(1)})
    seq = seq.accumulate(__episode=("sum", F.col("__opens")))
    return (seq.rows().groupBy(*[f"`{c}`" for c in by], "__episode")
            .agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.max(total).alias("total"),
                 F.count(F.lit(1)).alias("issue_rows"))
            .select(*[f"`{c}`" for c in by],
                    F.greatest(F.col("lo") - context_rows, F.lit(0)).alias("start"),
                    F.least(F.col("hi") + 1 + context_rows, F.col("total")).alias("end"),
                    "total", "issue_rows"))


def intervals_in_range(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals that overlap a closed time range."""
    return intervals.where((F.col("start") <= F.lit(end).cast("timestamp")) & (F.col("end") >= F.lit(start).cast("timestamp")))
