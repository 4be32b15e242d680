"""Typing, filters and target frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import finite, is_issue, is_reviewed, label_id, strategy_target
from tidemark.operators.ordering import evenly_spaced_take
from tidemark.profiles import Profile


def type_readings(df: DataFrame, *, time: str, keep_text: Iterable[str] = ()) -> DataFrame:
    """UTC timestamps and doubles; what cannot be parsed, and NaN, is null.

    Rows without a timestamp are dropped, which also removes metadata and
    header lines that a text scan brings along.
    """
    text = {time, *keep_text}
    typed = []
    for name in df.columns:
        column = F.col(f"`{name}`")
        if name == time:
            column = column.cast("string").try_cast("timestamp")
        elif name not in text:
            number = F.trim(column.cast("string")).try_cast("double")
            column = F.when(~F.isnan(number), number)
        typed.append(column.alias(name))
    return df.select(*typed).where(F.col(f"`{time}`").isNotNull())


def pad_columns(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Give the frame exactly these columns in this order, null where absent."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in present else F.lit(None).cast(kind).alias(c) for c in columns])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a frame become null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def between_times(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive UTC range filter with optional bounds; reaches the Parquet scan."""
    for bound, side in ((start, "ge"), (end, "le")):
        if bound:
            limit = F.lit(bound).cast("timestamp")
            if df.schema[time].dataType.typeName() == "timestamp_ntz":
                limit = limit.cast("timestamp_ntz")
            column = F.col(f"`{time}`")
            df = df.where(column >= limit if side == "ge" else column <= limit)
    return df


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required))


def usable_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(finite(*[F.col(f"`{c}`") for c in columns]))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order.

    An aggregate, not a window: copies of a key are reduced before the shuffle,
    so a key with very many copies is no burden.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    packed = F.min_by(F.struct(*[f"`{c}`" for c in rest]), F.struct(*[f"`{c}`" for c in order]))
    return (df.groupBy(*[f"`{c}`" for c in keys]).agg(packed.alias("__first"))
            .select(*[F.col(f"`{c}`") if c in keys else F.col(f"__first.`{c}`").alias(c) for c in df.columns]))


def reviewed_rows(df: DataFrame, profile: Profile) -> DataFrame:
    return df.where(is_reviewed(F.col(f"`{profile.target}`"), profile.good, profile.issue))


def reviewed_target_frame(df: DataFrame, profile: Profile, row_limit: int | None = None) -> DataFrame:
    """Reviewed rows with `issue` (0/1) and `model_target`, optionally spread to a row limit."""
    label = F.col(f"`{profile.target}`")
    work = reviewed_rows(df, profile).withColumn("issue", is_issue(label, profile.issue).cast("int"))
    work = evenly_spaced_take(work, row_limit, order=profile.global_order)
    if profile.task == "multiclass":
        return work.withColumn("model_target", label_id(label))
    if profile.task == "binary":
        return work.withColumn("model_target", F.col("issue"))
    raise ValueError(f"unknown task: {profile.task}")


def active_labels(df: DataFrame, label: str = "model_target") -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(label_id(F.col(label)).alias(label)).distinct()


def apply_target_strategy(df: DataFrame, profile: Profile, strategy: str) -> DataFrame:
    target = strategy_target(F.col(f"`{profile.target}`"), strategy, profile.issue)
    return df.withColumn("strategy_target", target).where(F.col("strategy_target").isNotNull())


def attach_small(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner",
                 broadcast_rows: int = 100_000) -> DataFrame:
    """Join a lookup table; broadcast only when its counted size allows it.

    A larger table joins by shuffle, where adaptive execution splits hot keys.
    """
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = F.broadcast(table)
    return df.join(table, list(on), how)

