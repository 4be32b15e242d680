"""Fixed row windows and per-row features along time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import infinite_to_null, is_issue, label_id, strategy_target
from tidemark.operators.ordering import Ordered, arrange, with_position
from tidemark.profiles import Profile


def window_features(df: DataFrame, profile: Profile, window_rows: int) -> DataFrame:
    """One summary row per `window_rows` consecutive rows of a source.

    The last, shorter window of a source is kept. Rows are counted out inside
    chunks and then pre-aggregated, so a long source is never one group.
    """
    label = F.col(f"`{profile.target}`")
    measures = profile.measurements
    narrow = df.select(*[f"`{c}`" for c in dict.fromkeys([profile.source, *profile.source_order, profile.target, *measures])])
    placed = with_position(narrow, by=[profile.source], order=profile.source_order, name="__row")
    issue = is_issue(label, profile.issue)
    statistics = [
        F.min(profile.time).alias("window_start"),
        F.max(profile.time).alias("window_end"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(issue).alias("issue_count"),
        F.avg(issue.cast("double")).alias("issue_rate"),
        F.coalesce(F.mode(label_id(label), True), F.lit(-1)).alias("target_mode"),
    ]
    for m in measures:
        column = F.col(f"`{m}`")
        statistics += [F.avg(column).alias(f"{m}_mean"), F.stddev_samp(column).alias(f"{m}_std"),
                       F.min(column).alias(f"{m}_min"), F.max(column).alias(f"{m}_max")]
    window_id = F.floor(F.col("__row") / window_rows).alias("window_id")
    return placed.groupBy(profile.source, window_id).agg(*statistics)


# --- feature columns; callers choose, one layout serves all ------------------

def clock_columns(time: Column) -> dict[str, Column]:
    return {"hour_utc": F.hour(time), "minute_utc": F.minute(time), "day_of_year": F.dayofyear(time)}


def cyclic_columns(time: Column) -> dict[str, Column]:
    hour = F.hour(time) * F.lit(2 * math.pi / 24)
    day = F.dayofyear(time) * F.lit(2 * math.pi / 366)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "doy_sin": F.sin(day), "doy_cos": F.cos(day)}


def delta_columns(seq: Ordered, measures: Sequence[str]) -> dict[str, Column]:
    """Absolute change from the row before; 0 where there is none."""
    return {f"{m} abs_delta": F.coalesce(F.abs(F.col(f"`{m}`") - F.lag(f"`{m}`", 1).over(seq.window())), F.lit(0.0))
            for m in measures}


def lag_columns(seq: Ordered, measures: Sequence[str], steps: Sequence[int]) -> dict[str, Column]:
    return {f"{m} lag_{k}": infinite_to_null(F.lag(f"`{m}`", k).over(seq.window())) for m in measures for k in steps}


def rolling_columns(seq: Ordered, measures: Sequence[str], widths: Sequence[int]) -> dict[str, Column]:
    """Mean and sample deviation over the last `width` rows, nulls skipped."""
    columns = {}
    for m in measures:
        for width in widths:
            frame = seq.window(-(width - 1), 0)
            columns[f"{m} roll_mean_{width}"] = infinite_to_null(F.avg(f"`{m}`").over(frame))
            columns[f"{m} roll_std_{width}"] = infinite_to_null(F.stddev_samp(f"`{m}`").over(frame))
    return columns


def _lay_out(df: DataFrame, profile: Profile, scope: str, back: int) -> Ordered:
    """`source` keeps neighbours inside a source; `global` lets them cross sources."""
    if scope == "source":
        return arrange(df, by=[profile.source], order=profile.source_order, back=back)
    return arrange(df, order=profile.global_order, back=back)


def baseline_features(df: DataFrame, profile: Profile, *, scope: str = "source") -> DataFrame:
    """Clock fields and absolute deltas."""
    seq = _lay_out(df, profile, scope, back=1)
    return seq.with_columns({**clock_columns(F.col(f"`{profile.time}`")),
                             **delta_columns(seq, profile.measurements)}).rows()


def context_features(df: DataFrame, profile: Profile, *, lags: Sequence[int] = (1, 3, 5),
                     widths: Sequence[int] = (5, 15), scope: str = "source") -> DataFrame:
    """Lags and rolling statistics that describe recent history."""
    seq = _lay_out(df, profile, scope, back=max([*lags, *(w - 1 for w in widths)], default=0))
    return seq.with_columns({**lag_columns(seq, profile.measurements, lags),
                             **rolling_columns(seq, profile.measurements, widths)}).rows()


def model_features(df: DataFrame, profile: Profile, *, lags: Sequence[int] = (1, 3, 5),
                   widths: Sequence[int] = (5, 15), scope: str = "source", place: tuple[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Baseline and context features from one layout, and the feature names.

    `place` names two more columns, no features: each row's position in its
    group of the layout and the group's rows, for a split in the same order.
    """
    seq = _lay_out(df, profile, scope, back=max([1, *lags, *(w - 1 for w in widths)]))
    added = {**clock_columns(F.col(f"`{profile.time}`")), **delta_columns(seq, profile.measurements),
             **lag_columns(seq, profile.measurements, lags), **rolling_columns(seq, profile.measurements, widths)}
    placed = dict(zip(place, (seq.position(), seq.total()), strict=True)) if place else {}
    return seq.with_columns({**added, **placed}).rows(), [*profile.measurements, *added]


def feature_sets(profile: Profile, width: int = 5) -> dict[str, list[str]]:
    """Named feature lists for sequence models."""
    raw = list(profile.measurements)
    deltas = raw + [f"{m} abs_delta" for m in raw]
    rolling = [f"{m} roll_{s}_{width}" for m in raw for s in ("mean", "std")]
    return {"measurements": raw, "measurements_plus_deltas": deltas,
            "measurements_plus_deltas_plus_rolling_time": deltas + rolling + ["hour_sin", "hour_cos", "doy_sin", "doy_cos"]}


def sequence_features(df: DataFrame, profile: Profile, *, strategy: str = "multiclass_1_3_4_9", width: int = 5,
                      scope: str = "source", by: Sequence[str] = ()) -> DataFrame:
    """Per-step features for sequence models with a strategy target.

    `by` adds keys (such as `split`) that neighbours must share.
    """
    groups = [*by, *([profile.source] if scope == "source" else [])]
    order = profile.source_order if scope == "source" else profile.global_order
    seq = arrange(df, by=groups, order=order, back=max(width - 1, 1))
    seq = seq.with_columns({**delta_columns(seq, profile.measurements),
                            **rolling_columns(seq, profile.measurements, [width]),
                            **cyclic_columns(F.col(f"`{profile.time}`"))})
    target = strategy_target(F.col(f"`{profile.target}`"), strategy, profile.issue)
    return seq.rows().withColumn("model_target", target).where(F.col("model_target").isNotNull())
