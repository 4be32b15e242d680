"""A model's predictions over one time range, as report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.cleaning import reviewed_target_frame
from tidemark.operators.intervals import label_runs, merge_labelled_intervals
from tidemark.operators.selection import interval_origin, select_range
from tidemark.profiles import Profile
from tidemark.session import settle


def interval_report(df: DataFrame, profile: Profile, predict: Callable[[DataFrame], DataFrame], *, splits: DataFrame | None = None, **choice) -> dict[str, DataFrame]:
    """Range, predictions, metrics, label counts and true / predicted intervals.

    `predict` adds a `prediction` column to reviewed rows with `model_target`.
    Features that look back are built before the range is cut if the caller
    passes them in `df`.
    """
    rows, _ = select_range(df, profile, **choice)
    scored = settle(predict(reviewed_target_frame(rows, profile)))
    runs = lambda column: label_runs(scored, time=profile.time, label=F.col(column), order=profile.global_order)
    report = {
        "predictions": scored,
        "metrics": metrics.classification_report(scored, "model_target", "prediction"),
        "f1": metrics.f1_score(scored, "model_target", "prediction"),
        "label_counts": metrics.predicted_label_counts(scored, "model_target", "prediction"),
        "true_intervals": merge_labelled_intervals(runs("model_target")),
        "predicted_intervals": merge_labelled_intervals(runs("prediction")),
    }
    if splits is not None:
        shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
        low, high = scored.agg(F.date_format(F.min(profile.time), shape), F.date_format(F.max(profile.time), shape)).first()
        report["origin"] = interval_origin(splits, profile.time, low, high)
    return report
