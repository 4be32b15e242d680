"""Next-value forecasting and anomaly scores from forecast errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.prepare import fit_scale
from tidemark.operators.cleaning import reviewed_target_frame, union_all
from tidemark.operators.metrics import ranking_metrics, threshold_sweep
from tidemark.operators.selection import features_for_splits
from tidemark.operators.sequences import forecast_windows, normalise_windows
from tidemark.operators.splits import split_by_strategy
from tidemark.profiles import Profile, fractional_row_limit
from tidemark.session import settle


@dataclass(frozen=True)
class Experiment:
    """One forecast run: what history it sees; window budgets are opt-in, None takes every window."""

    name: str
    include_target_history: bool = True
    lookback: int = 96
    max_gap_seconds: float = 5.0
    train_windows: int | None = None
    eval_windows: int | None = None
    train_sampling: str = "spread"
    eval_sampling: str = "issue_enriched"
    loss: str = "squaredError"
    regularisation: float = 1e-4
    learner: str = "linear"


def presets(kind: str) -> list[Experiment]:
    """Named experiment lists: history on or off, training budgets, loss, lookback; every window is scored."""
    # Experiment names, training budgets and lookbacks.
    own, other = Experiment("target_history_20k", train_windows=20_000), Experiment("exogenous_only_20k", include_target_history=False, train_windows=20_000)

    def more(base: Experiment, name: str, train: int = 100_000, **changes) -> Experiment:
        return Experiment(**{**asdict(base), "name": name, "train_windows": train, **changes})

    shared = [own, other, more(own, "target_history_100k"), more(other, "exogenous_only_100k"), more(other, "exogenous_huber_100k", loss="huber")]
    if kind == "quick":
        return shared
    if kind == "extended":
        return [*shared, more(own, "target_history_200k", 200_000), more(other, "exogenous_boosted_100k", learner="boosted"),
                more(other, "exogenous_lookback192_100k", lookback=192)]
    raise ValueError(f"unknown preset: {kind}")


def score_table(df: DataFrame, *, predicted: Column, actual: Column, spread: Column | float) -> DataFrame:
    """Add predicted and actual value, their difference and its scaled size."""
    scale = F.lit(float(spread)) if isinstance(spread, (int, float)) else spread
    df = df.withColumns({"predicted_value": predicted, "actual_value": actual})
    error = F.col("actual_value") - F.col("predicted_value")
    return df.withColumns({"forecast_error": error, "forecast_abs_error_scaled": F.abs(error) / scale})


def normal_sums(train: DataFrame) -> DataFrame:
    """Sums of products (i, j, total) over windows of (1, flattened history, y), with i <= j: all a ridge fit needs to know of them.

    A task adds the products of a batch to one square of sums and sends that once.
    Sums of disjoint windows add up by `merge_sums`, so a fit can take in new
    windows without reading the others again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                design = np.column_stack([np.ones(batch.num_rows), x, batch.column(1).to_numpy(zero_copy_only=False)])
                square = design.T @ design if square is None else square + design.T @ design
        if square is not None:
            i, j = np.triu_indices(len(square))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(square[i, j])], ["i", "j", "total"])

    return merge_sums(train.select(F.flatten("history").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, "i int, j int, total double"))


def merge_sums(sums: DataFrame) -> DataFrame:
    """One table of sums out of any number of them, put below each other."""
    return sums.groupBy("i", "j").agg(F.sum("total").alias("total"))


@dataclass(frozen=True)
class RidgeForecast:
    """Weights of the flattened history; applied as a column expression."""

    intercept: float
    weights: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.weights:
            return df.withColumn("prediction", F.lit(self.intercept))
        weights = F.array(*[F.lit(w) for w in self.weights])
        products = F.zip_with(F.flatten("history"), weights, lambda x, w: x * w)
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda a, b: a + b))


def solve_ridge(sums: DataFrame, regularisation: float) -> RidgeForecast:
    """Weights that minimise the mean squared error plus the penalty on all but the intercept.

    The driver holds the sums only, whose number depends on the history's width and not
    on the rows. Directions without any spread get no weight; without windows the
    prediction is 0.
    """
    found = sums.collect()
    if not found:
        return RidgeForecast(0.0, ())
    size = max(r["j"] for r in found) + 1
    square = np.zeros((size, size))
    for r in found:
        square[r["i"], r["j"]] = square[r["j"], r["i"]] = r["total"]
    mean = square[0] / square[0, 0]
    spread = square / square[0, 0] - np.outer(mean, mean)
    left = spread[1:-1, 1:-1] + regularisation * np.eye(size - 2)
    weights = np.linalg.lstsq(left, spread[1:-1, -1], rcond=None)[0]
    return RidgeForecast(float(mean[-1] - weights @ mean[1:-1]), tuple(map(float, weights)))


def fit_forecast(train: DataFrame, experiment: Experiment):
    """Regression of the scaled next value on the flattened scaled history."""
    if experiment.learner == "ridge":
        return solve_ridge(normal_sums(train), experiment.regularisation)
    ready = train.withColumn("features", array_to_vector(F.flatten("history")))
    if experiment.learner == "boosted":
        return GBTRegressor(featuresCol="features", labelCol="y", maxIter=30, maxDepth=5, seed=21).fit(ready)
    options = {"loss": "huber", "maxIter": 100} if experiment.loss == "huber" else {"loss": "squaredError", "maxIter": 50}
    return LinearRegression(featuresCol="features", labelCol="y", regParam=experiment.regularisation, **options).fit(ready)


def run_experiment(rows: DataFrame, profile: Profile, experiment: Experiment, *, target: str, seed: int = 21) -> tuple[DataFrame, dict]:
    """Windows, fit on good training windows, scores of validation and test."""
    inputs = [m for m in profile.measurements if experiment.include_target_history or m != target]
    common = dict(features=inputs, target=target, lookback=experiment.lookback, max_gap_seconds=experiment.max_gap_seconds, seed=seed)
    train = forecast_windows(rows.where("split = 'train'"), profile, good_only=True, limit=experiment.train_windows, mode=experiment.train_sampling, **common)
    judged = [forecast_windows(rows.where(F.col("split") == s), profile, limit=experiment.eval_windows, mode=experiment.eval_sampling, **common).withColumn("split", F.lit(s))
              for s in ("validation", "test")]
    windows = settle(union_all([train.withColumn("split", F.lit("train")), *judged]))
    mean, spread = fit_scale(windows.where("split = 'train'"), ["target_value"])["target_value"]
    spread += 1e-6
    scaled = normalise_windows(windows.withColumnRenamed("history", "steps"), len(inputs)).withColumnRenamed("steps", "history")
    scaled = scaled.withColumn("y", (F.col("target_value") - F.lit(mean)) / F.lit(spread))
    model = fit_forecast(scaled.where("split = 'train'"), experiment)
    scored = model.transform(scaled.where("split <> 'train'").withColumn("features", array_to_vector(F.flatten("history"))))
    table = score_table(scored, predicted=F.col("prediction") * F.lit(spread) + F.lit(mean), actual=F.col("target_value"), spread=spread)
    kept = ["split", profile.time, profile.source, *profile.tie_break, "target_value", "qc_label", "is_good", "is_issue", "predicted_value", "actual_value", "forecast_error",
            "forecast_abs_error_scaled"]
    counts = {r["split"]: r["n"] for r in windows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = {**{k: v for k, v in asdict(experiment).items() if v is not None}, "feature_count": len(inputs), **{f"{s}_windows_actual": counts.get(s, 0) for s in ("train", "validation", "test")}}
    return table.select(*kept).withColumn("experiment", F.lit(experiment.name)), summary


def forecast_anomalies(df: DataFrame, profile: Profile, experiments: Sequence[Experiment], *, target: str, data_fraction: float = 1.0,
                       seed: int = 21, **split_options) -> dict[str, DataFrame]:
    """The whole job: labels, split, features, windows, scores, thresholds, ranking.

    Labels are read and split on narrow columns first; wide feature rows join
    in afterwards by key.
    """
    narrow = df.select(*[f"`{c}`" for c in dict.fromkeys([profile.time, profile.source, *profile.tie_break, profile.target])])
    reviewed = reviewed_target_frame(narrow, profile)
    limit = fractional_row_limit(reviewed.count(), data_fraction)
    options = {"block_rows": 1024, "context_rows": 512, "merge_gap_rows": 128, "purge_gap_rows": 256, **split_options}
    modelled = settle(reviewed_target_frame(narrow, profile, limit)) if limit else reviewed
    cut = settle(split_by_strategy(modelled, profile, "episode_aware", **options))
    rows = settle(features_for_splits(df, cut, profile))
    tables, summaries = [], []
    for experiment in experiments:
        scores, summary = run_experiment(rows, profile, experiment, target=target, seed=seed)
        tables.append(settle(scores))
        summaries.append(summary)
    each = lambda f: union_all([f(t).withColumn("experiment", F.lit(e.name)) for t, e in zip(tables, experiments, strict=True)])
    score = "forecast_abs_error_scaled"
    return {"scores": union_all(tables), "thresholds": each(lambda t: threshold_sweep(t, score=score, issue_labels=profile.issue)),
            "ranking": each(lambda t: ranking_metrics(t, score=score)), "summary": df.sparkSession.createDataFrame(summaries)}
