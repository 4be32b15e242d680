"""Classifiers over fixed sequence windows, and distributed scoring."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import ClassificationModel, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.models.prepare import class_label
from tidemark.operators.metrics import f1_score
from tidemark.operators.sequences import normalise_windows, sequence_bundle
from tidemark.profiles import Profile


@dataclass
class SequenceClassifier:
    model: ClassificationModel
    classes: list[int]
    per_step: bool

    def predict(self, windows: DataFrame) -> DataFrame:
        """Windows (or their steps) with class labels `truth` and `prediction`."""
        ready = _vectors(windows, self.per_step)
        scored = self.model.transform(ready)
        keys = [c for c in ("split", "source_file", "window_index", "step", "window_start", "window_end") if c in scored.columns]
        return scored.select(*keys, class_label(F.col("__y"), self.classes).alias("truth"), class_label(F.col("prediction"), self.classes).alias("prediction"))


def _vectors(windows: DataFrame, per_step: bool) -> DataFrame:
    if not per_step:
        return windows.withColumns({"features": array_to_vector(F.flatten("steps")), "__y": F.col("y").cast("double")})
    # A step is judged with its neighbours on both sides.
    around = F.transform("steps", lambda s, i: F.flatten(F.array(F.coalesce(F.get("steps", i - 1), s), s, F.coalesce(F.get("steps", i + 1), s))))
    long = windows.withColumn("__pairs", F.arrays_zip(around.alias("x"), F.col("y").alias("t")))
    long = long.select("*", F.posexplode("__pairs").alias("step", "__pair")).drop("__pairs", "steps", "labels", "y")
    return long.withColumns({"features": array_to_vector(F.col("__pair.x")), "__y": F.col("__pair.t").cast("double")}).drop("__pair")


def fit_sequence_classifier(windows: DataFrame, classes: Sequence[int], *, channels: int, size: int, per_step: bool = False, kind: str = "perceptron",
                            seed: int = 21, config: Mapping | None = None) -> SequenceClassifier:
    """Train on the `train` windows: a multilayer perceptron or a forest."""
    train = _vectors(windows.where("split = 'train'"), per_step)
    inputs = channels * (3 if per_step else size)
    config = dict(config or {})
    if kind == "perceptron":
        hidden = config.pop("hidden", [32])
        learner = MultilayerPerceptronClassifier(layers=[inputs, *hidden, max(len(classes), 2)], labelCol="__y", seed=seed, **{"maxIter": 60, **config})
    else:
        learner = RandomForestClassifier(labelCol="__y", seed=seed, **{"numTrees": 50, "maxDepth": 10, **config})
    return SequenceClassifier(learner.fit(train), list(classes), per_step)


def search_sequence_models(splits: DataFrame, profile: Profile, *, features: Sequence[str], label: str, sizes: Sequence[int], reductions: Sequence[str],
                           configs: Sequence[Mapping], task: str = "multiclass", kind: str = "perceptron", seed: int = 21) -> list[dict]:
    """Try window size x label reduction x model settings, best validation F1 first.

    A size is skipped when a split has no full window of it.
    """
    trials = []
    for size, reduction in itertools.product(sizes, reductions):
        windows, classes = sequence_bundle(splits, profile, features=features, label=label, size=size, task=task, reduction=reduction)
        present = {r["split"] for r in windows.select("split").distinct().collect()}
        if present != {"train", "validation", "test"}:
            trials.append({"window_size": size, "reduction": reduction, "status": "skipped", "validation_f1": None})
            continue
        ready = normalise_windows(windows, len(features))
        for config in configs:
            model = fit_sequence_classifier(ready, classes, channels=len(features), size=size, kind=kind, seed=seed, config=config)
            scored = model.predict(ready.where("split = 'validation'"))
            f1 = f1_score(scored, "truth", "prediction", average="binary" if task == "binary" else "macro").first()["f1"]
            trials.append({"window_size": size, "reduction": reduction, "status": "fitted", "validation_f1": f1, **{f"config_{k}": str(v) for k, v in config.items()}})
    return sorted(trials, key=lambda t: -(t["validation_f1"] if t["validation_f1"] is not None else -1.0))


def score_windows(windows: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], *, size: int, channels: int, outputs: int,
                  column: str = "logits", batch_size: int = 512) -> DataFrame:
    """Score windows with a user's model, loaded once per Python worker.

    `make_scorer()` returns a function from a `(batch, size, channels)` array
    to a `(batch, outputs)` array.
    """
    scorer = predict_batch_udf(make_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[size, channels]])
    return windows.withColumn(column, scorer(F.flatten("steps")))


def decode_class(logits: Column, classes: Sequence[int]) -> Column:
    """Class label of the largest output."""
    return class_label(F.array_position(logits, F.array_max(logits)) - 1, classes)


def decode_binary(logits: Column) -> Column:
    """1 where the sigmoid of the first output reaches 0.5."""
    return (1.0 / (1.0 + F.exp(-F.get(logits, F.lit(0)))) >= 0.5).cast("int")
