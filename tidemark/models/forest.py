"""Random forests on tabular features: fit, grow, search, save."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.prepare import class_index, class_label, imputing_assembler
from tidemark.operators.metrics import class_weights, f1_score
from tidemark.session import scratch_path

DEFAULTS = {"numTrees": 100, "maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"}


@dataclass
class Forest:
    """A fitted pipeline with its features and class labels."""

    pipeline: PipelineModel
    features: list[str]
    classes: list[int]

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        scored = self.pipeline.transform(df)
        kept = [c for c in scored.columns if not c.startswith("__in_") and c not in ("features", "rawPrediction", "probability", "prediction")]
        return scored.select(*[F.col(f"`{c}`") for c in kept], class_label(F.col("prediction"), self.classes).alias(column))

    def importances(self, count: int = 12) -> list[tuple[str, float]]:
        ranked = sorted(zip(self.features, self.pipeline.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))
        return ranked[:count]

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = json.dumps({"features": self.features, "classes": self.classes})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return Forest(PipelineModel.load(f"{path}/pipeline"), meta["features"], meta["classes"])


@dataclass
class Prepared:
    """What every forest on the same rows shares: rows with class index and weight, imputing stages, class labels."""

    rows: DataFrame
    stages: list
    features: list[str]
    classes: list[int]


def prepare_rows(train: DataFrame, features: Sequence[str], *, label: str = "model_target") -> Prepared:
    """Balanced class weights and median-imputed inputs; they depend on the rows alone."""
    features = list(features)
    weights = {r[label]: r["weight"] for r in class_weights(train, label).collect()}
    classes = sorted(weights)
    weight = F.lit(1.0)
    for value, amount in weights.items():
        weight = F.when(F.col(label) == value, F.lit(float(amount))).otherwise(weight)
    ready = train.where(F.col(label).isNotNull()).withColumns({"__y": class_index(F.col(label), classes), "__w": weight})
    return Prepared(ready, imputing_assembler(ready, features), features, classes)


def fit_forest(train: DataFrame | Prepared, features: Sequence[str], *, label: str = "model_target", seed: int = 21, config: Mapping | None = None) -> Forest:
    """Random forest with balanced class weights and median-imputed inputs; several on the same rows share what `prepare_rows` finds."""
    ready = train if isinstance(train, Prepared) else prepare_rows(train, features, label=label)
    forest = RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", seed=seed, **{**DEFAULTS, **(config or {})})
    return Forest(Pipeline(stages=[*ready.stages, forest]).fit(ready.rows), ready.features, ready.classes)


def node_table(spark: SparkSession, model: Forest) -> DataFrame:
    """The fitted trees as rows, one a node, read from the written model.

    (tree, node, feature, threshold, left, right, shares, weight, gain): rows at or
    below the threshold go left; leaves have no feature. `shares` are the classes'
    parts of the training weight at the node, in the order of `model.classes`.
    """
    path = scratch_path(spark, "nodes")
    model.pipeline.stages[-1].write().save(path)
    node, names = F.col("nodeData"), F.array(*[F.lit(c) for c in model.features])
    inner, weight = node["leftChild"] >= 0, F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, F.get(names, node["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"), F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"), F.transform(node["impurityStats"], lambda v: v / weight).alias("shares"), weight.alias("weight"),
        F.when(inner, node["gain"]).alias("gain"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): gain times weight a feature brings, as parts of each tree, averaged over the trees that split."""
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    parts = gains.join(gains.groupBy("tree").agg(F.sum("g").alias("all")).where(F.col("all") > 0), "tree").withColumn("part", F.col("g") / F.col("all"))
    trees = parts.agg(F.countDistinct("tree").alias("trees"))
    return parts.groupBy("feature").agg(F.sum("part").alias("part")).join(F.broadcast(trees)).select("feature", (F.col("part") / F.col("trees")).alias("importance"))


def score_nodes(df: DataFrame, nodes: DataFrame, classes: Sequence[int], inputs: Mapping[str, Column], column: str = "prediction") -> DataFrame:
    """Score rows by a node table alone: each tree's leaf gives its shares, the largest sum wins, the first of equals.

    `inputs` names the expression of each feature (imputed as in the fit). Nodes are
    bounded by trees and depth, not by the data; they become one literal, and
    rows walk it in the JVM without a join.
    """
    found = nodes.orderBy("tree", "node").collect()
    place = {c: i for i, c in enumerate(inputs)}
    trees: dict[int, dict[int, list]] = {}
    for r in found:
        trees.setdefault(r["tree"], {})[r["node"]] = [place[r["feature"]] if r["feature"] is not None else -1, r["threshold"] or 0.0, r["left"] or 0, r["right"] or 0, r["shares"]]
    deepest = max((_depth(t) for t in trees.values()), default=0)
    listed = [dict(zip("ftlrs", map(list, zip(*[t[i] for i in sorted(t)])))) for t in trees.values()]
    literal = F.from_json(F.lit(json.dumps(listed)), "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,s:array<array<double>>>>")
    steps = F.array(*[F.lit(k) for k in range(deepest)]).cast("array<int>")

    def leaf(tree: Column, x: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            return F.when(F.get(tree["f"], at) < 0, at).when(F.get(x, F.get(tree["f"], at)) <= F.get(tree["t"], at), F.get(tree["l"], at)).otherwise(F.get(tree["r"], at))

        return F.get(tree["s"], F.aggregate(steps, F.lit(0), step))

    row = df.withColumn("__x", F.array(*[c.cast("double") for c in inputs.values()]))
    none = F.array(*[F.lit(0.0) for _ in classes])
    row = row.withColumn("__votes", F.aggregate(literal, none, lambda votes, tree: F.zip_with(votes, leaf(tree, F.col("__x")), lambda a, b: a + b)))
    return row.withColumn(column, class_label(F.array_position("__votes", F.array_max("__votes")) - 1, classes)).drop("__x", "__votes")


def _depth(tree: Mapping[int, list]) -> int:
    level, depth = [0], 0
    while True:
        level = [child for i in level if tree[i][0] >= 0 for child in tree[i][2:4]]
        if not level:
            return depth
        depth += 1


def evaluate(model: Forest, df: DataFrame, *, label: str = "model_target", task: str = "multiclass") -> float:
    scored = model.predict(df).select(label, "prediction")
    return f1_score(scored, label, "prediction", average="binary" if task == "binary" else "macro").first()["f1"] or 0.0


def growth_curve(model: Forest, valid: DataFrame, *, step: int = 25, label: str = "model_target") -> DataFrame:
    """Validation F1 of the forest's first 25, 50, ... trees, from one scan.

    The trees of a fitted forest are independent, so the score of a smaller
    forest is the vote of a prefix of its trees.
    """
    forest = model.pipeline.stages[-1]
    table = valid.withColumn("__id", F.lit(0))
    for stage in model.pipeline.stages[:-1]:
        table = stage.transform(table)
    table = table.select(label, "features")
    votes, marks = None, []
    for i, tree in enumerate(forest.trees, start=1):
        one = tree.copy().setFeaturesCol("features").setPredictionCol("__p").setProbabilityCol(f"__prob{i}").setRawPredictionCol("__r")
        table = one.transform(table).drop("__p", "__r")
        part = vector_to_array(F.col(f"__prob{i}"))
        votes = part if votes is None else F.zip_with(votes, part, lambda a, b: a + b)
        if i % step == 0 or i == len(forest.trees):
            table = table.withColumn(f"__sum{i}", votes)
            votes = F.col(f"__sum{i}")
            marks.append(i)
    picks = [F.struct(F.lit(i).alias("trees"), class_label(F.array_position(F.col(f"__sum{i}"), F.array_max(f"__sum{i}")) - 1, model.classes).alias("prediction")) for i in marks]
    long = table.select(label, F.explode(F.array(*picks)).alias("s")).select(label, "s.*")
    return f1_score(long, label, "prediction", by=["trees"]).withColumnRenamed("f1", "validation_f1")


def search(train: DataFrame, valid: DataFrame, features: Sequence[str], space: Mapping[str, Sequence], *, label: str = "model_target",
           task: str = "multiclass", seed: int = 21, refit_on: DataFrame | None = None, refit_top: int = 2) -> tuple[list[dict], Forest]:
    """Grid search on the fixed validation split; first best wins.

    With `refit_on` the best configurations are fitted again on more rows and
    the better of them is returned.
    """
    trials, best = [], (-1.0, None)
    ready = prepare_rows(train, features, label=label)  # once for all trials
    for number, values in enumerate(itertools.product(*space.values()), start=1):
        config = dict(zip(space, values, strict=True))
        model = fit_forest(ready, features, label=label, seed=seed, config=config)
        f1 = evaluate(model, valid, label=label, task=task)
        trials.append({"trial": number, **config, "validation_f1": f1})
        if f1 > best[0]:
            best = (f1, model)
    trials.sort(key=lambda t: -t["validation_f1"])
    if refit_on is not None:
        best = (-1.0, best[1])
        ready = prepare_rows(refit_on, features, label=label)
        for trial in trials[:refit_top]:
            model = fit_forest(ready, features, label=label, seed=seed, config={k: trial[k] for k in space})
            trial["refit_f1"] = evaluate(model, valid, label=label, task=task)
            if trial["refit_f1"] > best[0]:
                best = (trial["refit_f1"], model)
    return trials, best[1]
