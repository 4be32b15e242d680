"""k-means on window summaries or row features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.prepare import fit_medians, fit_scale, impute, scaled
from tidemark.profiles import Profile
from tidemark.session import settle


def window_feature_names(df: DataFrame) -> list[str]:
    names = [c for c in df.columns if c.endswith(("_mean", "_std"))]
    if not names:
        raise ValueError("no window mean or deviation columns to cluster on")
    return names


def row_level_input(df: DataFrame, profile: Profile) -> DataFrame:
    """Rows in the shape of window summaries: each row is its own window."""
    rate = F.col("issue").cast("double") if "issue" in df.columns else F.col(profile.target).isin(list(profile.issue)).cast("double")
    return df.withColumns({"window_start": F.col(profile.time), "window_end": F.col(profile.time), "issue_rate": rate})


def cluster(df: DataFrame, features: Sequence[str], *, clusters: int, seed: int = 21, starts: int = 1,
            all_distances: bool = False) -> tuple[DataFrame, float]:
    """Rows with `cluster` and `distance_to_centroid`, and the training cost.

    Inputs are median-imputed and scaled by the population deviation. Of
    several random starts the one with the lowest cost is kept. `all_distances`
    adds the distances to every centre as an array.
    """
    features = list(features)
    filled = impute(df, fit_medians(df, features))
    scale = fit_scale(filled, features)
    ready = filled.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*scaled(scale).values()).alias("__x")).withColumn("__v", array_to_vector("__x"))
    best = None
    for attempt in range(starts):
        model = KMeans(k=clusters, seed=seed + attempt, featuresCol="__v", predictionCol="cluster").fit(ready)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    labelled = best.transform(ready)
    distances = []
    for center in best.clusterCenters():
        point = F.array(*[F.lit(float(v)) for v in center])
        distances.append(F.sqrt(F.aggregate(F.zip_with("__x", point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    labelled = labelled.withColumn("distances", F.array(*distances)).withColumn("distance_to_centroid", F.get("distances", F.col("cluster")))
    # Original values come back for reports; the imputed ones served the fit.
    return labelled.drop("__x", "__v", *([] if all_distances else ["distances"])), best.summary.trainingCost


def lloyd(df: DataFrame, features: Sequence[str], *, clusters: int, order: Sequence[str], rounds: int = 3) -> DataFrame:
    """Rows with `cluster` and `distance_to_centroid` after rounds of k-means from fixed starts.

    The first start is the first row by `order`; each further one is the row
    farthest from the starts so far, ties to the first by `order`. So the result
    can be repeated by any engine. A round is one aggregate of sums per centre,
    an empty centre stays; the driver holds centres only. Fewer rows than
    `clusters`: so many centres.
    """
    features = list(features)
    filled = impute(df, fit_medians(df, features))
    ready = settle(filled.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*scaled(fit_scale(filled, features)).values()).alias("__x")))
    along, centres = [F.col(f"`{c}`").asc() for c in order], []
    while len(centres) < clusters:
        ranked = ready.orderBy(*along) if not centres else ready.where(F.array_min(_squares(centres)) > 0).orderBy(F.array_min(_squares(centres)).desc(), *along)
        first = ranked.select("__x").limit(1).collect()  # a top-1: no sort of all rows
        if not first:
            break
        centres.append(list(first[0]["__x"]))
    for _ in range(rounds if centres else 0):
        sums = ready.groupBy(_nearest(centres).alias("c")).agg(*[F.avg(F.get("__x", F.lit(i))).alias(f"m{i}") for i in range(len(features))]).collect()
        for r in sums:
            centres[r["c"]] = [r[f"m{i}"] for i in range(len(features))]
    kept = [F.col(f"`{c}`") for c in df.columns]
    if not centres:
        return ready.select(*kept, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance_to_centroid"))
    return ready.select(*kept, _nearest(centres).alias("cluster"), F.sqrt(F.array_min(_squares(centres))).alias("distance_to_centroid"))


def _squares(centres: Sequence[Sequence[float]]) -> Column:
    """Squared distances of a row to all centres, as plain arithmetic."""
    each = [[(F.get("__x", F.lit(i)) - F.lit(float(v))) * (F.get("__x", F.lit(i)) - F.lit(float(v))) for i, v in enumerate(c)] for c in centres]
    return F.array(*[reduce(lambda a, b: a + b, terms) for terms in each])


def _nearest(centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre, the first of equals."""
    return (F.array_position(_squares(centres), F.array_min(_squares(centres))) - 1).cast("int")
