"""Model jobs, cluster reports and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.models import clusters, forecast, forest, sequence_models
from tidemark.models.interval_report import interval_report
from tidemark.models.prepare import fit_medians, impute
from tidemark.operators import cleaning, features, metrics, selection, sequences, splits, summaries
from tidemark.plans.registry import PROFILE, READINGS, SCORES, query, r9, readings, scores
from tidemark.plans.sequence_queries import FIXED, window_sql
from tidemark.plans.split_queries import GLOBAL, PER_SOURCE, episode_split_sql
from tidemark.session import scratch_path, settle
from tidemark.sources.datasets import write_reports

HOLES = READINGS + ", holes AS (SELECT row_id, CASE WHEN m1 < 2 THEN NULL ELSE m1 END AS m1, CASE WHEN m2 > 120 THEN NULL ELSE m2 END AS m2 FROM readings)"


@query("m01_impute_medians", HOLES + f" SELECT row_id, {r9('coalesce(m1, (SELECT quantile_cont(m1, 0.5) FROM holes))', 'm1')}, {r9('coalesce(m2, (SELECT quantile_cont(m2, 0.5) FROM holes))', 'm2')} FROM holes")
def impute_medians(spark, sf):
    holes = readings(spark, sf).select("row_id", F.when(F.col("m1") >= 2, F.col("m1")).alias("m1"), F.when(F.col("m2") <= 120, F.col("m2")).alias("m2"))
    return impute(holes, fit_medians(holes, ["m1", "m2"]))


PLACE = ("__position", "__total")


def _tabular(spark, sf):
    """Split reviewed rows with features; short and small so that a check stays quick."""
    rows = cleaning.reviewed_target_frame(readings(spark, sf), PROFILE)
    built, names = features.model_features(rows, PROFILE, lags=(1,), widths=(5,), place=PLACE)  # the split lies in the same order
    return settle(splits.split_by_strategy(built, PROFILE, "per_source_contiguous", placed=PLACE)), names


SMALL = {"numTrees": 8, "maxDepth": 6}


def _forest(spark, sf):
    rows, names = _tabular(spark, sf)
    return rows, names, forest.fit_forest(rows.where("split = 'train'"), names, config=SMALL)


# What SQL can state of fitted models: every row that is scored, with its truth, and values in their range.
@query("m02_forest_predictions", PER_SOURCE + " SELECT row_id, ts, source_file, CAST(qc AS BIGINT) AS model_target, TRUE AS known_label FROM split WHERE split = 'test'")
def forest_predictions(spark, sf):
    rows, _, model = _forest(spark, sf)
    return model.predict(rows.where("split = 'test'")).select(
        "row_id", "ts", "source_file", "model_target", F.coalesce(F.col("prediction").isin(model.classes), F.lit(False)).alias("known_label"))


@query("m02_forest_importances", "SELECT CAST(12 AS BIGINT) AS features, TRUE AS in_range")
def forest_importances(spark, sf):
    found = spark.createDataFrame(_forest(spark, sf)[2].importances(), "feature string, importance double")
    return found.agg(F.countDistinct("feature").alias("features"), ((F.min("importance") >= 0) & (F.sum("importance") <= 1.000001)).alias("in_range"))


@query("m02_forest_nodes", PER_SOURCE + " SELECT row_id, TRUE AS as_fitted FROM split WHERE split = 'test'")
def forest_nodes(spark, sf):
    """Every test row scored by the node table alone and by the fitted forest."""
    rows, names, model = _forest(spark, sf)
    filled = fit_medians(rows.where("split = 'train'"), names)
    scored = forest.score_nodes(model.predict(rows.where("split = 'test'")), forest.node_table(spark, model), model.classes,
                                {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(filled[c])) for c in names}, column="by_nodes")
    return scored.select("row_id", F.col("prediction").eqNullSafe(F.col("by_nodes")).alias("as_fitted"))


@query("m03_forest_growth", "SELECT CAST(trees AS BIGINT) AS trees, TRUE AS in_range FROM (VALUES (2), (4), (6), (8)) t(trees)")
def forest_growth(spark, sf):
    rows, _, model = _forest(spark, sf)
    return forest.growth_curve(model, rows.where("split = 'validation'"), step=2).select("trees", F.col("validation_f1").between(0, 1).alias("in_range"))


@query("m04_forest_search", 'SELECT CAST(n AS BIGINT) AS "numTrees", CAST(d AS BIGINT) AS "maxDepth", TRUE AS in_range FROM (VALUES (5, 3), (5, 6)) t(n, d)')
def forest_search(spark, sf):
    rows, names = _tabular(spark, sf)
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")
    trials, _ = forest.search(train, valid, names, {"numTrees": [5], "maxDepth": [3, 6]}, refit_on=train.unionByName(valid), refit_top=1)
    return spark.createDataFrame(trials).select("numTrees", "maxDepth", F.col("validation_f1").between(0, 1).alias("in_range"))


@query("s26_saved_forest", PER_SOURCE + " SELECT count(*) AS rows, count(*) AS equal_rows FROM split WHERE split = 'test'")
def saved_forest(spark, sf):
    rows, _, model = _forest(spark, sf)
    path = scratch_path(spark, "forest")
    model.save(spark, path)
    again = forest.Forest.load(spark, path)
    test = rows.where("split = 'test'")
    both = model.predict(test).select("row_id", F.col("prediction").alias("saved")).join(again.predict(test).select("row_id", F.col("prediction").alias("loaded")), "row_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("saved") == F.col("loaded")).alias("equal_rows"))


def _windows(spark, sf):
    return features.window_features(readings(spark, sf), PROFILE, 64)


LABELLED = READINGS + window_sql("readings", "ts, row_id", 64).replace("SELECT p.source_file, p.window_id", ", base AS (SELECT p.source_file, p.window_id", 1) + """),
labelled AS (SELECT *, CAST(floor(m2_mean / 10) AS BIGINT) AS cluster, abs(m1_mean - 45) AS distance_to_centroid FROM base)"""


@query("m05_window_clusters", LABELLED + f" SELECT source_file, window_id, {r9('issue_rate', 'issue_rate')}, TRUE AS at_nearest_centre FROM labelled")
def window_clusters(spark, sf):
    windows = _windows(spark, sf)
    return clusters.cluster(windows, clusters.window_feature_names(windows), clusters=4, all_distances=True)[0].select(
        "source_file", "window_id", "issue_rate", (F.col("distance_to_centroid") <= F.array_min("distances") + 1e-9).alias("at_nearest_centre"))


@query("m05_row_clusters", READINGS + " SELECT CAST(3 AS BIGINT) AS clusters, count(*) AS rows FROM readings")
def row_clusters(spark, sf):
    rows = clusters.row_level_input(readings(spark, sf), PROFILE)
    return summaries.cluster_summary(clusters.cluster(rows, ["m1", "m2", "m3"], clusters=3)[0]).agg(F.count("*").alias("clusters"), F.sum("window_count").alias("rows"))


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """Far-apart starts and rounds of means, as common table expressions over the standardised windows."""
    away = lambda c: f"((z.x - {c}.x) * (z.x - {c}.x) + (z.y - {c}.y) * (z.y - {c}.y))"
    steps = [", z AS (SELECT source_file, window_id, (m1_mean - avg(m1_mean) OVER ()) / stddev_pop(m1_mean) OVER () AS x, (m2_mean - avg(m2_mean) OVER ()) / stddev_pop(m2_mean) OVER () AS y FROM base)",
             "s0 AS (SELECT x, y FROM z ORDER BY source_file, window_id LIMIT 1)"]
    for k in range(1, clusters):
        chosen = [f"s{j}" for j in range(k)]
        steps.append(f"s{k} AS (SELECT z.x, z.y FROM z, {', '.join(chosen)} ORDER BY least({', '.join(map(away, chosen))}) DESC, source_file, window_id LIMIT 1)")
    steps.append("c0 AS (" + " UNION ALL ".join(f"SELECT {k} AS k, x, y FROM s{k}" for k in range(clusters)) + ")")
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT * FROM (SELECT z.*, c.k, {away('c')} AS d, row_number() OVER (PARTITION BY z.source_file, z.window_id ORDER BY {away('c')}, c.k) AS rk FROM z, c{r} c) WHERE rk = 1)")
        if r < rounds:
            steps.append(f"c{r + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT k, avg(x) AS x, avg(y) AS y FROM a{r} GROUP BY k) m USING (k))")
    return ", ".join(steps)


@query("m05_lloyd_clusters", LABELLED + _lloyd_sql(4, 3) + f" SELECT source_file, window_id, CAST(k AS BIGINT) AS cluster, {r9('sqrt(d)', 'distance_to_centroid').replace(', 9)', ', 7)')} FROM a3")
def lloyd_clusters(spark, sf):
    found = clusters.lloyd(_windows(spark, sf), ["m1_mean", "m2_mean"], clusters=4, order=["source_file", "window_id"], rounds=3)
    return found.select("source_file", "window_id", "cluster", F.round("distance_to_centroid", 7).alias("distance_to_centroid"))


def _labelled(spark, sf):
    """Windows with a rule in place of fitted clusters, so that reports can be checked."""
    return _windows(spark, sf).withColumns({"cluster": F.floor(F.col("m2_mean") / 10), "distance_to_centroid": F.abs(F.col("m1_mean") - 45.0)})


@query("a13_cluster_summary", LABELLED + f""" SELECT cluster, count(*) AS window_count, {r9('avg(issue_rate)', 'mean_issue_rate')}, {r9('max(issue_rate)', 'max_issue_rate')}, {r9('avg(distance_to_centroid)', 'avg_distance').replace(', 9)', ', 7)')},
min(window_start) AS first_window, max(window_end) AS last_window FROM labelled GROUP BY cluster""")
def cluster_summary(spark, sf):
    table = summaries.cluster_summary(_labelled(spark, sf))
    return table.withColumn("avg_distance", F.round("avg_distance", 7))


@query("a13_cluster_means", LABELLED + f" SELECT cluster, {r9('avg(m1_mean)', 'm1_mean').replace(', 9)', ', 7)')}, {r9('avg(m2_mean)', 'm2_mean').replace(', 9)', ', 7)')} FROM labelled GROUP BY cluster")
def cluster_means(spark, sf):
    means = summaries.cluster_means(_labelled(spark, sf), ["m1_mean", "m2_mean"])
    return means.select("cluster", F.round("m1_mean", 7).alias("m1_mean"), F.round("m2_mean", 7).alias("m2_mean"))


@query("a13_cluster_counts_between", LABELLED + f""" SELECT cluster, count(*) AS window_count, {r9('avg(issue_rate)', 'mean_issue_rate')} FROM labelled
WHERE window_end >= epoch_us(TIMESTAMP '2024-01-10 00:00:00') AND window_start <= epoch_us(TIMESTAMP '2024-01-20 00:00:00') GROUP BY cluster""")
def cluster_counts(spark, sf):
    return summaries.cluster_counts_between(_labelled(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("w17_closest_members", LABELLED + " SELECT cluster, source_file, window_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance_to_centroid, issue_rate DESC, source_file, window_id) AS rank FROM labelled) WHERE rank <= 3")
def closest(spark, sf):
    return summaries.closest_members(_labelled(spark, sf), 3, ["source_file", "window_id"]).select("cluster", "source_file", "window_id", "rank")


@query("t09_interesting_windows", LABELLED + f" SELECT source_file, window_id, cluster, {r9('issue_rate', 'issue_rate')} FROM labelled ORDER BY issue_rate DESC, distance_to_centroid DESC, source_file, window_id LIMIT 10")
def interesting(spark, sf):
    return summaries.interesting_windows(_labelled(spark, sf), ["source_file", "window_id"]).select("source_file", "window_id", "cluster", "issue_rate")


def _sequence_input(spark, sf):
    rows = cleaning.reviewed_target_frame(readings(spark, sf), PROFILE)
    return splits.split_by_strategy(rows, PROFILE, "per_source_contiguous")


TEST_WINDOWS = PER_SOURCE + """, placed AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, row_id) - 1 AS pos FROM split WHERE split = 'test'),
cells AS (SELECT source_file, pos // 8 AS window_index, pos % 8 AS step, qc, count(*) OVER (PARTITION BY source_file, pos // 8) AS size FROM placed)"""


@query("m06_sequence_classifier", TEST_WINDOWS + " SELECT source_file, window_index, CAST(max(qc) AS BIGINT) AS truth, TRUE AS known_label FROM cells WHERE size = 8 GROUP BY ALL")
def sequence_classifier(spark, sf):
    windows, classes = sequences.sequence_bundle(_sequence_input(spark, sf), PROFILE, features=["m1", "m2"], label="model_target", size=8)
    ready = settle(sequences.normalise_windows(windows, 2))
    model = sequence_models.fit_sequence_classifier(ready, classes, channels=2, size=8, config={"maxIter": 15, "hidden": [8]})
    return _judged(model, ready, "source_file", "window_index")


def _judged(model, ready, *keys):
    return model.predict(ready.where("split = 'test'")).select(*keys, "truth", F.coalesce(F.col("prediction").isin(model.classes), F.lit(False)).alias("known_label"))


@query("m06_step_classifier", TEST_WINDOWS + " SELECT source_file, window_index, step, CAST(qc IN (3, 4, 9) AS BIGINT) AS truth, TRUE AS known_label FROM cells WHERE size = 8")
def step_classifier(spark, sf):
    windows, classes = sequences.sequence_bundle(_sequence_input(spark, sf), PROFILE, features=["m1", "m2"], label="issue", size=8, task="binary", output="step")
    ready = settle(sequences.normalise_windows(windows, 2))
    model = sequence_models.fit_sequence_classifier(ready, classes, channels=2, size=8, per_step=True, kind="forest", config={"numTrees": 5, "maxDepth": 4})
    return _judged(model, ready, "source_file", "window_index", "step")


@query("m07_sequence_search", """SELECT CAST(size AS BIGINT) AS window_size, reduction, status, CASE status WHEN 'fitted' THEN TRUE END AS in_range
FROM (VALUES (8, 'worst', 'fitted'), (8, 'majority', 'fitted'), (1000000, 'worst', 'skipped'), (1000000, 'majority', 'skipped')) t(size, reduction, status)""")
def sequence_search(spark, sf):
    rows = settle(_sequence_input(spark, sf))
    trials = sequence_models.search_sequence_models(rows, PROFILE, features=["m1", "m2"], label="model_target", sizes=[8, 1_000_000], reductions=["worst", "majority"],
                                                    configs=[{"numTrees": 4, "maxDepth": 3}], kind="forest")
    schema = "window_size int, reduction string, status string, validation_f1 double"
    return spark.createDataFrame([(t["window_size"], t["reduction"], t["status"], t["validation_f1"]) for t in trials], schema).select(
        "window_size", "reduction", "status", F.col("validation_f1").between(0, 1).alias("in_range"))


@query("m09_score_table", SCORES + f" SELECT row_id, {r9('predicted_value', 'predicted_value')}, {r9('actual_value', 'actual_value')}, {r9('actual_value - predicted_value', 'forecast_error')}, {r9('abs(actual_value - predicted_value) / 50', 'forecast_abs_error_scaled')} FROM scores")
def score_table(spark, sf):
    rows = scores(spark, sf).select("row_id", F.col("predicted_value").alias("p"), F.col("actual_value").alias("a"))
    return forecast.score_table(rows, predicted=F.col("p"), actual=F.col("a"), spread=50.0).drop("p", "a")


def _level_scorer():
    """A fixed scorer: how far the window's mean level lies above 50, and twice the reverse."""

    def score(batch: np.ndarray) -> np.ndarray:
        level = batch[:, :, 0].mean(axis=1) - 50.0
        return np.stack([level, -2.0 * level], axis=1)

    return score


@query("m10_window_scoring", FIXED + ", means AS (SELECT source_file, window_index, avg(m1) AS level FROM cells WHERE size = 16 GROUP BY ALL) SELECT source_file, window_index, CAST(CASE WHEN level >= 50 THEN 1 ELSE 4 END AS BIGINT) AS label, CAST(CASE WHEN level >= 50 THEN 1 ELSE 0 END AS BIGINT) AS high FROM means")
def window_scoring(spark, sf):
    windows = sequences.fixed_windows(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, features=["m1", "m2"], label="qc", size=16)
    scored = sequence_models.score_windows(windows, _level_scorer, size=16, channels=2, outputs=2)
    return scored.select("source_file", "window_index", sequence_models.decode_class(F.col("logits"), [1, 4]).alias("label"), sequence_models.decode_binary(F.col("logits")).alias("high"))


def _rule(rows):
    return rows.withColumn("prediction", F.when(F.col("m1") >= 120, 4).when(F.col("m1") >= 80, 3).when(F.col("m2") % 25 == 0, 9).otherwise(1))


def _report(spark, sf):
    rows = readings(spark, sf)
    cut = splits.split_by_strategy(cleaning.reviewed_target_frame(rows, PROFILE), PROFILE, "global_contiguous")
    return interval_report(rows, PROFILE, _rule, splits=cut, start="2024-01-10 00:00:00", end="2024-01-22 00:00:00")


CHOSEN = READINGS + """, chosen AS (SELECT *, CASE WHEN m1 >= 120 THEN 4 WHEN m1 >= 80 THEN 3 WHEN CAST(m2 AS BIGINT) % 25 = 0 THEN 9 ELSE 1 END AS prediction FROM readings
WHERE qc IN (1, 3, 4, 9) AND ts BETWEEN epoch_us(TIMESTAMP '2024-01-10 00:00:00') AND epoch_us(TIMESTAMP '2024-01-22 00:00:00'))"""


@query("m11_interval_label_counts", CHOSEN + " SELECT CAST(label AS BIGINT) AS label, CAST(sum(a) AS BIGINT) AS true_rows, CAST(sum(p) AS BIGINT) AS predicted_rows FROM (SELECT qc AS label, 1 AS a, 0 AS p FROM chosen UNION ALL SELECT prediction, 0, 1 FROM chosen) GROUP BY label")
def interval_labels(spark, sf):
    return _report(spark, sf)["label_counts"]


def spans_sql(name: str, label: str) -> str:
    return f""", {name}_rows AS (SELECT ts, {label} AS l, lag(ts) OVER g AS prev, lead(ts) OVER g AS nxt, CASE WHEN lag({label}) OVER g = {label} THEN 0 ELSE 1 END AS fresh, row_number() OVER g AS rn
FROM chosen WINDOW g AS (ORDER BY ts, source_file, row_id)), {name}_runs AS (SELECT *, sum(fresh) OVER (ORDER BY rn) AS run FROM {name}_rows),
{name} AS (SELECT coalesce(min(prev) FILTER (fresh = 1) + (min(ts) - min(prev) FILTER (fresh = 1)) // 2, min(ts)) AS start, coalesce(max(ts) + (max(nxt) - max(ts)) // 2, max(ts)) AS stop, CAST(min(l) AS BIGINT) AS label FROM {name}_runs GROUP BY run)"""


REPORT_SQL = (GLOBAL + CHOSEN[len(READINGS):] + spans_sql("true_spans", "qc") + spans_sql("guessed_spans", "prediction")
              + ", spans AS (SELECT split, min(ts) AS lo, max(ts) AS hi FROM split GROUP BY split), hit AS (SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS k "
              "FROM spans WHERE lo <= (SELECT max(ts) FROM chosen) AND hi >= (SELECT min(ts) FROM chosen)) "
              "SELECT start, stop AS \"end\", label, 'true_intervals' AS kind FROM true_spans UNION ALL SELECT start, stop, label, 'predicted_intervals' FROM guessed_spans "
              "UNION ALL SELECT NULL, NULL, NULL, CASE count(*) WHEN 0 THEN 'outside modeled range' WHEN 1 THEN min(split) ELSE 'mixed (' || string_agg(split, ', ' ORDER BY k) || ')' END FROM hit")


@query("m11_interval_report", REPORT_SQL)
def report_tables(spark, sf):
    tables = _report(spark, sf)
    origin = tables["origin"].select("origin")
    spans = cleaning.union_all([tables[k].select("start", "end", "label").withColumn("kind", F.lit(k)) for k in ("true_intervals", "predicted_intervals")])
    return spans.unionByName(origin.select(F.col("origin").alias("kind")), allowMissingColumns=True)


@query("m11_forest_interval_report", CHOSEN + " SELECT CAST(qc AS BIGINT) AS label, count(*) AS true_rows, TRUE AS all_rows_predicted FROM chosen GROUP BY qc")
def forest_report(spark, sf):
    """The report on a fitted forest: features are built on all rows, so that those at the range's edge look back."""
    rows, names, model = _forest(spark, sf)
    built = features.model_features(readings(spark, sf), PROFILE, lags=(1,), widths=(5,))[0]
    report = interval_report(built, PROFILE, model.predict, start="2024-01-10 00:00:00", end="2024-01-22 00:00:00")
    totals = report["label_counts"].agg(F.sum("true_rows").alias("t"), F.sum("predicted_rows").alias("p")).first()
    return report["label_counts"].where("true_rows > 0").select("label", "true_rows", F.lit(totals["t"] == totals["p"]).alias("all_rows_predicted"))


QUICK = {"lookback": 6, "max_gap_seconds": 14_400.0}
EPISODE = {"block_rows": 64, "context_rows": 4, "merge_gap_rows": 4, "purge_gap_rows": 4}


def _forecast(spark, sf, *experiments):
    return forecast.forecast_anomalies(readings(spark, sf), PROFILE, experiments, target="m1", data_fraction=1.0, **EPISODE)


# All rows of validation and test with six linked rows before them in their split and source: every window is scored.
SCORED = episode_split_sql(64, 4, 4, 4) + """, judged AS (SELECT s.split, s.ts, s.source_file, s.row_id, r.m1, s.qc FROM split s JOIN readings r USING (row_id) WHERE s.split <> 'train'),
steps AS (SELECT *, ts - lag(ts) OVER w AS gap FROM judged WINDOW w AS (PARTITION BY split, source_file ORDER BY ts, row_id)),
scored AS (SELECT * FROM (SELECT *, count(*) FILTER (gap <= 14400000000) OVER (PARTITION BY split, source_file ORDER BY ts, row_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS links FROM steps) WHERE links = 6)"""


@query("m08_forecast_scores", SCORED + f" SELECT split, ts, source_file, {r9('m1', 'actual_value')}, CAST(qc AS BIGINT) AS qc_label, qc = 1 AS is_good, qc IN (3, 4, 9) AS is_issue, TRUE AS error_fits FROM scored")
def forecast_scores(spark, sf):
    found = _forecast(spark, sf, forecast.Experiment("huber", include_target_history=False, loss="huber", **QUICK))["scores"]
    fits = (F.abs(F.col("forecast_error") - (F.col("actual_value") - F.col("predicted_value"))) < 1e-9) & (F.col("forecast_abs_error_scaled") >= 0)
    return found.select("split", "ts", "source_file", "actual_value", "qc_label", "is_good", "is_issue", F.coalesce(fits, F.lit(False)).alias("error_fits"))


def _ridge_sql(lookback: int, channels: list[str], penalty: float) -> str:
    """Windows, scales, normal equations and their solution by elimination, as common table expressions."""
    size = lookback * len(channels)
    lags = ", ".join(f"lag({c}, {lookback - k}) OVER w AS h{k * len(channels) + i}" for k in range(lookback) for i, c in enumerate(channels))
    own = lambda i: [f"h{k * len(channels) + i}" for k in range(lookback)]
    scales = ", ".join(f"({' + '.join(f'sum({h})' for h in own(i))}) / ({lookback} * count(*)) AS u{i}" for i in range(len(channels)))
    spreads = ", ".join(f"sqrt(({' + '.join(f'sum(({h} - u{i}) * ({h} - u{i}))' for h in own(i))}) / ({lookback} * count(*))) + 1e-6 AS s{i}" for i in range(len(channels)))
    scaled = ", ".join(f"(h{k} - u{k % len(channels)}) / s{k % len(channels)} AS z{k}" for k in range(size))
    name = lambda k: "y" if k == size else f"z{k}"
    cells = [(i, j) for i in range(size) for j in range(size + 1)]
    first = ", ".join(f"avg({name(i)} * {name(j)}) - avg({name(i)}) * avg({name(j)}){f' + {penalty}' if i == j else ''} AS a{i}_{j}" for i, j in cells)
    sql = f""", judged AS (SELECT s.split, s.ts, s.source_file, s.row_id, r.m1, r.m2, r.m3, s.qc FROM split s JOIN readings r USING (row_id)),
steps AS (SELECT *, ts - lag(ts) OVER w AS gap, {lags} FROM judged WINDOW w AS (PARTITION BY split, source_file ORDER BY ts, row_id)),
linked AS (SELECT *, count(*) FILTER (gap <= 14400000000) OVER (PARTITION BY split, source_file ORDER BY ts, row_id ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW) AS links,
count(*) FILTER (qc = 1) OVER (PARTITION BY split, source_file ORDER BY ts, row_id ROWS BETWEEN {lookback} PRECEDING AND CURRENT ROW) AS goods FROM steps),
windows AS (SELECT * FROM linked WHERE links = {lookback} AND (split <> 'train' OR goods = {lookback + 1})),
level AS (SELECT {scales}, avg(m1) AS uy, stddev_pop(m1) + 1e-6 AS sy FROM windows WHERE split = 'train'),
spread AS (SELECT {spreads} FROM windows, level WHERE split = 'train'),
z AS (SELECT split, ts, source_file, row_id, m1, (m1 - uy) / sy AS y, uy, sy, {scaled} FROM windows, level, spread),
means AS (SELECT {', '.join(f'avg({name(k)}) AS m_{name(k)}' for k in range(size + 1))} FROM z WHERE split = 'train'), e0 AS (SELECT {first} FROM z WHERE split = 'train')"""
    for k in range(size):
        turned = ", ".join((f"a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j}") + f" AS a{i}_{j}" for i, j in cells)
        sql += f", e{k + 1} AS (SELECT {turned} FROM e{k})"
    sql += f", weights AS (SELECT {', '.join(f'a{k}_{size} / a{k}_{k} AS w{k}' for k in range(size))} FROM e{size})"
    guess = f"m_y + {' + '.join(f'w{k} * (z{k} - m_z{k})' for k in range(size))}"
    return sql + f", forecast AS (SELECT split, row_id, m1, ({guess}) * sy + uy AS predicted, sy FROM z, means, weights WHERE split <> 'train')"


@query("m08_ridge_forecast", episode_split_sql(64, 4, 4, 4) + _ridge_sql(2, ["m2", "m3"], 0.01) + """ SELECT split, row_id, round(m1, 6) AS actual_value, round(predicted, 6) AS predicted_value,
round(abs(m1 - predicted) / sy, 6) AS forecast_abs_error_scaled FROM forecast""")
def ridge_forecast(spark, sf):
    """Fit and predictions in full: SQL builds and solves the same normal equations."""
    rows = readings(spark, sf)
    cut = splits.split_by_strategy(cleaning.reviewed_target_frame(rows, PROFILE), PROFILE, "episode_aware", **EPISODE)
    judged = settle(selection.features_for_splits(rows, cut, PROFILE))
    experiment = forecast.Experiment("ridge", include_target_history=False, learner="ridge", regularisation=0.01, lookback=2, max_gap_seconds=14_400.0)
    found, _ = forecast.run_experiment(judged, PROFILE, experiment, target="m1")
    return found.select("split", "row_id", *[F.round(c, 6).alias(c) for c in ("actual_value", "predicted_value", "forecast_abs_error_scaled")])


@query("m12_forecast_anomaly_job", SCORED + """ SELECT split, threshold_source, count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows, TRUE AS in_range FROM scored,
(VALUES ('good_q0.9'), ('good_q0.95'), ('good_q0.97'), ('good_q0.98'), ('good_q0.99'), ('good_q0.995'), ('validation_f1_optimized')) t(threshold_source) GROUP BY ALL""")
def forecast_job(spark, sf):
    found = _forecast(spark, sf, forecast.Experiment("own_history", **QUICK))["thresholds"]
    inside = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return found.select("split", "threshold_source", "rows", "issue_rows", inside.alias("in_range"))


@query("s25_written_reports", SCORES + f""" SELECT 'scores' AS dataset, count(*) AS rows, {r9('sum(error)', 'checked').replace(', 9)', ', 6)')} FROM scores
UNION ALL SELECT 'thresholds', count(DISTINCT split), CAST(count(*) FILTER (error >= 1.25) AS DOUBLE) FROM scores UNION ALL SELECT 'summary', count(DISTINCT split), CAST(count(*) FILTER (is_issue) AS DOUBLE) FROM scores""")
def written_reports(spark, sf):
    path = scratch_path(spark, "reports")
    table = scores(spark, sf)
    write_reports(table, metrics.threshold_metrics(table, {"fixed": 1.25}, score="error", issue_labels=[3, 4, 9]), metrics.ranking_metrics(table, score="error"), path)
    found = [("scores", spark.read.parquet(f"{path}/scores"), "error"), ("thresholds", spark.read.option("header", True).csv(f"{path}/threshold_metrics"), "predicted_anomaly_rows"),
             ("summary", spark.read.json(f"{path}/summary"), "issue_rows")]
    return cleaning.union_all([frame.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col(c).cast("double")), 6).alias("checked")) for name, frame, c in found])
