import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from tidemark.models import clusters, forecast, forest
from tidemark.operators import features, splits
from tidemark.operators.cleaning import reviewed_target_frame
from tidemark.plans.registry import PROFILE, readings

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tabular(spark):
    rows = reviewed_target_frame(readings(spark, SF), PROFILE)
    built, names = features.model_features(rows, PROFILE, lags=(1,), widths=(5,))
    return splits.split_by_strategy(built, PROFILE, "per_source_contiguous").cache(), names


def test_entry(spark):
    assert entry(spark).count() > 0


def test_forest_beats_majority_and_repeats(tabular):
    rows, names = tabular
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = forest.fit_forest(train, names, config={"numTrees": 8, "maxDepth": 6})
    f1 = forest.evaluate(model, test)
    majority = test.withColumn("prediction", F.lit(1))
    from tidemark.operators.metrics import f1_score
    assert f1 > f1_score(majority, "model_target", "prediction").first()["f1"]
    again = forest.fit_forest(train, names, config={"numTrees": 8, "maxDepth": 6})
    assert forest.evaluate(again, test) == pytest.approx(f1)
    assert {r[0] for r in model.predict(test).select("prediction").distinct().collect()} <= {1, 3, 4, 9}
    curve = {r["trees"]: r["validation_f1"] for r in forest.growth_curve(model, test, step=4).collect()}
    assert sorted(curve) == [4, 8] and curve[8] == pytest.approx(f1)


def test_search_prepares_rows_once_for_all_trials(tabular, monkeypatch):
    rows, names = tabular
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")
    asked, assemble = [], forest.imputing_assembler
    monkeypatch.setattr(forest, "imputing_assembler", lambda *a, **k: (asked.append(1), assemble(*a, **k))[1])
    trials, _ = forest.search(train, valid, names, {"numTrees": [2], "maxDepth": [2, 3]})
    assert len(asked) == 1 and len(trials) == 2
    alone = {d: forest.evaluate(forest.fit_forest(train, names, config={"numTrees": 2, "maxDepth": d}), valid) for d in (2, 3)}
    assert {t["maxDepth"]: t["validation_f1"] for t in trials} == pytest.approx(alone)


def test_inertia_does_not_rise_with_k(spark):
    windows = features.window_features(readings(spark, SF), PROFILE, 64)
    names = clusters.window_feature_names(windows)
    costs = [clusters.cluster(windows, names, clusters=k, starts=2)[1] for k in (2, 6)]
    assert costs[1] <= costs[0]
    found, _ = clusters.cluster(windows, names, clusters=3)
    assert found.where("distance_to_centroid IS NULL OR distance_to_centroid < 0").count() == 0


def test_saved_forest_predicts_the_same(spark):
    row = queries()["s26_saved_forest"](spark, "/root/testdata/sf0.001").first()
    assert row["rows"] == row["equal_rows"] > 0


def test_presets_cover_history_and_budgets():
    names = [e.name for e in forecast.presets("extended")]
    assert len(names) == len(set(names)) == 8
    assert not all(e.include_target_history for e in forecast.presets("quick"))
    with pytest.raises(ValueError):
        forecast.presets("none")


def test_forecast_scores_are_consistent(spark):
    rows = queries()["m08_forecast_scores"](spark, "/root/testdata/sf0.01")
    off = rows.where(F.abs(F.col("actual_value") - F.col("predicted_value") - F.col("forecast_error")) > 1e-6)
    assert rows.count() > 0 and off.count() == 0


def test_search_skips_impossible_windows(spark):
    got = queries()["m07_sequence_search"](spark, "/root/testdata/sf0.01").collect()
    assert {r["status"] for r in got} == {"fitted", "skipped"}


def test_lloyd_from_fixed_starts(spark):
    rows = [(i, float(x), None if i == 3 else float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (10, 10), (10, 11), (0, 2), (10, 9)])]
    df = spark.createDataFrame(rows, "id bigint, x double, y double").repartition(3)
    found = {r["id"]: r["cluster"] for r in clusters.lloyd(df, ["x", "y"], clusters=2, order=["id"]).collect()}
    assert found == {0: 0, 1: 0, 4: 0, 2: 1, 3: 1, 5: 1}
    same = clusters.lloyd(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id bigint, x double"), ["x"], clusters=5, order=["id"])
    assert [r["cluster"] for r in same.collect()] == [0, 0]  # equal rows: one centre
    assert clusters.lloyd(df.limit(0), ["x", "y"], clusters=2, order=["id"]).collect() == []


def test_ridge_sums_merge_and_equal_least_squares(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.normal(size=300)
    rows = [([[float(a), float(b)], [float(c), float(d)]], float(t)) for (a, b, c, d), t in zip(x, y)]
    schema = "history array<array<double>>, y double"
    whole, parts = spark.createDataFrame(rows, schema), [spark.createDataFrame(p, schema).repartition(3) for p in (rows[:100], rows[100:])]
    model = forecast.solve_ridge(forecast.normal_sums(whole), 0.05)
    merged = forecast.merge_sums(forecast.normal_sums(parts[0]).unionByName(forecast.normal_sums(parts[1])))
    centred, aim = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(centred.T @ centred / 300 + 0.05 * np.eye(4), centred.T @ aim / 300)
    for found in (model, forecast.solve_ridge(merged, 0.05)):
        assert np.allclose(found.weights, expected) and found.intercept == pytest.approx(y.mean() - expected @ x.mean(0))
    predicted = [r["prediction"] for r in model.transform(whole).collect()]
    assert np.allclose(predicted, model.intercept + x @ expected)
    # No windows, and a column without spread.
    nothing = forecast.solve_ridge(forecast.normal_sums(whole.limit(0)), 0.05)
    assert [r["prediction"] for r in nothing.transform(whole.limit(1)).collect()] == [0.0]
    flat = spark.createDataFrame([([[1.0, float(i)]], 2.0 * i) for i in range(5)], schema)
    assert forecast.solve_ridge(forecast.normal_sums(flat), 0.0).weights == pytest.approx((0.0, 2.0))


def test_node_table_scores_and_weighs_like_the_forest(spark, tabular):
    rows, names = tabular
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = forest.fit_forest(train, names, config={"numTrees": 5, "maxDepth": 4})
    nodes = forest.node_table(spark, model).cache()
    assert nodes.select("tree").distinct().count() == 5
    # Every child is a row, and leaves have no feature.
    assert nodes.where("feature IS NULL").count() == nodes.where("feature IS NOT NULL").count() + 5
    fitted = dict(p for p in model.importances(len(names)) if p[1] > 0)
    assert {r["feature"]: r["importance"] for r in forest.node_importances(nodes).collect() if r["importance"] > 0} == pytest.approx(fitted)
    from tidemark.models.prepare import fit_medians
    filled = fit_medians(train, names)
    inputs = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(filled[c])) for c in names}
    both = forest.score_nodes(model.predict(test), nodes, model.classes, inputs, column="by_nodes")
    assert both.count() > 0 and both.where("NOT prediction <=> by_nodes").count() == 0
    assert both.select("by_nodes").distinct().count() > 1


def test_split_takes_positions_from_the_features_layout(small_chunks, monkeypatch):
    """One layout for features and split, with the split that a layout of its own gives, over many chunks and null sources."""
    from tidemark.operators import ordering
    from tidemark.plans import model_queries

    laid, cut = [], ordering._cut
    monkeypatch.setattr(ordering, "_cut", lambda *a: (laid.append(cut(*a)), laid[-1])[1])
    model_queries._tabular(small_chunks, "/root/testdata/sf0.001")
    assert [chunks.count > 1 for chunks in laid] == [True]
    rows = reviewed_target_frame(readings(small_chunks, "/root/testdata/sf0.001"), PROFILE)
    rows = rows.withColumn("source_file", F.when(F.col("source_file") != "view", F.col("source_file")))
    built, names = features.model_features(rows, PROFILE, lags=(1,), widths=(5,), place=("p", "n"))
    assert not {"p", "n"} & set(names)
    got = {r["row_id"]: (r["p"], r["n"]) for r in built.select("row_id", "p", "n").collect()}
    line = {}
    for r in sorted(rows.select("source_file", "ts", "row_id").collect(), key=lambda r: (r["ts"], r["row_id"])):
        line.setdefault(r["source_file"], []).append(r["row_id"])
    assert got == {k: (i, len(ids)) for ids in line.values() for i, k in enumerate(ids)}
    for strategy in ("per_source_contiguous", "global_contiguous"):
        built, _ = features.model_features(rows, PROFILE, lags=(1,), widths=(5,), place=("p", "n"), scope="global" if strategy[0] == "g" else "source")
        here, anew = splits.split_by_strategy(built, PROFILE, strategy, placed=("p", "n")), splits.split_by_strategy(rows, PROFILE, strategy)
        assert here.columns == [*built.drop("p", "n").columns, "split"]
        assert sorted(here.select("row_id", "split").collect()) == sorted(anew.select("row_id", "split").collect())
    with pytest.raises(ValueError):
        splits.split_by_strategy(built, PROFILE, "episode_aware", placed=("p", "n"))
