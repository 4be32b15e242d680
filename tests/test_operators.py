import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.labels import finite, is_issue, is_reviewed, strategy_target
from tidemark.operators import asof, cleaning, features, intervals, sampling, selection, sequences, splits, summaries
from tidemark.operators.metrics import exact_quantiles, f1_score, ranking_metrics
from tidemark.operators.ordering import arrange
from tidemark.profiles import Profile, fractional_row_limit, scaled_cap
from tidemark.sources import exports

PROFILE = Profile()
BASE = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)


def at(second):
    return None if second is None else BASE + dt.timedelta(seconds=second)


def sensor(spark, labels, source="a", step=1, start_id=0):
    rows = [(start_id + i, at(i * step), source, float(i), float(i % 5), 1.0, label) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "row_id bigint, ts timestamp, source_file string, m1 double, m2 double, m3 double, qc int")


def test_runs_with_midpoints(spark):
    df = sensor(spark, [1, 1, 3, 3, 1, 9], step=2)
    runs = intervals.label_runs(df, time="ts", label=F.col("qc"), order=["ts", "row_id"], by=["source_file"])
    got = [(r["label"], r["first_row"], r["last_row"], r["start"].second, r["end"].second) for r in runs.orderBy("first_row").collect()]
    assert got == [(1, 0, 1, 0, 3), (3, 2, 3, 3, 7), (1, 4, 4, 7, 9), (9, 5, 5, 9, 10)]


def test_runs_fill_or_drop_null_labels(spark):
    df = sensor(spark, [1, None, 1, 1])
    dropped = intervals.label_runs(df, time="ts", label=F.col("qc"), order=["ts", "row_id"])
    filled = intervals.label_runs(df, time="ts", label=F.col("qc"), order=["ts", "row_id"], fill_value=9)
    assert dropped.count() == 1 and sorted(r["label"] for r in filled.collect()) == [1, 1, 9]


def test_merge_rows_is_disjoint_and_sorted(spark):
    rows = [("a", 0, 3), ("a", 2, 10), ("a", 4, 5), ("a", 12, 13), ("a", 20, 21), ("b", 0, 1)]
    got = intervals.merge_row_intervals(spark.createDataFrame(rows, "s string, start bigint, end bigint"), by=["s"], gap_rows=2)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 13), ("a", 20, 21), ("b", 0, 1)]


def test_nearest_join_ties_and_duplicates(spark):
    left = spark.createDataFrame([(i, at(s)) for i, s in enumerate((10, 20, 30))], "row_id bigint, ts timestamp")
    right = spark.createDataFrame([(i, at(s), i + 1) for i, s in enumerate((8, 12, 12, 20, 20, 25))], "row_id bigint, ts timestamp, v int")
    got = asof.nearest_join(left, right, time="ts", left_tie="row_id", right_tie="row_id", columns=["v"], tolerance_seconds=5)
    assert [r["v"] for r in got.orderBy("row_id").collect()] == [1, 5, 6]


def test_nearest_join_keeps_every_left_row(small_chunks):
    random.seed(3)
    left = [(i, random.choice("xyz"), at(random.randint(0, 900))) for i in range(300)]
    right = [(i, random.choice("xy"), at(random.randint(0, 900)), i) for i in range(200)]
    a = small_chunks.createDataFrame(left, "row_id bigint, k string, ts timestamp")
    b = small_chunks.createDataFrame(right, "row_id bigint, k string, ts timestamp, v int")
    got = {r["row_id"]: r["v"] for r in asof.nearest_join(a, b, time="ts", by=["k"], left_tie="row_id", right_tie="row_id", columns=["v"], tolerance_seconds=7).collect()}
    assert len(got) == 300
    for i, k, t in left:
        near = [((abs((t - u).total_seconds()), u > t, -j if u <= t else j), v) for j, key, u, v in right if key == k and abs((t - u).total_seconds()) <= 7]
        assert got[i] == (min(near)[1] if near else None)


def test_best_companions_against_brute_force(spark):
    random.seed(5)

    def files(prefix, count):
        out = []
        for i in range(count):
            start = random.randint(0, 40) * 10
            end = start + random.choice([5, 10, 20, 35])
            if random.random() < 0.12:
                start = end = None
            out.append((f"{prefix}{i:03d}", random.choice("abcdef"), start, end))
        return out

    epoch = lambda s: None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc)
    primary = files("p", 120)
    candidates = [c for c in files("c", 60) if (c[1] != "f" or c[2] is None) and (c[1] != "e" or c[2] is not None)]
    schema = "name string, series_key string, start_time timestamp, end_time timestamp"
    frame = lambda rows: spark.createDataFrame([(n, k, epoch(s), epoch(e)) for n, k, s, e in rows], schema)
    got = {r["name"]: (r["companion"], r["exact"], r["overlap_seconds"]) for r in asof.best_companions(frame(primary), frame(candidates)).collect()}
    for name, key, start, end in primary:
        same = [c for c in candidates if c[1] == key]
        if not same:
            assert name not in got
            continue
        overlap = lambda c: -1.0 if None in (start, end, c[2], c[3]) else max(0.0, float(min(end, c[3]) - max(start, c[2])))
        best = min(same, key=lambda c: ((c[2], c[3]) != (start, end), -overlap(c), abs((c[2] or 0) - (start or 0)), abs((c[3] or 0) - (end or 0)), c[0]))
        assert got[name][:2] == (best[0], (best[2], best[3]) == (start, end)) and got[name][2] == max(overlap(best), 0.0) or start is None


def test_typing_turns_nan_and_text_into_null(spark):
    raw = spark.createDataFrame([("2025-03-01T00:00:00.000Z", " 8.1", "x"), ("not a time", "1", "y"), ("2025-03-01T00:00:01Z", "NaN", "z"), ("2025-03-01T00:00:02Z", "bad", "z")],
                                "t string, v string, source_file string")
    rows = cleaning.type_readings(raw, time="t", keep_text=["source_file"]).orderBy("t").collect()
    assert [r["v"] for r in rows] == [8.1, None, None]


def test_label_predicates(spark):
    df = spark.createDataFrame([("3",), ("1",), ("0",), ("x",), (None,), ("9.0",)], "q string")
    got = df.select(is_issue(F.col("q"), (3, 4, 9)).alias("i"), is_reviewed(F.col("q"), (1,), (3, 4, 9)).alias("r"),
                    strategy_target(F.col("q"), "collapsed_1_34_9", (3, 4, 9)).alias("t")).collect()
    assert [r["i"] for r in got] == [True, False, False, False, False, True]
    assert [r["r"] for r in got] == [True, True, False, False, False, True]
    assert [r["t"] for r in got] == [34, 1, None, None, None, 9]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [True, False, False, False]


def test_row_limits():
    assert fractional_row_limit(1000, 1.0) is None and fractional_row_limit(1000, 0.25) == 250 and fractional_row_limit(1, 0.1) == 1
    assert scaled_cap(1000, 0.5, 600) == 600
    with pytest.raises(ValueError):
        fractional_row_limit(10, 0)


def test_window_features_edges(spark):
    df = sensor(spark, [3, 1, 3, 1, None])
    rows = features.window_features(df, PROFILE, 4).orderBy("window_id").collect()
    assert [r["row_count"] for r in rows] == [4, 1]
    assert rows[0]["target_mode"] == 1 and rows[1]["target_mode"] == -1
    assert rows[0]["issue_rate"] == 0.5 and rows[1]["m1_std"] is None


def test_window_labels(spark):
    df = spark.createDataFrame([([3, 1, 3, 1],), ([1, 1, 9],), ([],)], "v array<int>")
    got = df.select(sequences.window_label(F.col("v"), "majority").alias("m"), sequences.window_label(F.col("v"), "worst").alias("w")).collect()
    assert [(r["m"], r["w"]) for r in got] == [(3, 3), (1, 9), (1, 1)]


def test_forecast_windows_reject_gaps(spark):
    df = sensor(spark, [1] * 12).withColumn("ts", F.when(F.col("row_id") >= 6, F.col("ts") + F.expr("INTERVAL 60 SECONDS")).otherwise(F.col("ts")))
    found = sequences.forecast_windows(df, PROFILE, features=["m1"], target="m1", lookback=3, max_gap_seconds=2)
    rows = {r["row_index"]: [s[0] for s in r["history"]] for r in found.collect()}
    assert sorted(rows) == [3, 4, 5, 9, 10, 11]
    assert rows[9] == [6.0, 7.0, 8.0]


def test_forecast_windows_need_good_rows(spark):
    df = sensor(spark, [1, 1, 1, 4, 1, 1, 1, 1])
    ends = sequences.forecast_windows(df, PROFILE, features=["m1"], target="m1", lookback=2, max_gap_seconds=2, good_only=True)
    assert sorted(r["row_index"] for r in ends.collect()) == [2, 6, 7]


@pytest.mark.parametrize("cycle", range(3, 21))
def test_slot_schedule_keeps_shares_and_balance(cycle):
    slots = splits.slot_schedule(0.70, 0.15, cycle=cycle)
    shares = dict(zip(splits.SPLITS, (0.70, 0.15, 0.15), strict=True))
    assert len(slots) == cycle and sorted(slots) == sorted(splits.slot_schedule(0.70, 0.15, cycle=cycle, kind="runs"))
    for name, share in shares.items():
        count = slots.count(name)
        assert count >= 1 and abs(count - max(1.0, share * cycle)) < 2
        for upto in range(cycle + 1):  # no stretch from the start is more than a slot off
            assert abs(slots[:upto].count(name) - count * upto / cycle) <= 1


def test_clean_blocks_fill_targets_within_a_block(small_chunks):
    df = sensor(small_chunks, [1] * 700 + [3] * 4 + [1] * 900)
    rows = splits.episode_aware(df, PROFILE, 0.70, 0.15, block_rows=16).groupBy("split").count().collect()
    assert {r["split"]: abs(r["count"] - 1604 * s) <= 16 for r, s in ((r, {"train": 0.70, "validation": 0.15, "test": 0.15}[r["split"]]) for r in rows)} == dict.fromkeys(splits.SPLITS, True)


@pytest.mark.parametrize("strategy", splits.STRATEGIES)
def test_splits_are_complete_and_disjoint(small_chunks, strategy):
    df = sensor(small_chunks, [1] * 120 + [3] * 8 + [1] * 60 + [4] * 3 + [1] * 100).unionByName(sensor(small_chunks, [1] * 50 + [9] * 5 + [1] * 40, "b", start_id=1000))
    options = {"block_rows": 16} if strategy in ("interleaved_blocks", "episode_aware") else {}
    got = splits.split_by_strategy(df, PROFILE, strategy, **options)
    assert got.count() == df.count() and got.select("row_id").distinct().count() == df.count()


def test_no_episode_crosses_a_split_and_purge_removes_rows(small_chunks):
    df = sensor(small_chunks, ([1] * 37 + [3] * 9) * 8)
    whole = splits.split_by_strategy(df, PROFILE, "episode_aware", block_rows=16, context_rows=2)
    episode = F.floor(F.col("row_id") / 46)
    spread = whole.where("qc = 3").groupBy(episode).agg(F.countDistinct("split").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    purged = splits.split_by_strategy(df, PROFILE, "episode_aware", block_rows=16, context_rows=2, purge_gap_rows=4)
    assert 0 < purged.count() < whole.count()


@pytest.mark.parametrize("labels", [[1] * 40, [3] * 40, []])
def test_episode_split_without_one_side(spark, labels):
    df = sensor(spark, labels)
    assert splits.split_by_strategy(df, PROFILE, "episode_aware", block_rows=8).count() == len(labels)


def test_units_do_not_depend_on_the_chunks(spark):
    df = sensor(spark, ([1] * 53 + [3] * 5 + [1] * 31) * 6).unionByName(sensor(spark, [1] * 70 + [4] * 3, "b", start_id=5000))
    options = {"block_rows": 8, "context_rows": 2, "purge_gap_rows": 2}
    whole = splits.split_by_strategy(df, PROFILE, "episode_aware", **options)
    try:
        spark.conf.set("spark.tidemark.rowsPerChunk", "30")
        pieces = splits.split_by_strategy(df, PROFILE, "episode_aware", **options)
    finally:
        spark.conf.unset("spark.tidemark.rowsPerChunk")
    assert whole.count() == pieces.count() and whole.exceptAll(pieces).isEmpty()


def test_split_shares_and_gap(spark):
    df = sensor(spark, [1] * 60 + [3] * 40)
    table = summaries.split_distribution(splits.contiguous(df, PROFILE, 0.70, 0.15), "qc")
    for s in splits.SPLITS:
        assert table.agg(F.sum(f"{s}_share")).first()[0] == pytest.approx(1.0)
    gap = summaries.share_gap(table).first()
    assert 0 <= gap["mean_pairwise_total_variation"] <= gap["max_pairwise_total_variation"] <= 1


def test_balanced_sample_sizes(small_chunks):
    df = sensor(small_chunks, ([1] * 9 + [3]) * 60)
    kept = sampling.balanced_reviewed(df, PROFILE, 100, 0.4)
    assert kept.count() == 100 and kept.where("qc = 3").count() == 40
    scarce = sampling.balanced_reviewed(df, PROFILE, 200, 0.5)
    assert scarce.count() == 200 and scarce.where("qc = 3").count() == 60
    assert sampling.balanced_reviewed(df, PROFILE, 5000, 0.5).count() == 600


def test_subsets_of_small_frames_are_whole(spark):
    df = sensor(spark, [1, 3] * 10)
    for strategy in ("full_train", "time_spread", "issue_focused", "balanced_reviewed"):
        assert sampling.subsample(df, PROFILE, strategy, 50, issue_rows=5).count() == 20


def test_quantiles_with_heavy_ties(small_chunks):
    import numpy as np
    values = [0.0] * 700 + [float(v) for v in range(300)]
    df = small_chunks.createDataFrame([(v,) for v in values], "x double")
    got = {r["fraction"]: r["quantile"] for r in exact_quantiles(df, F.col("x"), [0.1, 0.7, 0.85, 0.999]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(values, q))


def test_ranking_needs_both_classes(spark):
    df = spark.createDataFrame([("v", 0.9, True), ("v", 0.4, False), ("v", 0.4, True), ("t", 0.3, False)], "split string, e double, is_issue boolean")
    got = {r["split"]: r for r in ranking_metrics(df, score="e").collect()}
    assert got["t"]["roc_auc"] is None and got["v"]["roc_auc"] == pytest.approx(0.75)
    assert got["v"]["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_f1_without_hits_is_zero(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "y int, p int")
    assert f1_score(df, "y", "p", average="binary").first()["f1"] == 0.0


def test_strategy_labels_and_feature_sets():
    from tidemark.functions.labels import strategy_labels
    assert strategy_labels("raw_multiclass") is None and strategy_labels("collapsed_1_34_9") == [1, 34, 9]
    assert strategy_labels("collapsed_12_34_9") == [12, 34, 9] and strategy_labels("binary_issue") == [0, 1]
    sets = features.feature_sets(PROFILE)
    assert [len(v) for v in sets.values()] == [3, 6, 16]


def test_feature_sets_name_built_columns(spark):
    built = features.sequence_features(sensor(spark, [1, 3, 9, 1]), PROFILE)
    for names in features.feature_sets(PROFILE).values():
        assert set(names) <= set(built.columns)


def write_exports_by_hand(folder, exports=6, readings=700):
    for e in range(exports):
        lines = ["# station", f"2020-01-0{e + 1}T00:00:00Z, a metadata line with a time", '#"Time UTC (yyyy-mm-ddThh:mm:ss.fffZ)",m1', *[f"2025-03-01T00:{i // 60:02d}:{i % 60:02d}.000Z,{i}" for i in range(readings)]]
        (folder / f"s{e}.csv").write_text("\n".join(lines) + "\n")


def test_exports_lose_nothing_when_the_cluster_changes_size(spark, tmp_path):
    write_exports_by_hand(tmp_path)
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        lines = exports.export_lines(spark, str(tmp_path))
        headers = exports.export_headers(lines)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
        assert exports.read_exports(lines, headers).count() == 4200
        first = exports.read_exports(lines, headers, first_rows=650)
        assert {r["source_file"]: (r["count"], r["top"]) for r in first.groupBy("source_file").agg(F.count("*").alias("count"), F.max("m1").alias("top")).collect()} == {f"s{e}.csv": (650, 649.0) for e in range(6)}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_first_rows_cross_splits(spark, tmp_path):
    write_exports_by_hand(tmp_path, 2, 3000)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        lines = exports.export_lines(spark, str(tmp_path))
        got = exports.read_exports(lines, exports.export_headers(lines), first_rows=2500).groupBy("source_file").agg(F.count("*").alias("n"), F.max("m1").alias("top")).collect()
        assert [(r["n"], r["top"]) for r in got] == [(2500, 2499.0)] * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_full_range_and_a_bundle_keep_every_row(spark):
    df = sensor(spark, [1, 3] * 600)
    assert selection.select_range(df, PROFILE, auto=False)[0].count() == 1200
    assert selection.select_range(df, PROFILE, auto=False, thin_to=100)[0].count() == 100
    assert selection.context_panel(df, PROFILE, "2024-01-01 00:00:30", 20, by_source=False).count() == 20


def test_carried_totals_stay_within_two_rows_per_chunk(spark):
    """Many groups inside single chunks need no carry; only groups that cross an edge do."""
    df = spark.range(20_000).select(F.col("id").alias("t"), F.floor(F.col("id") / 4).alias("g"))
    try:
        spark.conf.set("spark.tidemark.rowsPerChunk", "1800")
        seq = arrange(df, by=["g"], order=["t"])
        chunks, rows = seq._chunks.count, seq.accumulate(n=("total", F.lit(1)), upto=("sum", F.lit(1))).rows()
        assert chunks > 5 and rows.where("n <> 4 OR upto <> t % 4 + 1").count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.unset("spark.tidemark.rowsPerChunk")


def test_a_year_beside_a_second_stays_few_rows(spark):
    rows = [("p", "s", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))]
    others = [("short", "s", dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1, 0, 0, 1)), ("apart", "s", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1))]
    schema = "name string, series_key string, start_time timestamp, end_time timestamp"
    primary, candidates = spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema)
    found = asof.best_companions(primary, candidates).collect()
    assert [(r["name"], r["companion"], r["overlap_seconds"]) for r in found] == [("p", "short", 1.0)]
    found = asof.best_companions(candidates, primary).collect()
    assert {r["name"]: (r["companion"], r["overlap_seconds"]) for r in found} == {"short": ("p", 1.0), "apart": ("p", 0.0)}


def test_modelling_split_keeps_every_row_by_default(spark):
    df = sensor(spark, [1, 1, 3, 0, 1, 9, 1, 1, 1, 4] * 30)
    assert sampling.modelling_split(df, PROFILE, strategy="global_contiguous").count() == 270
    some = sampling.modelling_split(df, PROFILE, strategy="global_contiguous", subset="time_spread", subset_rows=50)
    assert some.where("split = 'train'").count() == 50 and some.where("split <> 'train'").count() == 81
