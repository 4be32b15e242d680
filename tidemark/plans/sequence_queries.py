"""Row order, windows, runs, episodes, sequences and time sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, features, intervals, ordering, sampling, selection, sequences, splits
from tidemark.plans.registry import PROFILE, READINGS, SHIPMENT_PROFILE, SHIPMENTS, query, r9, readings, shipments, spread_sql

W = "PARTITION BY source_file ORDER BY ts, row_id"
G = "ORDER BY ts, source_file, row_id"
ROW = "row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) AS qc"
REVIEWED = "qc IN (1, 3, 4, 9)"
NUMBERED = READINGS + f""", numbered AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY source_file) AS n,
qc IN (3, 4, 9) AS bad FROM readings)"""


def window_sql(table: str, order: str, size: int) -> str:
    stats = ", ".join(f"{r9(f'avg(m{i})', f'm{i}_mean')}, {r9(f'stddev_samp(m{i})', f'm{i}_std')}, {r9(f'min(m{i})', f'm{i}_min')}, {r9(f'max(m{i})', f'm{i}_max')}" for i in (1, 2, 3))
    return f""", placed AS (SELECT *, (row_number() OVER (PARTITION BY source_file ORDER BY {order}) - 1) // {size} AS window_id FROM {table}),
tallied AS (SELECT source_file, window_id, qc, count(*) AS c FROM placed GROUP BY source_file, window_id, qc),
modes AS (SELECT source_file, window_id, qc, row_number() OVER (PARTITION BY source_file, window_id ORDER BY c DESC, qc) AS rk FROM tallied)
SELECT p.source_file, p.window_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS row_count, count(*) FILTER (p.qc IN (3, 4, 9)) AS issue_count,
{r9('avg(CASE WHEN p.qc IN (3, 4, 9) THEN 1 ELSE 0 END)', 'issue_rate')}, CAST(min(m.qc) AS BIGINT) AS target_mode, {stats}
FROM placed p JOIN modes m ON p.source_file = m.source_file AND p.window_id = m.window_id AND m.rk = 1 GROUP BY p.source_file, p.window_id"""


@query("a01_window_features", READINGS + window_sql("readings", "ts, row_id", 64))
def window_features(spark, sf):
    return features.window_features(readings(spark, sf), PROFILE, 64)


@query("a01_window_features_shipments", SHIPMENTS + window_sql("shipments", "ts, k1, k2, k3, k4, m2", 128))
def shipment_windows(spark, sf):
    return features.window_features(shipments(spark, sf), SHIPMENT_PROFILE, 128)


@query("w01_row_position_by_source", READINGS + f" SELECT row_id, source_file, row_number() OVER ({W}) - 1 AS row_index, count(*) OVER (PARTITION BY source_file) AS source_rows FROM readings")
def position_by_source(spark, sf):
    return ordering.with_position(readings(spark, sf).select("row_id", "source_file", "ts"), by=["source_file"], order=["ts", "row_id"], total="source_rows").drop("ts")


@query("w01_row_position_global", SHIPMENTS + " SELECT k1, k2, k3, k4, m2, row_number() OVER (ORDER BY ts, source_file, k1, k2, k3, k4, m2) - 1 AS row_index FROM shipments")
def position_global(spark, sf):
    return ordering.with_position(shipments(spark, sf).select("ts", "source_file", "k1", "k2", "k3", "k4", "m2"), order=SHIPMENT_PROFILE.global_order).drop("ts", "source_file")


def deltas_sql(over: str) -> str:
    return ", ".join(r9(f"coalesce(abs(m{i} - lag(m{i}) OVER ({over})), 0)", f"m{i} abs_delta") for i in (1, 2, 3))


CLOCK = "CAST(hour(make_timestamp(ts)) AS BIGINT) AS hour_utc, CAST(minute(make_timestamp(ts)) AS BIGINT) AS minute_utc, CAST(dayofyear(make_timestamp(ts)) AS BIGINT) AS day_of_year"


@query("w02_baseline_features", READINGS + f" SELECT {ROW}, {CLOCK}, {deltas_sql(W)} FROM readings")
def baseline(spark, sf):
    return features.baseline_features(readings(spark, sf), PROFILE)


@query("w02_baseline_features_global", READINGS + f" SELECT {ROW}, {CLOCK}, {deltas_sql(G)} FROM readings")
def baseline_global(spark, sf):
    return features.baseline_features(readings(spark, sf), PROFILE, scope="global")


@query("w03_lag_features", READINGS + " SELECT row_id, " + ", ".join(f'lag(m{i}, {k}) OVER ({W}) AS "m{i} lag_{k}"' for i in (1, 2, 3) for k in (1, 3, 5)) + " FROM readings")
def lags(spark, sf):
    added = features.context_features(readings(spark, sf), PROFILE, widths=())
    return added.drop("ts", "source_file", "m1", "m2", "m3", "qc")


def rolling_sql(over: str, widths=(5, 15)) -> str:
    return ", ".join(f"{r9(f'avg(m{i}) OVER ({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)', f'm{i} roll_mean_{w}')}, "
                     f"{r9(f'stddev_samp(m{i}) OVER ({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)', f'm{i} roll_std_{w}')}" for i in (1, 2, 3) for w in widths)


@query("w04_rolling_features", READINGS + f" SELECT row_id, {rolling_sql(W)} FROM readings")
def rolling(spark, sf):
    return features.context_features(readings(spark, sf), PROFILE, lags=()).drop("ts", "source_file", "m1", "m2", "m3", "qc")


@query("w04_rolling_features_global", READINGS + f" SELECT row_id, {rolling_sql(G)} FROM readings")
def rolling_global(spark, sf):
    return features.context_features(readings(spark, sf), PROFILE, lags=(), scope="global").drop("ts", "source_file", "m1", "m2", "m3", "qc")


RUNS = READINGS + f""", steps AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, lag(ts) OVER ({W}) AS prev, lead(ts) OVER ({W}) AS next,
CASE WHEN lag(qc) OVER ({W}) = qc THEN 0 ELSE 1 END AS fresh FROM readings),
islands AS (SELECT *, sum(fresh) OVER ({W}) AS run FROM steps),
runs AS (SELECT source_file, run, CAST(min(qc) AS BIGINT) AS label, count(*) AS rows, min(pos) AS first_row, max(pos) AS last_row, min(ts) AS first_time, max(ts) AS last_time,
arg_min(prev, pos) FILTER (prev IS NOT NULL AND fresh = 1) AS prev, arg_max(next, pos) AS next_any, max(pos) AS maxpos FROM islands GROUP BY source_file, run),
bounds AS (SELECT r.*, i.next AS after FROM runs r JOIN islands i ON i.source_file = r.source_file AND i.pos = r.maxpos),
spans AS (SELECT source_file, label, rows, first_row, last_row, first_time, last_time,
CASE WHEN prev IS NULL THEN first_time ELSE prev + (first_time - prev) // 2 END AS start,
CASE WHEN after IS NULL THEN last_time ELSE last_time + (after - last_time) // 2 END AS "end" FROM bounds)"""


@query("w05_label_runs", RUNS + " SELECT source_file, label, rows, first_row, last_row, first_time, last_time FROM spans")
def runs(spark, sf):
    return _runs(spark, sf).drop("start", "end")


def _runs(spark, sf):
    return intervals.label_runs(readings(spark, sf), time="ts", label=F.col("qc"), order=["ts", "row_id"], by=["source_file"])


@query("w06_midpoint_spans", RUNS + ' SELECT source_file, label, start, "end" FROM spans WHERE label <> 1')
def spans(spark, sf):
    return intervals.label_runs(readings(spark, sf), time="ts", label=F.col("qc"), order=["ts", "row_id"], by=["source_file"], fill_value=9,
                                keep=~F.col("label").isin(1)).select("source_file", "label", "start", "end")


MERGED = RUNS + """, issue_spans AS (SELECT source_file, label, start, "end" FROM spans WHERE label IN (3, 4, 9)),
flagged AS (SELECT *, CASE WHEN lag(label) OVER w = label AND start <= lag("end") OVER w + 1800000000 THEN 0 ELSE 1 END AS opens FROM issue_spans WINDOW w AS (PARTITION BY source_file ORDER BY start, "end", label)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY source_file ORDER BY start, "end", label) AS island FROM flagged)
SELECT source_file, min(start) AS start, max("end") AS "end", min(label) AS label, count(*) AS merged FROM grouped GROUP BY source_file, island"""


@query("w07_merge_labelled_intervals", MERGED)
def merged_intervals(spark, sf):
    found = _runs(spark, sf).where(F.col("label").isin(3, 4, 9))
    return intervals.merge_labelled_intervals(found, by=["source_file"], max_gap_seconds=1800)


@query("w08_merge_row_intervals", NUMBERED + """, pieces AS (SELECT source_file, pos AS start, pos + 1 + CAST(m1 AS BIGINT) % 9 AS stop FROM numbered WHERE bad),
reach AS (SELECT *, max(stop) OVER (PARTITION BY source_file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM pieces),
grouped AS (SELECT *, sum(CASE WHEN upto IS NULL OR start > upto + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY start, stop) AS island FROM reach)
SELECT source_file, min(start) AS start, max(stop) AS "end" FROM grouped GROUP BY source_file, island""".replace("CAST(m1 AS BIGINT)", "CAST(floor(m1) AS BIGINT)"))
def merged_rows(spark, sf):
    placed = ordering.with_position(readings(spark, sf), by=["source_file"], order=["ts", "row_id"], name="pos")
    pieces = placed.where(F.col("qc").isin(3, 4, 9)).select("source_file", F.col("pos").alias("start"), (F.col("pos") + 1 + F.floor("m1") % 9).alias("end"))
    return intervals.merge_row_intervals(pieces, by=["source_file"], gap_rows=3)


EPISODES = NUMBERED + """, marks AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY source_file ORDER BY pos) - 1 <= 4 THEN 0 ELSE 1 END AS opens FROM numbered WHERE bad),
runs AS (SELECT source_file, min(pos) AS lo, max(pos) + 1 AS hi, min(n) AS n, count(*) AS issue_rows FROM (SELECT *, sum(opens) OVER (PARTITION BY source_file ORDER BY pos) AS r FROM marks) GROUP BY source_file, r),
padded AS (SELECT source_file, greatest(lo - 6, 0) AS lo, least(hi + 6, n) AS hi, n, issue_rows FROM runs),
touching AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY source_file ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM padded),
episodes AS (SELECT source_file, min(lo) AS start, max(hi) AS "end", min(n) AS total, CAST(sum(issue_rows) AS BIGINT) AS issue_rows FROM (SELECT *, sum(opens) OVER (PARTITION BY source_file ORDER BY lo) AS e FROM touching) GROUP BY source_file, e)"""


def _placed(spark, sf):
    return splits.place_issues(readings(spark, sf), PROFILE, F.col("qc").isin(3, 4, 9))


@query("w09_issue_episodes", EPISODES + ' SELECT source_file, start, "end", total, issue_rows FROM episodes')
def episodes(spark, sf):
    rows = _placed(spark, sf).where("__issue")
    return intervals.issue_episodes(rows, by=["source_file"], position="row_index", total="source_rows", context_rows=6, merge_gap_rows=4)


@query("w10_episode_and_clean_units", EPISODES + """, gaps AS (SELECT source_file, coalesce(lag("end") OVER w, 0) AS start, start AS stop FROM episodes WINDOW w AS (PARTITION BY source_file ORDER BY start)
UNION ALL SELECT source_file, max("end"), max(total) FROM episodes GROUP BY source_file)
SELECT source_file, start, "end", 'episode' AS kind FROM episodes UNION ALL
SELECT source_file, s AS start, least(s + 16, stop) AS "end", 'clean' FROM (SELECT source_file, stop, unnest(range(start, stop, 16)) AS s FROM gaps WHERE start < stop)""")
def units(spark, sf):
    found, clean = splits.split_units(_placed(spark, sf), PROFILE, context_rows=6, merge_gap_rows=4)
    blocks = splits.clean_blocks(clean, PROFILE, 16)
    return found.withColumn("kind", F.lit("episode")).unionByName(blocks.withColumn("kind", F.lit("clean")))


LOOKBACK, GAP = 8, 7200
FORECAST = READINGS + f""", steps AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, ts - lag(ts) OVER ({W}) AS gap FROM readings),
checked AS (SELECT *, sum(CASE WHEN {{valid}} THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN {LOOKBACK} PRECEDING AND CURRENT ROW) AS good_rows,
sum(CASE WHEN gap <= {GAP * 1_000_000} THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW) AS links FROM steps),
ends AS (SELECT * FROM checked WHERE good_rows = {LOOKBACK + 1} AND links = {LOOKBACK})"""
HISTORY = f""" SELECT e.row_id, e.ts, e.source_file, e.pos AS row_index, e.m1 AS target_value, CAST(e.qc AS BIGINT) AS qc_label, e.qc = 1 AS is_good, e.qc IN (3, 4, 9) AS is_issue,
{r9('arg_min(h.m1, h.pos)', 'first_m1')}, {r9('arg_max(h.m2, h.pos)', 'last_m2')}, {r9('sum(h.m1)', 'sum_m1')}, {r9('sum(h.m2 * (h.pos - e.pos))', 'weighted_m2')}
FROM {{ends}} e JOIN steps h ON h.source_file = e.source_file AND h.pos BETWEEN e.pos - {LOOKBACK} AND e.pos - 1
GROUP BY e.row_id, e.ts, e.source_file, e.pos, e.m1, e.qc"""


def _flat(windows):
    h = F.col("history")
    at = lambda i, c: F.get(F.get(h, F.lit(i)), F.lit(c))
    total = F.aggregate(h, F.lit(0.0), lambda a, s: a + F.get(s, F.lit(0)))
    weighted = F.aggregate(F.transform(h, lambda s, i: F.get(s, F.lit(1)) * (i - LOOKBACK)), F.lit(0.0), lambda a, x: a + x)
    return windows.withColumns({"first_m1": at(0, 0), "last_m2": at(LOOKBACK - 1, 1), "sum_m1": total, "weighted_m2": weighted}).drop("history")


def _forecast(spark, sf, **options):
    return sequences.forecast_windows(readings(spark, sf), PROFILE, features=["m1", "m2"], target="m1", lookback=LOOKBACK, max_gap_seconds=GAP, **options)


@query("w11_forecast_windows", FORECAST.format(valid="TRUE") + HISTORY.format(ends="ends"))
def forecast(spark, sf):
    return _flat(_forecast(spark, sf))


@query("w11_forecast_windows_good_only", FORECAST.format(valid="qc = 1") + HISTORY.format(ends="ends"))
def forecast_good(spark, sf):
    return _flat(_forecast(spark, sf, good_only=True))


@query("t06_spread_ends", FORECAST.format(valid="TRUE") + f", chosen AS ({spread_sql('ends', 40, by='source_file', order='pos')}) SELECT row_id, source_file, pos AS row_index FROM chosen")
def spread_ends(spark, sf):
    return _ends(spark, sf, "spread")


def _ends(spark, sf, mode):
    rows = sequences.forecast_rows(readings(spark, sf), PROFILE, features=["m1"], target="m1", lookback=LOOKBACK, max_gap_seconds=GAP)
    return sequences.choose_ends(rows.where("is_end"), PROFILE, limit=40, mode=mode).select("row_id", "source_file", "row_index")


@query("t06_issue_enriched_ends", FORECAST.format(valid="TRUE") + f""", sizes AS (SELECT source_file, count(*) AS n, count(*) FILTER (qc IN (3, 4, 9)) AS ni FROM ends GROUP BY source_file),
sided AS (SELECT e.*, z.n AS all_n, z.ni, e.qc IN (3, 4, 9) AS bad, row_number() OVER (PARTITION BY e.source_file, e.qc IN (3, 4, 9) ORDER BY pos) - 1 AS spos,
CASE WHEN e.qc IN (3, 4, 9) THEN 40 ELSE 40 - z.ni END AS k, CASE WHEN e.qc IN (3, 4, 9) THEN z.ni ELSE z.n - z.ni END AS m FROM ends e JOIN sizes z USING (source_file)),
kept AS (SELECT * FROM sided WHERE all_n <= 40 OR (ni >= 40 AND bad AND list_contains([CASE WHEN i = 39 THEN m - 1 ELSE CAST(floor(i * (CAST(m - 1 AS DOUBLE) / CAST(39 AS DOUBLE))) AS BIGINT) END FOR i IN range(40)], spos))
OR (ni < 40 AND (bad OR k >= m OR list_contains([CASE WHEN i = k - 1 AND k > 1 THEN m - 1 ELSE CAST(floor(i * (CAST(m - 1 AS DOUBLE) / CAST(greatest(k - 1, 1) AS DOUBLE))) AS BIGINT) END FOR i IN range(k)], spos))))
SELECT row_id, source_file, pos AS row_index FROM kept""")
def enriched_ends(spark, sf):
    return _ends(spark, sf, "issue_enriched")


@query("t06_random_ends", FORECAST.format(valid="TRUE") + " SELECT row_id, source_file, row_index FROM (SELECT row_id, source_file, pos AS row_index, row_number() OVER (PARTITION BY source_file ORDER BY md5(source_file || '|' || pos || '|21'), pos) AS rk FROM ends) WHERE rk <= 40")
def random_ends(spark, sf):
    return _ends(spark, sf, "random")


@query("t08_capped_forecast_windows", FORECAST.format(valid="TRUE") + f", per_source AS ({spread_sql('ends', 27, by='source_file', order='pos')}), capped AS ({spread_sql('per_source', 133, order='source_file, pos')})"
       + HISTORY.format(ends="capped"))
def capped_windows(spark, sf):
    return _flat(_forecast(spark, sf, limit=133))


@query("t07_contiguous_blocks", READINGS + f""", placed AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM readings), blocks AS (SELECT source_file, pos // 48 AS b, count(*) AS rows FROM placed GROUP BY ALL HAVING count(*) >= 13),
chosen AS ({spread_sql('blocks', 42, order='source_file, b')}), budget AS (SELECT *, sum(rows) OVER (ORDER BY source_file, b) - rows AS before FROM chosen)
SELECT p.row_id, p.ts, p.source_file, p.m1, p.m2, p.m3, CAST(p.qc AS BIGINT) AS qc FROM placed p JOIN budget c ON p.source_file = c.source_file AND p.pos // 48 = c.b WHERE c.before + p.pos % 48 < 2000 AND (SELECT count(*) FROM readings) > 2000
UNION ALL SELECT row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) FROM readings WHERE (SELECT count(*) FROM readings) <= 2000""")
def blocks(spark, sf):
    return sequences.contiguous_blocks(readings(spark, sf), PROFILE, max_rows=2000, block_rows=48, lookback=12)


FIXED = READINGS + f""", placed AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM readings WHERE {REVIEWED}),
cells AS (SELECT source_file, pos // 16 AS window_index, row_id, ts, m1, m2, qc, pos % 16 AS step, count(*) OVER (PARTITION BY source_file, pos // 16) AS size FROM placed)"""


@query("w12_fixed_windows", FIXED + f" SELECT source_file, window_index, min(ts) AS window_start, max(ts) AS window_end, {r9('sum(m1 * (step + 1))', 'weighted_m1')}, {r9('sum(m2)', 'sum_m2')}, CAST(sum(qc * (step + 1)) AS BIGINT) AS weighted_label FROM cells WHERE size = 16 GROUP BY source_file, window_index")
def fixed(spark, sf):
    windows = sequences.fixed_windows(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, features=["m1", "m2"], label="qc", size=16)
    add = lambda a, x: a + x
    return windows.select("source_file", "window_index", "window_start", "window_end",
                          F.aggregate(F.transform("steps", lambda s, i: F.get(s, F.lit(0)) * (i + 1)), F.lit(0.0), add).alias("weighted_m1"),
                          F.aggregate(F.transform("steps", lambda s: F.get(s, F.lit(1))), F.lit(0.0), add).alias("sum_m2"),
                          F.aggregate(F.transform("labels", lambda v, i: v * (i + 1)), F.lit(0), add).alias("weighted_label"))


@query("w13_window_labels", FIXED + """, tallied AS (SELECT source_file, window_index, qc, count(*) AS n FROM cells WHERE size = 16 GROUP BY ALL)
SELECT source_file, window_index, CAST(max(qc) AS BIGINT) AS worst, CAST(arg_max(qc, n * 100 + qc) AS BIGINT) AS majority FROM tallied GROUP BY source_file, window_index""")
def labels(spark, sf):
    windows = sequences.fixed_windows(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, features=["m1"], label="qc", size=16)
    return windows.select("source_file", "window_index", sequences.window_label(F.col("labels"), "worst").alias("worst"), sequences.window_label(F.col("labels"), "majority").alias("majority"))


SPLIT_CELLS = READINGS + f""", counted AS (SELECT *, row_number() OVER ({G}) - 1 AS gpos, count(*) OVER () AS gn FROM readings WHERE {REVIEWED}),
split AS (SELECT *, CASE WHEN gpos < floor(gn * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN gpos < floor(gn * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM counted),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, source_file ORDER BY ts, row_id) - 1 AS pos FROM split),
cells AS (SELECT split, source_file, pos // 16 AS window_index, ts, m1, m2, qc, pos % 16 AS step, count(*) OVER (PARTITION BY split, source_file, pos // 16) AS size FROM placed),
targets AS (SELECT split, source_file, window_index, max(qc) AS worst, max(CAST(qc IN (3, 4, 9) AS INT)) AS any_issue FROM cells WHERE size = 16 GROUP BY ALL)"""


def _bundle(spark, sf, **options):
    rows = cleaning.reviewed_target_frame(readings(spark, sf), PROFILE)
    cut = splits.contiguous(rows, PROFILE, 0.70, 0.15)
    return sequences.sequence_bundle(cut, PROFILE, features=["m1", "m2"], size=16, **options)[0]


@query("w14_sequence_targets", SPLIT_CELLS + " SELECT split, source_file, window_index, CAST(worst AS BIGINT) AS y_label, dense_rank() OVER (ORDER BY worst) - 1 AS y FROM targets")
def sequence_targets(spark, sf):
    return _bundle(spark, sf, label="model_target").select("split", "source_file", "window_index", "y_label", "y")


@query("w14_binary_targets", SPLIT_CELLS + " SELECT split, source_file, window_index, CAST(any_issue AS BIGINT) AS y FROM targets")
def binary_targets(spark, sf):
    return _bundle(spark, sf, label="issue", task="binary").select("split", "source_file", "window_index", "y")


@query("w14_per_step_targets", SPLIT_CELLS + """, ranked AS (SELECT *, dense_rank() OVER (ORDER BY qc) - 1 AS y FROM cells WHERE size = 16)
SELECT split, source_file, window_index, CAST(sum(y * (step + 1)) AS BIGINT) AS weighted_y FROM ranked GROUP BY ALL""")
def step_targets(spark, sf):
    b = _bundle(spark, sf, label="model_target", output="step")
    return b.select("split", "source_file", "window_index", F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0), lambda a, x: a + x).alias("weighted_y"))


@query("a23_channel_statistics", SPLIT_CELLS + f""", used AS (SELECT * FROM cells WHERE size = 16 AND split = 'train')
SELECT CAST(0 AS BIGINT) AS channel, {r9('avg(m1)', 'mean')}, {r9('stddev_pop(m1) + 1e-6', 'std')} FROM used UNION ALL SELECT CAST(1 AS BIGINT), {r9('avg(m2)', 'mean')}, {r9('stddev_pop(m2) + 1e-6', 'std')} FROM used""")
def channel_statistics(spark, sf):
    return sequences.channel_statistics(_bundle(spark, sf, label="model_target").where("split = 'train'"), 2)


@query("w15_normalised_windows", SPLIT_CELLS + f""", fit AS (SELECT avg(m1) AS a1, stddev_pop(m1) + 1e-6 AS s1, avg(m2) AS a2, stddev_pop(m2) + 1e-6 AS s2 FROM cells WHERE size = 16 AND split = 'train')
SELECT split, source_file, window_index, {r9('sum((m1 - (SELECT a1 FROM fit)) / (SELECT s1 FROM fit) * (step + 1))', 'weighted_m1').replace(', 9)', ', 7)')},
{r9('sum((m2 - (SELECT a2 FROM fit)) / (SELECT s2 FROM fit))', 'sum_m2').replace(', 9)', ', 7)')} FROM cells WHERE size = 16 GROUP BY split, source_file, window_index""")
def normalised(spark, sf):
    w = sequences.normalise_windows(_bundle(spark, sf, label="model_target"), 2)
    add = lambda a, x: a + x
    return w.select("split", "source_file", "window_index",
                    F.round(F.aggregate(F.transform("steps", lambda s, i: F.get(s, F.lit(0)) * (i + 1)), F.lit(0.0), add), 7).alias("weighted_m1"),
                    F.round(F.aggregate(F.transform("steps", lambda s: F.get(s, F.lit(1))), F.lit(0.0), add), 7).alias("sum_m2"))


@query("w16_sequence_features", READINGS + f""", built AS (SELECT row_id, {deltas_sql(W)}, {rolling_sql(W, (5,))}, {r9('sin(2 * pi() * hour(make_timestamp(ts)) / 24)', 'hour_sin')},
{r9('cos(2 * pi() * hour(make_timestamp(ts)) / 24)', 'hour_cos')}, {r9('sin(2 * pi() * dayofyear(make_timestamp(ts)) / 366)', 'doy_sin')}, {r9('cos(2 * pi() * dayofyear(make_timestamp(ts)) / 366)', 'doy_cos')},
CASE WHEN qc IN (3, 4) THEN 34 WHEN qc IN (1, 9) THEN qc END AS t FROM readings) SELECT * EXCLUDE (t), CAST(t AS BIGINT) AS model_target FROM built WHERE t IS NOT NULL""")
def sequence_features(spark, sf):
    built = features.sequence_features(readings(spark, sf), PROFILE, strategy="collapsed_1_34_9")
    return built.drop("ts", "source_file", "m1", "m2", "m3", "qc")


@query("t01_evenly_spaced_take", READINGS + f", taken AS ({spread_sql('readings', 321)}) SELECT {ROW} FROM taken")
def take(spark, sf):
    return ordering.evenly_spaced_take(readings(spark, sf), 321, order=PROFILE.global_order)


@query("t01_take_per_source", READINGS + f", taken AS ({spread_sql('readings', 77, by='source_file', order='ts, row_id')}) SELECT {ROW} FROM taken")
def take_per_source(spark, sf):
    return ordering.evenly_spaced_take(readings(spark, sf), 77, by=["source_file"], order=["ts", "row_id"])


@query("t02_time_spread_subset", READINGS + f", reviewed AS (SELECT * FROM readings WHERE {REVIEWED}), taken AS ({spread_sql('reviewed', 1000)}) SELECT {ROW} FROM taken")
def time_spread(spark, sf):
    return sampling.time_spread(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, 1000)


def focused_sql(by: str, limit: int, issue_rows: int) -> str:
    cols = f"by='{by}'" if by else ""
    order = "ts, row_id" if by else "ts, source_file, row_id"
    return (f", base AS ({spread_sql('readings', limit - issue_rows, by=by, order=order)}), extra AS ({spread_sql('readings', issue_rows, by=by, order=order, where='qc IN (3, 4, 9)')}), "
            f"pooled AS (SELECT * FROM base UNION SELECT * FROM extra), taken AS ({spread_sql('pooled', limit, by=by, order=order)}) SELECT {ROW} FROM taken")


@query("t03_issue_focused_subset", READINGS + focused_sql("", 1500, 400))
def focused(spark, sf):
    return sampling.issue_focused(readings(spark, sf), PROFILE, 1500, 400)


@query("t05_issue_focused_per_part", READINGS + focused_sql("source_file", 300, 90))
def focused_per_part(spark, sf):
    return sampling.issue_focused(readings(spark, sf), PROFILE, 300, 90, by=["source_file"])


def side_sql(limit: str, side: str, by: str, order: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT * EXCLUDE (sp, sn, k) FROM (SELECT *, row_number() OVER ({part}ORDER BY {order}) - 1 AS sp, count(*) OVER ({part}) AS sn, {limit} AS k FROM sized WHERE {side})
WHERE k >= sn OR (k > 0 AND list_contains([CASE WHEN i = k - 1 AND k > 1 THEN sn - 1 ELSE CAST(floor(i * (CAST(sn - 1 AS DOUBLE) / CAST(greatest(k - 1, 1) AS DOUBLE))) AS BIGINT) END FOR i IN range(k)], sp))"""


def balanced_sql(limit: int, share: float, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    order = "ts, row_id" if by else "ts, source_file, row_id"
    quota = f"least({round(limit * share)}, ni)"
    return (f", sized AS (SELECT *, count(*) FILTER (qc IN (3, 4, 9)) OVER ({part}) AS ni FROM readings WHERE qc IN (1, 3, 4, 9)), "
            f"issue_side AS ({side_sql(quota, 'qc IN (3, 4, 9)', by, order)}), good_side AS ({side_sql(f'{limit} - {quota}', 'qc = 1', by, order)}) "
            f"SELECT {ROW} FROM issue_side UNION ALL SELECT {ROW} FROM good_side")


@query("t04_balanced_subset", READINGS + balanced_sql(1200, 0.4))
def balanced(spark, sf):
    return sampling.balanced_reviewed(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, 1200, 0.4, stratify=False)


@query("t05_balanced_per_part", READINGS + balanced_sql(250, 0.5, "source_file"))
def balanced_per_part(spark, sf):
    return sampling.balanced_reviewed(cleaning.reviewed_rows(readings(spark, sf), PROFILE), PROFILE, 250, 0.5, by=["source_file"], stratify=False)


STRATA = READINGS + """, quota AS (SELECT least(480, count(*)) AS qi FROM readings WHERE qc IN (3, 4, 9)),
strata AS (SELECT r.*, row_number() OVER (PARTITION BY qc ORDER BY ts, source_file, row_id) - 1 AS lp, count(*) OVER (PARTITION BY qc) AS ln,
CASE WHEN qc = 1 THEN 1200 - qi ELSE CAST(ceil(CAST(qi AS DOUBLE) / 3) AS BIGINT) END AS k, qc <> 1 AS bad FROM readings r, quota WHERE qc IN (1, 3, 4, 9)),
stratum AS (SELECT * FROM strata WHERE k >= ln OR list_contains([CASE WHEN i = k - 1 THEN ln - 1 ELSE CAST(floor(i * (CAST(ln - 1 AS DOUBLE) / CAST(k - 1 AS DOUBLE))) AS BIGINT) END FOR i IN range(k)], lp)),
sides AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ts, source_file, row_id) - 1 AS gp, count(*) OVER (PARTITION BY bad) AS gn, CASE WHEN bad THEN qi ELSE 1200 - qi END AS t FROM strata, quota),
spare AS (SELECT row_id FROM sides WHERE t >= gn OR list_contains([CASE WHEN i = t - 1 THEN gn - 1 ELSE CAST(floor(i * (CAST(gn - 1 AS DOUBLE) / CAST(t - 1 AS DOUBLE))) AS BIGINT) END FOR i IN range(t)], gp)),
short AS (SELECT s.bad, count(*) < max(CASE WHEN s.bad THEN qi ELSE 1200 - qi END) AS refill FROM stratum s, quota GROUP BY s.bad),
pool AS (SELECT x.*, CASE WHEN x.bad THEN qi ELSE 1200 - qi END AS t FROM strata x JOIN short USING (bad), quota WHERE x.row_id IN (SELECT row_id FROM stratum) OR (refill AND x.row_id IN (SELECT row_id FROM spare))),
final AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ts, source_file, row_id) - 1 AS fp, count(*) OVER (PARTITION BY bad) AS fn FROM pool)
SELECT row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) AS qc FROM final WHERE (SELECT count(*) FROM readings) > 1200 AND (t >= fn OR list_contains([CASE WHEN i = t - 1 THEN fn - 1 ELSE CAST(floor(i * (CAST(fn - 1 AS DOUBLE) / CAST(t - 1 AS DOUBLE))) AS BIGINT) END FOR i IN range(t)], fp))
UNION ALL SELECT row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) FROM readings WHERE (SELECT count(*) FROM readings) <= 1200"""


@query("t04_balanced_stratified_subset", STRATA)
def stratified(spark, sf):
    return sampling.balanced_reviewed(readings(spark, sf), PROFILE, 1200, 0.4)


@query("t10_auto_range", READINGS + f""", hits AS (SELECT ts, row_number() OVER ({G}) - 1 AS h, count(*) OVER () AS hn FROM readings WHERE qc = 4),
center AS (SELECT ts AS c FROM hits WHERE h = hn // 2), near AS (SELECT r.*, row_number() OVER ({G}) - 1 AS p, count(*) OVER () AS n FROM readings r, center
WHERE ts BETWEEN c - 43200000000 AND c + 43200000000) SELECT {ROW} FROM near WHERE n <= 120 OR p BETWEEN greatest(least(greatest(n // 2 - 60, 0) + 120, n) - 120, 0) AND least(greatest(n // 2 - 60, 0) + 120, n) - 1""")
def auto_range(spark, sf):
    return selection.select_range(readings(spark, sf), PROFILE, max_points=120, max_hours=24.0)[0]


@query("t10_index_range", READINGS + f""", numbered AS (SELECT *, row_number() OVER ({G}) - 1 AS p, count(*) OVER () AS n FROM readings),
hits AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS h, count(*) OVER () AS hn FROM numbered WHERE qc = 4), center AS (SELECT p AS c FROM hits WHERE h = hn // 2)
SELECT {ROW} FROM numbered, center WHERE p BETWEEN greatest(least(greatest(c - 400, 0) + 800, n) - 800, 0) AND least(greatest(c - 400, 0) + 800, n) - 1""")
def index_range(spark, sf):
    return selection.select_range(readings(spark, sf), PROFILE, max_hours=None)[0]


@query("s18_context_panel", READINGS + f""", placed AS (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY source_file) AS n FROM readings),
best AS (SELECT source_file, arg_min(p, struct_pack(d := abs(ts - epoch_us(TIMESTAMP '2024-01-30 20:00:00')), p := p)) AS b, max(n) AS n FROM placed GROUP BY source_file),
panel AS (SELECT source_file, CASE WHEN least(greatest(b - 60, 0) + 120, n) - greatest(b - 60, 0) < 120 THEN greatest(least(greatest(b - 60, 0) + 120, n) - 120, 0) ELSE greatest(b - 60, 0) END AS lo, least(greatest(b - 60, 0) + 120, n) AS hi FROM best)
SELECT {ROW} FROM placed JOIN panel USING (source_file) WHERE p >= lo AND p < hi""")
def context_panel(spark, sf):
    return selection.context_panel(readings(spark, sf), PROFILE, "2024-01-30 20:00:00", 120)


PANELS = RUNS + """, counts AS (SELECT source_file, count(*) AS n FROM readings GROUP BY source_file),
mids AS (SELECT source_file, label, first_row, last_row, (first_row + last_row) // 2 AS mid, n FROM spans JOIN counts USING (source_file) WHERE label IN (3, 4, 9)),
panels AS (SELECT *, least(greatest(mid - 12, 0) + 24, n) AS hi, CASE WHEN least(greatest(mid - 12, 0) + 24, n) - greatest(mid - 12, 0) < 24 THEN greatest(least(greatest(mid - 12, 0) + 24, n) - 24, 0) ELSE greatest(mid - 12, 0) END AS lo FROM mids)"""


@query("s19_flag_context_sample", PANELS + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY source_file, first_row) AS rk FROM panels)
SELECT DISTINCT i.row_id, i.ts, i.source_file, i.m1, i.m2, i.m3, CAST(i.qc AS BIGINT) AS qc FROM islands i JOIN ranked r ON i.source_file = r.source_file AND i.pos >= r.lo AND i.pos < r.hi WHERE rk <= 5""")
def flag_context(spark, sf):
    return selection.flag_context_sample(readings(spark, sf), PROFILE, [3, 4, 9], 24, 5)


@query("t11_panel_scores", PANELS + f""", cells AS (SELECT p.source_file, p.label, p.first_row, p.mid, p.lo, p.hi, i.ts, i.qc FROM panels p JOIN islands i ON i.source_file = p.source_file AND i.pos >= p.lo AND i.pos < p.hi),
shares AS (SELECT source_file, label, first_row, mid AS middle_row, lo AS panel_start, hi AS panel_stop, avg(CASE WHEN qc = label THEN 1 ELSE 0 END) AS target_share, avg(CASE WHEN qc = 9 AND label <> 9 THEN 1 ELSE 0 END) AS avoid_share,
(max(ts) - min(ts)) / 1e6 / greatest(hi - lo - 1, 1) / 60 AS gap_minutes, (mid - lo) / CAST(greatest(hi - lo - 1, 1) AS DOUBLE) AS target_position FROM cells GROUP BY source_file, label, first_row, mid, lo, hi)
SELECT source_file, label, first_row, middle_row, panel_start, panel_stop, {r9('target_share', 'target_share')}, {r9('avoid_share', 'avoid_share')},
{r9('3.0 + 0.5 + least(target_share, 0.25) * 2.0 - avoid_share * 6.0 - ln(1 + gap_minutes) * 0.8 - abs(target_position - 0.5) * 4.0', 'score')} FROM shares""")
def panel_scores(spark, sf):
    scored = selection.panel_scores(readings(spark, sf), PROFILE, [3, 4, 9], 24, measurement="m1", secondary="m2", avoid=[9])
    return scored.select("source_file", "label", "first_row", "middle_row", "panel_start", "panel_stop", "target_share", "avoid_share", "score")


SCORED = PANELS + """, cells AS (SELECT p.source_file, p.label, p.first_row, p.mid, p.lo, p.hi, i.ts, i.qc FROM panels p JOIN islands i ON i.source_file = p.source_file AND i.pos >= p.lo AND i.pos < p.hi),
shares AS (SELECT source_file, label, first_row, mid AS middle_row, lo AS panel_start, hi AS panel_stop, min(ts) AS panel_from, max(ts) AS panel_to, CAST(1 AS DOUBLE) AS measurement_share, CAST(1 AS DOUBLE) AS secondary_share,
avg(CASE WHEN qc = label THEN 1 ELSE 0 END) AS target_share, avg(CASE WHEN qc = 9 AND label <> 9 THEN 1 ELSE 0 END) AS avoid_share,
(max(ts) - min(ts)) / 1e6 / greatest(hi - lo - 1, 1) / 60 AS gap_minutes, (mid - lo) / CAST(greatest(hi - lo - 1, 1) AS DOUBLE) AS target_position FROM cells GROUP BY source_file, label, first_row, mid, lo, hi),
scored AS (SELECT *, 3.0 + 0.5 + least(target_share, 0.25) * 2.0 - avoid_share * 6.0 - ln(1 + gap_minutes) * 0.8 - abs(target_position - 0.5) * 4.0 AS raw FROM shares)"""


def overlap_sql(used: str) -> str:
    return f"coalesce((SELECT sum(greatest(0, least(s.panel_to, u.panel_to) - greatest(s.panel_from, u.panel_from)) / 1e6 / greatest(1, (s.panel_to - s.panel_from) / 1e6)) FROM {used} u), 0)"


def pick_sql(label: int, used: str) -> str:
    return f"SELECT * FROM (SELECT s.*, raw - 8 * {overlap_sql(used) if used else '0'} AS score FROM scored s WHERE label = {label}) ORDER BY round(score, 9) DESC, source_file, first_row LIMIT 1"


BEST = (SCORED + f", b3 AS ({pick_sql(3, '')}), b4 AS ({pick_sql(4, 'b3')}), used4 AS (SELECT * FROM b3 UNION ALL SELECT * FROM b4), b9 AS ({pick_sql(9, 'used4')}) SELECT source_file, label, first_row, middle_row, panel_start, panel_stop, panel_from, panel_to, "
        + ", ".join(r9(c, c) for c in ("measurement_share", "secondary_share", "target_share", "avoid_share", "gap_minutes", "target_position", "score")) + " FROM (SELECT * FROM used4 UNION ALL SELECT * FROM b9)")


@query("t11_best_panels", BEST)
def best_panels(spark, sf):
    return selection.best_panels(readings(spark, sf), PROFILE, [3, 4, 9], 24, measurement="m1", secondary="m2", avoid=[9])
