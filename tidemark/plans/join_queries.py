"""Key joins, as-of joins, export ingestion and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.names import device_family, name_time, series_key
from tidemark.operators import asof, cleaning, intervals, ordering, selection, splits
from tidemark.operators.features import window_features
from tidemark.plans.registry import PROFILE, READINGS, query, r9, readings, spread_sql, table
from tidemark.plans.row_queries import NAMES, export_names
from tidemark.plans.sequence_queries import RUNS, window_sql
from tidemark.plans.split_queries import GLOBAL, global_contiguous, reviewed
from tidemark.session import scratch_path, settle
from tidemark.sources import datasets, exports

W = "PARTITION BY source_file ORDER BY ts, row_id"
ROW = "row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) AS qc"
TOLERANCE = 600_000_000


# --- as-of joins -------------------------------------------------------------

def nearest_sql(left: str, right: str, value: str, key: str = "") -> str:
    """Nearest right row by enumerating every right row within the tolerance."""
    on = f"AND l.{key} = r.{key}" if key else ""
    return f"""(SELECT l.row_id, r.{value}, abs(l.ts - r.ts) AS gap, row_number() OVER (PARTITION BY l.row_id ORDER BY abs(l.ts - r.ts), CASE WHEN r.ts <= l.ts THEN 0 ELSE 1 END,
CASE WHEN r.ts <= l.ts THEN -r.row_id ELSE r.row_id END) AS rk FROM {left} l JOIN {right} r ON r.ts BETWEEN l.ts - {TOLERANCE} AND l.ts + {TOLERANCE} {on})"""


# Every source has two companions, the next two in order of their names; `pair` names the source they belong to.
SOURCES = ("click", "error", "purchase", "signup", "view")


def pair_sql(step: int) -> str:
    return "CASE source_file " + " ".join(f"WHEN '{SOURCES[(i + step) % 5]}' THEN '{s}'" for i, s in enumerate(SOURCES)) + " END AS pair"


def pair(step: int):
    found = F.lit(None).cast("string")
    for i, s in enumerate(SOURCES):
        found = F.when(F.col("source_file") == SOURCES[(i + step) % 5], s).otherwise(found)
    return found.alias("pair")


DEVICES = READINGS + ", primary_rows AS (SELECT *, source_file AS pair FROM readings)" + "".join(f", companion{k} AS (SELECT *, {pair_sql(k)} FROM readings)" for k in (1, 2))


@query("j01_nearest_join", DEVICES + f" SELECT l.row_id, l.ts, l.m1, l.pair, n.m2 AS m2_near, n.gap FROM primary_rows l LEFT JOIN {nearest_sql('primary_rows', 'companion1', 'm2', 'pair')} n ON n.row_id = l.row_id AND n.rk = 1")
def nearest(spark, sf):
    rows = readings(spark, sf)
    left, right = rows.select("row_id", "ts", "m1", F.col("source_file").alias("pair")), rows.select("row_id", "ts", "m2", pair(1))
    return asof.nearest_join(left, right, time="ts", by=["pair"], left_tie="row_id", right_tie="row_id", columns=["m2"], tolerance_seconds=600, suffix="_near", gap="gap")


SHIFTED = """WITH items AS (SELECT l_returnflag AS k, epoch_us(l_shipdate) AS ts, l_orderkey AS row_id, l_quantity AS q, l_discount AS d FROM lineitem),
lhs AS (SELECT k, ts, row_number() OVER (ORDER BY k, ts) AS row_id, max(q) AS q FROM items GROUP BY k, ts), rhs AS (SELECT k, ts + 250000000 * (row_id % 7) - 700000000 AS ts, row_id, min(d) AS d FROM items GROUP BY k, items.ts + 250000000 * (row_id % 7) - 700000000, row_id)"""


@query("j01_nearest_join_by_key", SHIFTED + f" SELECT l.k, l.ts, l.q, n.d, n.gap FROM lhs l LEFT JOIN {nearest_sql('lhs', 'rhs', 'd', 'k')} n ON n.row_id = l.row_id AND n.rk = 1")
def nearest_by_key(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), F.col("l_orderkey").alias("row_id"),
                                                F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    left = items.groupBy("k", F.timestamp_micros("t").alias("ts")).agg(F.min("row_id").alias("row_id"), F.max("q").alias("q"))
    moved = F.timestamp_micros(F.col("t") + F.lit(250_000_000) * (F.col("row_id") % 7) - 700_000_000).alias("ts")
    right = items.groupBy("k", moved, "row_id").agg(F.min("d").alias("d"))
    found = asof.nearest_join(left, right, time="ts", by=["k"], left_tie="row_id", right_tie="row_id", columns=["d"], tolerance_seconds=600, gap="gap")
    return found.select("k", "ts", "q", "d", "gap")


CHAIN = DEVICES + f""", step1 AS (SELECT l.row_id, l.ts, l.m1, l.pair, n.m1 AS "m1 [fluorometer]" FROM primary_rows l LEFT JOIN {nearest_sql('primary_rows', 'companion1', 'm1', 'pair')} n ON n.row_id = l.row_id AND n.rk = 1),
step2 AS (SELECT s.*, n.m1 AS "m1 [oxygen]" FROM step1 s LEFT JOIN {nearest_sql('primary_rows', 'companion2', 'm1', 'pair')} n ON n.row_id = s.row_id AND n.rk = 1)"""


@query("j02_companion_chain", CHAIN + " SELECT * FROM step2")
def chain(spark, sf):
    rows = readings(spark, sf)
    part = lambda k: rows.select("row_id", "ts", "m1", pair(k))
    return asof.join_companions(part(0), [("fluorometer", part(1)), ("oxygen", part(2))], time="ts", by=["pair"], tie="row_id", tolerance_seconds=600)


@query("p04_companion_names", DEVICES + " SELECT row_id, ts, m1, m2, m1 AS \"m1 [oxygen]\", m3 FROM readings")
def companion_rename(spark, sf):
    rows = readings(spark, sf)
    names = asof.companion_names(["ts", "m1", "m2"], "oxygen", ["m1", "m3"])
    merged = asof.merged_columns(["ts", "m1", "m2"], [("oxygen", ["m1", "m3"])], fixed=("ts", "row_id"))
    doubled = rows.select("row_id", "ts", "m1", "m2", F.col("m1").alias(names["m1"]), F.col("m3").alias(names["m3"]))
    return doubled.select(*[f"`{c}`" for c in merged])


BEST = NAMES + """, infos AS (SELECT name, 'Site' || CAST(user_id AS VARCHAR) AS sk, CASE event_type WHEN 'click' THEN 'ctd' WHEN 'view' THEN 'fluorometer' ELSE 'x' END AS device, epoch_us(d) AS a, epoch_us(d + INTERVAL 1 DAY) + 250000 AS b FROM names),
pairs AS (SELECT p.name, c.name AS companion, p.a = c.a AND p.b = c.b AS exact, greatest(0, (least(p.b, c.b) - greatest(p.a, c.a)) / 1e6) AS overlap_seconds, abs(p.a - c.a) AS ga, abs(p.b - c.b) AS gb
FROM infos p JOIN infos c ON p.sk = c.sk AND p.device = 'ctd' AND c.device = 'fluorometer')
SELECT name, companion, exact, """ + r9("overlap_seconds", "overlap_seconds") + " FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY exact DESC, overlap_seconds DESC, ga, gb, companion) AS rk FROM pairs) WHERE rk = 1"


@query("j03_best_companions", BEST)
def best_companions(spark, sf):
    name = F.col("name")
    infos = export_names(spark, sf).select("name", device_family(name).alias("device"), series_key(name).alias("series_key"), name_time(name, 1).alias("start_time"), name_time(name, 2).alias("end_time"))
    # Both sides and every step read the parsed names, so they are made from the events once.
    infos = settle(infos.where(F.col("device").isin("ctd", "fluorometer")))
    pick = lambda d: infos.where(F.col("device") == d).drop("device")
    return asof.best_companions(pick("ctd"), pick("fluorometer"))


# --- joins by key and range ----------------------------------------------------

TAKEN = READINGS + f", picked AS ({spread_sql('readings', 1500)})"


@query("j04_select_by_keys", TAKEN + f" SELECT {ROW} FROM readings r WHERE EXISTS (SELECT 1 FROM picked p WHERE p.source_file = r.source_file AND p.ts = r.ts)")
def select_by_keys(spark, sf):
    rows = readings(spark, sf)
    keys = ordering.evenly_spaced_take(rows.select("source_file", "ts", "row_id"), 1500, order=PROFILE.global_order)
    return selection.select_by_keys(rows, keys, ["source_file", "ts"])


@query("j05_features_for_splits", GLOBAL + " SELECT r.source_file, r.ts, r.m1, r.m3, s.split, s.qc AS model_target, CAST(s.qc <> 1 AS BIGINT) AS issue FROM readings r JOIN split s ON r.source_file = s.source_file AND r.ts = s.ts")
def split_features(spark, sf):
    cut = splits.split_by_strategy(cleaning.reviewed_target_frame(reviewed(spark, sf), PROFILE), PROFILE, "global_contiguous")
    return selection.features_for_splits(readings(spark, sf).select("source_file", "ts", "m1", "m3"), cut, PROFILE)


@query("j06_not_selected", TAKEN + f" SELECT {ROW} FROM readings r WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.source_file = r.source_file AND p.ts = r.ts)")
def not_selected(spark, sf):
    rows = readings(spark, sf)
    keys = ordering.evenly_spaced_take(rows.select("source_file", "ts", "row_id"), 1500, order=PROFILE.global_order)
    return selection.not_selected(rows, keys, ["source_file", "ts"]).select(*rows.columns)


WINDOWS = READINGS + f", placed AS (SELECT *, (row_number() OVER ({W}) - 1) // 64 AS window_id FROM readings)"


@query("j07_windows_of_sources", WINDOWS + " SELECT source_file, window_id, count(*) AS row_count FROM placed WHERE source_file IN ('click', 'view') GROUP BY ALL")
def windows_of_sources(spark, sf):
    rows = readings(spark, sf)
    chosen = rows.where(F.col("source_file").isin("click", "view")).select("source_file").distinct()
    return cleaning.attach_small(window_features(rows, PROFILE, 64), chosen, ["source_file"], "left_semi").select("source_file", "window_id", "row_count")


@query("j08_intervals_in_range", RUNS + ' SELECT source_file, label, start, "end" FROM spans WHERE start <= epoch_us(TIMESTAMP \'2024-01-20 00:00:00\') AND "end" >= epoch_us(TIMESTAMP \'2024-01-10 00:00:00\')')
def intervals_in_range(spark, sf):
    runs = intervals.label_runs(readings(spark, sf), time="ts", label=F.col("qc"), order=["ts", "row_id"], by=["source_file"])
    return intervals.intervals_in_range(runs, "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("source_file", "label", "start", "end")


@query("j09_interval_origin", GLOBAL + """, spans AS (SELECT split, min(ts) AS lo, max(ts) AS hi FROM split GROUP BY split), hit AS (SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS k FROM spans
WHERE lo <= epoch_us(TIMESTAMP '2024-01-24 00:00:00') AND hi >= epoch_us(TIMESTAMP '2024-01-20 00:00:00')) SELECT CASE count(*) WHEN 0 THEN 'outside modeled range' WHEN 1 THEN min(split) ELSE 'mixed (' || string_agg(split, ', ' ORDER BY k) || ')' END AS origin FROM hit""")
def interval_origin(spark, sf):
    return selection.interval_origin(global_contiguous(spark, sf), "ts", "2024-01-20 00:00:00", "2024-01-24 00:00:00")


@query("j10_materialised_splits", GLOBAL + " SELECT r.row_id, r.ts, r.source_file, r.m1, r.m2, r.m3, CAST(r.qc AS BIGINT) AS qc, s.split, CAST(r.qc <> 1 AS BIGINT) AS issue, CAST(r.qc AS BIGINT) AS model_target FROM readings r JOIN split s ON r.source_file = s.source_file AND r.ts = s.ts WHERE r.qc IN (1, 3, 4, 9)")
def materialised(spark, sf):
    return selection.materialise_splits(readings(spark, sf), global_contiguous(spark, sf), PROFILE)


@query("j11_labels_in_windows", WINDOWS + """, rated AS (SELECT source_file, window_id FROM placed GROUP BY ALL HAVING avg(CASE WHEN qc IN (3, 4, 9) THEN 1 ELSE 0 END) >= 0.2)
SELECT source_file, window_id, CAST(qc AS BIGINT) AS label, count(*) AS rows FROM placed JOIN rated USING (source_file, window_id) GROUP BY source_file, window_id, qc""")
def labels_in_windows(spark, sf):
    rows = readings(spark, sf)
    rated = window_features(rows, PROFILE, 64).where(F.col("issue_rate") >= 0.2)
    return selection.rows_in_windows(rows, rated, PROFILE, 64)


# --- exports: the readings written as instrument files, then read back ----------

EXPORTED = READINGS + """, cells AS (SELECT source_file AS src, source_file || '_' || strftime(make_timestamp(ts), '%Y%m%d') || '.csv' AS source_file, ts, row_id, m1, CASE WHEN m2 < 15 THEN NULL ELSE m2 END AS m2, m3, CAST(qc AS DOUBLE) AS qc FROM readings),
typed AS (SELECT ts AS "Time UTC", m1, m2, CASE WHEN src = 'view' THEN NULL ELSE m3 END AS m3, CASE WHEN src = 'search' THEN NULL ELSE qc END AS qc, source_file, row_id FROM cells)"""


def exported(spark, sf):
    """Write the readings once as exports of differing layout; give their lines and headers."""
    rows = readings(spark, sf).withColumn("m2", F.when(F.col("m2") >= 15, F.col("m2")))
    kind = F.when(F.col("source_file").isin("view", "search", "error"), F.col("source_file")).otherwise("plain")
    name = F.concat("source_file", F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv"))
    path = scratch_path(spark, "exports")
    exports.write_exports(rows, path, name=name, time="ts", kind=kind, order=["ts", "row_id"], columns={
        "plain": ["m1", "m2", "m3", "qc"], "view": ["m1", "m2", "qc"], "error": ["qc", "m3", "m2", "m1"], "search": ["m1", "m2", "m3"]})
    lines = exports.export_lines(spark, path, named_by="folder")
    return lines, exports.export_headers(lines)


@query("s02_scan_exports", EXPORTED + ' SELECT "Time UTC", m1, m2, m3, qc, source_file FROM typed')
def scan_exports(spark, sf):
    lines, headers = exported(spark, sf)
    return exports.read_exports(lines, headers, columns=["m1", "m2", "m3", "qc"])


@query("s03_scan_plain_tables", EXPORTED + ' SELECT "Time UTC", m2, qc, source_file FROM typed')
def scan_plain(spark, sf):
    lines, _ = exported(spark, sf)
    headers = exports.export_headers(lines, header_row=2)
    named = headers.withColumn("columns", F.transform("columns", lambda c: F.when(c.contains("Time UTC"), "Time UTC").otherwise(c)))
    return exports.read_exports(lines, named, columns=["m2", "qc"])


@query("s03_scan_quoted_tables", "SELECT doc_id * 1000000 AS \"Time UTC\", CAST(n_chars AS DOUBLE) AS n_chars, CAST(doc_id AS DOUBLE) AS doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS breaks FROM documents")
def scan_quoted(spark, sf):
    """Texts with line breaks and quotes inside quoted fields, written as a table and read back line by line."""
    path = scratch_path(spark, "quoted")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.date_format(F.timestamp_seconds("doc_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time UTC"), "text", "n_chars", "doc_id")
    rows.write.option("header", True).option("escape", '"').csv(path)
    records = exports.csv_records(exports.export_lines(spark, path))
    table = exports.read_exports(records, exports.export_headers(records, header_row=0), columns=["text", "n_chars", "doc_id"], text=["text"])
    text = F.coalesce("text", F.lit(""))
    return table.select("Time UTC", "n_chars", "doc_id", F.md5(text.cast("binary")).alias("text_md5"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("breaks"))


@query("s04_available_columns", EXPORTED + """, names AS (SELECT DISTINCT source_file, src FROM cells), heads AS (SELECT source_file, unnest(CASE src WHEN 'view' THEN ['Time UTC', 'm1', 'm2', 'qc'] WHEN 'error' THEN ['Time UTC', 'qc', 'm3', 'm2', 'm1'] WHEN 'search' THEN ['Time UTC', 'm1', 'm2', 'm3'] ELSE ['Time UTC', 'm1', 'm2', 'm3', 'qc'] END) AS name,
unnest(range(CASE src WHEN 'view' THEN 4 WHEN 'search' THEN 4 ELSE 5 END)) AS pos FROM names)
SELECT name, first_export, position FROM (SELECT name, source_file AS first_export, pos AS position, row_number() OVER (PARTITION BY name ORDER BY source_file, pos) AS rk FROM heads) WHERE rk = 1""")
def columns_seen(spark, sf):
    return exports.available_columns(exported(spark, sf)[1])


@query("s05_exports_with_columns", EXPORTED + " SELECT DISTINCT source_file AS export FROM cells WHERE src NOT IN ('view', 'search')")
def complete_exports(spark, sf):
    return exports.exports_with_columns(exported(spark, sf)[1], ["m3", "qc"])


@query("s06_first_rows_per_export", EXPORTED + ' SELECT "Time UTC", m1, source_file FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY "Time UTC", row_id) AS rk FROM typed) WHERE rk <= 25')
def first_rows(spark, sf):
    lines, headers = exported(spark, sf)
    return exports.read_exports(lines, headers, columns=["m1"], first_rows=25)


@query("p03_source_stamp", EXPORTED + " SELECT source_file, count(*) AS rows FROM typed GROUP BY source_file")
def source_stamp(spark, sf):
    lines, headers = exported(spark, sf)
    return exports.read_exports(lines, headers, columns=["m1"]).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


# --- datasets ----------------------------------------------------------------

def stored(spark, sf):
    path = scratch_path(spark, "rows")
    datasets.write_rows(readings(spark, sf), path, PROFILE)
    return datasets.read_rows(spark, path)


PARTS = " SELECT source_file, count(*) AS row_count, min(ts) AS time_start, max(ts) AS time_end, count(qc) AS labelled_rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows FROM readings GROUP BY source_file"


@query("s08_row_dataset", READINGS + PARTS)
def row_dataset(spark, sf):
    return datasets.manifest_parts(stored(spark, sf), PROFILE)


MERGED = DEVICES + f""", near AS {nearest_sql('primary_rows', 'companion1', 'm1', 'pair')}, near2 AS {nearest_sql('primary_rows', 'companion2', 'm3', 'pair')}
SELECT l.row_id, l.ts, l.m1, CAST(l.qc AS BIGINT) AS qc, a.m1 AS "m1 [fluorometer]", b.m3, CAST(NULL AS DOUBLE) AS salinity, l.source_file FROM primary_rows l LEFT JOIN near a ON a.row_id = l.row_id AND a.rk = 1 LEFT JOIN near2 b ON b.row_id = l.row_id AND b.rk = 1"""


@query("s09_merged_row_dataset", MERGED)
def merged_dataset(spark, sf):
    rows = readings(spark, sf)
    primary = rows.select("row_id", "ts", "m1", "qc", "source_file", pair(0))
    companions = [("fluorometer", rows.select("row_id", "ts", "m1", pair(1))), ("oxygen", rows.select("row_id", "ts", "m3", pair(2)))]
    merged = asof.join_companions(primary, companions, time="ts", by=["pair"], tie="row_id", tolerance_seconds=600)
    padded = cleaning.pad_columns(merged, ["row_id", "ts", "m1", "qc", "m1 [fluorometer]", "m3", "salinity", "source_file"])
    path = scratch_path(spark, "merged")
    datasets.write_rows(padded, path, PROFILE)
    return datasets.read_rows(spark, path)


@query("s10_window_dataset", READINGS + window_sql("readings", "ts, row_id", 64))
def window_dataset(spark, sf):
    path = scratch_path(spark, "windows")
    datasets.write_windows(stored(spark, sf), path, PROFILE, 64)
    return spark.read.parquet(path)


@query("s11_manifest_summary", READINGS + f""" SELECT 'qc' AS target, count(*) AS row_count, {r9('count(*) FILTER (qc IN (3, 4, 9)) / CAST(count(*) AS DOUBLE)', 'issue_fraction')}, CAST(64 AS BIGINT) AS window_size,
count(*) FILTER (qc = 0) AS n0, count(*) FILTER (qc = 1) AS n1, count(*) FILTER (qc = 2) AS n2, count(*) FILTER (qc = 3) AS n3, count(*) FILTER (qc = 4) AS n4, count(*) FILTER (qc = 9) AS n9, 'm1,m2,m3' AS measurements FROM readings""")
def manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    datasets.write_manifest(readings(spark, sf), path, PROFILE, window_rows=64)
    summary = datasets.read_manifest(spark, path)[1]
    return summary.select("target", "row_count", "issue_fraction", "window_size", *[F.try_element_at("target_distribution", F.lit(k)).alias(f"n{k}") for k in ("0", "1", "2", "3", "4", "9")],
                          F.array_join("measurement_columns", ",").alias("measurements"))


@query("s11_manifest_merged", READINGS + """, named AS (SELECT *, CASE WHEN source_file = 'click' THEN 'Fluorometer' ELSE '' END || source_file AS name FROM readings), wins AS (SELECT name, (count(*) + 63) // 64 AS w FROM named GROUP BY name)
SELECT count(*) AS row_count, count(DISTINCT name) AS processed_file_count, (SELECT CAST(sum(w) AS BIGINT) FROM wins) AS window_count, count(DISTINCT name) FILTER (name LIKE 'Fluorometer%') AS fluorometer_files, count(DISTINCT name) FILTER (name NOT LIKE 'Fluorometer%') AS other_files,
count(*) FILTER (qc = 4) AS n4, 'm1,m2,m3,qc,row_id,ts' AS available, 'salinity' AS missing, 'qc' AS qc_columns, 'ctd' AS primary_device, CAST(600 AS DOUBLE) AS merge_tolerance_seconds, 'spread' AS file_selection_strategy, CAST(19 AS BIGINT) AS window_columns FROM named""")
def manifest_merged(spark, sf):
    """The manifest of the first week of all sources but one, then of what came after."""
    rows = readings(spark, sf).withColumn("source_file", F.concat(F.when(F.col("source_file") == "click", "Fluorometer").otherwise(""), "source_file"))
    early = (F.col("ts") < F.lit("2024-01-08")) & (F.col("source_file") != "view")
    made = datasets.DatasetSettings(64, primary_device="ctd", merge_tolerance_seconds=600, requested_columns=["m1", "m2", "m3", "salinity"])
    path = scratch_path(spark, "manifest")
    datasets.write_manifest(rows.where(early), path, PROFILE, settings=made)
    datasets.add_to_manifest(rows.where(~early), path, PROFILE, made)
    return datasets.read_manifest(spark, path)[1].select(
        "row_count", "processed_file_count", "window_count", *[F.try_element_at("device_file_counts", F.lit(d)).alias(f"{d}_files") for d in ("fluorometer", "other")],
        F.try_element_at("target_distribution", F.lit("4")).alias("n4"), F.array_join("all_available_columns", ",").alias("available"), F.array_join("missing_measurement_columns", ",").alias("missing"),
        F.array_join("qc_columns", ",").alias("qc_columns"), "primary_device", "merge_tolerance_seconds", "file_selection_strategy", F.size("window_columns").cast("bigint").alias("window_columns"))


@query("s11_part_map", READINGS + " SELECT DISTINCT source_file FROM readings")
def part_map(spark, sf):
    return datasets.part_map(stored(spark, sf), PROFILE).where(F.col("row_level_part").endswith(".parquet")).select("source_file").distinct()


@query("s22_manifest_reader", READINGS + PARTS.replace(" FROM readings", ", source_file AS label FROM readings"))
def manifest_reader(spark, sf):
    path = scratch_path(spark, "manifest")
    datasets.write_manifest(readings(spark, sf), path, PROFILE, window_rows=64)
    return datasets.read_manifest(spark, path)[0]


@query("s20_spread_parts", EXPORTED + f", parts AS (SELECT source_file, count(*) AS row_count FROM cells GROUP BY source_file), taken AS ({spread_sql('parts', 17, order='source_file')}) SELECT source_file, row_count FROM taken")
def spread_parts(spark, sf):
    name = F.concat("source_file", F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv")).alias("source_file")
    return datasets.select_parts(readings(spark, sf).groupBy(name).agg(F.count(F.lit(1)).alias("row_count")), 17)


@query("s17_overlapping_parts", READINGS + ", days AS (SELECT source_file, ts // 86400000000 AS d, min(ts) AS time_start, max(ts) AS time_end FROM readings GROUP BY ALL) SELECT * FROM days WHERE time_end >= epoch_us(TIMESTAMP '2024-01-09 12:00:00') AND time_start <= epoch_us(TIMESTAMP '2024-01-11 12:00:00')")
def part_pruning(spark, sf):
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).alias("d")
    parts = readings(spark, sf).groupBy("source_file", day).agg(F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))
    return datasets.overlapping_parts(parts, "2024-01-09 12:00:00", "2024-01-11 12:00:00")


@query("s21_load_bundle", WINDOWS + f""", parts AS (SELECT DISTINCT source_file FROM readings), chosen AS ({spread_sql('parts', 3, order='source_file')}), mine AS (SELECT * FROM readings WHERE source_file IN (SELECT source_file FROM chosen)),
sample AS ({spread_sql('mine', 200, by='source_file', order='ts, row_id')}), wins AS (SELECT source_file, window_id, min(ts) AS window_start FROM placed WHERE source_file IN (SELECT source_file FROM chosen) GROUP BY ALL),
kept AS ({spread_sql('wins', 40, order='window_start, source_file, window_id')})
SELECT 'rows' AS kind, source_file, count(*) AS n, min(ts) AS first, max(ts) AS last FROM sample GROUP BY source_file UNION ALL SELECT 'windows', source_file, count(*), min(window_start), max(window_start) FROM kept GROUP BY source_file""")
def bundle(spark, sf):
    rows = readings(spark, sf)
    parts = rows.select("source_file").distinct()
    _, sample, windows = datasets.load_bundle(rows, window_features(rows, PROFILE, 64), parts, PROFILE, part_limit=3, rows_per_part=200, window_limit=40)
    stats = lambda frame, kind, time: frame.groupBy("source_file").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return stats(sample, "rows", "ts").unionByName(stats(windows, "windows", "window_start"))
