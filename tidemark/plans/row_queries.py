"""Scans over the tables, typing, filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.labels import infinite_to_null, is_issue, is_reviewed, meaning
from tidemark.functions.names import clean_header, device_family, display_source, name_time, series_key
from tidemark.operators import cleaning, ordering, summaries
from tidemark.plans.registry import (GOOD, ISSUE, PROFILE, READINGS, SCORES, SHIPMENT_PROFILE, SHIPMENTS, query, r9, readings, scores, shipments,
                                     spread_sql, table)
from tidemark.profiles import PLUG_LABEL_MEANINGS, fractional_row_limit, scaled_cap

ROW = "row_id, ts, source_file, m1, m2, m3, CAST(qc AS BIGINT) AS qc"
NARROW = ["row_id", "ts", "source_file", "qc"]
REVIEWED = "qc IN (1, 3, 4, 9)"


@query("s15_full_scan", READINGS + " SELECT ts, source_file, CAST(qc AS BIGINT) AS qc FROM readings")
def full_scan(spark, sf):
    return readings(spark, sf).select("ts", "source_file", "qc")


@query("s16_head", READINGS + f" SELECT {ROW} FROM readings ORDER BY ts, row_id LIMIT 500")
def head(spark, sf):
    return readings(spark, sf).orderBy("ts", "row_id").limit(500)


@query("s17_time_range_scan", """SELECT event_id, epoch_us(ts) AS ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def time_range_scan(spark, sf):
    return cleaning.between_times(table(spark, sf, "events"), "ts", "2024-01-08 00:00:00", "2024-01-15 12:00:00").select("event_id", "ts", "value")


@query("p01_type_columns", """SELECT epoch_us(ts) AS ts, event_type AS source_file, TRY_CAST(text AS DOUBLE) AS reading FROM (
SELECT ts, event_type, CASE WHEN value >= 100 THEN NULL WHEN event_type = 'error' THEN NULL ELSE CAST(value AS VARCHAR) END AS text FROM events)""")
def type_columns(spark, sf):
    raw = table(spark, sf, "events").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("event_type").alias("source_file"),
        F.when(F.col("value") >= 100, "n/a").when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string")).alias("reading"))
    return cleaning.type_readings(raw, time="ts", keep_text=["source_file"])


@query("p02_drop_untimed", "SELECT event_id, epoch_us(ts) AS ts FROM events WHERE event_type <> 'error'")
def drop_untimed(spark, sf):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "no time").otherwise(stamp).alias("ts"))
    return cleaning.type_readings(raw, time="ts", keep_text=["event_id"])


@query("p05_pad_columns", READINGS + " SELECT ts, m1, CAST(NULL AS DOUBLE) AS salinity, source_file FROM readings")
def pad(spark, sf):
    return cleaning.pad_columns(readings(spark, sf), ["ts", "m1", "salinity", "source_file"])


@query("p08_issue_rows", READINGS + f" SELECT {ROW} FROM readings WHERE qc IN (3, 4, 9)")
def issue_rows(spark, sf):
    return readings(spark, sf).where(is_issue(F.col("qc"), ISSUE))


@query("p09_reviewed_rows", READINGS + f" SELECT {ROW} FROM readings WHERE {REVIEWED}")
def reviewed_rows(spark, sf):
    return readings(spark, sf).where(is_reviewed(F.col("qc"), GOOD, ISSUE))


@query("p11_reviewed_target_frame", READINGS + f""", reviewed AS (SELECT row_id, ts, source_file, CAST(qc AS BIGINT) AS qc,
CAST(qc IN (3, 4, 9) AS BIGINT) AS issue, CAST(qc AS BIGINT) AS model_target FROM readings WHERE {REVIEWED}) {spread_sql("reviewed", 700)}""")
def target_frame(spark, sf):
    return cleaning.reviewed_target_frame(readings(spark, sf).select(*NARROW), PROFILE, 700)


@query("p11_active_labels", READINGS + f" SELECT DISTINCT CAST(qc AS BIGINT) AS model_target FROM readings WHERE {REVIEWED}")
def active_labels(spark, sf):
    return cleaning.active_labels(cleaning.reviewed_target_frame(readings(spark, sf), PROFILE))


@query("p12_target_strategies", READINGS + """ SELECT 'raw_multiclass' AS strategy, row_id, CAST(qc AS BIGINT) AS strategy_target FROM readings
UNION ALL SELECT 'multiclass_1_3_4_9', row_id, CAST(qc AS BIGINT) FROM readings
UNION ALL SELECT 'collapsed_1_34_9', row_id, CASE WHEN qc IN (3, 4) THEN 34 ELSE qc END FROM readings WHERE qc IN (1, 3, 4, 9)
UNION ALL SELECT 'collapsed_12_34_9', row_id, CASE WHEN qc IN (3, 4) THEN 34 WHEN qc IN (1, 2) THEN 12 ELSE qc END FROM readings WHERE qc IN (1, 2, 3, 4, 9)
UNION ALL SELECT 'binary_issue', row_id, CAST(qc IN (3, 4, 9) AS INT) FROM readings""")
def target_strategies(spark, sf):
    names = ["raw_multiclass", "multiclass_1_3_4_9", "collapsed_1_34_9", "collapsed_12_34_9", "binary_issue"]
    rows = readings(spark, sf)
    each = [cleaning.apply_target_strategy(rows, PROFILE, n).select(F.lit(n).alias("strategy"), "row_id", "strategy_target") for n in names]
    return cleaning.union_all(each)


@query("p13_open_time_filter", READINGS + f" SELECT {ROW} FROM readings WHERE ts >= epoch_us(TIMESTAMP '2024-01-20 06:00:00')")
def open_filter(spark, sf):
    return cleaning.between_times(readings(spark, sf), "ts", start="2024-01-20 06:00:00")


@query("p14_usable_rows", READINGS + f" SELECT row_id, {r9('m1', 'm1')}, {r9('m3 / nullif(m2, 3)', 'ratio')} FROM readings WHERE m2 NOT IN (0, 3) AND m1 IS NOT NULL")
def usable(spark, sf):
    ratio = F.when(F.col("m2") == 0, F.lit(float("inf"))).when(F.col("m2") == 3, F.lit(float("nan"))).otherwise(F.col("m3") / F.col("m2"))
    return cleaning.usable_rows(readings(spark, sf).select("row_id", "m1", ratio.alias("ratio")), ["m1", "ratio"])


@query("p15_drop_incomplete", READINGS + " SELECT row_id, nullif(m1, 0.5) AS m1, nullif(m2, 7) AS m2 FROM readings WHERE nullif(m1, 0.5) IS NOT NULL AND m2 <> 7")
def incomplete(spark, sf):
    holes = readings(spark, sf).select("row_id", F.nullif("m1", F.lit(0.5)).alias("m1"), F.nullif("m2", F.lit(7.0)).alias("m2"))
    return cleaning.drop_incomplete(holes, ["m1", "m2"])


@query("p16_infinite_to_null", READINGS + f" SELECT row_id, {r9('CASE WHEN m2 = 0 THEN NULL ELSE m3 / m2 END', 'ratio')} FROM readings")
def no_infinity(spark, sf):
    ratio = F.when(F.col("m2") == 0, F.lit(float("-inf"))).otherwise(F.col("m3") / F.col("m2"))
    return readings(spark, sf).select("row_id", infinite_to_null(ratio).alias("ratio"))


@query("p17_first_per_key", SHIPMENTS + """ SELECT ts, source_file, k1, k2, k3, k4, m2 FROM (SELECT *,
row_number() OVER (PARTITION BY source_file, ts ORDER BY k1, k2, k3, k4, m2) AS n FROM shipments) WHERE n = 1""")
def first_per_key(spark, sf):
    rows = shipments(spark, sf).select("ts", "source_file", "k1", "k2", "k3", "k4", "m2")
    return cleaning.first_per_key(rows, ["source_file", "ts"], SHIPMENT_PROFILE.tie_break)


NAMES = """WITH names AS (SELECT DISTINCT 'Site' || CAST(user_id AS VARCHAR) || '_' || CASE event_type
 WHEN 'click' THEN 'ConductivityTemperatureDepth' WHEN 'view' THEN 'Fluorometer' WHEN 'error' THEN 'OxygenSensor' ELSE event_type END
 || '_' || strftime(date_trunc('day', ts), '%Y%m%dT%H%M%SZ') || '_' || strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y%m%dT%H%M%S') || '.250Z'
 || CASE WHEN user_id % 2 = 0 THEN '-NaN' ELSE '' END || '.csv' AS name, user_id, event_type, date_trunc('day', ts) AS d FROM events)"""


def export_names(spark, sf):
    """File names as an instrument archive would give them, one per source, user and day."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    device = (F.when(F.col("event_type") == "click", "ConductivityTemperatureDepth").when(F.col("event_type") == "view", "Fluorometer")
              .when(F.col("event_type") == "error", "OxygenSensor").otherwise(F.col("event_type")))
    name = F.concat(F.lit("Site"), F.col("user_id").cast("string"), F.lit("_"), device, F.lit("_"), F.date_format(day, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"),
                    F.date_format(day + F.expr("INTERVAL 1 DAY"), "yyyyMMdd'T'HHmmss"), F.lit(".250Z"),
                    F.when(F.col("user_id") % 2 == 0, "-NaN").otherwise(""), F.lit(".csv"))
    return table(spark, sf, "events").select(name.alias("name"), "user_id", "event_type", day.alias("day")).distinct()


@query("s07_parse_export_names", NAMES + """ SELECT name, CASE event_type WHEN 'click' THEN 'ctd' WHEN 'view' THEN 'fluorometer' WHEN 'error' THEN 'oxygen' ELSE 'other' END AS device,
'Site' || CAST(user_id AS VARCHAR) AS series_key, epoch_us(d) AS start_time, epoch_us(d + INTERVAL 1 DAY) + 250000 AS end_time FROM names""")
def parse_names(spark, sf):
    name = F.col("name")
    return export_names(spark, sf).select("name", device_family(name).alias("device"), series_key(name).alias("series_key"),
                                          name_time(name, 1).alias("start_time"), name_time(name, 2).alias("end_time"))


@query("p18_display_source", """SELECT DISTINCT 'Site' || CAST(user_id AS VARCHAR) || '_' || event_type AS label FROM events""")
def display_names(spark, sf):
    raw = F.concat(F.lit("Site"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type"), F.lit("_20250301T000000Z_20260302T000000Z.csv"))
    return table(spark, sf, "events").select(display_source(raw).alias("label")).distinct()


@query("p19_label_meanings", READINGS + """ SELECT row_id, CASE qc WHEN 0 THEN 'no QC' WHEN 1 THEN 'good' WHEN 2 THEN 'probably good' WHEN 3 THEN 'probably bad'
WHEN 4 THEN 'bad' WHEN 9 THEN 'missing / NaN' END AS meaning FROM readings""")
def label_meanings(spark, sf):
    return readings(spark, sf).select("row_id", meaning(F.col("qc"), PROFILE.meanings).alias("meaning"))


@query("p19_plug_label_meanings", READINGS + """ SELECT row_id, CASE qc WHEN 0 THEN 'good' WHEN 1 THEN 'conductivity bad plug' WHEN 2 THEN 'conductivity bad other'
WHEN 3 THEN 'non-conductivity failure' WHEN 4 THEN 'missing data' END AS meaning FROM readings""")
def plug_meanings(spark, sf):
    return readings(spark, sf).select("row_id", meaning(F.col("qc"), PLUG_LABEL_MEANINGS).alias("meaning"))


@query("p20_fractional_limits", READINGS + f""" SELECT source_file, count(*) AS rows, least(count(*), greatest(1, CAST(round_even(count(*) * CAST(0.35 AS DOUBLE), 0) AS BIGINT))) AS row_limit,
CAST(350000 AS BIGINT) AS train_cap, CAST(4200 AS BIGINT) AS issue_cap FROM readings WHERE {REVIEWED} GROUP BY source_file""")
def fractional_limits(spark, sf):
    counts = cleaning.reviewed_rows(readings(spark, sf), PROFILE).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    limit = F.least(F.col("rows"), F.greatest(F.lit(1), F.bround(F.col("rows") * F.lit(0.35), 0).cast("bigint")))
    return counts.withColumns({"row_limit": limit, "train_cap": F.lit(scaled_cap(1_000_000, 0.35, 10_000)), "issue_cap": F.lit(scaled_cap(12_000, 0.35, 1_000))})


@query("p20_fraction_of_rows", READINGS + f", reviewed AS (SELECT row_id, ts, source_file FROM readings WHERE {REVIEWED}), limits AS (SELECT count(*) AS n, CAST(round_even(count(*) * CAST(0.03 AS DOUBLE), 0) AS BIGINT) AS k FROM reviewed), "
       "positions AS (SELECT CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / CAST(k - 1 AS DOUBLE))) AS BIGINT) END AS pos FROM limits, unnest(range(k)) AS u(i)) "
       "SELECT row_id, ts, source_file FROM (SELECT *, row_number() OVER (ORDER BY ts, source_file, row_id) - 1 AS pos FROM reviewed) WHERE pos IN (SELECT pos FROM positions)")
def fraction_of_rows(spark, sf):
    rows = cleaning.reviewed_rows(readings(spark, sf), PROFILE).select("row_id", "ts", "source_file")
    return ordering.evenly_spaced_take(rows, fractional_row_limit(rows.count(), 0.03), order=PROFILE.global_order)


@query("p21_misclassified_rows", SCORES + " SELECT row_id, ts, source_file, CAST(qc_label AS BIGINT) AS qc_label, CAST(prediction AS BIGINT) AS prediction FROM scores WHERE prediction <> qc_label ORDER BY ts, source_file, row_id LIMIT 12")
def misclassified(spark, sf):
    rows = scores(spark, sf).select("row_id", "ts", "source_file", "qc_label", "prediction")
    return summaries.misclassified(rows, PROFILE.global_order, truth="qc_label")


@query("p21_error_rate", SCORES + f" SELECT count(*) AS rows, count(*) FILTER (prediction <> qc_label) AS wrong_rows, {r9('avg(CASE WHEN prediction <> qc_label THEN 1 ELSE 0 END)', 'error_rate')} FROM scores")
def error_rate(spark, sf):
    return summaries.error_rate(scores(spark, sf), truth="qc_label")


@query("u01_union_frames", READINGS + " SELECT row_id, ts, m1, CAST(NULL AS DOUBLE) AS m3 FROM readings WHERE source_file IN ('click', 'error') UNION ALL SELECT row_id, ts, CAST(NULL AS DOUBLE), m3 FROM readings WHERE source_file NOT IN ('click', 'error')")
def union_frames(spark, sf):
    rows = readings(spark, sf)
    return cleaning.union_all([rows.where("source_file IN ('click', 'error')").select("row_id", "ts", "m1"), rows.where("source_file NOT IN ('click', 'error')").select("row_id", "ts", "m3")])


@query("f01_math", READINGS + f""" SELECT row_id, {r9('abs(m1 - m2)', 'a')}, CAST(ceil(m1 / 7) AS BIGINT) AS c, CAST(floor(m1 / 7) AS BIGINT) AS f, {r9('sin(m3)', 's')}, {r9('cos(m3)', 'k')},
{r9('ln(1 + abs(m1))', 'l')}, {r9('least(greatest(m1, 5), 90)', 'clipped')} FROM readings""")
def math_functions(spark, sf):
    m1 = F.col("m1")
    return readings(spark, sf).select("row_id", F.abs(m1 - F.col("m2")).alias("a"), F.ceil(m1 / 7).alias("c"), F.floor(m1 / 7).alias("f"), F.sin("m3").alias("s"),
                                      F.cos("m3").alias("k"), F.log1p(F.abs(m1)).alias("l"), F.least(F.greatest(m1, F.lit(5.0)), F.lit(90.0)).alias("clipped"))


@query("f02_dates", """SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour_utc, CAST(minute(ts) AS BIGINT) AS minute_utc, CAST(dayofyear(ts) AS BIGINT) AS day_of_year,
strftime(ts, '%Y-%m-%d %H:%M') AS stamp, epoch_us(ts) // 2 AS half, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS since FROM events""")
def date_functions(spark, sf):
    ts = F.to_timestamp(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    since = F.unix_micros(ts) - F.unix_micros(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.hour(ts).alias("hour_utc"), F.minute(ts).alias("minute_utc"), F.dayofyear(ts).alias("day_of_year"),
                                             F.date_format(ts, "yyyy-MM-dd HH:mm").alias("stamp"), F.floor(F.unix_micros(ts) / 2).alias("half"), since.alias("since"))


@query("f03_strings", """SELECT doc_id, trim(source) AS source, lower(lang) AS lang, starts_with(text, 'The') AS the, contains(text, 'data') AS has_data,
length(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked_length, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word FROM documents""")
def string_functions(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.trim("source").alias("source"), F.lower("lang").alias("lang"), text.startswith("The").alias("the"),
                                                text.contains("data").alias("has_data"), F.length(F.regexp_replace(text, "[0-9]+", "#")).alias("masked_length"),
                                                F.regexp_extract(text, "([A-Za-z]+)", 1).alias("first_word"))


@query("f03_clean_headers", """SELECT event_id, CASE WHEN value < 5 THEN 'Time UTC' WHEN value < 10 THEN 'Time UTC' WHEN value < 50 THEN event_type || ' (C)' ELSE event_type END AS header FROM events""")
def header_cleaning(spark, sf):
    kind = F.col("value")
    raw = (F.when(kind < 5, '#"Time UTC (yyyy-mm-ddThh:mm:ss.fffZ)"').when(kind < 10, " sample_time").when(kind < 50, F.concat(F.lit(' "'), F.col("event_type"), F.lit(' (C)"')))
           .otherwise(F.concat(F.lit("# "), F.col("event_type"))))
    return table(spark, sf, "events").select("event_id", clean_header(raw).alias("header"))


@query("f04_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def json_functions(spark, sf):
    packed = F.to_json(F.struct(F.from_json("props", "k bigint").alias("p"), F.col("event_type").alias("e")))
    back = F.from_json(packed, "p struct<k:bigint>, e string")
    return table(spark, sf, "events").select("event_id", back["p"]["k"].alias("k"), back["e"].alias("event_type"))


@query("f05_arrays", f"""SELECT vec_id, {r9('list_sum(embedding)', 'total')}, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS max_at,
CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS min_at, {r9('embedding[1 + 8]', 'second_row_first')} FROM embeddings""")
def array_functions(spark, sf):
    e = F.col("embedding")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, 8))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.aggregate(F.transform(e, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("total"), (F.array_position(e, F.array_max(e)) - 1).alias("max_at"),
        (F.array_position(e, F.array_min(e)) - 1).alias("min_at"), F.get(F.get(matrix, F.lit(1)), F.lit(0)).cast("double").alias("second_row_first"))


@query("f06_maps", READINGS + " SELECT source_file, count(*) FILTER (qc = 1) AS good, count(*) FILTER (qc = 4) AS bad, count(*) FILTER (qc = 7) AS averaged FROM readings GROUP BY source_file")
def map_functions(spark, sf):
    counts = readings(spark, sf).groupBy("source_file", "qc").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("qc", "n"))).alias("m"))
    pick = lambda v: F.coalesce(F.try_element_at("m", F.lit(v)), F.lit(0))
    return packed.select("source_file", pick(1).alias("good"), pick(4).alias("bad"), pick(7).alias("averaged"))
