"""Registered queries, their input views and their SQL counterparts.

`READINGS` is the sensor-stream view over `events`; Spark builds it with the
DataFrame API and the SQL counterpart spells it out. Results are normalised by
`emit` so both sides show the same types: whole numbers as bigint, instants as
microseconds, doubles rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.profiles import Profile
from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PROFILE = Profile()
START, ISSUE, GOOD = "2024-01-08 00:00:00", (3, 4, 9), (1,)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL counterpart if there is one."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return emit(build(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


def emit(df: DataFrame, digits: int = 9) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.unix_micros(column.cast("timestamp"))
        elif kind in ("integer", "short", "byte", "long"):
            column = column.cast("bigint")
        elif kind in ("double", "float", "decimal"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as labelled sensor readings of five sources."""
    level = F.regexp_extract("props", "([0-9]+)", 1)
    qc = (F.when(level.cast("int") % 20 == 0, 0).when(F.col("value") >= 150, 4).when(F.col("value") >= 100, 3)
          .when(F.col("user_id") % 25 == 0, 9).when(F.col("user_id") % 25 == 1, 2).otherwise(1))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source_file"),
        F.col("value").alias("m1"), F.col("user_id").cast("double").alias("m2"), level.cast("double").alias("m3"), qc.alias("qc"))


READINGS = """WITH readings AS (
SELECT event_id AS row_id, epoch_us(ts) AS ts, event_type AS source_file, value AS m1, CAST(user_id AS DOUBLE) AS m2,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS m3,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 = 0 THEN 0 WHEN value >= 150 THEN 4 WHEN value >= 100 THEN 3
            WHEN user_id % 25 = 0 THEN 9 WHEN user_id % 25 = 1 THEN 2 ELSE 1 END AS qc
FROM events)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a second stream: many readings share one instant."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("bigint").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_returnflag").alias("source_file"), F.col("l_quantity").alias("m1"),
        F.col("l_extendedprice").alias("m2"), F.col("l_discount").alias("m3"),
        F.when(F.col("l_discount") >= 0.09, 4).when(F.col("l_quantity") >= 45, 3).when(F.col("l_tax") >= 0.08, 9).otherwise(1).alias("qc"))


SHIPMENTS = """WITH shipments AS (
SELECT l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4, epoch_us(l_shipdate) AS ts,
       l_returnflag AS source_file, l_quantity AS m1, l_extendedprice AS m2, l_discount AS m3,
       CASE WHEN l_discount >= 0.09 THEN 4 WHEN l_quantity >= 45 THEN 3 WHEN l_tax >= 0.08 THEN 9 ELSE 1 END AS qc
FROM lineitem)"""
SHIPMENT_PROFILE = Profile(tie_break=("k1", "k2", "k3", "k4", "m2"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in for model scores over all readings."""
    guess = F.when(F.col("m1") >= 120, 4).when(F.col("m1") >= 80, 3).when(F.col("m2") % 25 == 0, 9).otherwise(1)
    return readings(spark, sf_dir).select(
        "row_id", "ts", "source_file", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "validation").otherwise("test").alias("split"), F.col("qc").alias("qc_label"),
        F.col("qc").isin(*GOOD).alias("is_good"), F.col("qc").isin(*ISSUE).alias("is_issue"),
        F.col("m1").alias("actual_value"), (F.col("m3") * F.lit(0.5)).alias("predicted_value"),
        (F.abs(F.col("m1") - F.col("m3") * F.lit(0.5)) / F.lit(50.0)).alias("error"), guess.alias("prediction"))


SCORES = READINGS + """, scores AS (
SELECT row_id, ts, source_file, CASE WHEN ts < epoch_us(TIMESTAMP '2024-01-16 00:00:00') THEN 'validation' ELSE 'test' END AS split, qc AS qc_label,
       qc = 1 AS is_good, qc IN (3, 4, 9) AS is_issue, m1 AS actual_value, m3 * CAST(0.5 AS DOUBLE) AS predicted_value,
       abs(m1 - m3 * CAST(0.5 AS DOUBLE)) / CAST(50 AS DOUBLE) AS error,
       CASE WHEN m1 >= 120 THEN 4 WHEN m1 >= 80 THEN 3 WHEN CAST(m2 AS BIGINT) % 25 = 0 THEN 9 ELSE 1 END AS prediction
FROM readings)"""


def spread_sql(source: str, limit: int | str, *, order: str = "ts, source_file, row_id", by: str = "", where: str = "TRUE") -> str:
    """SQL for an evenly spaced take: it lists the kept positions outright."""
    part = f"PARTITION BY {by} " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT * EXCLUDE (spread_pos, spread_n) FROM (
  SELECT *, row_number() OVER ({part}ORDER BY {order}) - 1 AS spread_pos, count(*) OVER ({over}) AS spread_n FROM {source} WHERE {where})
WHERE spread_n <= {limit} OR list_contains([CASE WHEN i = {limit} - 1 AND {limit} > 1 THEN spread_n - 1
  ELSE CAST(floor(i * (CAST(spread_n - 1 AS DOUBLE) / CAST(greatest({limit} - 1, 1) AS DOUBLE))) AS BIGINT) END FOR i IN range({limit})], spread_pos)"""




def r9(expression: str, name: str) -> str:
    return f'round(CAST({expression} AS DOUBLE), 9) + CAST(0 AS DOUBLE) AS "{name}"'
