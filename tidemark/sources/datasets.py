"""Row-level and window-level datasets with their manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import is_issue, label_id
from tidemark.functions.names import device_family, display_source
from tidemark.operators.cleaning import attach_small
from tidemark.operators.features import window_features
from tidemark.operators.ordering import evenly_spaced_take
from tidemark.operators.sampling import subsample
from tidemark.profiles import Profile


def write_rows(df: DataFrame, path: str, profile: Profile, *, compression: str = "zstd") -> None:
    """Row-level Parquet, partitioned by source and clustered by time.

    Range partitioning spreads a large source over several files with narrow
    time ranges, so later time filters skip most of them.
    """
    clustered = df.repartitionByRange(profile.source, profile.time).sortWithinPartitions(profile.source, profile.time)
    clustered.write.mode("overwrite").option("compression", compression).partitionBy(profile.source).parquet(path)


def read_rows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*[f"`{c}`" for c in columns]) if columns else rows


def write_windows(rows: DataFrame, path: str, profile: Profile, window_rows: int) -> None:
    window_features(rows, profile, window_rows).write.mode("overwrite").option("compression", "zstd").parquet(path)


def manifest_parts(rows: DataFrame, profile: Profile) -> DataFrame:
    """One row per source: rows, time span, labelled and issue rows."""
    label = F.col(f"`{profile.target}`")
    return rows.groupBy(F.col(profile.source).alias("source_file")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(profile.time).alias("time_start"), F.max(profile.time).alias("time_end"),
        F.count_if(label_id(label).isNotNull()).alias("labelled_rows"), F.count_if(is_issue(label, profile.issue)).alias("issue_rows"))


@dataclass(frozen=True)
class DatasetSettings:
    """How a dataset was made; recorded in its manifest."""

    window_rows: int
    primary_device: str | None = None
    merge_tolerance_seconds: float | None = None
    file_selection: str = "spread"
    requested_columns: Sequence[str] = ()
    qc_columns: Sequence[str] = ()
    sample_rows: int | None = None


def partial_manifest(rows: DataFrame, profile: Profile) -> DataFrame:
    """What one row per source tells of some rows, so that it can be merged with what others tell.

    Row, label and value counts add up, spans widen, columns with a value join:
    partials of disjoint rows merge to the partial of all of them, whether they
    share sources or not.
    """
    label = F.col(f"`{profile.target}`")
    columns = [c for c in rows.columns if c != profile.source]
    filled = [F.count(F.col(f"`{c}`")).alias(f"__n{i}") for i, c in enumerate(columns)]
    # Label counts come first, so a source moves as one row a label.
    by_label = rows.groupBy(F.col(profile.source).alias("source_file"), label_id(label).alias("__label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(profile.time).alias("first"), F.max(profile.time).alias("last"), F.count_if(is_issue(label, profile.issue)).alias("issue"), *filled)
    known = F.array_compact(F.array(*[F.when(F.col(f"__s{i}") > 0, F.lit(c)) for i, c in enumerate(columns)]))
    entries = F.collect_list(F.when(F.col("__label").isNotNull(), F.struct(F.col("__label").cast("string"), "n")))
    return (by_label.groupBy("source_file").agg(
        F.sum("n").alias("row_count"), F.min("first").alias("time_start"), F.max("last").alias("time_end"), F.coalesce(F.sum(F.when(F.col("__label").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled_rows"),
        F.sum("issue").alias("issue_rows"), F.map_from_entries(F.array_sort(entries)).alias("labels"), *[F.sum(f"__n{i}").alias(f"__s{i}") for i in range(len(columns))])
        .select("source_file", "row_count", "time_start", "time_end", "labelled_rows", "issue_rows", "labels", known.alias("columns")))


def merge_partials(partials: DataFrame) -> DataFrame:
    """One partial per source out of any number of them."""
    counts = partials.select("source_file", F.explode_outer("labels").alias("k", "v")).groupBy("source_file", "k").agg(F.sum("v").alias("v"))
    labels = counts.groupBy("source_file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("labels"))
    merged = partials.groupBy("source_file").agg(
        F.sum("row_count").alias("row_count"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.sum("labelled_rows").alias("labelled_rows"),
        F.sum("issue_rows").alias("issue_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
    joined = merged.withColumnRenamed("source_file", "__s").join(labels, F.col("__s").eqNullSafe(F.col("source_file")))
    return joined.select(*[f.name for f in partials.schema.fields])


def summarise_partials(partials: DataFrame, profile: Profile, settings: DatasetSettings) -> DataFrame:
    """The dataset's totals as one row, from merged partials alone: no row of the data is read."""
    labels = partials.select(F.explode("labels").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    listed = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("target_distribution"))
    devices = partials.groupBy(device_family(F.col("source_file")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counted = devices.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("device_file_counts"))
    names = partials.select(F.explode("columns").alias("c")).agg(F.array_sort(F.collect_set("c")).alias("all_available_columns"))
    rows, size = F.sum("row_count"), F.lit(settings.window_rows)
    totals = partials.agg(
        F.coalesce(rows, F.lit(0)).alias("row_count"), F.coalesce(F.sum("issue_rows") / rows, F.lit(0.0)).alias("issue_fraction"), F.count(F.lit(1)).alias("processed_file_count"),
        F.coalesce(F.sum(F.ceil(F.col("row_count") / size)), F.lit(0)).cast("bigint").alias("window_count"))
    text = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    requested = list(settings.requested_columns) or list(profile.measurements)
    statistics = [f"{m}_{kind}" for m in profile.measurements for kind in ("mean", "std", "min", "max")]
    totals = totals.withColumns({"target_distribution": listed.scalar(), "device_file_counts": counted.scalar(), "all_available_columns": names.scalar()})
    return totals.select(
        F.lit(profile.target).alias("target"), "row_count", "target_distribution", "issue_fraction", F.lit(settings.window_rows).alias("window_size"),
        text(profile.measurements).alias("measurement_columns"), F.array(*[F.lit(v) for v in profile.issue]).alias("issue_labels"),
        "processed_file_count", "window_count", "device_file_counts", "all_available_columns", text(requested).alias("requested_measurement_columns"),
        F.array_except(text(requested), F.col("all_available_columns")).alias("missing_measurement_columns"), text(settings.qc_columns or [profile.target]).alias("qc_columns"),
        F.array_union(F.array(F.lit(profile.source)), F.col("all_available_columns")).alias("row_columns"),
        text(["window_start", "window_end", "source_file", "row_count", "issue_count", "issue_rate", "target_mode", *statistics]).alias("window_columns"),
        F.lit(settings.primary_device).cast("string").alias("primary_device"), F.lit(settings.merge_tolerance_seconds).cast("double").alias("merge_tolerance_seconds"),
        F.lit(settings.file_selection).alias("file_selection_strategy"), F.lit(settings.sample_rows).cast("bigint").alias("sample_rows_per_file"))


def write_manifest(rows: DataFrame, path: str, profile: Profile, *, window_rows: int | None = None, settings: DatasetSettings | None = None) -> None:
    """Manifest as JSON: `parts`, one line per source, and `summary`, one line."""
    settings = settings or DatasetSettings(window_rows)
    partial_manifest(rows, profile).write.mode("overwrite").option("timestampFormat", INSTANT).json(f"{path}/parts")
    _write_summary(rows.sparkSession, path, profile, settings)


def add_to_manifest(rows: DataFrame, path: str, profile: Profile, settings: DatasetSettings) -> None:
    """Add rows that joined the dataset; only they are read, the rest is known from the manifest."""
    partial_manifest(rows, profile).write.mode("append").option("timestampFormat", INSTANT).json(f"{path}/parts")
    _write_summary(rows.sparkSession, path, profile, settings)


def _write_summary(spark: SparkSession, path: str, profile: Profile, settings: DatasetSettings) -> None:
    summary = summarise_partials(merge_partials(read_partials(spark, path)), profile, settings)
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/summary")


INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PARTIAL_SCHEMA = ("source_file string, row_count bigint, time_start timestamp, time_end timestamp, labelled_rows bigint, issue_rows bigint, "
                  "labels map<string,bigint>, columns array<string>")
SUMMARY_SCHEMA = ("target string, row_count bigint, target_distribution map<string,bigint>, issue_fraction double, window_size int, "
                  "measurement_columns array<string>, issue_labels array<int>, processed_file_count bigint, window_count bigint, device_file_counts map<string,bigint>, "
                  "all_available_columns array<string>, requested_measurement_columns array<string>, missing_measurement_columns array<string>, qc_columns array<string>, "
                  "row_columns array<string>, window_columns array<string>, primary_device string, merge_tolerance_seconds double, file_selection_strategy string, sample_rows_per_file bigint")


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTIAL_SCHEMA).option("timestampFormat", INSTANT).json(f"{path}/parts")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parts with a display label, summary)."""
    parts = merge_partials(read_partials(spark, path)).drop("labels", "columns").withColumn("label", display_source(F.col("source_file")))
    summary = spark.read.text(f"{path}/summary").select(F.from_json("value", SUMMARY_SCHEMA).alias("s")).select("s.*")
    return parts, summary


def part_map(rows: DataFrame, profile: Profile) -> DataFrame:
    """Which file of a row-level dataset holds which source: (row_level_part, source_file); no column of the rows is read."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return rows.select(name.alias("row_level_part"), F.col(f"`{profile.source}`").alias("source_file")).distinct()


def select_parts(parts: DataFrame, limit: int | None, mode: str = "spread", *, name: str = "source_file") -> DataFrame:
    """All parts, the first ones, or parts spread evenly over the name order."""
    if limit is None:
        return parts
    if mode == "first":
        return parts.orderBy(name).limit(limit)
    if mode == "spread":
        return evenly_spaced_take(parts, limit, order=[name])
    raise ValueError(f"unknown part selection: {mode}")


def overlapping_parts(parts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Parts whose time span meets a closed range with optional bounds."""
    if start:
        parts = parts.where(F.col("time_end") >= F.lit(start).cast("timestamp"))
    if end:
        parts = parts.where(F.col("time_start") <= F.lit(end).cast("timestamp"))
    return parts


def load_bundle(rows: DataFrame, windows: DataFrame, parts: DataFrame, profile: Profile, *, part_limit: int | None = None,
                mode: str = "spread", rows_per_part: int | None = None, issue_rows_per_part: int | None = None, strategy: str = "time_spread",
                window_limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen parts, their rows and their window summaries; both are sampled only where a limit is given."""
    chosen = select_parts(parts, part_limit, mode)
    names = chosen.select(F.col("source_file").alias(profile.source))
    picked = attach_small(rows, names, [profile.source], "left_semi")
    sample = picked
    if rows_per_part is not None:
        sample = subsample(picked, profile, strategy, rows_per_part, issue_rows=rows_per_part if issue_rows_per_part is None else issue_rows_per_part, by=[profile.source])
    kept = attach_small(windows, names, [profile.source], "left_semi")
    return chosen, sample, kept if window_limit is None else evenly_spaced_take(kept, window_limit, order=["window_start", profile.source, "window_id"])


def write_reports(scores: DataFrame, thresholds: DataFrame, summaries: DataFrame, path: str) -> None:
    """Scores as Parquet, threshold metrics as CSV, summaries as JSON lines."""
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    thresholds.write.mode("overwrite").option("header", True).csv(f"{path}/threshold_metrics")
    summaries.write.mode("overwrite").json(f"{path}/summary")
