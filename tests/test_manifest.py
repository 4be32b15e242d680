"""Manifests merge: what parts tell is what all rows tell."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans.registry import PROFILE
from tidemark.sources import datasets

SETTINGS = datasets.DatasetSettings(10, primary_device="ctd", merge_tolerance_seconds=60, requested_columns=["m1", "nowhere"], sample_rows=5)


def rows_of(spark, sources=4, each=37):
    made = [(s * 1000 + i, datetime(2024, 1, 1) + timedelta(minutes=7 * i + s), f"src {s}", float(i), None if s == 1 else 1.0, None, [1, 3, 4, 9, None][(i + s) % 5]) for s in range(sources) for i in range(each)]
    return spark.createDataFrame(made, "row_id bigint, ts timestamp, source_file string, m1 double, m2 double, m3 double, qc int")


def shown(spark, path):
    parts, summary = datasets.read_manifest(spark, path)
    return sorted(map(str, parts.collect())), summary.first().asDict()


def test_added_parts_merge_to_the_whole(spark, tmp_path):
    rows = rows_of(spark)
    datasets.write_manifest(rows, f"{tmp_path}/whole", PROFILE, settings=SETTINGS)
    pieces = [F.col("row_id") % 3 == k for k in range(3)]  # every source is split over all pieces
    datasets.write_manifest(rows.where(pieces[0]), f"{tmp_path}/added", PROFILE, settings=SETTINGS)
    for piece in pieces[1:]:
        datasets.add_to_manifest(rows.where(piece), f"{tmp_path}/added", PROFILE, SETTINGS)
    assert shown(spark, f"{tmp_path}/added") == shown(spark, f"{tmp_path}/whole")
    found = shown(spark, f"{tmp_path}/whole")[1]
    assert found["row_count"] == 148 and found["window_count"] == 16 and found["processed_file_count"] == 4
    assert found["missing_measurement_columns"] == ["nowhere"] and found["device_file_counts"] == {"other": 4}
    assert found["all_available_columns"] == ["m1", "m2", "qc", "row_id", "ts"] and sum(found["target_distribution"].values()) == rows.where("qc IS NOT NULL").count()


def test_empty_dataset_and_part_map(spark, tmp_path):
    rows = rows_of(spark)
    datasets.write_manifest(rows.limit(0), f"{tmp_path}/none", PROFILE, settings=SETTINGS)
    parts, summary = shown(spark, f"{tmp_path}/none")
    assert parts == [] and summary["row_count"] == 0 and summary["issue_fraction"] == 0.0 and summary["window_count"] == 0
    datasets.write_rows(rows, f"{tmp_path}/rows", PROFILE)
    held = datasets.part_map(datasets.read_rows(spark, f"{tmp_path}/rows"), PROFILE).collect()
    assert {r["source_file"] for r in held} == {f"src {s}" for s in range(4)} and all(r["row_level_part"].endswith(".parquet") for r in held)
