"""Quoted fields with line breaks: split reading against one reader over the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import exports


def write_quoted(path, rows, seed):
    rng = random.Random(seed)
    pieces = ["plain", 'said "so"', "two\nlines", "a, b", "\n", "", 'tail"\n"head', "x" * 50, "many\n\n\nbreaks, and \"\"", "ünï\ncode"]
    made = [[f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z", str(i), rng.choice(pieces) + rng.choice(pieces), str(i * 2)] for i in range(rows)]
    with path.open("w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["Time UTC", "k", "note", "twice"])
        writer.writerows(made)


@pytest.mark.parametrize("split", ["128m", "3k", "700"])
def test_breaks_in_quotes_equal_one_reader(spark, tmp_path, split):
    for k in range(2):
        write_quoted(tmp_path / f"q{k}.csv", 600, k)
    (tmp_path / "plain.csv").write_text('Time UTC,k,note,twice\n2024-01-01T00:00:00Z,1,"no break",2\n')
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        lines = exports.export_lines(spark, str(tmp_path))
        records = exports.csv_records(lines)
        assert lines.select("at.file", "at.split").distinct().count() > (3 if split != "128m" else 2)
        found = exports.read_exports(records, exports.export_headers(records, header_row=0), text=["note"])
        got = sorted((r["source_file"], r["k"], r["note"] or "", r["twice"]) for r in found.collect())
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")
    expected = []
    for path in sorted(tmp_path.glob("*.csv")):
        for row in list(csv.reader(io.StringIO(path.read_text(), newline="")))[1:]:
            expected.append((path.name, float(row[1]), row[2], float(row[3])))
    assert got == sorted(expected)


def test_files_without_breaks_pass_as_they_are(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Time UTC,k\n2024-01-01T00:00:00Z,"1"\n')
    lines = exports.export_lines(spark, str(tmp_path))
    assert exports.csv_records(lines) is lines
    (tmp_path / "b.csv").write_text('Time UTC,k\n2024-01-01T00:00:00Z,"never closed\nto the end\n')
    records = exports.csv_records(exports.export_lines(spark, str(tmp_path)))
    assert sorted(r["line"] for r in records.collect()) == ['2024-01-01T00:00:00Z,"1"', '2024-01-01T00:00:00Z,"never closed\nto the end', "Time UTC,k", "Time UTC,k"]


def test_a_long_split_is_read_in_pieces(spark, tmp_path, monkeypatch):
    """One file in one split: its lines are dealt over many tasks, and records and breaks stay those of one reader."""
    write_quoted(tmp_path / "q.csv", 600, 3)
    monkeypatch.setattr(exports, "_PIECE_BITS", 3, raising=False)
    monkeypatch.setattr(exports, "_TASK_BYTES", 1_000, raising=False)
    settled, settle = [], exports.settle
    monkeypatch.setattr(exports, "settle", lambda df: settled.append(settle(df)) or settled[-1])
    lines = exports.export_lines(spark, str(tmp_path))
    assert lines.select("at.file", "at.split").distinct().count() == 1
    got = [r["line"] for r in exports.csv_records(lines).orderBy("at").collect()]
    assert list(csv.reader(got)) == list(csv.reader(io.StringIO((tmp_path / "q.csv").read_text(), newline="")))
    dealt = next(df for df in settled if "__odd" in df.columns).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < lines.count() / 4
