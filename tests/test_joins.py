"""Companion sweeps and file pairing: what is read, moved and met, beside the results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.ordering import arrange

START = datetime(2024, 1, 1)


def stream(spark, name, seed, rows=300, values=1):
    rng = random.Random(seed)
    made = [(k, START + timedelta(seconds=rng.randint(0, 4_000)), rng.choice(["a", "b"]), *[rng.random() for _ in range(values)]) for k in range(rows)]
    return spark.createDataFrame(made, f"row_id bigint, ts timestamp, pair string, {', '.join(f'{name}{i} double' for i in range(values))}")


def plain_nearest(left, right, tolerance, column):
    found = {}
    for row in left:
        before = [r for r in right if r["pair"] == row["pair"] and r["ts"] <= row["ts"]]
        after = [r for r in right if r["pair"] == row["pair"] and r["ts"] > row["ts"]]
        picks = [max(before, key=lambda r: (r["ts"], r["row_id"]))] if before else []
        picks += [min(after, key=lambda r: (r["ts"], r["row_id"]))] if after else []
        best = min(picks, key=lambda r: abs((r["ts"] - row["ts"]).total_seconds()), default=None)  # the earlier of equals
        found[row["row_id"]] = best[column] if best and abs((best["ts"] - row["ts"]).total_seconds()) <= tolerance else None
    return found


def test_three_devices_in_one_sweep(small_chunks):
    left, sides = stream(small_chunks, "m", 1), [stream(small_chunks, f"d{k}_", 2 + k, rows=120 + 40 * k) for k in range(3)]
    merged = asof.nearest_joins(left, [asof.Side(s, "row_id", {f"d{k}_0": f"x{k}"}) for k, s in enumerate(sides)], time="ts", by=["pair"], left_tie="row_id", tolerance_seconds=20)
    rows = {r["row_id"]: r for r in merged.collect()}
    assert len(rows) == 300
    for k, side in enumerate(sides):
        expected = plain_nearest(left.collect(), side.collect(), 20, f"d{k}_0")
        assert {i: r[f"x{k}"] for i, r in rows.items()} == expected


def test_sweep_moves_rows_once_whatever_the_devices(small_chunks):
    """The result reads the written chunks: no row of an input is scanned, shuffled or sorted again."""
    left, sides = stream(small_chunks, "m", 1), [stream(small_chunks, f"d{k}_", 2 + k) for k in range(3)]
    for n in (1, 3):
        merged = asof.nearest_joins(left, [asof.Side(s, "row_id", {f"d{k}_0": f"x{k}"}) for k, s in enumerate(sides[:n])], time="ts", by=["pair"], left_tie="row_id", tolerance_seconds=20)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD") == 2  # the rows, and their summaries a chunk
        assert "LocalTableScan" not in plan and "Union" not in plan and "SortMergeJoin" not in plan


def test_chained_carries_read_the_input_once(small_chunks):
    rows = [(k, k % 7, float(k % 11)) for k in range(400)]
    df = small_chunks.createDataFrame(rows, "k bigint, g bigint, x double").repartition(3)
    seq = arrange(df, by=["g"], order=["k"])
    seq = seq.accumulate(a=("sum", F.col("x"))).accumulate(b=("max", F.col("a") % 5)).accumulate(c=("last", F.when(F.col("b") > 4, F.col("k"))), d=("total", F.col("x")))
    plan = seq.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobinPartitioning" not in plan and "LocalTableScan" not in plan
    got = {r["k"]: r for r in seq.rows().collect()}
    assert len(got) == 400
    for g in range(7):
        a = b = 0.0
        b, c, total = None, None, sum(x for _, h, x in rows if h == g)
        for k, h, x in rows:
            if h != g:
                continue
            a += x
            b = a % 5 if b is None else max(b, a % 5)
            c = k if b > 4 else c
            assert (got[k]["a"], got[k]["b"], got[k]["c"], got[k]["d"]) == (a, b, c, total)


def files(spark, spans, name):
    made = [(f"{name}{i:05d}", "s", START + timedelta(seconds=a), START + timedelta(seconds=b)) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(made, "name string, series_key string, start_time timestamp, end_time timestamp")


def laid_out(monkeypatch, primary, candidates):
    """The best companions, and how many rows the tree of the sweep holds."""
    rows, made = [], asof.range_nodes
    monkeypatch.setattr(asof, "range_nodes", lambda *args: rows.append(made(*args)) or rows[0])
    best = {r["name"]: r["companion"] for r in asof.best_companions(primary, candidates).collect()}
    return best, rows[0].count()


def test_one_long_file_does_not_pair_all_others(spark, monkeypatch):
    short = [(3600 * i, 3600 * i + 3000) for i in range(600)]
    primary, candidates = files(spark, short, "p"), files(spark, [*[(a + 600, b + 600) for a, b in short], (0, 365 * 86_400)], "c")
    best, rows = laid_out(monkeypatch, primary, candidates)
    assert rows < 1_201 * 11
    assert len(best) == 600 and set(best.values()) == {"c00600"}  # covers each primary as a whole


def test_files_that_all_overlap_meet_no_pairs(small_chunks, monkeypatch):
    """Every primary overlaps every candidate: 250,000 pairs, of which none is made."""
    primary = files(small_chunks, [(i, 10_000 - 3 * i) for i in range(500)], "p")
    candidates = files(small_chunks, [(2 * i, 10_001 - 2 * i) for i in range(500)], "c")
    best, rows = laid_out(monkeypatch, primary, candidates)
    assert rows < 1_000 * 10
    for i in range(0, 500, 7):
        a, b = i, 10_000 - 3 * i
        rank = min((-(min(b, d) - max(a, c)), abs(c - a), abs(d - b), f"c{j:05d}") for j, (c, d) in enumerate((2 * j, 10_001 - 2 * j) for j in range(500)))
        assert best[f"p{i:05d}"] == rank[3]


@pytest.mark.parametrize("seed, reach", [(8, 500_000), (9, 40_000), (10, 2_000)])
def test_best_companions_equal_brute_force(small_chunks, seed, reach):
    """Sparse to dense; instants, backward ranges and ties among them."""
    rng = random.Random(seed)
    spans = lambda n: [(a, a + rng.choice([-30, 0, 1, 5, 60, 900, 20_000, 400_000])) for a in (10 * rng.randint(0, reach // 10) for _ in range(n))]
    ps, cs = spans(150), spans(150)
    cs += ps[:5]
    primary, candidates = files(small_chunks, ps, "p"), files(small_chunks, cs, "c")
    got = {r["name"]: (r["companion"], r["exact"], r["overlap_seconds"]) for r in asof.best_companions(primary, candidates).collect()}
    for i, (a, b) in enumerate(ps):
        rank = min(((c, d) != (a, b), -max(0, min(b, d) - max(a, c)), abs(c - a), abs(d - b), f"c{j:05d}") for j, (c, d) in enumerate(cs))
        assert got[f"p{i:05d}"] == (rank[4], not rank[0], float(-rank[1]))


def test_files_with_an_exact_companion_ask_no_nodes(spark, monkeypatch):
    """Only the last primary has no candidate of its own range: the tree holds one that asks, and no node beyond its series."""
    spans = [(100 * i, 100 * i + 90) for i in range(40)]
    lone, many = files(spark, [(0, 90), (30, 95)], "s"), files(spark, spans, "c")
    primary = files(spark, [*spans, (50, 1_000)], "p").unionByName(lone.withColumn("series_key", F.lit("other")))
    candidates = many.unionByName(files(spark, [(5, 50)], "o").withColumn("series_key", F.lit("other")))
    rows, made = [], asof.range_nodes
    monkeypatch.setattr(asof, "range_nodes", lambda *args: rows.append(made(*args)) or rows[0])
    best = {r["name"]: (r["companion"], r["exact"]) for r in asof.best_companions(primary, candidates).collect()}
    assert best == {**{f"p{i:05d}": (f"c{i:05d}", True) for i in range(40)}, "p00040": ("c00001", False), "s00000": ("o00000", False), "s00001": ("o00000", False)}
    assert rows[0].where("side = 1").select("name").distinct().count() <= 3
    assert rows[0].where("side = 0 AND name LIKE 'o%'").count() == 2  # one candidate needs two levels, not those of the longest series
