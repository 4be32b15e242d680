import bisect

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import arrange, evenly_spaced_take, spread_keep, with_bin, with_position


def skewed(spark, rows=3000):
    """One source holds most rows, and one instant holds a third of them."""
    k = F.col("id")
    return spark.range(rows).select(
        k.alias("row_id"), F.when(k % 10 < 7, "big").when(k % 10 < 9, "mid").otherwise(F.concat(F.lit("s"), (k % 50).cast("string"))).alias("source"),
        F.timestamp_micros(F.when(k % 3 == 0, F.lit(1_700_000_000_000_000)).otherwise(F.lit(1_700_000_000_000_000) + F.pmod(k * 7919, F.lit(100_000)))).alias("ts"),
        F.when(k % 17 != 0, (k * 31 % 101).cast("double")).alias("x"), (k * 13 % 7).alias("label"))


@pytest.mark.parametrize("by", [[], ["source"]])
def test_layout_equals_plain_windows(spark, by):
    df = skewed(spark)
    order = ["ts", "row_id"]
    seq = arrange(df, by=by, order=order, back=9, ahead=2, tallies={"hit": F.col("label") == 3}, chunk_rows=130)
    assert seq._chunks.count > 10
    flag = F.when(F.col("label") == 5, F.col("row_id"))
    seq = seq.with_columns({
        "pos": seq.position(), "n": seq.total(), "hits": seq.running("hit"), "all_hits": seq.total("hit"),
        "lag9": F.lag("x", 9).over(seq.window()), "lead2": F.lead("x", 2).over(seq.window()), "roll": F.max("x").over(seq.window(-9, 0))})
    seq = seq.accumulate(s=("sum", F.col("label")), t=("total", F.col("label")), m=("max", F.col("x")), prev=("last", flag), nxt=("next", flag))
    got = seq.rows()
    part = by or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(*order)
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*part)
    hit = (F.col("label") == 3).cast("int")
    want = df.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.count("*").over(whole).alias("n"), F.sum(hit).over(upto).alias("hits"),
        F.sum(hit).over(whole).alias("all_hits"), F.lag("x", 9).over(w).alias("lag9"), F.lead("x", 2).over(w).alias("lead2"), F.max("x").over(w.rowsBetween(-9, 0)).alias("roll"),
        F.sum("label").over(upto).alias("s"), F.sum("label").over(whole).alias("t"), F.max("x").over(upto).alias("m"), F.last(flag, True).over(upto).alias("prev"),
        F.first(flag, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nxt"))
    assert got.count() == df.count()
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_chunks_are_bounded_despite_skew(spark):
    from tidemark.operators.ordering import CHUNK
    seq = arrange(skewed(spark, 20_000), by=["source"], order=["ts", "row_id"], chunk_rows=500)
    largest = seq.frame.groupBy(CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 1000


def test_spread_positions_match_numpy(spark):
    cases = [(10, k) for k in (0, 1, 2, 3, 9, 10, 12)] + [(1, 1), (7, 5), (1000, 333), (997, 64)]
    for n, k in cases:
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        kept = sorted(r["id"] for r in df.where(spread_keep(F.col("id"), F.col("n"), k)).collect())
        want = list(range(n)) if n <= k else sorted(set(np.linspace(0, n - 1, num=k, dtype=int).tolist()))
        assert kept == want, (n, k)


def test_take_keeps_both_ends(spark):
    taken = sorted(r["row_id"] for r in evenly_spaced_take(skewed(spark), 25, order=["row_id"]).collect())
    assert len(taken) == 25 and taken[0] == 0 and taken[-1] == 2999


def test_empty_input(spark):
    empty = skewed(spark).where("row_id < 0")
    assert with_position(empty, by=["source"], order=["ts", "row_id"]).count() == 0


def test_null_groups_and_times(small_chunks):
    rows = [(i, None if i % 4 == 0 else "a", None if i % 9 == 0 else i) for i in range(400)]
    df = small_chunks.createDataFrame(rows, "row_id bigint, source string, t bigint")
    got = with_position(df, by=["source"], order=["t", "row_id"])
    plain = df.withColumn("row_index", (F.row_number().over(Window.partitionBy("source").orderBy("t", "row_id")) - 1).cast("bigint"))
    assert got.exceptAll(plain.select(*got.columns)).isEmpty() and got.count() == 400


@pytest.mark.parametrize("count", [0, 1, 7, 8, 9, 63, 64, 65, 600])
def test_bins_equal_bisection(spark, count):
    bounds = [{"k0": i // 3, "k1": f"n{i % 3}"} for i in range(count)]
    rows = spark.range(700).select(F.floor(F.col("id") / 3).alias("a"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("b"), "id")
    found = with_bin(rows, "bin", bounds, "struct<k0:bigint,k1:string>", F.struct(F.col("a").alias("k0"), F.col("b").alias("k1")))
    assert found.columns == ["a", "b", "id", "bin"]
    assert {r["id"]: r["bin"] for r in found.collect()} == {i: bisect.bisect_right(range(count), i) for i in range(700)}


def test_many_chunks_are_found_by_compiled_comparisons(spark):
    """Past 64 bounds too, no step of the layout is a function over an array, which Spark interprets row by row."""
    seq = arrange(skewed(spark), by=["source"], order=["ts", "row_id"], chunk_rows=60)
    assert len(seq._chunks.bounds) > 64
    assert "lambda" not in seq.frame._jdf.queryExecution().toString()
