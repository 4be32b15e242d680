"""Bracketed quantiles against numpy, at every level of brackets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles

FRACTIONS = [0.0, 0.001, 0.25, 0.5, 0.77, 0.9, 0.95, 0.999, 1.0]


def numbers(kind, rng):
    if kind == "ties":
        return [rng.choice([0.0, -0.0, 1.0, 2.5]) for _ in range(3000)]
    if kind == "distinct":
        return [rng.gauss(0, 1e6) for _ in range(3000)]
    if kind == "skewed":
        return [7.0] * 2000 + [rng.expovariate(1.0) for _ in range(800)] + [1e300, -1e300, 5e-324]
    return [rng.random()]


@pytest.mark.parametrize("inside,accuracy", [(50_000, 10_000), (20, 50), (0, 20)])
@pytest.mark.parametrize("kind", ["ties", "distinct", "skewed", "one"])
def test_equal_numpy(spark, monkeypatch, kind, inside, accuracy):
    monkeypatch.setattr(quantiles, "INSIDE_ROWS", inside)  # small: brackets are cut again and again
    monkeypatch.setattr(quantiles, "LEVEL_BOUNDS", 60 if inside else 4_096)
    values = numbers(kind, random.Random(1))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = quantiles.quantiles_of(df, {"v": (F.col("v"), FRACTIONS), "minus": (-F.col("v"), [0.5, 0.9])}, accuracy=accuracy)
    line = np.sort(np.array(values) + 0.0)
    for q, x in zip(FRACTIONS, got["v"]):
        at = (len(line) - 1) * q
        low = math.floor(at)
        assert x == (line[low] if at == low else line[low] * (1.0 - (at - low)) + line[low + 1] * (at - low))
    assert got["minus"][0] == -got["v"][FRACTIONS.index(0.5)]


def test_nulls_nan_and_infinities(spark):
    rows = [(None,), (math.nan,), (math.inf,), (-math.inf,), (1.0,), (2.0,)]
    df = spark.createDataFrame(rows, "v double")
    got = quantiles.quantiles_of(df, {"v": (F.col("v"), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]), "none": (F.lit(None).cast("double"), [0.5]), "nan": (F.lit(math.nan), [0.5])})
    assert got["v"][:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got["v"][4]) and math.isnan(got["v"][5])
    assert got["none"] == [None] and math.isnan(got["nan"][0])
    assert quantiles.exact_quantiles(df.limit(0), F.col("v"), [0.5]).collect() == []
    assert quantiles.medians(df.where("v IS NULL"), ["v"]) == {}


def test_groups_and_columns(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), F.col("id").alias("a b"), (F.col("id") * F.col("id")).alias("c"))
    got = {(r["g"], r["fraction"]): r["quantile"] for r in quantiles.exact_quantiles(df, F.col("c"), [0.5, 0.9], by="g").collect()}
    for key, rest in ((None, 0), ("g1", 1), ("g2", 2)):
        mine = np.array([float(k * k) for k in range(1000) if k % 3 == rest])
        assert got[key, 0.5] == pytest.approx(np.quantile(mine, 0.5)) and got[key, 0.9] == pytest.approx(np.quantile(mine, 0.9))
    assert quantiles.medians(df, ["a b", "c"]) == {"a b": 499.5, "c": (499.0 ** 2 + 500.0 ** 2) / 2}


def test_nothing_moves_by_value(spark, monkeypatch):
    """One row a bracket and task crosses a shuffle, and the few rows inside: far fewer than the rows."""
    from pyspark.sql import DataFrame

    moved = []
    plain = DataFrame.collect

    def counted(self):
        found = plain(self)
        moved.append(len(found))
        return found

    monkeypatch.setattr(DataFrame, "collect", counted)
    df = spark.range(200_000).select(F.rand(3).alias("v"))
    quantiles.quantiles_of(df, {"v": (F.col("v"), [0.5, 0.99])})
    assert sum(moved) < 2_000  # brackets of 0.04 % of the rows each, not 200,000 values


@pytest.mark.parametrize("kind", ["ties", "distinct", "skewed"])
def test_a_sketch_of_a_part_gives_the_same(spark, monkeypatch, kind):
    """The first sketch stands on about SKETCH_ROWS rows of a long series and on all of a short one; all rows are counted."""
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", 100)
    monkeypatch.setattr(quantiles, "INSIDE_ROWS", 20)
    values = numbers(kind, random.Random(2))
    df = spark.createDataFrame([(v, v if i % 60 == 0 else None) for i, v in enumerate(values)], "v double, few double").repartition(5)
    sketched, plain = [], quantiles._sketched
    monkeypatch.setattr(quantiles, "_sketched", lambda frame, *a: (sketched.append(frame.count()), plain(frame, *a))[1])
    got = quantiles.quantiles_of(df, {"v": (F.col("v"), FRACTIONS), "few": (F.col("few"), FRACTIONS)})
    assert sketched == [len(values)]
    for name, line in (("v", sorted(values)), ("few", sorted(values[::60]))):
        for q, x in zip(FRACTIONS, got[name]):
            at = (len(line) - 1) * q
            low = math.floor(at)
            assert x == (line[low] if at == low else line[low] * (1.0 - (at - low)) + line[low + 1] * (at - low))
