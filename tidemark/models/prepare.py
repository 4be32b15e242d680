"""Fitted preparation steps shared by the models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import medians


def impute(df: DataFrame, fitted: Mapping[str, float]) -> DataFrame:
    """Fill missing and NaN values with fitted medians."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(float(v))) for c, v in fitted.items()})


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without values is filled with 0."""
    found = medians(df, columns)
    return {c: found.get(c, 0.0) for c in columns}


def imputing_assembler(df: DataFrame, columns: Sequence[str], output: str = "features") -> list:
    """Pipeline stages that impute by exact training medians and build a vector.

    Spark's own `Imputer` takes approximate medians; a `SQLTransformer` with
    the exact ones saves and loads with the pipeline all the same.
    """
    fitted = fit_medians(df, columns)
    filled = {c: f"__in_{i}" for i, c in enumerate(columns)}
    parts = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), CAST({fitted[c]!r} AS DOUBLE)) AS {name}" for c, name in filled.items())
    return [SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__"), VectorAssembler(inputCols=list(filled.values()), outputCol=output)]


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets 1."""
    row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 1.0)) for i, c in enumerate(columns)}


def scaled(columns: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in columns.items()}


def class_index(label: Column, classes: Sequence[int]) -> Column:
    return (F.array_position(F.array(*[F.lit(int(c)) for c in classes]), label.cast("int")) - 1).cast("double")


def class_label(index: Column, classes: Sequence[int]) -> Column:
    return F.get(F.array(*[F.lit(int(c)) for c in classes]), index.cast("int"))
