"""Helpers shared by the operators: table access, Arrow row maps, session settings, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import prepare, scratch_path, ship

#: Rows and bytes of one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, "16m"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches, UTC, the package on every executor."""
    prepare(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; cuts lineage."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_map(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply `function` to column lists of one Arrow batch after the other; it returns columns of `schema`."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"
