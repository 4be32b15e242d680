"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_CHUNK_CONF = "spark.tidemark.rowsPerChunk"
DEFAULT_ROWS_PER_CHUNK = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator relies on (UTC clock, AQE)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def rows_per_chunk(spark: SparkSession) -> int:
    return max(int(spark.conf.get(ROWS_PER_CHUNK_CONF, str(DEFAULT_ROWS_PER_CHUNK))), 1)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read: the cluster's `spark.checkpoint.dir`.

    Only a local master, where driver and executors are one machine, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder for one intermediate dataset.

    All paths of an application lie in one folder, which `discard_scratch`
    removes; it runs by itself when the driver ends.
    """
    folder = _scratch_folder(spark)
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(discard_scratch, spark)
    return f"{folder}/{stem}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate datasets; results that still read them must be written before."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _OWNED.discard(_scratch_folder(spark))


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


_OWNED: set[str] = set()
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors, once per application.

    Functions inside plans are pickled by module name, so executors must be able
    to import the package wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to reliable storage and cut its lineage.

    Used where a result is read several times, so the work above it runs once
    and survives the loss of executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
