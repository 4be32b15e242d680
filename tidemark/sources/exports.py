"""Instrument exports: delimited text below a free-form metadata block.

Files are read as lines, in parallel and splittable. The order of lines in an
export is (file path, split start, position in the split); no step needs a
whole file in one task. Where splits start and which numbers their lines get
depends on the size of the cluster at the time of the scan, so numbered lines
are written once, and headers and readings are both taken from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.names import TIME_COLUMN, clean_header
from tidemark.operators.cleaning import attach_small, type_readings
from tidemark.session import scratch_path, settle

# A quote inside a quoted field is doubled; a field may be of any length.
_PARSING = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"', "maxCharsPerColumn": "-1"}
# Lines that are put in order together, as a power of two, and bytes of lines in one task.
_PIECE_BITS = 12
_TASK_BYTES = 32 << 20
_FIELD_BREAK = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def export_lines(spark: SparkSession, path: str | Sequence[str], *, named_by: str = "file") -> DataFrame:
    """Lines with `export` (its name), `line` and `at` (their order), written once.

    `named_by="folder"` takes the name from the `key=name` folder around the
    files, for exports that a distributed writer split into several parts.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, r"([^/=]+)/[^/]+$", 1) if named_by == "folder" else F.regexp_extract(file, r"([^/]+)$", 1)
    at = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    numbered = lines.select(F.url_decode(name).alias("export"), F.col("value").alias("line"), at.alias("at"))
    written = scratch_path(spark, "lines")
    numbered.write.parquet(written)
    return spark.read.schema(numbered.schema).parquet(written)


def csv_records(lines: DataFrame) -> DataFrame:
    """Lines as records: lines inside a quoted field are joined by a line feed; same columns.

    Whether a line stands inside quotes depends on all quotes before it in its
    file. Each piece of a few thousand lines is read for both cases at once, as
    if it began outside and as if it began inside a quoted field: it gives its
    number of quotes and how many records would begin in it either way. A prefix
    over the pieces of a file then tells which case holds and which record is
    open where a piece begins. Pieces are dealt over as many tasks as the lines
    need, so that no task holds more of a larger table.
    Files without a line of odd quotes pass as they are, and of the others only
    the lines of broken records are grouped. A quote that is never closed takes
    the rest of its file into one record, as it does for any reader.
    """
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    counted = lines.withColumns({"__file": F.col("at.file"), "__piece": F.struct(F.col("at.split").alias("split"), F.shiftright("at.n", _PIECE_BITS).alias("n")), "__quotes": quotes})
    broken = settle(counted.groupBy("__file").agg(F.sum(F.octet_length("line")).alias("bytes"), F.max(F.col("__quotes") % 2).alias("odd")).where("odd = 1"))
    total = broken.agg(F.sum("bytes")).first()[0]
    if total is None:
        return lines
    broken, tasks = broken.select("__file"), -(-total // _TASK_BYTES)

    def dealt(df: DataFrame) -> DataFrame:
        # Below the session's own number of partitions the window's shuffle does it, and joins small ones.
        return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, "__file", "__piece")

    whole = attach_small(counted, broken, ["__file"], "left_anti").select(*lines.columns)
    inside = Window.partitionBy("__file", "__piece").orderBy("at")
    before = F.coalesce(F.sum("__quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = settle(dealt(attach_small(counted, broken, ["__file"], "left_semi")).withColumn("__odd", before % 2))
    pieces = local.groupBy("__file", "__piece").agg(
        F.sum("__quotes").alias("__all"), F.count_if(F.col("__odd") == 0).alias("__from_outside"), F.count_if(F.col("__odd") == 1).alias("__from_inside"))
    earlier = Window.partitionBy("__file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__begins", F.coalesce(F.sum("__all").over(earlier) % 2, F.lit(0)))
    pieces = pieces.withColumn("__records", F.when(F.col("__begins") == 0, F.col("__from_outside")).otherwise(F.col("__from_inside")))
    pieces = pieces.withColumn("__open", F.last(F.when(F.col("__records") > 0, F.struct(F.col("__piece").alias("piece"), F.col("__records").alias("k"))), True).over(earlier))
    placed = dealt(attach_small(local, settle(pieces.select("__file", "__piece", "__begins", "__open")), ["__file", "__piece"]))
    starts, ends = (F.col("__odd") + F.col("__begins")) % 2 == 0, (F.col("__odd") + F.col("__begins") + F.col("__quotes")) % 2 == 0
    k = F.count_if(starts).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    record = F.when(k > 0, F.struct(F.col("__piece").alias("piece"), k.alias("k"))).otherwise(F.col("__open"))
    numbered = placed.withColumns({"__alone": starts & ends, "__record": record})
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    joined = (numbered.where(~F.col("__alone")).groupBy("export", "__file", "__record").agg(parts.alias("__parts"))
              .select("export", F.array_join("__parts.line", "\n").alias("line"), F.get("__parts", F.lit(0))["at"].alias("at")))
    return whole.unionByName(numbered.where("__alone").select(*lines.columns)).unionByName(joined.select(*lines.columns))


def export_headers(lines: DataFrame, *, header_row: int | None = None) -> DataFrame:
    """Column names of each export and where its header stands.

    The header is the first line with a time field, or line `header_row`
    (zero-based) of ordinary tables.
    """
    fields = F.transform(F.split("line", _FIELD_BREAK), clean_header)
    if header_row is not None:
        rank = F.row_number().over(Window.partitionBy("export").orderBy("at"))
        found = lines.withColumn("__rank", rank).where(F.col("__rank") <= header_row + 1)
        plain = F.transform(F.split("line", _FIELD_BREAK), lambda f: F.regexp_replace(F.trim(f), '^"|"$', ""))
        return (found.where(F.col("__rank") == header_row + 1).select("export", plain.alias("columns"), F.col("at").alias("header_at")))
    marked = F.col("line").contains(TIME_COLUMN) | F.col("line").contains("sampleTime") | F.col("line").contains("sample_time")
    heads = lines.where(marked).select("export", "at", fields.alias("columns")).where(F.array_contains("columns", TIME_COLUMN))
    return heads.groupBy("export").agg(F.min_by("columns", "at").alias("columns"), F.min("at").alias("header_at"))


def available_columns(headers: DataFrame) -> DataFrame:
    """Every column name with its first-seen place (export order, then position)."""
    fields = headers.select("export", F.posexplode("columns").alias("position", "name"))
    first = fields.groupBy("name").agg(F.min(F.struct("export", "position")).alias("first"))
    return first.select("name", F.col("first.export").alias("first_export"), F.col("first.position").alias("position"))


def exports_with_columns(headers: DataFrame, required: Sequence[str]) -> DataFrame:
    """Exports that hold every required column."""
    wanted = F.array(*[F.lit(c) for c in required])
    return headers.where(F.size(F.array_except(wanted, "columns")) == 0).select("export")


def read_exports(lines: DataFrame, headers: DataFrame, *, columns: Sequence[str] | None = None, time: str = TIME_COLUMN,
                 allow_missing: bool = True, first_rows: int | None = None, text: Sequence[str] = ()) -> DataFrame:
    """Typed readings of all exports, stamped with `source_file`; columns in `text` stay strings.

    Exports may have different columns in different order; a column an export
    lacks is null. `first_rows` keeps the first data lines of each export in
    file order, counted before untimed lines are dropped.
    """
    headers = settle(headers)
    if columns is None:
        names = available_columns(headers).orderBy("first_export", "position").select("name")
        columns = [r["name"] for r in names.collect()]
    elif not allow_missing:
        lacking = headers.join(exports_with_columns(headers, columns), "export", "left_anti").select("export").take(1)
        if lacking:
            raise ValueError(f"missing expected columns in {lacking[0]['export']}")
    wanted = [time, *[c for c in columns if c != time]]
    width = headers.agg(F.max(F.size("columns"))).first()[0] or 1
    data = attach_small(lines, headers, ["export"]).where(F.col("at") > F.col("header_at"))
    if first_rows is not None:
        data = _first_lines(data.where(F.length(F.trim("line")) > 0), first_rows)
    parsed = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), _PARSING)
    cells = data.select("export", "columns", parsed.alias("row")).withColumn("cells", F.array(*[F.col(f"row.c{i}") for i in range(width)]))

    def cell(name: str) -> Column:
        return F.get("cells", F.array_position("columns", F.lit(name)).cast("int") - 1).alias(name)

    table = cells.select(*[cell(c) for c in wanted], F.col("export").alias("source_file"))
    return type_readings(table, time=time, keep_text=["source_file", *text])


def _first_lines(data: DataFrame, count: int) -> DataFrame:
    """The first `count` lines of each export; lines are ranked inside their split, and only in splits that can hold one."""
    placed = data.withColumns({"__file": F.col("at.file"), "__split": F.col("at.split")})
    sizes = placed.groupBy("export", "__file", "__split").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("export").orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("__before", before).where(F.col("__before") < count).drop("__size")
    rank = F.row_number().over(Window.partitionBy("export", "__file", "__split").orderBy("at"))
    near = placed.join(starts, ["export", "__file", "__split"]).withColumn("__rank", rank)
    return near.where(F.col("__before") + F.col("__rank") <= count).select(*data.columns)


def write_exports(rows: DataFrame, path: str, *, name: Column, time: str, columns: dict[str, Sequence[str]], kind: Column,
                  order: Sequence[str], missing: str = "NaN") -> None:
    """Write readings as exports: a metadata block, a header, data lines.

    `columns` lists the columns of each kind of export, `kind` tells a row's
    kind. A large export is written by several tasks, in order.
    """
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, names in columns.items():
        values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in names]
        title = '#"Time UTC (yyyy-mm-ddThh:mm:ss.fffZ)",' + ",".join(f'"{c}"' for c in names)
        line = F.when(F.col("__kind") == key, F.concat_ws(",", stamp, *values)).otherwise(line)
        head = F.when(F.col("__kind") == key, title).otherwise(head)
    marked = rows.withColumns({"export": name, "__kind": kind})
    body = marked.select("export", F.lit(1).alias("__part"), *order, line.alias("line"))
    top = marked.select("export", "__kind").distinct().select("export", F.posexplode(F.array(F.lit("# station metadata"), F.lit("# instrument, serial"), head)).alias("__i", "line"))
    top = top.select("export", F.lit(0).alias("__part"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order[:-1]],
                     F.col("__i").cast(rows.schema[order[-1]].dataType).alias(order[-1]), "line")
    ordered = body.unionByName(top).repartitionByRange("export", "__part", *order).sortWithinPartitions("export", "__part", *order)
    ordered.select("export", "line").write.mode("overwrite").partitionBy("export").text(path)
