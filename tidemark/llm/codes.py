"""Vector codes: each vector is cut into parts, each part named by the nearest entry of its codebook.

The codebooks come from ball k-means. A part that was given to an entry lies in
that entry's ball. An entry j can be as near to the part as its own entry i only
if |c_i - c_j| <= 2 |x - c_i|, so

- entries beyond twice the ball's radius are no neighbours of the ball at all,
- a part nearer than half the way to the nearest neighbour is in the stable core
  and needs no distance but its own,
- any other part lies in the ring between two neighbours' half distances and is
  compared with the neighbours inside that ring only.

The tests are on squared integers, so the result is the one of a full search,
ties to the lower index included. Radii are known without another pass: the old
radius plus the entry's own move is a bound of the new one.

Spark holds the vectors, their parts and codes; a round is one narrow pass that
assigns and adds up, with one row per entry and task going to an aggregate of
(part, entry). The driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import scratch_path

#: Components beyond this magnitude are held at it: further out a squared distance leaves 64 bits.
LARGEST = 1 << 27
#: Up to this magnitude all sums of squares are exact in doubles, which have the faster products.
EXACT_IN_DOUBLES = 1 << 20
#: Rows worked on at once in a task.
BLOCK_ROWS = 2_048

PARTS_SCHEMA = "vec_id bigint, label int, parts binary"
CODED_SCHEMA = PARTS_SCHEMA + ", code binary"
SCORED_SCHEMA = "vec_id bigint, label int, code string, error bigint"
SUMS_SCHEMA = "part int, entry int, members bigint, reach bigint, total array<bigint>"


@dataclass
class Balls:
    """Codebooks (parts x entries x width) with each entry's neighbours inside its radius."""

    entries: np.ndarray
    order: np.ndarray     # parts x entries x entries: other entries by distance, then index
    distance: np.ndarray  # squared distances in that order; beyond twice the radius: no neighbour (-1)

    @classmethod
    def around(cls, entries: np.ndarray, radius: np.ndarray | None = None) -> Balls:
        """`radius`: bound of |x - entry| over each entry's parts; None where nothing is known."""
        parts, size, _ = entries.shape
        apart = squared(entries, entries)
        index = np.arange(size)
        apart[:, index, index] = -1  # an entry comes first in its own list, which is then cut off
        order = np.argsort(apart, axis=2, kind="stable")[:, :, 1:]
        distance = np.take_along_axis(apart, order, axis=2)
        if radius is not None:
            distance = np.where(distance <= 4 * np.minimum(radius, 1 << 30)[:, :, None] ** 2, distance, -1)
        return cls(entries, order, distance)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Full search: index and squared distance of each part's nearest entry; x is parts x rows x width."""
        away = squared(x, self.entries)
        index = away.argmin(axis=2)  # the first of equals
        return index, np.take_along_axis(away, index[:, :, None], axis=2)[:, :, 0]

    def moved(self, x: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts whose ball is known: stable cores keep their entry, the rest looks at its ring."""
        best, away = given.copy(), np.empty(given.shape, np.int64)
        for p in range(x.shape[0]):
            entries, parts = self.entries[p], x[p]
            own = ((parts - entries[given[p]]) ** 2).sum(axis=1)
            lowest = own.copy()
            reach = 4 * own
            rows = np.arange(len(own))
            for step in range(self.order.shape[2]):
                between = self.distance[p, given[p][rows], step]
                rows = rows[(between >= 0) & (between <= reach[rows])]
                if not len(rows):
                    break
                other = self.order[p, given[p][rows], step]
                distance = ((parts[rows] - entries[other]) ** 2).sum(axis=1)
                better = (distance < lowest[rows]) | ((distance == lowest[rows]) & (other < best[p, rows]))
                best[p, rows[better]], lowest[rows[better]] = other[better], distance[better]
            away[p] = lowest
        return best, away


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, parts x rows x entries, exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if largest <= EXACT_IN_DOUBLES and x.shape[2] <= 512 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    product = x @ entries.transpose(0, 2, 1)
    return ((x * x).sum(axis=2)[:, :, None] - 2 * product + (entries * entries).sum(axis=2)[:, None, :]).astype(np.int64)


def vector_parts(embeddings: DataFrame, *, scale: int = 256) -> DataFrame:
    """(vec_id, label, parts): the vectors as integers floor(scale * x), 32-bit little-endian.

    Rows whose vector is null or holds a null or non-finite component go. An
    empty vector has no component and stays.
    """
    arrow = to_arrow_schema(StructType.fromDDL(PARTS_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keep, made = np.zeros(len(batch), bool), []
            values, first = lists.values, lists.offsets.to_numpy()
            good = np.isfinite(values.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64))
            bad_before = np.concatenate([[0], np.cumsum(~good)])
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (bad_before[first[1:]] == bad_before[first[:-1]])
            numbers = np.where(good, values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
            scaled = np.clip(np.floor(np.clip(numbers, -1e12, 1e12) * scale), -LARGEST, LARGEST).astype("<i4")
            for i in np.flatnonzero(whole):
                keep[i] = True
                made.append(scaled[first[i]:first[i + 1]].tobytes())
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(made, pa.binary())], schema=arrow)

    columns = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return columns.mapInArrow(run, PARTS_SCHEMA)


def seeds(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """First codebooks: the parts of the vectors with the smallest ids, ascending (nulls after all, equal ids by content).

    The length of the first vector is that of the codebooks; None if there is none to cut.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].parts) // 4
    cut = [np.frombuffer(r.parts, "<i4") for r in first if len(r.parts) == 4 * width and width % parts == 0]
    return np.stack(cut).reshape(len(cut), parts, width // parts).transpose(1, 0, 2).astype(np.int64) if cut else None


def _assigned(balls: Balls, parts: int, known: bool, emit, schema: str):
    """A map over tasks: assigns blocks of rows and hands (batch, which rows fit, codes, distances, parts) to `emit`."""
    bytes_of, arrow = 4 * parts * balls.entries.shape[2], to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in _blocks(batches):
            raw = batch.column(2)
            fits = np.fromiter((v.as_buffer().size == bytes_of for v in raw), bool, len(batch))
            joined = b"".join(v.as_py() for v, f in zip(raw, fits) if f)
            x = np.frombuffer(joined, "<i4").reshape(-1, parts, bytes_of // 4 // parts).transpose(1, 0, 2).astype(np.int64)
            if known:
                codes = np.frombuffer(b"".join(v.as_py() for v, f in zip(batch.column(3), fits) if f), np.uint8).reshape(-1, parts).T.astype(np.int64)
                codes, away = balls.moved(x, codes)
            else:
                codes, away = balls.nearest(x)
            made = emit(state, arrow, batch, fits, codes, away, x)
            if made is not None:
                yield made
        last = emit(state, arrow, None, None, None, None, None)
        if last is not None:
            yield last

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small Arrow batches put together to blocks that are worth a numpy call."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK_ROWS:
            yield _together(held)
            held, rows = [], 0
    if rows:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns], names=whole.column_names)


def _optional(values: list, fits: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of the rows that fit, null for the others."""
    found = iter(values)
    return pa.array([next(found) if f else None for f in fits], kind)


def _coded(state, arrow, batch, fits, codes, away, x):
    if batch is None:
        return None
    rows = codes.T.astype(np.uint8)
    return pa.RecordBatch.from_arrays([*batch.columns[:3], _optional([r.tobytes() for r in rows], fits, pa.binary())], schema=arrow)


def _summed(size: int):
    def emit(state, arrow, batch, fits, codes, away, x):
        if batch is None:
            if not state:
                return None
            part, entry = np.nonzero(state["members"])
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(state["members"][part, entry], pa.int64()), pa.array(state["reach"][part, entry], pa.int64()),
                 pa.array(list(state["total"][part, entry]), pa.list_(pa.int64()))], schema=arrow)
        parts, _, width = x.shape
        if not state:
            state.update(members=np.zeros((parts, size), np.int64), reach=np.zeros((parts, size), np.int64), total=np.zeros((parts, size, width), np.int64))
        for p in range(parts):
            state["members"][p] += np.bincount(codes[p], minlength=size)
            np.maximum.at(state["reach"][p], codes[p], away[p])
            np.add.at(state["total"][p], codes[p], x[p])
        return None

    return emit


def _scored(state, arrow, batch, fits, codes, away, x):
    if batch is None:
        return None
    rows = codes.T.astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), _optional([r.tobytes().hex() for r in rows], fits, pa.string()), _optional(away.sum(axis=0).tolist(), fits, pa.int64())],
        schema=arrow)


def compress(embeddings: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), final codebooks) of all vectors that hold finite numbers only.

    Each part of a vector takes the nearest entry (ties to the lower index);
    after each of `rounds` assignments an entry becomes the floor of the mean of
    its parts, an entry without parts stays. `entries` is at most 256, so that an
    index is one byte.

    Null vectors and vectors with a null or non-finite component go. Repeated
    rows count as often as they occur. Fewer vectors than entries: so many
    entries. A vector whose length is not that of the first, or is no multiple
    of `parts`, can't be cut: its row stays, without code and error. No vector:
    no rows and no codebooks. Components are held within +-2^27.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    at = vector_parts(embeddings, scale=scale)
    spark, books = embeddings.sparkSession, seeds(at, parts, entries)
    if books is None:
        return at.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), None
    size, balls, known = books.shape[1], Balls.around(books), False
    for _ in range(rounds):
        # The codes of this round are written, then added up from the table, so each assignment is made once.
        path = scratch_path(spark, "vector-codes")
        at.mapInArrow(_assigned(balls, parts, known, _coded, CODED_SCHEMA), CODED_SCHEMA).write.option("compression", "zstd").parquet(path)
        at, known = spark.read.schema(CODED_SCHEMA).parquet(path), True
        sums = (at.mapInArrow(_assigned(_own_ball(balls), parts, True, _summed(size), SUMS_SCHEMA), SUMS_SCHEMA).groupBy("part", "entry")
                .agg(F.sum("members").alias("members"), F.max("reach").alias("reach"),
                     *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(books.shape[2])]).collect())  # at most parts x entries rows
        old, books, reach = books, books.copy(), np.zeros(books.shape[:2], np.int64)
        for r in sums:
            books[r.part, r.entry] = [r[f"t{k}"] // r.members for k in range(books.shape[2])]
            reach[r.part, r.entry] = math.isqrt(r.reach) + 1
        move = np.array([[math.isqrt(int(d)) + 1 for d in row] for row in ((books - old) ** 2).sum(axis=2)]).reshape(reach.shape)
        balls = Balls.around(books, reach + move)
    return at.mapInArrow(_assigned(balls, parts, known, _scored, SCORED_SCHEMA), SCORED_SCHEMA), books


def _own_ball(balls: Balls) -> Balls:
    """The same codebooks without neighbours: every part keeps its entry, only its distance is taken."""
    return Balls(balls.entries, balls.order[:, :, :0], balls.distance[:, :, :0])


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry, position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def code_report(embeddings: DataFrame, **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes with the error summed over equal labels, nulls together."""
    found, books = compress(embeddings, **settings)
    path = scratch_path(embeddings.sparkSession, "vector-errors")
    found.write.parquet(path)
    found = embeddings.sparkSession.read.schema(found.schema).parquet(path)
    totals = found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("of_label")))  # Spark broadcasts the totals where they are small and splits a hot label where not
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
