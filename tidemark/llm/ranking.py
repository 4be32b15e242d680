"""Ranked lexical search by bag deduplication.

Only the terms of the items matter to a score, so each document is restricted to
the items' vocabulary: its bag holds the times of those terms. Documents with
equal bags and equal length share m score alike for every item; they are one
class. Classes are found by hash and verified by the bag itself (the grouping
compares it), scored once, and the best classes of an item are expanded to their
members by ascending doc_id.

Twenty classes an item are enough, without loss: a class that comes after twenty
others, by score and then by its smallest doc_id, has twenty documents before
all of its own, the smallest members of those classes.

Spark does the work: bags are one narrow pass over the texts, counts an
aggregate, classes a grouping with partial aggregates (many copies of a text
shrink before they move), each task keeps the best twenty classes an item, and
windows with a pushed-down limit rank what is left. Items are taken in blocks of
bounded vocabulary, so what a task holds does not grow with the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import row_map, written

#: Bytes of terms, A-Z as a-z; all others part terms. Bytes from 0x80 on belong to code points above U+007F.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: (item, term) pairs and items of one block: bounds of what the driver and each task hold.
PAIRS_PER_BLOCK, ITEMS_PER_BLOCK = 1_000_000, 10_000
#: Entries of a task's working arrays.
CELLS = 2_000_000
#: Bytes of classes that may be broadcast.
BROADCAST_BYTES = 16 << 20
NO_ID = (1 << 63) - 1
SCORED_SCHEMA = "item int, score bigint, first_id bigint, class_hash bigint, m bigint, bag binary"


def terms(text: bytes | None) -> list[bytes]:
    """Maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ in UTF-8 text, A-Z lower-cased."""
    return text.translate(FOLD).split() if text else []


@dataclass
class Block:
    """Some items, and the items each of their terms occurs in."""

    items: list
    vocabulary: dict[bytes, int]
    first: np.ndarray   # term t occurs in item[first[t]:first[t + 1]], times[...] times
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, bytes | None]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        postings: list[dict[int, int]] = []
        for k, (_, text) in enumerate(rows):
            for t in terms(text):
                at = vocabulary.setdefault(t, len(vocabulary))
                if at == len(postings):
                    postings.append({})
                postings[at][k] = postings[at].get(k, 0) + 1
        sizes = [len(p) for p in postings]
        return cls([r[0] for r in rows], vocabulary, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64),
                   np.array([k for p in postings for k in p], np.int64), np.array([n for p in postings for n in p.values()], np.int64))


def bags(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of every row: n terms in all, and (term, times) pairs of the vocabulary as 32-bit numbers, null if none."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        n, made = [], []
        for text in columns["text"]:
            found = terms(text)
            n.append(len(found))
            known = [vocabulary[t] for t in found if t in vocabulary]
            if known:
                index, times = np.unique(np.array(known, np.uint32), return_counts=True)
                made.append(np.stack([index, times.astype(np.uint32)], 1).tobytes())
            else:
                made.append(None)
        return {"doc_id": columns["doc_id"], "n": n, "bag": made}

    return row_map(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id bigint, n bigint, bag binary")


def counts(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents a term of the vocabulary is in); tasks send one row a term."""
    arrow = to_arrow_schema(StructType.fromDDL("term int, amount bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = np.array(batch.column(0).to_pylist(), np.int64)
            total[size] += (n > 0).sum()
            total[size + 1] += n.sum()
            joined = b"".join(b for b in batch.column(1).to_pylist() if b)
            total[:size] += np.bincount(np.frombuffer(joined, np.uint32)[::2], minlength=size)[:size]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=arrow)

    rows = found.select("n", "bag").mapInArrow(run, "term int, amount bigint").groupBy("term").agg(F.sum("amount").alias("amount")).collect()  # one row a term of the block
    total = np.zeros(size + 2, np.int64)
    for r in rows:
        total[r.term] = r.amount
    return int(total[size]), int(total[size + 1]), total[:size]


def _best(block: Block, weights: np.ndarray, top: int):
    """A map over classes: each task's best `top` classes of every item."""
    items, first, sizes = len(block.items), block.first, np.diff(block.first)
    # Terms in many items meet their weights in one matrix product, the others by their lists.
    common = np.flatnonzero(sizes > max(8, items // 8))
    common = common[:max(1, CELLS // max(items, 1))]
    place = np.full(len(sizes), -1)
    place[common] = np.arange(len(common))
    matrix = np.zeros((len(common), items))
    for k, t in enumerate(common):
        matrix[k, block.item[first[t]:first[t + 1]]] = block.times[first[t]:first[t + 1]]
    most = np.bincount(block.item, block.times, minlength=items).max(initial=0) * max(1, int(weights.max(initial=0))) * 1_000_000
    exact = most < 1 << 53  # sums of whole numbers below this are exact in doubles
    arrow = to_arrow_schema(StructType.fromDDL(SCORED_SCHEMA))

    def scores(bag_list: list[bytes], m: np.ndarray) -> np.ndarray:
        pairs = np.frombuffer(b"".join(bag_list), np.uint32).reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bag_list)), [len(b) // 8 for b in bag_list])
        term, times = pairs[:, 0], pairs[:, 1]
        value = weights[term] * ((1_000_000_000 * times) // (1_000 * times + 12 * m[row]))
        if not exact:
            out = np.zeros((len(bag_list), items), np.int64)
            for r, t, v in zip(row, term, value):
                out[r, block.item[first[t]:first[t + 1]]] += v * block.times[first[t]:first[t + 1]]
            return out
        wide = place[term] >= 0
        dense = np.zeros((len(bag_list), len(common)))
        dense[row[wide], place[term[wide]]] = value[wide]
        out = dense @ matrix
        row, term, value = row[~wide], term[~wide], value[~wide]
        size = sizes[term]
        for part in _runs(size):
            s = size[part]
            at = np.repeat(first[term[part]] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
            key = np.repeat(row[part], s) * items + block.item[at]
            out += np.bincount(key, np.repeat(value[part], s) * block.times[at], minlength=out.size).reshape(out.shape)
        return out.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: np.zeros(0, np.int64) for k in ("item", "score", "first_id", "class_hash", "ref")}
        least, classes, made = np.ones(items, np.int64), {}, 0
        rows_at_once = max(1, CELLS // max(items, 1))
        for batch in batches:
            for start in range(0, len(batch), rows_at_once):
                piece = batch.slice(start, rows_at_once)
                hashed, ids = piece.column(0).to_numpy(), piece.column(3).to_numpy()
                m, bag_list = piece.column(1).to_numpy(), piece.column(2).to_pylist()
                found = scores(bag_list, m)
                row, item = np.nonzero(found >= least)
                if not len(row):
                    continue
                fresh = {"item": item, "score": found[row, item], "first_id": ids[row], "class_hash": hashed[row], "ref": made + row}
                for r in np.unique(row).tolist():
                    classes[made + r] = (int(m[r]), bag_list[r])
                made += len(bag_list)
                best = {k: np.concatenate([best[k], fresh[k]]) for k in best}
                order = np.lexsort((best["class_hash"], best["first_id"], -best["score"], best["item"]))
                best = {k: v[order] for k, v in best.items()}
                begins = np.searchsorted(best["item"], best["item"])
                keep = np.arange(len(begins)) - begins < top
                best = {k: v[keep] for k, v in best.items()}
                full = np.flatnonzero(np.bincount(best["item"], minlength=items) >= top)
                least[full] = best["score"][np.searchsorted(best["item"], full, side="right") - 1]
                classes = {r: classes[r] for r in np.unique(best["ref"]).tolist()}
        of = [classes[r] for r in best["ref"].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
            (best["item"], best["score"], best["first_id"], best["class_hash"], [c[0] for c in of], [c[1] for c in of]), arrow.types)], schema=arrow)

    return run


def _runs(sizes: np.ndarray) -> list[slice]:
    """Consecutive entries whose sizes add up to about CELLS at most."""
    if not len(sizes):
        return []
    group = np.cumsum(sizes) // CELLS
    cuts = np.flatnonzero(np.diff(group)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(sizes)])]


def _rank_block(documents: DataFrame, block: Block, top: int) -> DataFrame | None:
    """(item, rank, doc_id, score) of one block of items; null ids come after all others of their score."""
    found = written(bags(documents, block.vocabulary), "bags")
    n_docs, n_terms, df = counts(found, len(block.vocabulary))
    if not n_terms or not block.vocabulary:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    keyed = found.filter("bag IS NOT NULL").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.expr(f"75 + (CAST(n AS DECIMAL(14,0)) * CAST('{25 * n_docs}' AS DECIMAL(22,0))) div CAST({n_terms} AS DECIMAL(20,0))").alias("m"), "bag",
    ).withColumn("class_hash", F.xxhash64("m", "bag"))
    classes = keyed.groupBy("class_hash", "m", "bag").agg(F.min("id_key").alias("first_id"))
    order = [F.col("score").desc(), "first_id", "class_hash", "m", "bag"]
    scored = classes.mapInArrow(_best(block, weights, top), SCORED_SCHEMA)
    chosen = written(scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("place") <= top).drop("place"), "best-classes")
    key = ["class_hash", "m", "bag"]
    wanted = chosen.select(key).distinct()  # at most `top` classes an item
    size = wanted.agg(F.coalesce(F.sum(F.length("bag") + 64), F.lit(0))).first()[0]
    members = keyed.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, key, "left_semi")
    # A hot class is cut to its smallest ids in each task before the rows move (limit pushed below the window's shuffle).
    members = members.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id_key"))).filter(F.col("place") <= top).drop("place")
    expanded = chosen.drop("first_id").join(members, key)
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "id_key"))).filter(F.col("rank") <= top)
    return ranked.select("item", "rank", F.expr(f"nullif(id_key, {NO_ID})").alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, *, top: int = 20, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents with a score above 0, equal scores by ascending doc_id.

    Null and empty texts have no term: such documents are in no result and count
    nowhere, such items have no row. Every row of either table counts for
    itself, so equal item rows give equal rows of results and repeated documents
    each take a rank. Documents without an id come last among equals. Empty
    tables give no rows.
    """
    spark, id_type = documents.sparkSession, items.schema[id_column].dataType.simpleString()
    texts = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("binary").alias("text"))
    sized = row_map(texts.select("text"), lambda c: {"pairs": [len(set(terms(t))) for t in c["text"]]}, "pairs bigint")
    pairs, rows = sized.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-pairs // PAIRS_PER_BLOCK), -(-rows // ITEMS_PER_BLOCK))
    out = None
    for b in range(blocks):
        part = texts if blocks == 1 else texts.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks})") == b)
        block = Block.of(sorted(((r.item_id, bytes(r.text) if r.text is not None else None) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")))
        ranked = _rank_block(documents, block, top) if block.vocabulary else None
        if ranked is not None:
            names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {id_type}")
            found = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
