"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines; long lines are cut where a hash of the bytes
before a space says so, on average every 24 words. Cuts depend on what stands
around them, not on the line's start: a word put in or taken out changes the
paragraph around it, and the rest stays. Each paragraph's digest (with its occurrence among
equal paragraphs) goes into three cells of a table that keep a count, the
exclusive or of digests, and that of check sums. Two sketches subtract cell by
cell; what both texts share vanishes. Cells with one digest left give it away,
and taking it out of its other cells opens more of them. If that gets stuck, both
texts are sketched again at four times the size, until the difference is out.

Nulls count as empty texts; these have no paragraphs, and two of them are alike.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import row_map
from tidemark.operators.ordering import comparable, search_bounds

#: Words of the longest line that is never cut and of the mean paragraph of others, and cells of a fingerprint.
RUN_WORDS, CELLS = 24, 24
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_M1, _M2, _S1, _S2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33), np.uint64(29)
_HALF, _THIRDS = np.uint64(32), np.arange(3)
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("keys", "<u8")])


_WINDOW, _PADDING = np.arange(8), np.zeros(8, np.uint8)


def paragraphs(text: str | None) -> Iterator[bytes]:
    """Paragraphs in UTF-8, those of long lines last and with single spaces between words."""
    long = []
    for line in (text or "").split("\n"):
        words = line.split()
        if len(words) > RUN_WORDS:
            long.append(" ".join(words))
        elif words:
            yield line.encode("utf-8", "surrogatepass")
    if long:
        yield from _runs(_BETWEEN.join(long).encode("utf-8", "surrogatepass"))


#: Between two long lines; the zeros keep a line's first cuts free of the line before it.
_BETWEEN = "\n" + "\0" * 8


def _runs(lines: bytes) -> Iterator[bytes]:
    """Cut between lines, and behind a space where the eight bytes before it hash into one part of `RUN_WORDS`."""
    data = np.frombuffer(lines, np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10))
    ends = np.concatenate([_PADDING, data])[stops[:, None] + _WINDOW].view(np.uint64).ravel() * _M1
    chosen = (((ends ^ (ends >> _S2)) * _M2) >> _S1) % np.uint64(RUN_WORDS) == 0
    chosen |= data[stops] == 10
    first = 0
    for cut in stops[chosen].tolist():
        yield lines[first:cut]
        first = cut + (1 if lines[cut] == 32 else len(_BETWEEN))
    yield lines[first:]


def digests(text: str | None) -> np.ndarray:
    """Digests of a text's paragraphs; equal paragraphs get different ones by their occurrence."""
    seen: dict[bytes, int] = {}
    found = []
    for p in paragraphs(text):
        nth = seen[p] = seen.get(p, -1) + 1
        found.append(xxhash.xxh64_intdigest(p, nth))
    return np.array(found, np.uint64)


def _mixed(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = keys[:, None] ^ seeds[None, :]
    h *= _M1
    h ^= h >> _S1
    h *= _M2
    h ^= h >> _S2
    return h


def _put(cells: np.ndarray, keys: np.ndarray, signs: np.ndarray, h: np.ndarray | None = None) -> None:
    h = _mixed(keys, _SEEDS) if h is None else h
    third = len(cells) // 3
    at = ((h[:, :3] % np.uint64(third)).view(np.int64) + _THIRDS * third).ravel()
    np.add.at(cells["count"], at, np.repeat(signs, 3))
    np.bitwise_xor.at(cells["keys"], at, np.repeat(keys, 3))
    np.bitwise_xor.at(cells["check"], at, np.repeat((h[:, 3] >> _HALF).astype(np.uint32), 3))


def build(keys: np.ndarray, cells: int = CELLS) -> np.ndarray:
    table = np.zeros(cells, _CELL)
    if len(keys):
        _put(table, keys, np.ones(len(keys), np.int32))
    return table


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _CELL)
    out["count"] = a["count"] - b["count"]
    out["keys"] = a["keys"] ^ b["keys"]
    out["check"] = a["check"] ^ b["check"]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests only in the first and only in the second text; None if the sketch is too small for them."""
    table = table.copy()
    ours, theirs = [], []
    for _ in range(len(table) + 1):
        single = np.flatnonzero(np.abs(table["count"]) == 1)
        if not len(single):
            break
        keys, signs = table["keys"][single], table["count"][single]
        h = _mixed(keys, _SEEDS)
        pure = (h[:, 3] >> _HALF).astype(np.uint32) == table["check"][single]
        # A digest may be alone in several of its cells.
        once = {key: i for i, key in enumerate(keys.tolist()) if pure[i]}
        if not once:
            break
        at = list(once.values())
        keys, signs, h = keys[at], signs[at], h[at]
        ours.append(keys[signs > 0])
        theirs.append(keys[signs < 0])
        _put(table, keys, -signs, h)
    if table["count"].any() or table["keys"].any():
        return None
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *ours]), np.concatenate([empty, *theirs])


def difference(at_size: Callable[[int], tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The differing digests of two texts, whose sketches `at_size` gives; four times the size on failure."""
    while True:
        out = peel(subtract(*at_size(cells)))
        if out is not None:
            return out
        cells *= 4


def likeness(a: np.ndarray, b: np.ndarray, sketch_a: np.ndarray | None = None, sketch_b: np.ndarray | None = None) -> float:
    """Shared part of all paragraphs of two texts, from the peeled difference of their sketches."""
    keys, signs = np.concatenate([a, b]), np.repeat(np.array([1, -1], np.int32), [len(a), len(b)])

    def subtracted(cells: int) -> np.ndarray:
        """Both sketches of this size, one taken from the other, in one pass."""
        if cells == CELLS and sketch_a is not None and sketch_b is not None:
            return subtract(sketch_a, sketch_b)
        table = np.zeros(cells, _CELL)
        _put(table, keys, signs)
        return table

    cells = CELLS
    while cells < 1.2 * abs(len(a) - len(b)):  # at least so many digests differ, and no smaller sketch can give them away
        cells *= 2
    while (out := peel(subtracted(cells))) is None:
        cells *= 4
    union = len(a) + len(out[1])
    return (len(a) - len(out[0])) / union if union else 1.0


def fingerprint(table: np.ndarray) -> str:
    return base64.b64encode(table.tobytes()).decode()


def load(printed: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(printed), _CELL)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the following one."""
    part = len(text) // 3
    return text[:len(text) - part] + following[:part]


# ---------------------------------------------------------------- documents beside their successors

#: Ranges at most, and sampled keys for each: bounds of what the driver holds.
RANGES, SAMPLES = 8_192, 16


def beside_next(documents: DataFrame, function: Callable[[object, str, str], tuple], names: list[str], schema: str) -> DataFrame:
    """Apply `function(doc_id, text, next text)` in descending order of doc_id; after the last comes the first.

    Rows stand in order of (doc_id, hash of the text), ids of any type by their own
    order, null ids last; so one id on many texts is spread over several ranges, too.
    Only rows alike in both can't be told apart. A sample of keys of bounded size,
    those with the smallest hashes, cuts the order into ranges. The first document of each range
    is also sent to the range before it, so each text moves once (a few twice)
    and no range needs another's task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    place = comparable(documents, "doc_id")
    place = F.lit(0) if documents.schema["doc_id"].dataType.typeName() == "void" else place
    keyed = documents.select("doc_id", F.struct(place.alias("id"), F.xxhash64(text).alias("tie")).alias("place"), text.alias("text"))
    kind = keyed.schema["place"].dataType.simpleString()
    tasks = max(1, 2 * documents.rdd.getNumPartitions())
    wanted = min(4 * tasks, RANGES)  # several ranges a task, so that tasks are about as large
    sample = keyed.select("place").distinct().orderBy(F.xxhash64("place")).limit(SAMPLES * wanted)
    drawn = [r["place"] for r in sample.orderBy("place").collect()]
    bounds = [drawn[i].asDict() for i in sorted({len(drawn) * k // wanted for k in range(1, wanted)}) if i] if len(drawn) > 1 else []
    listed = lambda values, of: F.from_json(F.lit(json.dumps(values, default=str)), f"array<{of}>")
    ranged = keyed.withColumn("range", search_bounds(json.loads(json.dumps(bounds, default=str)), kind, F.col("place")))
    heads = {r["range"]: r["head"].asDict() for r in ranged.groupBy("range").agg(F.max("place").alias("head")).collect()}  # one row per range
    there = sorted(heads)
    span = (there[-1] + 1) if there else 0
    before = dict(zip(there, there[1:] + there[:1]))  # where a range's first document is the successor
    head_of = F.get(listed([heads.get(i) for i in range(span)], kind), F.col("range"))
    goes_to = F.get(listed([before.get(i, 0) for i in range(span)], "int"), F.col("range"))
    own = F.struct(F.col("range").alias("target"), F.lit(0).alias("guest"))
    guest = F.struct(goes_to.alias("target"), F.lit(1).alias("guest"))
    sent = ranged.select("doc_id", "place", "text", F.explode(F.when(F.col("place").eqNullSafe(head_of), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    laid = (sent.select("doc_id", "place", "text", "to.target", "to.guest").repartition(min(tasks, max(1, len(there))), "target")
            .sortWithinPartitions("target", "guest", F.col("place").desc(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("target", "guest", "doc_id", "text")))
            for target, is_guest, doc, text in rows:
                if waiting is not None and waiting[0] == target:
                    out.append(function(waiting[1], waiting[2], text))
                waiting = None if is_guest else (target, doc, text)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return laid.select("target", "guest", "doc_id", "text").mapInArrow(run, schema)


def compare_versions(documents: DataFrame) -> DataFrame:
    """Each text, its edited version and the next text: fingerprints and likenesses; repeated rows stay repeated, an empty table gives none."""
    kept: dict[str, tuple] = {}

    def sketched(text: str):
        keys = digests(text)
        return keys, build(keys)

    def run(doc, text, following):
        # The next text of one row is the text of the row after it.
        own = kept.pop(text, None) or sketched(text)
        kept.clear()
        after = kept[following] = sketched(following)
        changed = edited(text, following)
        other = sketched(changed)
        return (doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own[1]), fingerprint(other[1]),
                likeness(own[0], other[0], own[1], other[1]), likeness(own[0], after[0], own[1], after[1]))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return beside_next(documents, run, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                       f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, digests) of every row, to compare versions that are kept apart."""

    def run(columns):
        keys = [digests(t) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "fingerprint": [fingerprint(build(k)) for k in keys], "digests": [k.view(np.int64).tolist() for k in keys]}

    kind = documents.schema["doc_id"].dataType.simpleString()
    return row_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string, digests array<bigint>")
