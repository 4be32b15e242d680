"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has 64 bits, one set where more than half of its shingles'
hashes have it. Fingerprints link at `budget` or fewer differing bits.

Equal fingerprints fall together first. The others are split over tasks by blocks
of bits: with more blocks than the budget has bits, two linked fingerprints agree
on one block at least, so they meet in that block's group. A group too large for
a task is split again by the blocks of its remaining bits, as deep as needed; no
group is cut off. Inside the groups a binary trie over the sorted fingerprints is
joined with itself: pairs of nodes go down together, gather differing bits, and
end when these exceed the budget. All groups of a task go down at once in numpy,
and only links that connect something new leave the task. Large-star and
small-star rounds make components of the links.

Null texts count as empty; texts without words have fingerprint zero and link
like any other. A component's id is its smallest doc_id; null ids only name
components without any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map, written

BITS, BUDGET = 64, 4
#: Largest group of one trie join; larger ones are split again.
GROUP_ROWS = 2_000
#: Rows of one task's groups.
TASK_ROWS = 60_000
#: Node pairs handled at once; bounds a task's memory.
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(text: str | None, words_each: int = 4) -> np.ndarray:
    """Hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - words_each + 1].tolist(), ends[words_each - 1:].tolist()
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """Bits that are set in more than half of the hashes."""
    hashes = shingle_hashes(text, words_each)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[first:first + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, *, words_each: int = 4) -> DataFrame:
    """(doc_id, print bigint) of every row; the 64 bits as a signed number."""

    def run(columns):
        made = np.array([fingerprint(t, words_each) for t in columns["text"]], np.uint64).view(np.int64)
        return {"doc_id": columns["doc_id"], "print": made.tolist()}

    kind = documents.schema["doc_id"].dataType.simpleString()
    return row_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, print bigint")


# ---------------------------------------------------------------- groups

def _blocks(bits: list[int], count: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.array(bits), count)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def grouped(prints: DataFrame, *, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(way, value, print): the groups in which all linked pairs meet, none over `group_rows` unless its bits are used up.

    `way` names the blocks that the group's members agree on, `value` those bits.
    """
    way_bits: dict[str, list[int]] = {"": []}
    open_rows = prints.select(F.lit("").alias("way"), F.lit(0).cast("bigint").alias("value"), "print")
    done: list[DataFrame] = []
    while True:
        # A way's next blocks: its unused bits in budget + 1 parts.
        nexts = {way: _blocks([b for b in range(BITS) if b not in set(used)], budget + 1) for way, used in way_bits.items()}
        parts = F.create_map(*[x for way, blocks in nexts.items() for x in (
            F.lit(way), F.array(*[F.struct(F.lit(f"{way}{k}").alias("way"), F.lit(_mask(way_bits[way] + block)).alias("mask")) for k, block in enumerate(blocks)]))])
        split = open_rows.select("print", F.explode(parts[F.col("way")]).alias("part")).select(F.col("part.way").alias("way"), F.col("print").bitwiseAND(F.col("part.mask")).alias("value"), "print")
        way_bits = {f"{way}{k}": way_bits[way] + block for way, blocks in nexts.items() for k, block in enumerate(blocks)}
        split = written(split, "trie-groups")
        sizes = split.groupBy("way", "value").count()
        deeper = all(len(used) < BITS - budget - 1 for used in way_bits.values())
        large = written(sizes.filter((F.col("count") > group_rows) & F.lit(deeper)).select("way", "value"), "trie-large")
        ways = [r.way for r in large.select("way").distinct().collect()]  # at most (budget + 1) per block of the level before
        if not ways:
            done.append(split)
            break
        done.append(split.join(large, ["way", "value"], "left_anti"))
        open_rows = split.join(large, ["way", "value"], "left_semi")
        way_bits = {way: way_bits[way] for way in ways}
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- trie join

def trie_pairs(prints: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `budget` bits, inside groups; `prints` must be sorted within consecutive groups.

    A node is a range of sorted fingerprints that share the bits above a depth. A
    pair of nodes goes down to the pairs of their children; a pair of a node with
    itself also to its two children as a pair.
    """
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    start, end = edges[:-1], edges[1:]
    several = end - start > 1
    stack = [(start[several], end[several], start[several], end[several], np.zeros(several.sum(), np.int8), 0)]
    while stack:
        a, b, c, d, bits, depth = stack.pop()
        if len(a) > PAIRS_AT_ONCE and depth < BITS:
            half = len(a) // 2
            stack += [tuple(x[half:] for x in (a, b, c, d, bits)) + (depth,), tuple(x[:half] for x in (a, b, c, d, bits)) + (depth,)]
            continue
        # Node pairs with few fingerprints end here: theirs are compared outright.
        rows = (b - a) * (d - c)
        small = rows <= 16 if depth < BITS else np.ones(len(a), bool)
        if small.any():
            yield from _compare(prints, a[small], b[small], c[small], d[small], budget)
        keep = ~small
        a, b, c, d, bits = (x[keep] for x in (a, b, c, d, bits))
        if not len(a) or depth >= BITS:
            continue
        one = np.uint64(1) << np.uint64(BITS - 1 - depth)
        m, n = _middle(prints, a, b, one), _middle(prints, c, d, one)
        same = a == c
        zero_zero = (a, m, c, n, bits)
        one_one = (m, b, n, d, bits)
        zero_one = (a, m, n, d, bits + 1)
        one_zero = (m, b, c, n, bits + 1)
        made = []
        for k, part in enumerate((zero_zero, one_one, zero_one, one_zero)):
            live = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= budget)
            if k == 3:
                live &= ~same
            if k < 2:  # a node with itself needs two fingerprints
                live &= ~same | (part[1] - part[0] > 1)
            made.append([x[live] for x in part])
        a, b, c, d, bits = (np.concatenate(x) for x in zip(*made))
        if len(a):
            stack.append((a, b, c, d, bits.astype(np.int8), depth + 1))


def _middle(prints: np.ndarray, start: np.ndarray, end: np.ndarray, one: np.uint64) -> np.ndarray:
    """Where the bit turns to one inside each range of sorted fingerprints that share the bits above it."""
    low, high = start.copy(), end.copy()
    while True:
        todo = low < high
        if not todo.any():
            return low
        mid = (low + high) // 2
        is_one = (prints[np.minimum(mid, len(prints) - 1)] & one) != 0
        high = np.where(todo & is_one, mid, high)
        low = np.where(todo & ~is_one, mid + 1, low)


def _compare(prints, a, b, c, d, budget):
    width, height = b - a, d - c
    count = width * height
    for first, last in _runs(count, PAIRS_AT_ONCE):
        n = count[first:last]
        which = np.repeat(np.arange(first, last), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[which] + inside // height[which], c[which] + inside % height[which]
        ordered = i < j
        i, j = i[ordered], j[ordered]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= budget
        if near.any():
            yield i[near], j[near]


def _runs(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total = np.cumsum(count)
    first = 0
    while first < len(count):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + most, side="right")))
        yield first, last
        first = last


class Forest:
    """Union-find over positions."""

    def __init__(self, size: int) -> None:
        self.above = list(range(size))

    def top(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.above[max(i, j)] = min(i, j)
        return True


def links(groups: DataFrame, total: int, *, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between fingerprints, enough to connect what is linked in each task."""
    tasks = max(1, math.ceil(total / TASK_ROWS))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["way", "value", "print"], kind="stable")
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        keys = rows.groupby(["way", "value"], sort=False).ngroup().to_numpy()
        order = np.lexsort((prints, keys))
        prints, keys = prints[order], keys[order]
        known, node = np.unique(prints, return_inverse=True)
        forest, found = Forest(len(known)), []
        for i, j in trie_pairs(prints, keys, budget):
            found += [(x, y) for x, y in zip(node[i].tolist(), node[j].tolist()) if forest.join(x, y)]
        signed = known.view(np.int64)
        return pd.DataFrame({"a": [signed[x] for x, _ in found], "b": [signed[y] for _, y in found]}, dtype="int64")

    # A group is whole in one task; tasks follow the rows of all groups.
    keyed = groups.withColumn("task", F.pmod(F.xxhash64("way", "value"), F.lit(tasks)))
    return keyed.groupBy("task").applyInPandas(run, "a bigint, b bigint")


# ---------------------------------------------------------------- components

def components(edges: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """(node, root): each linked node's smallest reachable node, by large-star and small-star rounds until they settle.

    With `rounds`, edges that still change in the last of them are an error.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    last = None
    for number in count(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.countDistinct("a")).first())
        if now == last and now[0] == now[2]:
            break
        if number == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def resolve(documents: DataFrame, *, words_each: int = 4, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, print) of every row, written; (print, root, component_id) of every fingerprint): root is a print of the component."""
    made = written(fingerprints(documents, words_each=words_each), "fingerprints")
    # Copies share a fingerprint: from here on there is one row per fingerprint, with its smallest id.
    known = written(made.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    total = known.count()
    groups = grouped(known.select("print"), budget=budget, group_rows=group_rows)
    rooted = components(links(groups, total * (budget + 1), budget=budget))
    # Ids of components: the smallest id of any member.
    member = rooted.join(known, rooted["node"] == known["print"]).select("root", "first_id").unionByName(
        rooted.select(F.col("root").alias("print")).distinct().join(known, "print").select(F.col("print").alias("root"), "first_id"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(named, "root").select(F.col("node").alias("print"), "root", "component_id").unionByName(named.select(F.col("root").alias("print"), "root", "component_id"))
    return made, known.join(of_print, "print", "left").select("print", F.coalesce("root", "print").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))


def near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; repeated rows stay repeated."""
    made, resolved = resolve(documents, **settings)
    return made.join(resolved, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """((doc_id, print) of every row; the one (doc_id, print) of each component that comes first by id, then print): null ids come last."""
    made, resolved = resolve(documents, **settings)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print")).alias("least")
    return made, made.join(resolved.select("print", "root"), "print").groupBy("root").agg(least).select("least.doc_id", "least.print")
