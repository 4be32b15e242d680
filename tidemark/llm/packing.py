"""Best-fit packing by a configuration linear program.

Documents become token ids and are cut only where longer than a sequence. How
many pieces there are of each length is all that the packing problem needs: at
most one count per length. A configuration is a multiset of lengths that fits one
sequence; the linear program asks for the fewest sequences whose configurations
cover the counts. Multiplicative weights solve it: each length's price falls as
it is covered, a knapsack dynamic program prices configurations, and those around
each length get a small share of the sequences, until all lengths are covered.
The prices also give a bound that no packing is below: if the program's value is
not near it, it runs again with faster prices. The numbers are then rounded; only
what rounding leaves over, under one sequence a configuration, meets best fit.

Each piece then takes a place by its rank among the pieces of its length. Ranks
come from counts per (length, bucket) and positions inside a bucket, so that a
length shared by very many pieces is spread over many tasks.

Null texts count as empty: the end token alone, one piece of length 1. Repeated
rows are pieces of their own. No rows give no sequences.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_map, written

CAPACITY, END_ID = 2048, 0
#: Fixed value: a special token of the vocabulary.
MARK = "<|endoftext|>"
#: Words tokenised at once and kept in a worker's memo.
AT_ONCE, MEMO, PORTION = 1_024, 350_000, 2_000_000
#: Pieces of one bucket.
BUCKET_ROWS = 2_000


class Tokenizer:
    """A tokenizer with a bounded memo of blank-separated words.

    The vocabulary's pattern never matches a blank, so a text's ids are those of
    its words in order; words that are new go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Loaded
        from tokenizers import normalizers

        self.codec = Loaded.from_file(path)
        self.codec.no_truncation()
        self.codec.no_padding()
        self.mark = MARK if self.codec.token_to_id(MARK) is not None else ""
        self.mark_id = self.codec.token_to_id(MARK)
        self.memo: dict[str, bytes] = {}
        # What the vocabulary does to a text first; to printable ASCII without blanks, only the last of these does anything.
        with open(path, encoding="utf-8") as file:
            steps = (json.load(file).get("normalizer") or {}).get("normalizers") or []
        self.lowers = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
        self.normalizer, self.nothing = self.codec.normalizer, normalizers.Sequence([])

    def ids_of(self, text: str) -> list[int]:
        """Ids from the tokenizer itself; strings of special tokens are ordinary text."""
        self.codec.encode_special_tokens = True
        return self.codec.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words that are new to several of the texts are tokenised once."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.memo.get, words)) for words in split]
        missing = [self._gaps(ids) for ids in found]
        new = self._new({words[i] for words, gaps in zip(split, missing) for i in gaps})
        for words, ids, gaps in zip(split, found, missing):
            for i in gaps:
                ids[i] = new[words[i]]
        if len(self.memo) + len(new) <= MEMO:
            self.memo.update((w, ids) for w, ids in new.items() if len(w) <= 64)
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]

    @staticmethod
    def _gaps(found: list) -> list[int]:
        gaps, at = [], -1
        try:
            while True:
                gaps.append(at := found.index(None, at + 1))
        except ValueError:
            return gaps

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word. Many words go as one string with a special token between them, which no word holds."""
        odd = [w for w in words if not self.mark or "<|" in w]
        made = {w: np.array(self.ids_of(w), "<u4").tobytes() for w in odd}
        plain = words.difference(odd) if odd else words
        lowered = {w: w.lower() for w in plain if w.isascii() and w.isprintable()} if self.lowers else {}
        made.update(self._joined([w for w in plain if w not in lowered]))
        self.codec.normalizer = self.nothing
        of_lower = self._joined(list(set(lowered.values())))
        self.codec.normalizer = self.normalizer
        made.update((w, of_lower[low]) for w, low in lowered.items())
        return made

    def _joined(self, plain: list[str]) -> dict[str, bytes]:
        """Ids of each of words without parts of special tokens, by the codec as it is."""
        made: dict[str, bytes] = {}
        self.codec.encode_special_tokens = False
        for first in range(0, len(plain), AT_ONCE):
            part = plain[first:first + AT_ONCE]
            ids = np.array(self.codec.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            made.update((w, raw[a:b]) for w, a, b in zip(part, [0, *(e + 4 for e in ends)], [*ends, len(raw)]))
        return made


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about PORTION code points: what a worker splits into words at once."""
    first = size = 0
    for i, text in enumerate(texts):
        if size + len(text) > PORTION and i > first:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker process; its memo is small enough to stay there."""
    return Tokenizer(path)


def cut(documents: DataFrame, path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""

    def run(columns):
        codec = tokenizer(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        out = {name: [] for name in names}
        texts = [t or "" for t in columns["text"]]
        made = (ids for first, last in _portions(texts) for ids in codec.encode_all(texts[first:last]))
        for doc, ids in zip(columns["doc_id"], made):
            ids = np.append(ids, np.array([END_ID], "<u4"))
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                row = (doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)
                for name, value in zip(names, row):
                    out[name].append(value)
        return out

    kind = documents.schema["doc_id"].dataType.simpleString()
    return row_map(documents.select("doc_id", "text"), run,
                   f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity, and the length taken last there (0: none, one less room)."""
    value, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        k = fits[room]
        if k:
            ways = value[room - lengths[:k]] + prices[:k]
            best = int(ways.argmax())
            if ways[best] > value[room]:
                value[room], taken[room] = ways[best], lengths[best]
    return value, taken


def _fill(taken: np.ndarray, room: int) -> list[int]:
    inside = []
    while room > 0:
        length = int(taken[room])
        if length:
            inside.append(length)
            room -= length
        else:
            room -= 1
    return inside


def configurations(counts: dict[int, int], capacity: int, *, share: float = 0.34, rate: float = 0.01, slack: float = 0.002, close: float = 0.001) -> tuple[dict, float]:
    """The linear program: fractional numbers of sequences per configuration that hold all counts exactly, and a bound that no packing is below.

    Any prices give such a bound: what all pieces cost over the dearest sequence.
    In a phase no length is covered by more than `share` of its count, so prices
    follow what has been covered. A configuration must come within `slack` of
    the dearest one; where a phase brings little, twice as far, so that in the
    end every length is covered. Among ways within `close` of each other the
    longest length is taken: short ones fill gaps later.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(n)] for n in lengths], float)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    covered = np.zeros(len(lengths))
    found: dict = {}
    bound = 0.0
    while len(open_ := np.flatnonzero(covered < 1 - 1e-9)):
        # Prices: the length itself, scaled down as its count is covered.
        prices = lengths / capacity * np.exp(-rate * (covered - covered[open_].min()))
        value, taken = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ need) / value[capacity])
        room = need * np.minimum(share, 1 - covered)
        room[covered >= 1 - 1e-9] = 0
        least = room * 0.01
        before, dearest = covered.sum(), (1 - slack) * value[capacity]
        for i in open_[np.lexsort((-lengths[open_], covered[open_].round(6)))]:
            while room[i] > least[i]:
                inside, worth, left = Counter([int(i)]), prices[i], capacity - int(lengths[i])
                # What the dynamic program would take next, among lengths with room.
                while k := fits[left]:
                    ways = np.where(room[:k] > least[:k], value[left - lengths[:k]] + prices[:k], -1.0)
                    top = ways.max()
                    if top < 0:
                        break
                    j = int(np.flatnonzero(ways >= top * (1 - close))[-1])
                    inside[j] += 1
                    worth += prices[j]
                    left -= int(lengths[j])
                if worth < dearest:
                    break
                step = min(room[j] / k for j, k in inside.items())
                key = tuple(sorted(inside.items()))
                found[key] = found.get(key, 0.0) + step
                for j, k in inside.items():
                    room[j] -= step * k
                    covered[j] += step * k / need[j]
        covered[covered > 1 - 1e-9] = 1.0
        if covered.sum() - before < 0.02 * share * len(open_):
            slack = min(2 * slack, 1.0)
    return {tuple((int(lengths[j]), k) for j, k in key): times for key, times in found.items()}, bound


#: Distance to the bound at which the program isn't run again, and how it runs, in order.
GAP = 0.002
RUNS = ({}, {"rate": 0.1, "close": 0.01}, {"share": 0.1, "rate": 1.0, "close": 0.01})


def solve(counts: dict[int, int], capacity: int) -> tuple[dict, float]:
    """The program's best solution and the bound: the first run within `GAP` of the bound, else the one with the fewest sequences."""
    best, bound = None, sum(n * c for n, c in counts.items()) / capacity
    for how in RUNS:
        found, now = configurations(counts, capacity, **how)
        bound = max(bound, now)
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
        if sum(best.values()) <= (1 + GAP) * bound:
            break
    return best, bound


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how many sequences have each; together they hold exactly the counts.

    Whole parts of the program's numbers stand. The fractions are rounded up or
    down along the order of the configurations, so that their sum is kept; pieces
    that are then there too often leave their sequence, and those that are
    missing go into the rooms left by best fit.
    """
    need = {n: c for n, c in counts.items() if c}
    if not need:
        return []
    found, _ = solve(need, capacity)
    left, made, upto = dict(need), Counter(), 0.5
    order = sorted(found.items(), key=lambda x: (-sum(n * k for n, k in x[0]), x[0]))
    rounded = []
    for inside, times in order:
        whole = min(int(times + 1e-6), *(left[n] // k for n, k in inside))
        made[inside] += whole
        for n, k in inside:
            left[n] -= whole * k
        upto += max(0.0, times - whole)
        rounded.append((inside, int(upto)))
        upto -= int(upto)
    for inside, times in rounded:
        for _ in range(times):  # under one for each configuration, whatever the counts
            kept = tuple((n, min(k, left[n])) for n, k in inside if left[n])
            if kept:
                made[kept] += 1
                for n, k in kept:
                    left[n] -= k
    return sorted(_best_fit({n: c for n, c in left.items() if c}, capacity, +made).items())


def _best_fit(left: dict[int, int], capacity: int, begun: Counter) -> Counter:
    """Best fit, largest first, into the sequences begun and new ones. Equal sequences are handled together, so the work follows lengths, not pieces."""
    open_at: dict[int, Counter] = {}
    rooms = 0  # bit r: some open sequence has room r
    for inside, times in begun.items():
        room = capacity - sum(n * k for n, k in inside)
        open_at.setdefault(room, Counter())[tuple(n for n, k in inside for _ in range(k))] += times
        rooms |= 1 << room
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                inside, times = open_at[room].popitem()
                take = min(times, todo)
                if times > take:
                    open_at[room][inside] = times - take
                per = 1
            else:
                room, inside = capacity, ()
                per = min(capacity // length, todo)
                take = todo // per
            if room < capacity and not open_at[room]:
                rooms &= ~(1 << room)
            now, rest = inside + (length,) * per, room - per * length
            open_at.setdefault(rest, Counter())[now] += take
            rooms |= 1 << rest
            todo -= take * per
    done: Counter = Counter()
    for group in open_at.values():
        for inside, times in group.items():
            done[tuple(sorted(Counter(inside).items()))] += times
    return done


def places(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, in order of rank: (first rank, first sequence, pieces per sequence, offset of the first)."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for inside, times in planned:
        offset = 0
        for length, per in inside:
            out.setdefault(length, []).append((used[length], sequence, per, offset))
            used[length] += times * per
            offset += length * per
        sequence += times
    return out


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; `pieces` is read three times, give a written table."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    planned = places(plan(counts, capacity))
    buckets = max(1, math.ceil(max(counts.values(), default=0) / BUCKET_ROWS))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = spread.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    names = [c for c in pieces.columns]

    def run(columns):
        ranks, lengths = columns["rank"], columns["length"]
        found_sequence, found_offset = [], []
        for rank, length in zip(ranks, lengths):
            rows = planned[length]
            first, sequence, per, offset = rows[bisect_right(rows, rank, key=lambda r: r[0]) - 1]
            step, nth = divmod(rank - first, per)
            found_sequence.append(sequence + step)
            found_offset.append(offset + nth * length)
        return {n: columns[n] for n in names} | {"sequence_id": found_sequence, "offset": found_offset}

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return row_map(ranked.select(*names, "rank"), run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Cut, then pack."""
    return pack(written(cut(documents, path, capacity=capacity), "pieces"), capacity=capacity)
