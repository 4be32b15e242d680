"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded on its own. In
a piece the automaton offers the longest token at a position. A token may follow
another if no merge would have crossed the border between them; that test walks
both merge trees and is memoised for the pair. If no token fits, the last one is
taken back and a shorter one tried; positions from which nothing fitted are
marked, so each is left at most once and the work is linear in the piece.

Nulls encode as empty texts; an empty text has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map

NEVER = 1 << 60
#: Entries kept of the piece and pair memos of one worker; what no longer fits is worked out anew.
PIECE_MEMO, PAIR_MEMO = 300_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Encoder:
    """Encoder of a rank table; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = dict(sorted((rank, token) for token, rank in ranks.items()))
        self.left, self.right, self.merges = self._trees()
        reachable = [t for t in self.bytes_of if t in self.left]
        self.automaton = ahocorasick.Automaton()
        for t in reachable:
            self.automaton.add_word(self.bytes_of[t].decode("latin-1"), t)
        self.automaton.make_automaton()
        self.length = {t: len(self.bytes_of[t]) for t in reachable}
        self.shorter = {t: self._longest_prefix(self.bytes_of[t]) for t in reachable}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def _trees(self):
        """For each token the two tokens of its last merge; tokens that merging can't make are left out."""
        left, right, merges = {}, {}, {}
        ranks = self.ranks
        for rank, token in self.bytes_of.items():
            if len(token) == 1:
                left[rank] = right[rank] = rank
                continue
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ways = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                best = min(ways)
                if best >= rank:
                    break
                at = ways.index(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(ranks.get(p) in left for p in parts):
                a, b = ranks[parts[0]], ranks[parts[1]]
                left[rank], right[rank], merges[a, b] = a, b, rank
        return left, right, merges

    def _longest_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) in self.left:
                return rank
        return -1

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between tokens a and b.

        Going back in time, the later of the two merges at the border is undone.
        A merge across the border wins if it comes before the left side's next
        merge, and not after the right side's (of equals the left one is first).
        """
        until_a = until_b = NEVER
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                return False
            if a > b:
                if self.left[a] == a:
                    return True
                until_a, a = a, self.right[a]
            else:
                if self.left[b] == b:
                    if self.left[a] == a:
                        return True
                    until_a, a = a, self.right[a]
                else:
                    until_b, b = b, self.left[b]

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self._stay_apart(a, b)
            if len(self.pairs) < PAIR_MEMO:
                self.pairs[a, b] = known
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        text, size = raw.decode("latin-1"), len(raw)
        length, shorter, fits, known, longest = self.length, self.shorter, self.fits, self.pairs.get, self.automaton.iter_long
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, next(longest(text, 0))[1]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or known((last := out[-1], token), None) or fits(last, token)):
                out.append(token)
                if end == size:
                    return tuple(out)
                at, token = end, next(longest(text, end))[1]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def encode(self, text: str | None) -> array:
        """Ids of a whole text."""
        found = self.pattern.findall(text) if text else ()
        return array("I", chain.from_iterable(map(self.pieces.__getitem__, found)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Memo of encoded pieces, bounded."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        made = self.encoder.encode_piece(piece)
        if len(self) < PIECE_MEMO and len(piece) <= 64:
            self[piece] = made
        return made


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(read_ranks(path), pattern)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(df: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<bigint>) of every row; repeated rows stay repeated."""

    def run(columns):
        codec = encoder(path, pattern)
        return {"doc_id": columns["doc_id"], "ids": [codec.encode(t) for t in columns["text"]]}

    kind = df.schema[id_column].dataType.simpleString()
    return row_map(df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), run, f"doc_id {kind}, ids array<bigint>")


def decode(df: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of every row of ids; null ids decode to no bytes."""

    def run(columns):
        codec = encoder(path, pattern)
        return {"doc_id": columns["doc_id"], "decoded": [codec.decode(x or ()) for x in columns["ids"]]}

    kind = df.schema[id_column].dataType.simpleString()
    return row_map(df.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids")), run, f"doc_id {kind}, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each text, decode the ids again, and digest both, in one pass."""

    def run(columns):
        codec = encoder(path, pattern)
        out = {"doc_id": columns["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in columns["text"]:
            ids = codec.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(little_endian(ids)).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    kind = df.schema[id_column].dataType.simpleString()
    return row_map(df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), run,
                   f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
