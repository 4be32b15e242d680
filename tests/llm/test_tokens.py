"""Byte-level BPE against the public library, packing against counts and the tokenizer."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, packing

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="abe ’é\n"), st.lists(st.sampled_from(["er", "tion", "th", " the", "ing", "aa", "é"])).map("".join)))
def test_encoding_is_exact_and_decodes(text):
    ids = CODEC.encode(text)
    assert list(ids) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode("utf-8")


def test_small_vocabulary_with_tokens_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"aa": 260, b"aaaa": 261}
    codec = bpe.Encoder(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for text in ["xyz", "wxyz", "abcabc", "aaaaaaa", *("".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 12))) for _ in range(500))]:
        assert list(codec.encode(text)) == other.encode_ordinary(text), text


def test_digests_of_every_row(documents, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.digests(documents, path, public_tokenizers.PATTERN).collect()
    texts = [r.text or "" for r in documents.collect()]
    assert len(rows) == len(texts)
    want = Counter((hashlib.sha256(np.array(REFERENCE.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert Counter((r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.digests(nothing, path, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode(documents, path, public_tokenizers.PATTERN)
    assert {bytes(r.decoded).decode() for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()} == set(texts)


def test_words_in_memo_give_the_tokenizers_ids():
    codec = packing.Tokenizer(WORD_BPE)
    for text in ["Hello, hello world", "a\tb c d", "<|endoftext|> x <|startoftext|>", "é x", "", "  ", "\n\n", "naïve\r\nfoo"]:
        assert codec.encode(text).tolist() == codec.ids_of(text)


def holds(planned, counts, capacity):
    inside = Counter()
    for lengths, times in planned:
        assert times > 0 and sum(n * k for n, k in lengths) <= capacity
        for n, k in lengths:
            inside[n] += k * times
    return inside == Counter({n: c for n, c in counts.items() if c})


@pytest.mark.parametrize("runs", [packing.RUNS, packing.RUNS[1:]])
def test_plan_holds_the_counts_and_is_near_the_bound(monkeypatch, runs):
    monkeypatch.setattr(packing, "RUNS", runs)
    rng = random.Random(3)
    counts = Counter(min(64, max(1, int(rng.gauss(20, 9)))) for _ in range(5_000)) + Counter({64: 300})
    planned = packing.plan(dict(counts), 64)
    assert holds(planned, counts, 64)
    assert sum(t for _, t in planned) <= 1.01 * sum(n * c for n, c in counts.items()) / 64 + 1


def test_plan_of_awkward_lengths():
    for counts in ({}, {33: 5}, {64: 3}, {1: 1000}, {40: 10, 25: 7, 24: 3}):
        assert holds(packing.plan(dict(counts), 64), counts, 64)
    assert sum(t for _, t in packing.plan({32: 7}, 64)) == 4


@pytest.mark.parametrize("n", [300, 200_000])
def test_plan_keeps_configurations_of_hot_lengths(n):
    counts = {1000: n, 600: n, 380: n}
    planned = packing.plan(dict(counts), 2048)
    assert holds(planned, counts, 2048)
    assert sum(t for _, t in planned) <= 1.005 * n + 1
    found, bound = packing.configurations(counts, 2048)
    assert 1980 / 2048 * n - 1 <= bound <= n + 1e-6


@pytest.mark.parametrize("n, within", [(3_000, 0.005), (300_000, 0.002)])
def test_program_is_solved(n, within):
    """All lengths are covered, the value is near the bound, and rounding leaves little to best fit."""
    rng = np.random.default_rng(4)
    counts = dict(Counter(np.clip(rng.lognormal(5.6, 1.0, n).astype(int), 1, 2048).tolist()))
    found, bound = packing.solve(counts, 2048)
    held: dict = {}
    for inside, times in found.items():
        assert sum(length * k for length, k in inside) <= 2048
        for length, k in inside:
            held[length] = held.get(length, 0.0) + k * times
    assert held == pytest.approx(counts, rel=1e-6)
    value, used = sum(found.values()), sum(t for _, t in packing.plan(counts))
    assert bound <= used and value <= (1 + within) * bound and used <= value + 2 + 0.001 * value
    if n > 100_000:
        assert sum(int(t) for t in found.values()) > 0.95 * used


def test_best_fit_alone_is_not_enough():
    """Three lengths that fill a sequence only one of each: best fit pairs the long ones."""
    counts = {1000: 9_000, 600: 9_000, 380: 9_000}
    alone = sum(packing._best_fit(dict(counts), 2048, Counter()).values())
    assert sum(t for _, t in packing.plan(dict(counts))) <= 9_001 < 9_200 < alone


def test_packing_all_rows(documents, nothing, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 2)
    cut = packing.cut(documents, WORD_BPE, with_ids=True).collect()
    assert sum(r.start == 0 for r in cut) == documents.count()
    assert all(r.length == len(r.ids) <= 2048 for r in cut)
    packed = packing.pack_documents(documents, WORD_BPE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in cut)
    sequences: dict = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0


def test_words_that_skip_the_normalizer_have_its_ids(monkeypatch):
    rng = random.Random(5)
    signs = "aB1'.,-_<|>!\"É\u0301ßΣ\t\x00\x1c\u00a0😀İ\u212a"
    words = {"".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(4_000)} | {"Don't", "DON'T.", "'S", "<|ENDOFTEXT|>", "<|endoftext|>", ""}
    codec = packing.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    seen, joined = [], codec._joined
    monkeypatch.setattr(codec, "_joined", lambda plain: (seen.append((codec.codec.normalizer is None or "Lowercase" not in str(codec.codec.normalizer), plain)), joined(plain))[1])
    made = codec._new(set(words))
    assert made == {w: np.array(codec.ids_of(w), "<u4").tobytes() for w in words}
    # Printable ASCII is lowered once for all its cases, and goes past the normalizer; nothing else does.
    (skips, rest), (alone, lowered) = seen
    assert not skips and alone and sorted(lowered) == sorted({w.lower() for w in words if w.isascii() and w.isprintable() and "<|" not in w})
    assert all(not (w.isascii() and w.isprintable()) for w in rest)
