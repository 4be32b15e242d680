"""Vector codes, ranked search and the quality classifier against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import boosting, codes, ranking
from tidemark.llm.common import ready


def plain_codes(rows, parts, entries, rounds):
    """Full search in Python integers over (vec_id, integers)."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            given = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, given) if g == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("scale,spread", [(256, 1.0), (4, 1.0), (256, 60_000.0)])
def test_codes_equal_a_full_search(spark, scale, spread):
    ready(spark)
    rng = random.Random(int(spread) + scale)
    vectors = [(k * 3, [rng.gauss(0, spread) for _ in range(8)], rng.choice([1, 2, None])) for k in range(150)]
    vectors += [(1000 + k, vectors[k % 7][1], 3) for k in range(60)]  # many copies
    bad = [(2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2002, [math.nan] + [1.0] * 7, 1), (-5, [math.inf] + [1.0] * 7, None)]
    frame = spark.createDataFrame(vectors + bad, "vec_id bigint, embedding array<double>, label int").repartition(5)
    report = {r.vec_id: r for r in codes.code_report(frame, parts=4, entries=16, rounds=3, scale=scale).collect()}
    whole = sorted((k, [math.floor(scale * x) for x in v]) for k, v, _ in vectors)
    expected, books = plain_codes(whole, 4, 16, 3)
    assert sorted(report) == [k for k, _ in whole]
    assert [(report[k].code, report[k].error) for k, _ in whole] == expected
    label = {k: name for k, _, name in vectors}
    totals = Counter()
    for (k, _), (_, error) in zip(whole, expected):
        totals[label[k]] += error
    assert all(r.label_error == totals[label[k]] for k, r in report.items())
    joined = ",".join(str(x) for book in books for c in book for x in c)
    assert {r.codebooks_sha256 for r in report.values()} == {hashlib.sha256(joined.encode()).hexdigest()}


def test_rings_skip_work_and_keep_ties():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-40, 40, (2, 30, 3)), np.zeros((2, 2, 3), np.int64)], axis=1)  # two equal entries
    x = np.concatenate([rng.integers(-60, 60, (2, 900, 3)), np.zeros((2, 5, 3), np.int64)], axis=1)
    full = codes.Balls.around(entries)
    index, away = full.nearest(x)
    for given in (index, rng.integers(0, 32, index.shape)):
        reach = np.zeros((2, 32), np.int64)
        for p in range(2):
            own = ((x[p] - entries[p][given[p]]) ** 2).sum(axis=1)
            np.maximum.at(reach[p], given[p], own)
        radius = np.array([[math.isqrt(int(v)) + 1 for v in row] for row in reach])
        balls = codes.Balls.around(entries, radius)
        again, distance = balls.moved(x, given)
        assert (again == index).all() and (distance == away).all()
    near = codes.Balls.around(entries, np.full((2, 32), 3))
    assert (near.distance < 0).mean() > 0.8  # small balls have few neighbours


def test_codes_of_odd_tables(spark):
    ready(spark)
    schema = "vec_id bigint, embedding array<float>, label int, code string"
    assert codes.code_report(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [0.5] * 16, None, "clash"), (1, [0.5] * 16, None, "clash"), (None, [0.25] * 16, 4, "x"), (9, [1.0] * 3, 4, "x"), (10, [], 4, "x")]
    found = sorted(((r.vec_id or 0, r.code, r.error, r.label_error) for r in codes.code_report(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert len(found) == 5 and {f for f in found if f[1] is None} == {(9, None, None, 0), (10, None, None, 0)}
    assert [f for f in found if f[0] == 1] == [(1, "00" * 16, 0, 0)] * 2
    assert codes.code_report(spark.createDataFrame([(9, [1.0] * 3, 4, "x")], schema)).first().code is None


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_search(documents, items, top):
    bags = [(k, Counter(TERM.findall((t or "").translate(FOLD)))) for k, t in documents]
    bags = [(k, b) for k, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, scored = Counter(TERM.findall((text or "").translate(FOLD))), []
        for k, b in bags:
            m = 75 + (25 * sum(b.values()) * big_n) // big_l
            score = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m)) for t, n in wanted.items() if t in b)
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return out


def searched(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize("pairs,exact", [(1_000_000, True), (60, True), (1_000_000, False)])
def test_search_equals_plain_scores(spark, monkeypatch, pairs, exact):
    ready(spark)
    monkeypatch.setattr(ranking, "PAIRS_PER_BLOCK", pairs)  # small: many blocks of items
    if not exact:
        monkeypatch.setattr(ranking, "CELLS", 40)
        monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    documents = [(k, prose(rng, rng.randint(1, 60))) for k in range(120)]
    documents += [(500 + k, documents[k % 5][1].upper()) for k in range(80)]  # large classes of equal bags
    documents += [(None, documents[0][1]), (900, None), (901, ""), (902, "... ---"), (903, "ÄÖ é\u0080x K2"), (3, documents[3][1])]
    items = [(k, prose(rng, 12)) for k in range(12)] + [(50, documents[0][1]), (51, "ÄÖ äö k2 k2"), (52, None), (53, "nothing-like-this"), (54, "!!"), (None, "the of the")]
    found = ranking.search(spark.createDataFrame(documents, "doc_id bigint, text string").repartition(6), spark.createDataFrame(items, "item_id bigint, text string"), top=20)
    assert searched(found) == sorted(plain_search(documents, items, 20), key=str)


def test_search_of_empty_tables(spark, nothing, documents):
    items = spark.createDataFrame([(1, "the", 0), (1, "the", 0)], "item_id bigint, text string, rank int")
    assert ranking.search(nothing, items).collect() == []
    assert ranking.search(documents, items.limit(0)).collect() == []
    found = searched(ranking.search(documents, items, top=3))
    assert len(found) == 6 and found[0] == found[1]  # equal item rows give equal results


def labelled(spark, rows=900):
    rng, made = random.Random(4), []
    for k in range(rows):
        text, good = prose(rng, rng.randint(40, 200)), int(k % 5 != 0)
        if not good:
            text = [" ".join(w + rng.choice(["***", "%%%"]) for w in text.split()), text.upper().replace(" ", "!! "), (text.split()[0] + " ") * 80, " | ".join(text.split())][k // 5 % 4]
        made.append((k, text, good))
    return made


def test_trees_tell_held_out_rows(spark):
    ready(spark)
    rows = labelled(spark)
    documents = spark.createDataFrame([(k, t, "en", 0.5) for k, t, _ in rows], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(k, g, 0) for k, _, g in rows] + [(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    x, y = boosting.sample(documents, labels, max_rows=500)
    assert len(x) == sum(zlib.crc32(str(k).encode()) % 5 != 0 and (g == 0 or True) for k, _, g in rows) - max(0, sum(zlib.crc32(str(k).encode()) % 5 != 0 and g for k, _, g in rows) - 500)
    found = {r.doc_id: r for r in boosting.score(documents, boosting.fit(x, y, trees=30)).collect()}
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    held = [(k, g) for k, _, g in rows if found[k].held_out]
    assert sum(found[k].predicted == g for k, g in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())


def test_flat_arrays_walk_like_nodes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    trees = boosting.fit(x, y, trees=25, depth=3, bins=16)

    def walk(row):
        margin = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97


def test_classifier_edge_cases(spark, documents, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    base = boosting.fit(*boosting.sample(documents, labels))
    assert {round(r.score, 6) for r in boosting.score(documents, base).collect()} == {0.5}
    assert boosting.fit(np.ones((4, 24)), np.ones(4)).score(np.zeros((1, 24)))[0] == pytest.approx(5 / 6)
    ones = spark.createDataFrame([(k, 1) for k in (1, 5, 5, 9)] + [(4, 0), (7, 0)], "doc_id bigint, quality int")
    trees = boosting.fit(*boosting.sample(documents, ones), least_rows=1)
    found = boosting.score(documents, trees).collect()
    assert len(found) == documents.count() and all(r.held_out is not None and r.predicted in (0, 1) for r in found)
    assert boosting.score(nothing, trees).collect() == []
    assert boosting.statistics(None) == boosting.statistics("") == [0.0] * len(boosting.STATISTICS)
