"""Quality rules, toxicity, SimHash groups and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import quality, simhash, toxicity
from tidemark.llm.common import ready, table, written


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places: dict = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b c a b c", "x\nx\n\n \nx", "a a a a a", "é  b|c <d>\x0bf", "wor d two\nthree"])
def test_counts(text):
    assert quality.count(text)[:5] == plain_counts(text)


def test_counts_of_random_texts():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "d* ", "\n", "é"]) for _ in range(rng.randint(0, 60)))
        assert quality.count(text)[:5] == plain_counts(text)


def corpus(spark, rows=600):
    rng = random.Random(9)
    made = []
    for k in range(rows):
        text, junk = prose(rng, rng.randint(60, 300)), k % 11 == 0
        if junk:
            text = " ".join(w + rng.choice(["***", "%%%", "###"]) for w in text.split())
        made.append((k, text, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else "hot", len(text), junk))
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, junk boolean")


def test_outliers_go_and_the_bulk_stays(spark):
    ready(spark)
    docs = corpus(spark)
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(found) == 600
    assert all(found[r.doc_id].kept != r.junk for r in docs.select("doc_id", "junk").collect())
    assert {r.doc_id for r in quality.keep(docs).collect()} == {k for k, r in found.items() if r.kept}


def test_estimate_matches_numpy(spark):
    """Mean and covariance after the steps against the same steps in numpy, with exact medians and order."""
    ready(spark)
    docs = corpus(spark, 500).filter("NOT junk")
    measured = written(quality.counts(docs), "t")
    got = {r.group: r for r in quality.fit(measured).collect()}["0"]
    x = np.array([r.x for r in measured.filter(~quality.base_failed()).select(quality.vector().alias("x")).collect()])
    center = np.median(x, 0)
    precision = np.diag(1 / np.maximum(np.median(np.abs(x - center), 0) * 1.4826, quality.FLOORS) ** 2)
    for _ in range(quality.STEPS):
        far = np.einsum("ni,ij,nj->n", x - center, precision, x - center)
        half = np.argsort(far)[: int(np.ceil(len(x) * quality.HALF))]
        center = x[half].mean(0)
        precision = np.linalg.inv(np.cov(x[half].T, bias=True) * quality.consistency(quality.HALF, x.shape[1]) + np.diag(quality.FLOORS ** 2))
    assert got.n == len(x)
    np.testing.assert_allclose(got.center, center, atol=0.01)
    np.testing.assert_allclose(np.array(got.precision).reshape(precision.shape), precision, rtol=0.05, atol=2.0)


def test_groups_are_drawn_toward_their_language(spark):
    """Any two sizes differ by weight alone, next to the former bound of 70 texts as anywhere."""
    ready(spark)
    rng = random.Random(8)
    sizes = {"one": 1, "few": 69, "more": 70, "large": 300}
    rows = [(k, prose(rng, rng.randint(60, 120)), "en", source) for k, source in enumerate(s for s, n in sizes.items() for _ in range(n))]
    measured = written(quality.counts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")), "t")
    estimates = written(quality.fit(measured), "t")
    d = len(quality.FEATURES)
    of_group = {r.group: (r.n, np.array(r.center), np.linalg.inv(np.array(r.precision).reshape(d, d))) for r in estimates.collect()}
    of_pair = {r.source: r for r in quality.resolve(estimates, measured).collect()}
    assert set(of_pair) == set(sizes)
    _, c0, v0 = of_group["0"]
    n1, c1, v1 = of_group["1\x1f=en"]
    w1 = n1 ** 2 / (n1 ** 2 + quality.PRIOR ** 2)
    c, v = c0 + w1 * (c1 - c0), w1 * v1 + (1 - w1) * v0
    for source, n in sizes.items():
        _, own, spread = of_group[f"2\x1f=en\x1f={source}"]
        w = n ** 2 / (n ** 2 + quality.PRIOR ** 2)
        np.testing.assert_allclose(of_pair[source].center, c + w * (own - c), rtol=1e-9)
        want = w * spread + (1 - w) * v
        np.testing.assert_allclose(np.linalg.inv(np.array(of_pair[source].precision).reshape(d, d)), want, rtol=1e-6, atol=1e-9)


def test_outliers_of_small_groups_do_not_excuse_themselves():
    """One far text in groups too small for a half stays far, even where it is part of the estimate."""
    rng, d = np.random.default_rng(2), 3
    for n in range(1, d + 8):
        x = rng.normal(size=(n, d))
        x[0] = 15.0
        center, cov = quality.blend((n, x.mean(0), np.cov(x.T, bias=True) + np.eye(d) if n > 1 else np.eye(d)), (np.zeros(d), np.eye(d)), quality.PRIOR)
        off = x[0] - center
        assert off @ np.linalg.inv(cov) @ off > quality.LIMIT


def test_blend_without_one_side():
    center, cov = np.zeros(2), np.eye(2)
    assert quality.blend(None, None, 70) is None
    assert quality.blend(None, (center, cov), 70)[1] is cov and quality.blend((5, center, cov), None, 70)[1] is cov


def test_chi_squared():
    assert quality.chi2_cdf(quality.chi2_quantile(0.5, 7), 7) == pytest.approx(0.5)
    assert quality.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_quality_of_odd_rows(documents, nothing):
    rows = quality.judge(documents).collect()
    assert len(rows) == documents.count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality.judge(nothing).count() == 0 and quality.keep(nothing).count() == 0
    assert quality.keep(documents).columns == documents.columns


def labelled(spark, bad=("idiot", "moronic", "trashy")):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(900):
        words, toxic = prose(rng, rng.randint(5, 200)).split(), k % 4 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        texts.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    ready(spark)
    docs, labels, truth = labelled(spark)
    texts, marks = toxicity.sample(docs, labels)
    assert len(texts) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in truth)
    model = toxicity.fit(texts, marks)
    found = toxicity.score(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    plain = prose(random.Random(8), 20)
    assert model.score(plain + " idiots") > 5 * model.score(plain)  # a form that was never seen


def test_toxicity_bounds_and_edges(spark, documents, nothing):
    docs, labels, _ = labelled(spark)
    assert len(toxicity.sample(docs, labels, max_positive=10, max_negative=20)[0]) == 30
    texts, _ = toxicity.sample(docs, labels, max_chars=5_000)
    assert 0 < sum(map(len, texts)) <= 5_000
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.sample(docs, none) == ([], [])
    model = toxicity.fit([], [])
    rows = toxicity.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(["a", "b"], [1, 1]).score("c") > 0.5
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.sample(docs, odd)[1] == [1]


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t", "One", "ÄB cd", "a b c d", "a b c d e a b c d e a b c d", "A  b\nC\x0bd e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def clustered(rng, centers, around):
    prints = []
    for _ in range(centers):
        p = rng.getrandbits(64)
        for _ in range(around):
            prints.append(p)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                p ^= 1 << b
    return np.unique(np.array(prints, np.uint64))


@pytest.mark.parametrize("budget", [0, 1, 4])
def test_trie_join_finds_all_pairs(budget):
    prints = clustered(random.Random(budget), 60, 12)
    found = {(int(i), int(j)) for a, b in simhash.trie_pairs(prints, np.zeros(len(prints), int), budget) for i, j in zip(a, b)}
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(distance <= budget)) if i < j}


@pytest.mark.parametrize("group_rows", [2_000, 5])
def test_components_of_prints(spark, group_rows):
    """Also with groups so small that hot ones are split again and again."""
    ready(spark)
    prints = clustered(random.Random(4), 25, 16)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print bigint")
    rooted = {r.node: r.root for r in simhash.components(simhash.links(simhash.grouped(frame, group_rows=group_rows), 5 * len(prints))).collect()}
    forest = simhash.Forest(len(prints))
    for i, j in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)):
        forest.join(int(i), int(j))
    signed = prints.view(np.int64).tolist()
    groups: dict = {}
    for i, p in enumerate(signed):
        groups.setdefault(forest.top(i), set()).add(p)
    mine: dict = {}
    for p in signed:
        mine.setdefault(rooted.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_long_chain_is_one_component(spark):
    ready(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_unsettled_components_are_an_error(spark):
    ready(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=1)


def test_near_duplicates_of_odd_rows(documents, nothing):
    rows = simhash.near_duplicates(documents).collect()
    texts = documents.collect()
    assert Counter(r.fingerprint for r in rows) == Counter(f"{plain_print(t.text):016x}" for t in texts)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[2] == of[3] == of[7] == 2 and of[10] == of[5] == 5 and of[None] == 1
    assert simhash.near_duplicates(nothing).count() == 0


def test_pipeline_stages(spark, documents, nothing, tmp_path):
    """Each stage against its own operator on what came in; the columns stay."""
    ready(spark)
    _, labels, _ = labelled(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = corpus(spark, 200).drop("junk")
    docs = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1000))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
        if name == "near_dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()} and max(ids) < 1000
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, documents, str(tmp_path)).count() == len({r.component_id for r in simhash.near_duplicates(documents).collect()})


def test_run_reads_documents(spark, tmp_path):
    _, labels, _ = labelled(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    corpus(spark, 100).drop("junk").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert table(spark, str(tmp_path), "documents").count() == 100


def test_near_duplicate_stage_with_repeated_ids(spark, tmp_path):
    """One id on two texts, clashing columns, null ids: every group keeps one row."""
    rng = random.Random(12)
    ready(spark)
    a, b, c = (prose(rng, 120) for _ in range(3))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, same_text string, print bigint, kept_id string, component_id bigint"

    def kept(rows):
        docs = spark.createDataFrame([(k, t, "en", "s", 1, "clash", 7, "x", 3) for k, t in rows], schema)
        found = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)

    assert kept([(5, a), (5, b), (3, b)]) == sorted([(5, a), (3, b)])
    assert kept([(5, a), (5, b)]) == sorted([(5, a), (5, b)], key=str)
    assert kept([(5, a), (5, a), (5, a + " more")]) in ([(5, a)], [(5, a + " more")])
    nulls = kept([(None, a), (None, b), (4, b), (None, a), (None, None), (None, "")])
    assert len(nulls) == 3 and (None, a) in nulls and (4, b) in nulls
    assert kept([(1, a), (2, b), (9, c), (9, c)]) == sorted([(1, a), (2, b), (9, c)])
