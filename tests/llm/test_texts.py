"""HTML, chat, licenses, language model, sketches."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import chat, html, licenses, lm, sketch
from tidemark.llm.common import ready, written

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div id="cookie-notice">We use cookies. Accept them, please.</div>%s
<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("page, text", [
    (PAGE % "<!-- ad --><div class='ad'>Buy, now.</div><article><h1>Head</h1><p><b>One, &amp; two.<br><p>Three  \n four.</p></article>", "Head\nOne, & two.\nThree four."),
    (PAGE % "<div class='wrap'><aside>Side text, of some length, really.</aside><div class='post-content'><h2>Head</h2><p>First, with some text. And more.</p><ul><li>item one<li>item two</ul></div>"
     "<div class='comments'><p>I, a reader, disagree. Very much.</p></div></div>", "Head\nFirst, with some text. And more.\nitem one\nitem two"),
    (PAGE % "<article><p>Text &lt;b&gt; &#233;&eacute; &#x41;.</p><form><p>Your mail</p></form><script>if (a < b) {}</script></article>", "Text <b> éé A."),
    (PAGE % "<article></article>", ""), ("", ""), (None, ""), ("<p>only this", "only this"), ("no tags, at all.", "no tags, at all."), ("<!-- open comment", ""), ("<article><p>cut &am", "cut &am"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("around", ["<div id='content'>%s</div>", "<main>%s</main>", "%s"])
@pytest.mark.parametrize("first, last", [("<section>%s</section>", "<section>%s</section>"), ("<article>%s</article>", "<section>%s</section>"), ("<div>%s</div>", "%s")])
def test_article_in_several_parts_is_whole(around, first, last):
    said = [f"Sentence {k} of the article, with some words, and more of them." for k in range(10)]
    part = lambda head, texts: f"<h2>{head}</h2>" + "".join(f"<p>{t}</p>" for t in texts)
    page = PAGE % (around % (first % part("One", said[:7]) + last % part("Two", said[7:])))
    assert html.main_text(page) == "\n".join(["One", *said[:7], "Two", *said[7:]])


SAID = [f"Sentence {k} of the article, with some words, and more of them, as prose has." for k in range(8)]
PROSE = "".join(f"<p>{t}</p>" for t in SAID)


@pytest.mark.parametrize("page", [
    f"<body><div><div><a href='/a'>Home</a></div><div>Today</div><div>Log in</div></div><div>{PROSE}</div><div><div>More</div><div>Up</div></div></body>",
    f"<table><tr><td>Menu<td>Start</tr><tr><td><div>{PROSE}</div><td>Weather</tr></table>",
    f"<div><span>Site name</span></div><div><div><h2>Head</h2>{PROSE}</div></div><div><ul><li>One<li>Two<li>Three</ul></div>",
])
def test_ratios_alone_find_the_article(page, monkeypatch):
    """No article tag, no telling name, no role: without the ratios other blocks come along."""
    expected = "\n".join((["Head"] if "Head" in page else []) + SAID)
    assert html.main_text(page) == expected
    monkeypatch.setattr(html, "path_weights", lambda ratios: {p: 1.0 for p in ratios})
    assert html.main_text(page) != expected


REFERENCES = "".join(f"<li><a href='/{k}'>Author, A., and Other, B. (20{k}). A study of things, part {k}. Journal, 3.</a></li>" for k in range(10, 14))


@pytest.mark.parametrize("page, text", [
    (PAGE % f"<article>{PROSE}<section class='legal'><p>The law, as it stands, says much of this. It is read, and said.</p></section></article>", [*SAID, "The law, as it stands, says much of this. It is read, and said."]),
    (PAGE % f"<article>{PROSE}<div class='search-results-of-study'><p>In the study, they found, and wrote, a lot.</p></div></article>", [*SAID, "In the study, they found, and wrote, a lot."]),
    (PAGE % f"<article>{PROSE}<p>It is <span class='tags'>marked</span> here, too.</p></article>", [*SAID, "It is marked here, too."]),
    (PAGE % f"<div>{PROSE}<ul>{REFERENCES}</ul></div>", [*SAID, *[f"Author, A., and Other, B. (20{k}). A study of things, part {k}. Journal, 3." for k in range(10, 14)]]),
    # What only the names tell still goes.
    (PAGE % f"<article>{PROSE}<div class='ad'>Buy this, now, and save. It is good.</div><div class='legal'>All rights</div></article>", SAID),
    (PAGE % f"<div>{PROSE}<ul><li><a href='/x'>Home</a><li><a href='/y'>About us</a></ul></div>", SAID),
    (PAGE % f"<article>{PROSE}<p>End.<span class='share'>Share</span></p><p>So <span class='tags' hidden>x</span>it is.</p></article>", [*SAID, "End.", "So it is."]),
])
def test_names_take_out_no_article_text(page, text):
    assert html.main_text(page) == "\n".join(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b", "<!--", "-->", "&amp", "x, y.", "<script>", "</article>", "<article>", "\"'", ">"])).map("".join))
def test_any_markup_gives_some_text(page):
    assert isinstance(html.main_text(page), str)


def test_pages_keep_all_rows(spark, nothing):
    rows = [(1, "u", "<p>a, b.</p>", "x"), (1, "u", "<p>a, b.</p>", "x"), (None, None, None, None), (2, "u", "<p>" + "word, " * 200_000 + "</p>", "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert Counter(len(r.text) for r in found) == Counter([5, 5, 0, 1_199_999])
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "\\n", "<|im_start|>"]), st.one_of(st.text(), st.text(alphabet="<|\\im_end>\n")))))
def test_formatting_reads_back(turns):
    text, spans = chat.render(turns)
    assert [t for _, t in chat.parse(text)] == [t for _, t in turns]
    assert text.count(chat.START) == text.count(chat.END) == len(turns)
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


TURNS = [("user", "q"), ("assistant", "a")]


@pytest.mark.parametrize("record, layout, turns", [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", TURNS),
    ({"id": 3, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", TURNS),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "conversations with system", [("system", "s"), ("user", "q")]),
    ({"prompt": "q", "response": "a", "score": 0.5}, "prompt and response", TURNS),
    ({"instruction": "q", "input": "x", "output": "a"}, "instruction with input", [("user", "q\n\nx"), ("assistant", "a")]),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction with input", TURNS),
    ({"data": {"prompt": "q", "response": "a"}}, "nested data", TURNS),
    ({"history": [["x", "y"]], "prompt": "q", "response": "a"}, "history", [("user", "x"), ("assistant", "y"), *TURNS]),
    ([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "messages", TURNS),
    ({"messages": []}, None, []), ({"other": 1}, None, []), (None, None, []), ({}, None, []),
])
def test_layouts(record, layout, turns):
    found, schema, made = chat.canonical_turns(record)
    assert made == turns
    assert layout is None or found == layout
    assert len(schema) == 16


def test_fingerprints_follow_nested_paths():
    assert chat.field_paths({"a": [{"b": 1}, {"c": {"d": 2}}], "e": []}) == {"a[].b", "a[].c.d", "e[]"}
    assert chat.canonical_turns({"a": 1, "b": 2})[1] == chat.canonical_turns({"b": "x", "a": "y"})[1] != chat.canonical_turns({"a": {"b": 2}})[1]


def test_conversations_from_rows(spark, nothing):
    rows = [(1, 1, "assistant", "a"), (1, 0, "user", "<|im_end|>"), (2, 0, None, None), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "user", "y" * 300_000)]
    gathered = chat.gather_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = {r.conv_id: r for r in chat.read_back(chat.format_records(gathered)).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 2, 2: 2, None: 1, 3: 1}
    assert found[1].turns_sha256 == hashlib.sha256(b"user\n<|im_end|>\nassistant\na\n").hexdigest() and found[1].loss_chars == 1
    odd = spark.createDataFrame([(1, "not json"), (2, None), (3, json.dumps({"prompt": "q", "response": "a"}))], "conv_id bigint, record string")
    assert {r.conv_id: r.layout for r in chat.format_records(odd).collect()} == {1: None, 2: None, 3: "prompt and response"}


def test_license_matches_are_all_found():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(4)
    for name, notice in licenses.TEMPLATES.items():
        for _ in range(8):
            before = prose(rng, rng.randint(0, 9_000 if rng.random() < 0.1 else 200))
            found = scanner.scan(f"{before} {notice} {prose(rng, 100)}")
            match = next(m for m in found if m[0] == name)
            words = [w for t in before.split() for w in licenses.parts_of(t)]
            assert match[1] == len(words) and match[3] == 1.0
    assert scanner.scan(prose(rng, 3_000)) == [] and scanner.scan(None) == [] and scanner.scan("two words") == []
    grant = licenses.TEMPLATES["MIT grant"].split()
    assert "MIT grant" in [m[0] for m in scanner.scan(" ".join(grant[:-5]))]
    assert "MIT grant" not in [m[0] for m in scanner.scan(" ".join(grant[: len(grant) // 2]))]


def test_license_rows(documents, nothing):
    assert licenses.scan(documents).count() == 0 and licenses.scan(nothing).count() == 0


def test_network_learns_from_both_sides(spark, nothing):
    rng = random.Random(1)
    pairs = {"red": "apple", "blue": "sky", "green": "grass"}
    texts = [" ".join(f"{a} thing {b}" for a, b in (rng.choice(list(pairs.items())) for _ in range(200))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = lm.vocabulary(frame)
    network = lm.train(frame, words, passes=((2, 0.03), (1, 0.02)))
    ids = lm.Ids(words).of(texts[0])
    near = network.log_probabilities(ids, lm.contexts_of(ids), network.tables()).mean()
    share = np.bincount(ids) / len(ids)
    assert near > 0.6 * (share[share > 0] * np.log(share[share > 0])).sum()  # far better than frequencies
    mixed = np.random.default_rng(0).permutation(ids)
    assert network.log_probabilities(mixed, lm.contexts_of(mixed), network.tables()).mean() < near - 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "red"), (3, "red"), (None, "blue sky")], "doc_id bigint, text string")
    found = lm.score(odd, words, network).collect()
    assert sorted(r.n_tokens for r in found) == [0, 0, 1, 1, 2] and all(r.log_probability == 0 for r in found if not r.n_tokens)
    assert lm.pseudo_likelihood(nothing).count() == 0


@pytest.mark.parametrize("known", [0, 2, 50_000])
def test_every_word_has_a_probability_of_its_own(spark, monkeypatch, known):
    ready(spark)
    monkeypatch.setattr(lm, "KNOWN", known)
    rare = {"alphaxyz": 7, "betaxyz": 3, "gammaxyz": 1}
    said = [f"w{k}" for k in range(lm.WORDS)] * 9 + [w for w, n in rare.items() for _ in range(n)] + ["--", "Other."]
    random.Random(4).shuffle(said)
    corpus = spark.createDataFrame([(k, " ".join(said[k::5])) for k in range(5)], "doc_id bigint, text string")
    counted = written(lm.count_words(corpus), "t")
    words, network = lm.vocabulary(corpus), lm.Network.first()
    every = [r.word or "--" for r in counted.collect()]
    odd = spark.createDataFrame(list(enumerate([*every, "newxyz", "Betaxyz, betaxyz", "", None])) + [(None, "alphaxyz")], "doc_id bigint, text string")
    rows = lm.score(odd, words, network, counted).collect()
    assert len(rows) == len(every) + 5
    found = {w: r for w, r in zip([*every, "newxyz"], sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id))}
    score = {w: r.log_probability for w, r in found.items()}
    assert score["alphaxyz"] - score["gammaxyz"] == pytest.approx(np.log(7))
    assert score["betaxyz"] - score["gammaxyz"] == pytest.approx(np.log(3))
    assert score["newxyz"] == pytest.approx(score["gammaxyz"])
    assert next(r for r in rows if r.doc_id is None).log_probability == score["alphaxyz"]
    # The words of a class, and one for the unknown ones, share its probability.
    ids = np.array([lm.Ids(words).of(w)[0] for w in found])
    classes = np.exp(network.log_probabilities(np.arange(lm.VOCABULARY), np.full((lm.VOCABULARY, 4), lm.EDGE), network.tables()))
    for c in [*range(lm.WORDS), lm.WORDS + lm.ending("xyz")]:
        assert sum(np.exp(score[w]) for w, i in zip(found, ids) if i == c) == pytest.approx(classes[c], rel=1e-5)


class OneTask:
    """A frame of classes whose Arrow map runs here, as one task, so that a test sees the steps it takes."""

    def __init__(self, ids):
        self.batch, self.made = pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"]), None

    def mapInArrow(self, run, schema):
        self.made = list(run(iter([self.batch])))
        return self

    def collect(self):
        return []

    def select(self, *_):
        return self

    groupBy = agg = select


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_every_window_is_trained_on_once_a_pass(spark, monkeypatch, stride):
    sizes = [0, 1, 2, 7, 8, 9, 40, lm.BATCH + 5, 3 * lm.BATCH]
    texts = [np.random.default_rng(n).integers(0, lm.EDGE, n) for n in sizes]
    want = Counter(tuple(row) for ids in texts for row in np.column_stack([ids, lm.contexts_of(ids)]).tolist())
    seen = Counter()

    def noted(self, tokens, contexts, squares, rate):
        assert len(tokens) <= lm.BATCH
        seen.update(map(tuple, np.column_stack([tokens, contexts]).tolist()))

    monkeypatch.setattr(lm.Network, "step", noted)
    classes = OneTask([ids.astype(np.uint8).tobytes() for ids in texts] + [None])
    lm.train(None, [], passes=((stride, 0.01),), classes=classes)
    assert seen == want
    assert classes.made[0].column(2)[0].as_py() == sum(sizes)


def test_windows_reach_the_step_as_bytes(monkeypatch):
    """A batch of windows is held at one byte a class, not eight."""
    sent = []
    monkeypatch.setattr(lm.Network, "step", lambda self, tokens, contexts, squares, rate: sent.append((tokens, contexts)))
    lm.train(None, [], passes=((8, 0.01),), classes=OneTask([bytes(range(255)) * 20, None, b""]))
    assert [len(tokens) for tokens, _ in sent] == [lm.BATCH, lm.BATCH, 255 * 20 - 2 * lm.BATCH]
    assert all(tokens.itemsize == contexts.itemsize == 1 for tokens, contexts in sent)


@pytest.mark.parametrize("scale", [1, 60])
def test_step_equals_plain_sums(scale):
    """One step's gradient, from loops over the windows in double precision; with large weights scores are shifted."""
    rng = np.random.default_rng(2)
    net = lm.Network.first()
    net.group *= scale
    net.member *= scale
    net.group_bias += rng.normal(0, 0.1, lm.GROUPS).astype(np.float32)
    net.mix_bias += rng.normal(0, 0.1, lm.HIDDEN).astype(np.float32)
    tokens, around = rng.integers(0, 60, 90).astype(np.uint8), rng.integers(0, lm.VOCABULARY, (90, 4)).astype(np.uint8)
    before = [p.astype(np.float64) for p in net.parts()]
    embed, mix, mix_bias, group, group_bias, member, member_bias = before
    want = [np.zeros_like(p) for p in before]

    def slope(scores, at):
        e = np.exp(scores - scores.max())
        return e / e.sum() - (np.arange(len(scores)) == at)

    for token, near in zip(tokens.tolist(), around.tolist()):
        g, m = divmod(token, lm.MEMBERS)
        hidden = np.tanh(sum(embed[c] @ mix[p] for p, c in enumerate(near)) + mix_bias)
        by_group, by_member = slope(hidden @ group + group_bias, g) / 90, slope(hidden @ member[g] + member_bias[g], m) / 90
        back = (group @ by_group + member[g] @ by_member) * (1 - hidden**2)
        for p, c in enumerate(near):
            want[0][c] += mix[p] @ back
            want[1][p] += np.outer(embed[c], back)
        want[2] += back
        want[3] += np.outer(hidden, by_group)
        want[4] += by_group
        want[5][g] += np.outer(hidden, by_member)
        want[6][g] += by_member
    squares = [np.full_like(p, 1e4) for p in net.parts()]
    net.step(tokens, around, squares, 0.01)
    for square, gradient, old, new in zip(squares, want, before, net.parts()):
        assert np.abs((old - new) * np.sqrt(square) / 0.01 - gradient).max() < 2e-2 and np.isfinite(new).all()
    plain = [np.full_like(p, 1e-30) for p in lm.Network.first().parts()]
    other = lm.Network(*[p.astype(np.float32) for p in before])
    other.step(tokens, around, plain, 0.0)
    for square, gradient in zip(plain, want):
        assert np.allclose(np.sqrt(square / 0.02), np.abs(gradient), rtol=2e-3, atol=2e-6 * scale)


def test_tanh_by_exponentials():
    x = np.concatenate([np.linspace(-12, 12, 10_001), [-1e4, -90, -45, 0, 45, 90, 1e4]]).astype(np.float32)
    assert np.abs(lm._tanh(x.copy()) - np.tanh(x.astype(np.float64))).max() < 3e-7


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_window_order_goes_phase_by_phase(stride):
    for size in (0, 1, 2, 7, 8, 9, 100):
        assert lm.window_order(size, stride).tolist() == [k for phase in range(stride) for k in range(phase, size, stride)]


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = lm.Network.first()
    tokens, around = rng.integers(0, lm.VOCABULARY, 64), rng.integers(0, lm.VOCABULARY, (64, 4))
    before = net.log_probabilities(tokens, around, net.tables()).mean()
    squares = [np.full_like(p, 1e-4) for p in net.parts()]
    for _ in range(50):
        net.step(tokens, around, squares, 0.02)
    assert net.log_probabilities(tokens, around, net.tables()).mean() > before + 1.0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_sketches_give_the_difference(a, b):
    keys = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)]
    ours, theirs = sketch.difference(lambda cells: (sketch.build(keys[0], cells), sketch.build(keys[1], cells)), 6)
    assert set(ours.tolist()) == set(keys[0].tolist()) - set(keys[1].tolist())
    assert set(theirs.tolist()) == set(keys[1].tolist()) - set(keys[0].tolist())


def test_versions_beside_their_successors(documents, nothing, spark):
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in documents.collect()), key=lambda r: (-r[0], r[1]))
    found = sketch.compare_versions(documents.repartition(3)).collect()
    want = Counter()
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        changed = sketch.edited(text, after)
        sets = [set(sketch.digests(t).tolist()) for t in (text, changed, after)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want[doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
    assert len({r.fingerprint for r in found if r.doc_id in (5, 10)}) == 1
    assert sketch.compare_versions(nothing).count() == 0
    one = sketch.compare_versions(spark.createDataFrame([(4, "alone here")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0


def test_one_word_more_changes_one_paragraph():
    rng = random.Random(6)
    words = [f"w{rng.randrange(3_000)}" for _ in range(2_000)]
    own = sketch.digests(" ".join(words))
    assert 40 < len(own) < 160
    for at in (0, 700, 2_000):
        other = sketch.digests(" ".join([*words[:at], "inserted", *words[at:]]))
        assert sketch.likeness(own, other) > 0.9
    assert sketch.likeness(own, sketch.digests(" ".join(words[::-1]))) < 0.1
    assert b" ".join(sketch.paragraphs(" ".join(words))).decode() == " ".join(words)
    assert list(sketch.paragraphs("short line\n\n \t\n" + "é " * 30 + "end"))[0] == b"short line"


@pytest.mark.parametrize("kind, ids", [("string", ["b", "a", "é\"", None, "b"]), ("double", [1.25, 1.5, -2.0, None, 1.25]), ("date", ["2024-01-02", "2023-05-05", "2024-03-01", None, "2024-01-02"])])
def test_ids_of_any_type_keep_their_order(spark, nothing, kind, ids):
    rows = [(i, f"text {k} of its own") for k, i in enumerate(ids)]
    found = sketch.compare_versions(spark.createDataFrame(rows, "doc_id string, text string" if kind != "double" else "doc_id double, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").repartition(3))
    assert found.schema["doc_id"].dataType.simpleString() == kind and found.count() == 5
    tie = {r.text: r.h for r in spark.createDataFrame(rows, "x string, text string" if kind != "double" else "x double, text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], tie[r[1]]), reverse=True) + [r for r in rows if r[0] is None]
    want = {hashlib.sha256(sketch.edited(t, after).encode()).hexdigest() for (_, t), (_, after) in zip(order, order[1:] + order[:1])}
    assert {r.edited_sha256 for r in found.collect()} == want


def test_one_id_on_many_texts_is_spread(spark, nothing):
    rows = spark.range(400).selectExpr("CAST(7 AS BIGINT) AS doc_id", "concat('text ', id, ' and more') AS text").repartition(8)
    found = sketch.compare_versions(rows)
    assert found.count() == 400 and found.select(F.spark_partition_id()).distinct().count() > 4


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net = lm.Network.from_flat(lm.Network.first().flat().astype(np.float64))
    tokens, around = rng.integers(0, lm.VOCABULARY, 300), rng.integers(0, lm.VOCABULARY, (300, 4))
    before = [p.astype(np.float64).copy() for p in net.parts()]
    ones = [np.full_like(p, 1e12) for p in net.parts()]  # so large that a step is the plain gradient, scaled by a known amount
    net.step(tokens, around, ones, 1e5)
    moved = [(b - p.astype(np.float64)) / 1e5 * np.sqrt(0.98e12) for b, p in zip(before, net.parts())]

    def loss(parts):
        other = lm.Network(*parts)
        return -other.log_probabilities(tokens, around, np.einsum("vd,pdh->pvh", other.embed, other.mix)).mean()

    for k, part in enumerate(before):
        for at in [np.unravel_index(i, part.shape) for i in rng.choice(part.size, 4, replace=False)]:
            up, down = [p.copy() for p in before], [p.copy() for p in before]
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert moved[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-4)


def test_scores_equal_a_plain_sum(spark, monkeypatch):
    """A text's score, token by token in plain Python from the weights and the counts of words."""
    import math
    from collections import Counter

    ready(spark)
    monkeypatch.setattr(lm, "KNOWN", 5)
    monkeypatch.setattr(lm, "SCORED_TOKENS", 37)  # texts are put together and cut
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (1, 3, 40, 90, 200)] + ["", "Unheard-of wordsxyz, wordsxyz!"]
    corpus = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id bigint, text string")
    counted = written(lm.count_words(corpus), "plain-words")
    words = lm.vocabulary(corpus)
    network = lm.train(corpus, words, passes=((3, 0.05),))
    found = {r.doc_id: r for r in lm.score(corpus, words, network, counted).collect()}
    n = Counter(lm.normal(t) for text in texts * 3 for t in text.split())
    class_of = lambda w: words.index(w) if w in words else lm.WORDS + lm.ending(w)
    size = Counter()
    for w, times in n.items():
        size[class_of(w)] += times

    def softmax(x):
        x = [math.exp(v) for v in x]
        return [v / sum(x) for v in x]

    for k, text in enumerate(texts):
        ids, total = [class_of(lm.normal(t)) for t in text.split()], 0.0
        for i, token in enumerate(text.split()):
            hidden = np.zeros(lm.HIDDEN)
            for p, o in enumerate(lm.OFFSETS):
                near = ids[i + o] if 0 <= i + o < len(ids) else lm.EDGE
                hidden += network.embed[near].astype(float) @ network.mix[p].astype(float)
            hidden = np.tanh(hidden + network.mix_bias)
            g, m = divmod(ids[i], lm.MEMBERS)
            total += math.log(softmax(hidden @ network.group + network.group_bias)[g]) + math.log(softmax(hidden @ network.member[g] + network.member_bias[g])[m])
            if ids[i] >= lm.WORDS:
                total += math.log(n[lm.normal(token)] / (size[ids[i]] + 1))  # one more token for all unknown words
        assert found[k].log_probability == pytest.approx(total, rel=1e-4, abs=1e-3) and found[k].n_tokens == len(ids)
        assert found[k].per_token == (None if not ids else pytest.approx(total / len(ids), rel=1e-4))
