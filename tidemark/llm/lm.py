"""Masked pseudo-likelihood of a bidirectional window network.

Tokens are blank-separated words, lower-cased and without punctuation at their ends. The most
frequent words of the corpus are classes of their own, all others are in a class by their
ending. For each token the network sees the two tokens before and the two after it, embeds
their classes, mixes them by position in one hidden layer and predicts the class between, in
two steps: which group of classes, then which class of that group (16 of 16, so 32
exponentials a token in place of 256). The word within its class has its share of the class's
tokens in the whole corpus. A document's score is the sum of the log probabilities of all its tokens,
each given both sides. The vocabulary is every word of the corpus and grows with it: shares
of the `KNOWN` most frequent words are sent to the tasks, the others are joined by word. All
words that the corpus does not have count together as one more token of each class.

Words are counted over all documents. Training passes go over all documents, too:
every task starts from the same weights, takes a step per batch of windows (those of
all tokens of each text, `stride` apart, one phase after the other), and the tasks'
weights are averaged, weighted by their windows, in a Spark aggregate. Both what
is counted and what is trained on grow with the corpus; the network does not.

Null texts count as empty; a text without tokens scores 0. An empty corpus leaves
the first weights.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

WORDS, ENDINGS, EDGE = 192, 63, 255
VOCABULARY = WORDS + ENDINGS + 1
GROUPS = 16
MEMBERS = VOCABULARY // GROUPS
SIDE, EMBED, HIDDEN = 2, 16, 24
OFFSETS = (-2, -1, 1, 2)
BATCH = 2_048
#: Tokens scored at once; texts are put together up to it, longer ones taken in pieces.
SCORED_TOKENS = 16_384
#: Words besides the classes of their own whose shares every task holds.
KNOWN = 50_000
_ENDS = string.punctuation + "…“”„«»¿¡’‘–—"
#: Exponentials of scores under it are far from the ends of single precision.
SMALL = 40
#: (stride, rate) of each pass over the corpus; the stride orders a text's windows, all are taken.
PASSES = ((8, 0.03), (3, 0.015))


def normal(token: str) -> str:
    return token.strip(_ENDS).lower()


def ending(word: str) -> int:
    """Which of the shared classes a word is in if it has none of its own."""
    return xxhash.xxh32_intdigest(word[-3:].encode("utf-8", "surrogatepass")) % ENDINGS


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of the rows, which distinct token each token is, distinct tokens) of a column of texts; null is empty."""
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    encoded = lists.flatten().dictionary_encode()
    distinct, index, offsets = encoded.dictionary, encoded.indices.to_numpy(), lists.offsets.to_numpy()
    nothing = pc.index(distinct, "").as_py()
    if nothing >= 0:  # blanks at the ends of a text
        said = index != nothing
        offsets, index = np.concatenate([[0], np.cumsum(said)])[offsets], index[said]
    return offsets, index, distinct


def normals(tokens: pa.Array) -> pa.Array:
    """`normal` of a whole column."""
    return pc.utf8_lower(pc.utf8_trim(tokens, characters=_ENDS))


def endings(words: pa.Array) -> np.ndarray:
    """`ending` of a whole column."""
    tails = pc.utf8_slice_codeunits(words, start=-3).dictionary_encode()
    return np.array(list(map(ending, tails.dictionary.to_pylist())), np.int32)[tails.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)


def count_words(documents: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts; tokens of punctuation alone are the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])

        def sent(table: pa.Table) -> pa.RecordBatch:
            words = table["word"].combine_chunks()
            return pa.RecordBatch.from_arrays([words, pa.array(endings(words)), table["n_sum"].combine_chunks()], names=["word", "ending", "n"])

        for batch in batches:
            _, index, distinct = tokens_of(batch.column(0))
            times = np.bincount(index, minlength=len(distinct))
            held.append(pa.table({"word": normals(distinct), "n": pa.array(times, pa.int64())}).filter(pa.array(times > 0)))
            rows += len(held[-1])
            if rows > 400_000:
                table = merged()
                if len(table) > 200_000:
                    yield sent(table)
                    held, rows = [], 0
                else:
                    held, rows = [table.rename_columns(["word", "n"])], len(table)
        if rows:
            yield sent(merged())

    return documents.select("text").mapInArrow(run, "word string, ending int, n bigint").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _frequent(counted: DataFrame, most: int) -> list:
    return counted.filter("word <> ''").orderBy(F.desc("n"), "word").limit(most).collect()


def _well_known(counted: DataFrame, most: int) -> list:
    """At most about `most` of the frequent words, by a least count; the driver holds no list per partition."""
    size = F.floor(F.log("n") * 20)
    least, held = None, 0
    for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():  # under 1,000 rows
        held += r["words"]
        if held > most:
            break
        least = r["size"]
    return [] if least is None else counted.filter(size >= least).collect()


def vocabulary(documents: DataFrame) -> list[str]:
    """The words with classes of their own: the most frequent, ties in order."""
    return [r.word for r in _frequent(count_words(documents), WORDS)]


class Ids:
    """Classes of tokens."""

    def __init__(self, words: list[str]) -> None:
        self.own = {w: i for i, w in enumerate(words)}

    def of_word(self, word: str) -> int:
        found = self.own.get(word)
        return WORDS + ending(word) if found is None else found

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self.of_word(normal(t)) for t in (text or "").split()], np.int64)


class Reader:
    """Classes and known log shares of a column of texts; the words of tokens without a known share.

    Whatever depends on a token alone is found once for the distinct tokens of a batch.
    """

    def __init__(self, words: list[str], known: dict[str, float]) -> None:
        others = [w for w in known if w not in set(words)]
        self.listed = pa.array([*words, *others], pa.string())
        self.own = len(words)
        self.shares = np.array([*[0.0] * len(words), *[known[w] for w in others], math.nan])

    def read(self, texts: pa.Array):
        """(offsets, classes as bytes a token, sums of known log shares a row, rows, words and times of the others)."""
        offsets, index, distinct = tokens_of(texts)
        encoded = normals(distinct).dictionary_encode()
        words, word_of = encoded.dictionary, encoded.indices.to_numpy()[index]
        place = pc.index_in(words, value_set=self.listed).fill_null(len(self.listed)).to_numpy()
        share = self.shares[place][word_of]
        classes = np.where(place < self.own, place, WORDS + endings(words)).astype(np.uint8)[word_of]
        left = np.flatnonzero(np.isnan(share))
        share[left] = 0.0
        full, sums = np.flatnonzero(np.diff(offsets)), np.zeros(len(offsets) - 1)
        if len(full):  # row by row, so that a row's sum does not depend on its batch
            sums[full] = np.add.reduceat(share, offsets[full])
        rows = np.searchsorted(offsets, left, side="right") - 1
        pairs, times = np.unique(rows * max(1, len(words)) + word_of[left], return_counts=True)
        rows, left_words = np.divmod(pairs, max(1, len(words)))
        return offsets, classes, sums, rows, words.take(pa.array(left_words)), times


def _bytes_of(offsets: np.ndarray, classes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(classes.tobytes())])


def classes_of(documents: DataFrame, words: list[str]) -> DataFrame:
    """(ids): the classes of each text's tokens, one byte a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words, {})
        for batch in batches:
            offsets, classes, *_ = reader.read(batch.column(0))
            yield pa.RecordBatch.from_arrays([_bytes_of(offsets, classes)], names=["ids"])

    return documents.select("text").mapInArrow(run, "ids binary")


@dataclass
class Network:
    embed: np.ndarray  # vocabulary x embed
    mix: np.ndarray  # positions x embed x hidden
    mix_bias: np.ndarray
    group: np.ndarray  # hidden x groups
    group_bias: np.ndarray
    member: np.ndarray  # groups x hidden x members
    member_bias: np.ndarray  # groups x members

    @classmethod
    def first(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        f = np.float32
        return cls(rng.normal(0, 0.3, (VOCABULARY, EMBED)).astype(f), rng.normal(0, 0.3 / np.sqrt(len(OFFSETS)), (len(OFFSETS), EMBED, HIDDEN)).astype(f), np.zeros(HIDDEN, f),
                   rng.normal(0, 0.1, (HIDDEN, GROUPS)).astype(f), np.zeros(GROUPS, f), rng.normal(0, 0.1, (GROUPS, HIDDEN, MEMBERS)).astype(f), np.zeros((GROUPS, MEMBERS), f))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.mix, self.mix_bias, self.group, self.group_bias, self.member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Network:
        parts, at = [], 0
        for p in cls.first().parts():
            parts.append(values[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return cls(*parts)

    def tables(self) -> np.ndarray:
        """What each token adds to the hidden layer at each position."""
        return np.matmul(self.embed, self.mix)

    def hidden(self, contexts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Hidden layer, one column a token: sums over the few rows then run along the tokens."""
        total = tables[0].take(contexts[:, 0], 0)
        for p in range(1, len(OFFSETS)):
            total += tables[p].take(contexts[:, p], 0)
        total += self.mix_bias
        return _tanh(np.ascontiguousarray(total.T))

    def _weights(self) -> np.ndarray:
        """Per group, what gives a token's scores of all groups and then of the group's classes; the last row is the biases."""
        weights = np.empty((GROUPS, HIDDEN + 1, GROUPS + MEMBERS), self.group.dtype)
        weights[:, :HIDDEN, :GROUPS], weights[:, HIDDEN, :GROUPS] = self.group, self.group_bias
        weights[:, :HIDDEN, GROUPS:], weights[:, HIDDEN, GROUPS:] = self.member, self.member_bias
        return weights

    def log_probabilities(self, tokens: np.ndarray, contexts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of each token's class: log P(group) + log P(class of the group).

        Products are taken in double precision, whose last digits alone depend on
        the tokens beside a token, and rounded: a token's value is its own.
        """
        found, weights = np.empty(len(tokens)), self._weights()
        bound = np.abs(weights).sum(1).max()
        turned = np.ascontiguousarray(weights.transpose(0, 2, 1), np.float64)
        for first in range(0, len(tokens), BATCH):
            part = slice(first, first + BATCH)
            order, said, spans = _by_group(tokens[part])
            hidden = np.ones((HIDDEN + 1, len(said)))  # the last row meets the biases
            hidden[:HIDDEN] = self.hidden(contexts[part].take(order, 0), tables)
            products = np.empty((GROUPS + MEMBERS, len(said)))
            for g, at in spans:  # tokens of one group share one product
                np.matmul(turned[g], hidden[:, at], out=products[:, at])
            found[first + order] = _log_softmax_at(products.astype(np.float32).reshape(2, GROUPS, -1), np.stack([said // MEMBERS, said % MEMBERS]), bound).sum(0)
        return found

    def step(self, tokens: np.ndarray, contexts: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """One batch of gradient descent, scaled by running squares of the gradients."""
        n, f = len(tokens), np.float32
        order, said, spans = _by_group(tokens)
        near = contexts.take(order, 0).T + np.arange(len(OFFSETS))[:, None] * VOCABULARY  # places in the tables, one row a position
        tables = self.tables()
        tables[0] += self.mix_bias
        tables = tables.reshape(-1, HIDDEN)
        total = tables.take(near[0], 0)
        for at in near[1:]:
            total += tables.take(at, 0)
        hidden = np.ones((n, HIDDEN + 1), f)  # the last column meets the biases
        hidden[:, :HIDDEN] = _tanh(total)
        weights = self._weights()
        slope = np.empty((n, GROUPS + MEMBERS), f)
        for g, at in spans:
            np.matmul(hidden[at], weights[g], out=slope[at])
        _softmax_slope(slope.reshape(2 * n, GROUPS), np.stack([said // MEMBERS, said % MEMBERS], 1).ravel(), n, np.abs(weights).sum(1).max())
        toward, moved = np.empty((n, HIDDEN), f), np.zeros_like(weights)
        for g, at in spans:
            np.matmul(hidden[at].T, slope[at], out=moved[g])
            np.matmul(slope[at], weights[g, :HIDDEN].T, out=toward[at])
        total *= total
        np.subtract(f(1), total, out=total)
        toward *= total
        # What reaches the hidden layer from each token at each position, summed by token.
        near, reached = near.ravel(), np.empty((HIDDEN, len(OFFSETS) * VOCABULARY), f)
        each = np.empty((len(OFFSETS), n))
        for k, unit in enumerate(np.ascontiguousarray(toward.T)):
            each[:] = unit
            reached[k] = np.bincount(near, each.ravel(), minlength=reached.shape[1])
        by_token = reached.reshape(HIDDEN * len(OFFSETS), VOCABULARY)
        embed = by_token.T @ self.mix.transpose(2, 0, 1).reshape(-1, EMBED)
        mix = (by_token @ self.embed).reshape(HIDDEN, len(OFFSETS), EMBED).transpose(1, 2, 0)
        groups = moved[:, :, :GROUPS].sum(0)
        gradients = [embed, mix, reached[:, :VOCABULARY].sum(1), groups[:HIDDEN], groups[HIDDEN], moved[:, :HIDDEN, GROUPS:], moved[:, HIDDEN, GROUPS:]]
        for weight, gradient, square in zip(self.parts(), gradients, squares):
            square *= f(0.98)
            square += f(0.02) * gradient * gradient
            weight -= f(rate) * gradient / (np.sqrt(square) + f(1e-4))


def _by_group(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """An order that puts the tokens of a group together, the tokens in it, and where each group stands."""
    tokens = tokens.astype(np.uint8)
    order = np.argsort(tokens, kind="stable")
    said = tokens.take(order)
    ends = np.searchsorted(said, np.arange(0, VOCABULARY, MEMBERS, dtype=np.uint8)).tolist() + [len(said)]
    return order, said, [(g, slice(a, b)) for g, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, 1 - 2 / (exp(2 x) + 1): half the time of the library's."""
    x += x
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += x.dtype.type(1)
    np.divide(x.dtype.type(-2), x, out=x)
    x += x.dtype.type(1)
    return x


def _log_softmax_at(scores: np.ndarray, chosen: np.ndarray, bound: float) -> np.ndarray:
    """Log softmax along the second axis, at one place of each; no score is beyond `bound`."""
    if not bound < SMALL:
        scores -= scores.max(1, keepdims=True)
    own = np.take_along_axis(scores, chosen[:, None].astype(np.intp), 1)[:, 0].astype(np.float64)
    np.exp(scores, out=scores)
    total = scores[:, 0].astype(np.float64)
    for k in range(1, scores.shape[1]):  # in one order, however many columns there are
        total += scores[:, k]
    return own - np.log(total)


def _softmax_slope(scores: np.ndarray, chosen: np.ndarray, n: int, bound: float) -> None:
    """In place, the derivative of the negative log likelihood by the scores of each row, over n; no score is beyond `bound`."""
    if not bound < SMALL:
        scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores @ np.full((scores.shape[1],) * 2, n, scores.dtype)
    scores.ravel()[np.arange(0, scores.size, scores.shape[1]) + chosen] -= scores.dtype.type(1 / n)


def contexts_of(ids: np.ndarray) -> np.ndarray:
    """The tokens around each token; outside the text stands the edge."""
    edge = np.full(SIDE, EDGE, ids.dtype)
    framed = np.concatenate([edge, ids, edge])
    return np.stack([framed[SIDE + o:SIDE + o + len(ids)] for o in OFFSETS], 1)


def window_order(size: int, stride: int) -> np.ndarray:
    """All positions of a text, `stride` apart, one phase after the other: a batch of a long text is not of one passage."""
    rows = -(-size // stride)
    order = np.arange(rows * stride).reshape(rows, stride).T.ravel()
    return order[order < size]


def train(documents: DataFrame, words: list[str], *, passes: tuple[tuple[int, float], ...] = PASSES, classes: DataFrame | None = None) -> Network:
    """Train on all windows of all documents in every pass: local steps in the tasks, weights averaged after each pass.

    `classes` has the texts' classes if they are written already (`ids`).
    """
    classes, network = classes_of(documents, words) if classes is None else classes, Network.first()
    for stride, rate in passes:
        start = network.flat()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, windows = Network.from_flat(start), 0
            squares = [np.full_like(p, 1e-4) for p in own.parts()]
            held, waiting = [], 0  # rows of a token and those around it
            edge, near = bytes([EDGE]) * SIDE, SIDE + np.array((0, *OFFSETS))
            for batch in batches:
                for said in batch.column(0).to_pylist():
                    framed = np.frombuffer(edge + (said or b"") + edge, np.uint8)
                    order = window_order(len(framed) - 2 * SIDE, stride)
                    for first in range(0, len(order), BATCH):  # a long text's windows are not held at once
                        held.append(framed.take(order[first:first + BATCH, None] + near))
                        waiting += len(held[-1])
                        if waiting >= BATCH:  # under two batches
                            ids = np.concatenate(held)
                            own.step(ids[:BATCH, 0], ids[:BATCH, 1:], squares, rate)
                            held, waiting = [ids[BATCH:]], waiting - BATCH
                            windows += BATCH
            if waiting:
                ids = np.concatenate(held)
                own.step(ids[:, 0], ids[:, 1:], squares, rate * waiting / BATCH)
                windows += waiting
            if windows:
                values = own.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * windows), pa.array(np.full(len(values), float(windows)))], names=["i", "total", "windows"])

        gathered = classes.select("ids").mapInArrow(run, "i int, total double, windows double").groupBy("i").agg((F.sum("total") / F.sum("windows")).alias("value"))
        found = gathered.collect()  # one row per weight of the network
        if found:
            values = start.astype(np.float64)
            values[[r.i for r in found]] = [r.value for r in found]
            network = Network.from_flat(values)
    return network


def prepare(documents: DataFrame, words: list[str], counted: DataFrame) -> tuple[DataFrame, list[int]]:
    """(written (row, doc_id, n_tokens, ids, known, rest) of every row, tokens of each shared class).

    Texts are split once: `ids` has the classes, one byte a token, `known` the
    sum of the log shares that tasks hold, `rest` the other words and their times.
    """
    own = set(words)
    tokens_in = dict.fromkeys(range(ENDINGS), 1)  # one for all that the corpus does not have
    for r in counted.groupBy("ending").agg(F.sum("n").alias("n")).collect():  # at most ENDINGS rows
        tokens_in[r.ending] += r.n
    for r in counted.filter(F.col("word").isin(words)).collect():
        tokens_in[r.ending] -= r.n
    known = {r.word: math.log(r.n / tokens_in[r.ending]) for r in _well_known(counted, WORDS + KNOWN) if r.word not in own}
    left_type = pa.struct([("word", pa.string()), ("ending", pa.int32()), ("times", pa.int64())])
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = state.setdefault("reader", Reader(words, known))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            offsets, classes, sums, rows, left, times = reader.read(batch.column(1))
            structs = pa.StructArray.from_arrays([left, pa.array(endings(left)), pa.array(times, pa.int64())], fields=list(left_type))
            starts = np.searchsorted(rows, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(batch)), pa.int64()), batch.column(0), pa.array(np.diff(offsets), pa.int64()), _bytes_of(offsets, classes), pa.array(sums, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)], names=["row", "doc_id", "n_tokens", "ids", "known", "rest"])
            row += len(batch)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_tokens bigint, ids binary, known double, rest array<struct<word: string, ending: int, times: bigint>>"
    # Written once: a row's number holds only for one scan.
    return written(documents.select("doc_id", "text").mapInArrow(run, schema), "lm-rows"), [tokens_in[k] for k in range(ENDINGS)]


def score(documents: DataFrame, words: list[str], network: Network, counted: DataFrame | None = None, *, prepared: tuple[DataFrame, list[int]] | None = None) -> DataFrame:
    """(doc_id, per_token, log_probability, n_tokens) of every row; repeated rows stay repeated.

    `counted` has the corpus's words (`count_words`; give a written table), by default those of `documents`.
    """
    counted = written(count_words(documents), "lm-words") if counted is None else counted
    made, tokens_in = prepare(documents, words, counted) if prepared is None else prepared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            sums = np.array(batch.column(4).to_pylist(), np.float64)
            tokens, contexts, owners, held = [], [], [], 0

            def flush():
                found = network.log_probabilities(np.concatenate(tokens), np.concatenate(contexts), tables)
                np.add.at(sums, owners, np.add.reduceat(found, np.cumsum([0, *map(len, tokens[:-1])])))

            for k, said in enumerate(batch.column(3).to_pylist()):
                part = np.frombuffer(said, np.uint8)
                around = contexts_of(part)
                for first in range(0, len(part), SCORED_TOKENS):
                    tokens.append(part[first:first + SCORED_TOKENS])
                    contexts.append(around[first:first + SCORED_TOKENS])
                    owners.append(k)
                    held += len(tokens[-1])
                    if held >= SCORED_TOKENS:
                        flush()
                        tokens, contexts, owners, held = [], [], [], 0
            if tokens:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.float64())], names=["row", "doc_id", "n_tokens", "total"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = made.select("row", "doc_id", "n_tokens", "ids", "known").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, total double")
    rest = made.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.ending", "r.times")
    share = F.log(F.coalesce("n", F.lit(1)) / F.element_at(F.array(*(F.lit(float(n)) for n in tokens_in)), F.col("ending") + 1))
    of_row = rest.join(counted.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(share * F.col("times")).alias("share"))
    total = F.col("total") + F.coalesce("share", F.lit(0.0))
    return scored.join(of_row, "row", "left").select("doc_id", F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"), total.alias("log_probability"), "n_tokens")


def pseudo_likelihood(documents: DataFrame) -> DataFrame:
    """Count, split and look up once, train and score."""
    counted = written(count_words(documents), "lm-words")
    words = [r.word for r in _frequent(counted, WORDS)]
    prepared = prepare(documents, words, counted)
    return score(documents, words, train(documents, words, classes=prepared[0]), counted, prepared=prepared)
