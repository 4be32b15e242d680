"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (with word borders),
a window the mean of its words, and a softmax over two classes is linear in the
window's mean. A text is as toxic as its most toxic window, so a few words in a
long text are not averaged away; the same maximum is taken while vectors and
softmax are trained together in numpy. A misspelt word that was never seen
shares most n-grams with the word it came from.

The labelled rows for the fit are a bounded sample in the order of a hash of the
id (see `sample`); everything else covers all rows and whole texts.
Null texts count as empty; an empty text gets the score of the bias alone. With
labels of only one class, or none, the score is the smoothed base rate.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

SIZES = (3, 4, 5)
WINDOW, STRIDE = 24, 12
MEMO = 200_000
#: Digits and signs that stand for letters inside words.
LOOKALIKES = str.maketrans("01345@", "oieasa")
_LETTERS = re.compile(r"[\W\d_]+")


def normal(token: str) -> str:
    """Lower-case letters of a blank-separated token; digits between letters are read as letters."""
    word = token.lower()
    if not word.isalpha():
        word = _LETTERS.sub("", word.translate(LOOKALIKES)) if any(c.isalpha() for c in word) else ""
    return word


def ngrams(word: str) -> list[str]:
    """Character n-grams of a word with its borders, and the whole word."""
    if not word:
        return []
    framed = f"<{word}>"
    return [framed[i:i + n] for n in SIZES for i in range(len(framed) - n + 1)] + [framed]


@dataclass
class Model:
    grams: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    softmax: np.ndarray = field(default_factory=lambda: np.zeros((1, 2), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2, np.float32))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _prepare(self) -> None:
        # The softmax is linear in the mean, so each n-gram adds a number of its own to the log odds.
        odds = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        self._odds = dict(zip(self.grams, odds.tolist()))
        self._offset = float(self.bias[1] - self.bias[0])
        self._memo: dict[str, float] = {}

    def word_odds(self, token: str) -> float:
        found = ngrams(normal(token))
        value = sum(map(self._odds.get, found, [0.0] * len(found))) / len(found) if found else 0.0
        if len(self._memo) < MEMO and len(token) < 64:
            self._memo[token] = value
        return value

    def score(self, text: str | None) -> float:
        """Probability of class 1 of the most toxic window."""
        if not hasattr(self, "_odds"):
            self._prepare()
        memo, odds = self._memo, self.word_odds
        words = unrepeated((text or "").split())
        values = [memo[w] if w in memo else odds(w) for w in words]
        return float(1.0 / (1.0 + np.exp(-np.clip(window_means(np.array(values)).max(initial=0.0 if not words else -np.inf) + self._offset, -30, 30))))


def unrepeated(words: list[str]) -> list[str]:
    """A word said many times in a row counts once."""
    return [w for w, last in zip(words, chain([None], words)) if w != last]


def window_starts(size: int) -> np.ndarray:
    """Windows start every half window; the last one ends with the text."""
    if size <= WINDOW:
        return np.zeros(1 if size else 0, np.int64)
    return np.append(np.arange(0, size - WINDOW, STRIDE), size - WINDOW)


def window_means(values: np.ndarray) -> np.ndarray:
    starts = window_starts(len(values))
    if not len(starts):
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.minimum(starts + WINDOW, len(values))
    return (total[ends] - total[starts]) / (ends - starts)


def fit(texts: list[str | None], labels: list[int], *, size: int = 8, min_texts: int = 8, max_grams: int = 100_000, rounds: int = 60, rate: float = 0.1, decay: float = 1e-5, balance: float = 1.0, seed: int = 7) -> Model:
    """Train vectors and softmax jointly by full-batch Adam; n-grams in fewer than `min_texts` texts have no vector."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.0
        return Model(bias=np.array([0.0, np.log(max(base, 1e-9) / (1 - base))], np.float32))
    word_of: dict[str, int] = {}
    raw_of: dict[str, int] = {}
    rows = []
    for text in texts:
        ids = []
        for token in unrepeated((text or "").split()):
            k = raw_of.get(token)
            if k is None:
                k = raw_of[token] = word_of.setdefault(normal(token), len(word_of))
            ids.append(k)
        rows.append(np.array(ids, np.int32))
    words = list(word_of)
    del raw_of, word_of
    seen = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=len(words))
    texts_of: dict[str, int] = {}  # only n-grams that can reach min_texts through words of several texts
    for w, n in zip(words, seen.tolist()):
        if n > 1:  # most words of the texts are in one text only; what they share is in others, too
            for g in set(ngrams(w)):
                texts_of[g] = texts_of.get(g, 0) + n
    kept = sorted((g for g, n in texts_of.items() if n >= min_texts), key=lambda g: (-texts_of[g], g))[:max_grams]
    index = {g: i for i, g in enumerate(kept)}
    del texts_of
    # The n-grams of all words, laid end to end; compact, since the driver holds them.
    entries, known, share = array("i"), np.zeros(len(words), np.int32), np.zeros(len(words))
    for i, w in enumerate(words):
        found = ngrams(w)
        with_vector = [index[g] for g in found if g in index]
        entries.extend(with_vector)
        known[i], share[i] = len(with_vector), 1.0 / max(1, len(found))
    entry_gram = np.frombuffer(entries, np.int32) if len(entries) else np.zeros(0, np.int32)
    entry_word = np.repeat(np.arange(len(words), dtype=np.int32), known)
    # Windows of all texts, laid end to end.
    lengths = np.array([len(r) for r in rows])
    tokens = np.concatenate(rows)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    starts = [window_starts(n) + o for n, o in zip(lengths, offsets)]
    texts_with = np.array([i for i, s in enumerate(starts) if len(s)])
    counts = np.array([len(starts[i]) for i in texts_with])
    start = np.concatenate([starts[i] for i in texts_with])
    end = np.minimum(start + WINDOW, np.repeat(offsets[texts_with + 1], counts))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    target = y[texts_with]
    weight = np.where(target > 0, ((target == 0).sum() / max(1.0, (target > 0).sum())) ** balance, 1.0)
    weight /= weight.sum()

    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.1, (len(kept), size)), rng.normal(0, 0.5, (size, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, rounds + 1):
        vectors, softmax, bias = parameters
        direction = softmax[:, 1] - softmax[:, 0]
        word_value = share * _summed(entry_word, entry_gram, vectors @ direction, len(words))
        total = np.concatenate([[0.0], np.cumsum(word_value[tokens])])
        means = (total[end] - total[start]) / (end - start)
        best = np.maximum.reduceat(means, first)
        hits = np.flatnonzero(means >= np.repeat(best, counts))
        chosen = hits[np.searchsorted(hits, first)]
        slope = (1.0 / (1.0 + np.exp(-np.clip(means[chosen] + bias[1] - bias[0], -30, 30))) - target) * weight
        # Back from the chosen windows to their words, n-grams and vectors.
        width = end[chosen] - start[chosen]
        edge = np.zeros(len(tokens) + 1)
        np.add.at(edge, start[chosen], slope / width)
        np.add.at(edge, end[chosen], -slope / width)
        at_token = np.cumsum(edge[:-1])
        touched = np.flatnonzero(at_token)
        at_word = np.bincount(tokens[touched], at_token[touched], minlength=len(words))
        at_gram = _summed(entry_gram, entry_word, at_word * share, len(kept))
        toward = vectors.T @ at_gram
        gradients = [np.outer(at_gram, direction) + decay * vectors, np.stack([-toward, toward], 1) + decay * softmax, np.array([-slope.sum(), slope.sum()])]
        for k, (p, g) in enumerate(zip(parameters, gradients)):
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            parameters[k] = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return Model(index, *(p.astype(np.float32) for p in parameters))


def _summed(into: np.ndarray, source: np.ndarray, values: np.ndarray, size: int, block: int = 1 << 20) -> np.ndarray:
    """Sum of values[source] by `into`, a block of entries at a time: the driver holds no array of floats per entry."""
    out = np.zeros(size)
    for first in range(0, len(into), block):
        out += np.bincount(into[first:first + block], values[source[first:first + block]], minlength=size)
    return out


def held_out(id_column: str = "doc_id", folds: int = 5):
    """Rows kept from the fit: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", max_positive: int = 1_200, max_negative: int = 2_400,
           max_chars: int = 20_000_000) -> tuple[list[str | None], list[int]]:
    """Labelled texts for the fit, in the order of a hash of the id.

    The bound: `max_positive` and `max_negative` rows of the two classes, and
    `max_chars` code points in all. Held-out rows, null ids and null labels never
    enter. Of repeated labels of one id the largest counts, of repeated texts of
    one id the first in order.
    """
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
              .groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("label_of_row")).withColumn("place", F.xxhash64("doc_id")))
    of_class = [usable.filter(F.col("label_of_row") == k).orderBy("place", "doc_id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    # The broadcast side has at most max_positive + max_negative ids.
    chosen = written(of_class[0].unionByName(of_class[1]), "toxic-ids")
    found = written(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place", "label_of_row").agg(F.min("text").alias("text")), "toxic-sample")
    before = F.sum("size").over(Window.orderBy("place", "doc_id"))  # at most as many rows as chosen
    within = found.select("doc_id", "place", F.coalesce(F.length("text"), F.lit(0)).alias("size")).withColumn("chars", before).filter(F.col("chars") <= max_chars).select("doc_id")
    rows = sorted(found.join(within, "doc_id", "left_semi").select("doc_id", "text", "label_of_row").collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.label_of_row for r in rows]


def scorer(model: Model):
    """Column function: score of a text column."""
    shared: dict[str, Model] = {}

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        own = shared.setdefault("model", model)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return run


def score(documents: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows stay repeated."""
    scored = documents.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
