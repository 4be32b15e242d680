"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text becomes a vector of statistics (shares of letters, capitals, symbols,
repeated lines, words and word triples, lengths, entropy). Trees grow level by
level on binned statistics: the gradients of a level are summed by (node, bin),
and a split is read off the running sums. All trees end up in flat arrays (one
row a node), which numpy walks for all rows at once.

Statistics are computed in the tasks, of whole texts, for training and scoring
alike; the driver gets the vectors of the bounded training sample only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map, written

STATISTICS = ["log_chars", "log_words", "word_length", "word_length_spread", "letters", "capitals", "capital_words", "digits", "symbols", "marks", "exclamations", "stops",
              "spaces", "beyond_ascii", "short_words", "distinct_words", "top_word", "following_word", "repeated_triples", "line_words", "repeated_lines", "ended_lines",
              "symbol_words", "entropy"]
_SYMBOLS, _MARKS = b"#*$%&|<>", b",;:()\"'-"


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = max(1, len(words))
    ascii_letters, capitals = int(seen[97:123].sum() + seen[65:91].sum()), int(seen[65:91].sum())
    beyond = int(seen[192:].sum())  # first bytes of code points above U+007F
    letters = max(1, ascii_letters + beyond)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    times = Counter(words)
    pairs, triples = zip(words, words[1:]), Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    share = seen[seen > 0] / size
    return [
        np.log1p(len(text)), np.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0, float(lengths.std()) if len(words) else 0.0,
        (ascii_letters + beyond) / size, capitals / letters, sum(w[0].isupper() for w in words) / n, int(seen[48:58].sum()) / size,
        sum(int(seen[b]) for b in _SYMBOLS) / size, sum(int(seen[b]) for b in _MARKS) / size, int(seen[33]) / size, int(seen[46]) / n,
        int(seen[32]) / size, beyond / len(text), float((lengths <= 3).mean()) if len(words) else 0.0,
        len(times) / n, max(times.values(), default=0) / n, sum(a == b for a, b in pairs) / n,
        (len(words) - 2 - len(triples)) / n if len(words) > 2 else 0.0,
        len(words) / max(1, len(lines)), 1.0 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        len(_SYMBOL_WORD.findall(text)) / n, float(-(share * np.log2(share)).sum()),
    ]


_SYMBOL_WORD = re.compile(r"[#*$%&|<>](?=\s|$)")


@dataclass
class Trees:
    """Complete trees of one depth laid end to end: node k of a tree has the children 2k + 1 and 2k + 2."""

    depth: int = 0
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - (2 ** self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least_rows: int = 10) -> Trees:
    """Boosted trees on the logistic loss; without rows or with one label only the base rate alone."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        rate_of_ones = (y.sum() + 1.0) / (len(y) + 2.0)
        return Trees(base=float(np.log(rate_of_ones / (1 - rate_of_ones))))
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: at most edges[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(rows, base), 2 ** depth - 1
    found = Trees(depth, base, np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, 2 ** depth)))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            gain, choice, cut = np.full(count, 1e-9), np.zeros(count, np.int32), np.full(count, -1)
            for f in range(width):
                if not len(edges[f]):
                    continue
                key = (node - first) * bins + binned[:, f]
                g, h, c = (np.bincount(key, w, minlength=count * bins).reshape(count, bins).cumsum(axis=1) for w in (gradient, curve, None))
                left = g ** 2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                left[(c < least_rows) | (c[:, -1:] - c < least_rows)] = -1
                left[:, len(edges[f]):] = -1
                at = left.argmax(axis=1)
                top = left[np.arange(count), at]
                better = top > gain
                gain[better], choice[better], cut[better] = top[better], f, at[better]
            for k in np.flatnonzero(cut >= 0):
                found.feature[t, first + k], found.threshold[t, first + k] = choice[k], edges[choice[k]][cut[k]]
            here = node - first
            right = (cut[here] >= 0) & (binned[np.arange(rows), choice[here]] > cut[here])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, w, minlength=2 ** depth) for w in (gradient, curve))
        found.value[t] = -rate * g / (h + ridge)
        margin += found.value[t][leaf]
    return found


def held_out(id_column: str = "doc_id", folds: int = 5):
    """Rows kept from the fit: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, labels) for the fit: at most `max_rows` rows of each label, in the order of a hash of the id.

    Held-out rows, null ids and null labels never enter. Of repeated labels of
    one id the largest counts, of repeated texts of one id the least vector.
    """
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
              .groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("wanted")).withColumn("place", F.xxhash64("doc_id")))
    of_label = [usable.filter(F.col("wanted") == k).orderBy("place", "doc_id").limit(max_rows).select("doc_id", "wanted") for k in (0, 1)]
    # The broadcast side has at most 2 * max_rows ids.
    chosen = documents.select("doc_id", "text").join(F.broadcast(written(of_label[0].unionByName(of_label[1]), "quality-ids")), "doc_id")
    vectors = row_map(chosen.select("wanted", "doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "wanted": c["wanted"], "x": [statistics(t) for t in c["text"]]},
                      f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, wanted int, x array<double>")
    rows = sorted(vectors.groupBy("doc_id").agg(F.min(F.struct("x", "wanted")).alias("v")).collect(), key=lambda r: r.doc_id)
    return np.array([r.v.x for r in rows]).reshape(-1, len(STATISTICS)), np.array([r.v.wanted for r in rows])


def score(documents: DataFrame, trees: Trees, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, whole texts.

    Null and empty texts have statistics of zero and get the trees' score for
    them; repeated rows stay repeated; an empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(columns: dict[str, list]) -> dict[str, list]:
        texts = columns["text"]
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": trees.score(x).tolist()}

    scored = row_map(documents.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
