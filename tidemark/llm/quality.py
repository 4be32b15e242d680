"""Quality rules: base counts and robust multivariate outliers.

Each text gives counts, the counts a vector of transformed statistics. Per
language and source a minimum-covariance-determinant estimate describes the bulk
of the vectors: from coordinatewise medians, concentration steps refit mean and
covariance on the half of a group's texts with the smallest distances until the
half settles. Texts far away by Mahalanobis distance are rejected.

The steps are Spark aggregates over the small table of vectors, summed per group
before they move, so a source with a third of all rows is no single task; the
half's border comes from a histogram of distances with bins of one per cent.
A group's estimate is drawn toward that of its language, a language's toward that
of all texts, the more so the fewer texts it has: n texts weigh n^2 / (n^2 + k^2), k
ten times the statistics. There is no size at which verdicts jump.

Null texts have no words. A null language or source is a group of its own.
Texts that fail the base rules take no part in the estimate and are never kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map, written

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
FEATURES = ("word_length", "symbols", "repeated_lines", "repeated_words", "upper", "digits", "marks")
#: Spread below which a statistic's own scatter is not believed: many are zero in nearly all good texts.
FLOORS = np.array([0.05, 0.06, 0.12, 0.10, 0.04, 0.05, 0.08])
#: Steps, share of the half, texts at which a group's own estimate weighs as much as its language's, and the squared distance beyond which a text goes.
STEPS, HALF, PRIOR = 4, 0.5, 10 * len(FEATURES)
LIMIT = 90.0
_NOT_UPPER = re.compile(r"[^A-ZÀ-ÖØ-ÞΑ-ΡΣ-ΫА-Я]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_DIGIT_LESS = re.compile(r"[^0-9]+")


def count(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII blanks
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeats = 0
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) < len(triples):
        seen: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, t in enumerate(triples):
            first = seen.setdefault(t, i)
            if first != i:
                covered[first:first + 3] = covered[i:i + 3] = b"\1\1\1"
        repeats = covered.count(1)
    upper = len(_NOT_UPPER.sub("", text))
    letters = len(_NOT_LETTER.sub("", text))
    digits = len(_DIGIT_LESS.sub("", text))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), upper, letters, digits, max(0, chars - letters - digits - symbols))


def counts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) of every row."""

    def run(columns):
        made = np.array([count(t) for t in columns["text"]], np.int64).reshape(-1, len(COUNTS))
        return {k: columns[k] for k in ("doc_id", "lang", "source")} | dict(zip(COUNTS, map(list, made.T.tolist())))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return row_map(documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), run,
                   f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def counts_column() -> Callable[..., Column]:
    """Column function: struct of the counts of a text column."""

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([count(t) for t in texts], np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))

    return run


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def vector(of: Callable[[str], Column] = F.col) -> Column:
    """The transformed statistics: logarithm of the word length, roots of shares."""
    share = lambda a, b: F.sqrt(of(a) / F.greatest(of(b), F.lit(1)))
    return F.array(F.log((of("word_chars") + 1) / (of("n_words") + 1)), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
                   share("n_upper", "n_letters"), share("n_digits", "word_chars"), share("n_marks", "n_words"))


def squared_distance(x: Column, center: Column, precision: Column) -> Column:
    """Mahalanobis distance; `precision` lists the inverse covariance row by row."""
    d = len(FEATURES)
    off = [x[i] - center[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        inner = F.lit(0.0)
        for j in range(i + 1, d):
            inner = inner + precision[i * d + j] * off[j]
        total = total + off[i] * (precision[i * d + i] * off[i] + 2 * inner)
    return F.greatest(total, F.lit(0.0))


LEVELS = (("lang", "source"), ("lang",), ())


def _level(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each text's group at one level, as one string; null parts have a mark of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("~")) for k in keys]
    return vectors.select(F.concat_ws("\x1f", F.lit(str(len(keys))), *parts).alias("group"), "x")


def fit(measured: DataFrame, *, steps: int = STEPS) -> DataFrame:
    """Estimates (group, n, center, precision) for all levels, from rows of counts.

    `measured` is read once a step; give a written table.
    """
    vectors = measured.filter(~base_failed()).select("lang", "source", vector().alias("x"))
    rows = _level(vectors, LEVELS[0])
    for keys in LEVELS[1:]:
        rows = rows.unionByName(_level(vectors, keys))
    d = len(FEATURES)
    # Start: median and median absolute deviation by coordinate.
    middle = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile_approx(F.col("x")[i], 0.5, 1000).alias(f"m{i}") for i in range(d)))
    middle = written(middle, "quality-medians")
    spread = _with_groups(rows, middle).groupBy("group").agg(F.first("n").alias("n"), F.first(F.array(*(f"m{i}" for i in range(d)))).alias("center"),
                                                             F.array(*(F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), 0.5, 1000) for i in range(d))).alias("mad"))
    scale = [F.greatest(F.col("mad")[i] * 1.4826, F.lit(float(FLOORS[i]))) for i in range(d)]
    zero = F.lit(0.0)
    estimate = written(spread.select("group", "n", "center", F.array(*((1 / (scale[i] * scale[i]) if i == j else zero) for i in range(d) for j in range(d))).alias("precision")), "quality-start")
    for step in range(steps):
        placed = _with_groups(rows, estimate).select("group", "n", "x", squared_distance(F.col("x"), F.col("center"), F.col("precision")).alias("far"))
        placed = placed.withColumn("bin", F.floor(F.log(F.col("far") + 1e-6) * 100).cast("int"))
        sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
        # Moments by bin of the distance: all that a step needs, and few rows however large the group.
        binned = placed.groupBy("group", "bin").agg(F.first("n").alias("n"), F.count("*").alias("rows_here"), *sums)
        listed = binned.groupBy("group").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "rows_here", F.array(*(f"s{i}" for i in range(d))).alias("s"), F.array(*(f"q{i}_{j}" for i in range(d) for j in range(i, d))).alias("q")))).alias("bins"))
        estimate = written(_refit(listed), "quality-step")
    return estimate


def _refit(listed: DataFrame) -> DataFrame:
    """Mean and inverse covariance of the half of each group nearest to the last estimate."""
    d = len(FEATURES)

    def run(columns):
        out = {"group": columns["group"], "n": columns["n"], "center": [], "precision": []}
        for n, bins in zip(columns["n"], columns["bins"]):
            want, got = max(math.ceil(n * HALF), min(n, d + 2)), 0
            s, q = np.zeros(d), np.zeros(d * (d + 1) // 2)
            for b in bins:
                got += b["rows_here"]
                s += b["s"]
                q += b["q"]
                if got >= want:
                    break
            mean = s / got
            moment = np.zeros((d, d))
            moment[np.triu_indices(d)] = q / got
            cov = moment + np.triu(moment, 1).T - np.outer(mean, mean)
            # The nearest half of a normal sample looks narrower than the sample; then the floors.
            cov = cov * consistency(got / n, d) + np.diag(FLOORS ** 2)
            out["center"].append(mean.tolist())
            out["precision"].append(np.linalg.inv(cov).ravel().tolist())
        return out

    return row_map(listed, run, "group string, n bigint, center array<double>, precision array<double>")


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 0.0
    term = total = 1.0 / a
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
        if term < 1e-14 * total:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p and high < 1e4:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float, k: int) -> float:
    """Factor that makes the covariance of the nearest share of a normal sample that of the sample."""
    if share >= 0.999:
        return 1.0
    return share / max(chi2_cdf(chi2_quantile(share, k), k + 2), 1e-9)


#: Groups up to which their estimates are broadcast: each has d + d * d numbers, so this is under 10 MB.
BROADCAST_GROUPS = 20_000


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's columns; few groups are broadcast, many are joined by key (Spark splits skewed ones)."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "group")


def blend(own: tuple[float, np.ndarray, np.ndarray] | None, wider: tuple[np.ndarray, np.ndarray] | None, prior: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(center, covariance) of a group of n texts, drawn toward a wider group's.

    The weight grows with the square of n: in a handful of texts, of which half
    can't be left out, one outlier moves the estimate and would excuse itself.
    """
    if own is None or wider is None:
        return own[1:] if own else wider
    n, center, cov = own
    weight = n * n / (n * n + prior * prior)
    return wider[0] + weight * (center - wider[0]), weight * cov + (1 - weight) * wider[1]


def resolve(estimates: DataFrame, groups: DataFrame, *, prior: float = PRIOR) -> DataFrame:
    """(lang, source, center, precision) for each pair of `groups`: its own estimate drawn toward its language's, that one toward that of all."""
    named = groups.select("lang", "source").distinct()
    for k, keys in enumerate(LEVELS):
        # The empty string of the first part keeps the key of all texts a column: a constant would make the join a nested loop.
        key = F.concat_ws("\x1f", F.concat(F.lit(str(len(keys))), F.coalesce(F.left("lang", F.lit(0)), F.lit(""))), *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in keys])
        named = named.withColumn("group", key).join(estimates.select("group", F.struct("n", "center", "precision").alias(f"of{k}")), "group", "left").drop("group")

    def run(columns):
        d = len(FEATURES)
        out = {"lang": columns["lang"], "source": columns["source"], "center": [], "precision": []}
        for levels in zip(*(columns[f"of{k}"] for k in range(len(LEVELS)))):
            found = None
            for own in reversed(levels):
                at = (own["n"], np.array(own["center"]), np.linalg.inv(np.array(own["precision"]).reshape(d, d))) if own else None
                found = blend(at, found, prior)
            out["center"].append(found[0].tolist() if found else None)
            out["precision"].append(np.linalg.inv(found[1]).ravel().tolist() if found else None)
        return out

    return row_map(named, run, "lang string, source string, center array<double>, precision array<double>")


def verdict(measured: DataFrame, resolved: DataFrame, *, of: Callable[[str], Column] = F.col, limit: float = LIMIT) -> DataFrame:
    """Add base_failed, distance and kept to rows of counts (`of` names the columns of counts); without any estimate the base rules decide."""
    keyed = resolved.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("center").alias("__center"), F.col("precision").alias("__precision"))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_GROUPS else keyed
    joined = measured.join(keyed, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = base_failed(of)
    far = F.when(~failed, F.sqrt(squared_distance(vector(of), F.col("__center"), F.col("__precision"))))
    judged = joined.withColumns({"base_failed": failed, "distance": far})
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))).drop("__lang", "__source", "__center", "__precision")


def keep(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; their counts are taken twice, so that no text moves."""
    measured = written(counts(documents), "quality-counts")
    resolved = resolve(fit(measured), measured)
    bare = documents.select("lang", "source", F.struct("*").alias("__row")).withColumn("__counts", counts_column()("__row.text"))
    return verdict(bare, resolved, of=lambda c: F.col(f"__counts.{c}")).filter("kept").select("__row.*")


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every row; repeated rows stay repeated."""
    measured = written(counts(documents), "quality-counts")
    return verdict(measured, resolve(fit(measured), measured))
