"""Classification, threshold and ranking metrics without driver-side data.

Quantiles and thresholds come from bracketed counts (`quantiles`), with no shuffle
by score. Ranking curves need every distinct score: there equal scores are
counted before the shuffle, so many equal scores are no burden.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import search_bounds, arrange
from tidemark.operators.quantiles import exact_quantiles, grouped_quantiles, quantiles_of  # noqa: F401 (exact_quantiles is part of this module's surface)
from tidemark.session import settle


def score_histogram(df: DataFrame, value: Column, *, by: Sequence[str] = (), flags: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values with row counts (`n`) and counts of flagged rows."""
    counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(c).alias(name) for name, c in (flags or {}).items()]
    return df.withColumn("value", value.cast("double")).where(F.col("value").isNotNull()).groupBy(*by, "value").agg(*counts)


# --- classification ----------------------------------------------------------

def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1(tp: Column, predicted: Column, actual: Column) -> Column:
    return _ratio(2.0 * tp, predicted + actual)


def label_counts(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per label: true, predicted and matching row counts."""
    pairs = df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))
    return (pairs.select(*by, F.explode(both).alias("c")).groupBy(*by, F.col("c.label").alias("label"))
            .agg(F.sum("c.a").alias("true_rows"), F.sum("c.p").alias("predicted_rows"), F.sum("c.tp").alias("hits")))


def classification_report(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; empty denominators give 0."""
    counts = label_counts(df, truth, predicted, by)
    hits, guessed, actual = F.col("hits"), F.col("predicted_rows"), F.col("true_rows")
    return counts.select(*by, "label", _ratio(hits, guessed).alias("precision"), _ratio(hits, actual).alias("recall"),
                         _f1(hits, guessed, actual).alias("f1"), actual.alias("support"))


def f1_score(df: DataFrame, truth: str, predicted: str, *, average: str = "macro", labels: Sequence[int] | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 over the labels (those seen, unless given), or F1 of label 1."""
    report = classification_report(df, truth, predicted, by)
    if average == "binary":
        return report.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("label") == 1, F.col("f1"))), F.lit(0.0)).alias("f1"))
    if labels is None:
        return report.groupBy(*by).agg(F.avg("f1").alias("f1"))
    listed = report.where(F.col("label").isin(list(labels)))
    return listed.groupBy(*by).agg((F.sum("f1") / len(labels)).alias("f1"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    """Row-normalised confusion matrix, one row per true label; empty rows are 0.

    Like the per-label shares it is computed over the listed labels only.
    """
    known = df.where(F.col(truth).isin(list(labels)) & F.col(predicted).isin(list(labels)))
    counts = known.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(predicted) == v).alias(f"c{v}") for v in labels])
    frame = df.sparkSession.createDataFrame([(v,) for v in labels], "label int")
    cells = [F.coalesce(F.col(f"c{v}") / F.col("n"), F.lit(0.0)).alias(f"pred_{v}") for v in labels]
    return frame.join(counts, "label", "left").select("label", *cells)


def predicted_label_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """True and predicted rows per label, zero-filled."""
    return label_counts(df, truth, predicted).select("label", "true_rows", "predicted_rows")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * count) of each class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total, classes = counts.agg(F.sum("rows")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.greatest(F.col("rows"), F.lit(1))))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negative over positive rows, for a binary 0/1 target."""
    positive = F.sum(F.col(label))
    return df.agg(((F.count(label) - positive) / F.greatest(positive, F.lit(1))).alias("positive_weight"))


# --- anomaly scores ----------------------------------------------------------

def threshold_metrics(scores: DataFrame, thresholds: Mapping[str, float], *, score: str, split: str = "split",
                      issue_labels: Sequence[int], levels: Mapping | None = None) -> DataFrame:
    """Metrics at named thresholds, per split: one pass for all thresholds.

    `levels`: known median and 95 % quantile of each split's scores, if asked before.
    """
    value, issue, label = F.col(score), F.col("is_issue"), F.col("qc_label")
    if levels is None:
        scores = settle(scores.select(split, score, "is_issue", "qc_label"))
        levels = grouped_quantiles(scores, score, LEVELS, by=split)
    fixed = [F.count(F.lit(1)).alias("rows"), F.count_if(issue).alias("issue_rows")]
    fixed += [F.count_if(label == v).alias(f"label_{v}_rows") for v in issue_labels]
    for i, limit in enumerate(thresholds.values()):
        over = value >= F.lit(float(limit))
        fixed += [F.count_if(over).alias(f"p{i}"), F.count_if(over & issue).alias(f"h{i}")]
        fixed += [F.count_if(over & (label == v)).alias(f"h{i}_{v}") for v in issue_labels]
    counts = scores.groupBy(split).agg(*fixed)
    each = []
    for i, (name, limit) in enumerate(thresholds.items()):
        guessed, hits, actual = F.col(f"p{i}"), F.col(f"h{i}"), F.col("issue_rows")
        each.append(F.struct(
            F.lit(name).alias("threshold_source"), F.lit(float(limit)).alias("threshold"), guessed.alias("predicted_anomaly_rows"),
            _ratio(hits, guessed).alias("precision"), _ratio(hits, actual).alias("recall"), _f1(hits, guessed, actual).alias("f1"),
            *[_ratio(F.col(f"h{i}_{v}"), F.col(f"label_{v}_rows")).alias(f"label_{v}_recall") for v in issue_labels]))
    exploded = counts.select(split, "rows", "issue_rows", *[f"label_{v}_rows" for v in issue_labels], F.explode(F.array(*each)).alias("m"))
    # Splits without a score are left out, as they have no level.
    known = {k: xs for k, xs in levels.items() if xs[0] is not None and k is not None}

    def level(i: int) -> Column:
        found = F.lit(None).cast("double")
        for k, xs in known.items():
            found = F.when(F.col(split) == F.lit(k), F.lit(xs[i])).otherwise(found)
        return found

    return exploded.where(F.col(split).isin(list(known))).select(
        split, "rows", "issue_rows", *[f"label_{v}_rows" for v in issue_labels], "m.*", level(0).alias("median_abs_error_scaled"), level(1).alias("p95_abs_error_scaled"))


# Quantiles of the threshold sweep and of the error level.
GOOD_QUANTILES = (0.90, 0.95, 0.97, 0.98, 0.99, 0.995)
LEVELS = (0.5, 0.95)
SEARCH_STEPS, SEARCH_LOW, SEARCH_HIGH = 250, 0.50, 0.999


def search_fractions() -> list[float]:
    step = (SEARCH_HIGH - SEARCH_LOW) / (SEARCH_STEPS - 1)
    return [SEARCH_LOW + step * i for i in range(SEARCH_STEPS - 1)] + [SEARCH_HIGH]


def good_thresholds(valid: DataFrame, score: str, quantiles: Sequence[float] = GOOD_QUANTILES) -> dict[str, float]:
    """Score quantiles of good validation rows (of all rows if none is good); empty without rows."""
    found = quantiles_of(valid, {"good": (F.when(F.col("is_good"), F.col(score)), quantiles), "all": (F.col(score), quantiles)})
    return _named(quantiles, found["good"], found["all"])


def _named(quantiles: Sequence[float], good: Sequence[float | None], every: Sequence[float | None]) -> dict[str, float]:
    base = good if good and good[0] is not None else every
    return {f"good_q{q:g}": x for q, x in zip(quantiles, base) if x is not None}


def best_f1_threshold(valid: DataFrame, score: str, *, limits: Sequence[float] | None = None) -> tuple[float, float] | None:
    """Threshold with the best validation F1 among 250 quantiles; first wins ties, None without rows.

    Every row is counted once, in the bucket of the highest candidate it reaches.
    """
    if limits is None:
        limits = quantiles_of(valid, {"all": (F.col(score), search_fractions())})["all"]
    limits = sorted({x for x in limits if x is not None})
    if not limits:
        return None
    rows = (valid.where(F.col(score).isNotNull()).groupBy(search_bounds(limits, "double", F.col(score).cast("double")).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_issue").alias("h")).collect())  # one row a candidate
    actual = sum(r["h"] for r in rows)
    best, best_f1 = limits[0], -1.0
    for i, limit in enumerate(limits):
        guessed = sum(r["n"] for r in rows if r["b"] > i)
        hits = sum(r["h"] for r in rows if r["b"] > i)
        f1 = 2.0 * hits / (guessed + actual) if guessed + actual else 0.0
        if f1 > best_f1:
            best, best_f1 = limit, f1
    return best, best_f1


def threshold_sweep(scores: DataFrame, *, score: str, split: str = "split", issue_labels: Sequence[int],
                    validation: str = "validation") -> DataFrame:
    """Good-row quantile thresholds and the F1-optimised one, on every split.

    All quantiles, those of each split and those of the validation rows, are
    asked together, so they share each pass over the settled scores.
    """
    scores = settle(scores.select(split, score, "is_good", "is_issue", "qc_label"))
    valid, splits = F.col(split) == validation, [r[0] for r in scores.select(split).distinct().collect()]
    asked = {"good": (F.when(valid & F.col("is_good"), F.col(score)), GOOD_QUANTILES), "all": (F.when(valid, F.col(score)), [*GOOD_QUANTILES, *search_fractions()])}
    asked |= {f"split {i}": (F.when(F.col(split) == F.lit(k), F.col(score)), LEVELS) for i, k in enumerate(splits) if k is not None}
    found = quantiles_of(scores, asked)
    limits = _named(GOOD_QUANTILES, found["good"], found["all"])
    best = best_f1_threshold(scores.where(valid), score, limits=found["all"][len(GOOD_QUANTILES):])
    if best:
        limits["validation_f1_optimized"] = best[0]
    levels = {k: found[f"split {i}"] for i, k in enumerate(splits) if k is not None}
    return threshold_metrics(scores, limits, score=score, split=split, issue_labels=issue_labels, levels=levels)


def ranking_metrics(scores: DataFrame, *, score: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """Average precision and ROC AUC with ties handled; null with one class only."""
    by = list(by)
    histogram = score_histogram(scores, -F.col(score), by=by, flags={"pos": F.col("is_issue")})
    seq = arrange(histogram, by=by, order=["value"]).accumulate(
        __seen=("sum", F.col("n")), __hits=("sum", F.col("pos")), rows=("total", F.col("n")), issue_rows=("total", F.col("pos")))
    curve = seq.rows()
    negatives = F.col("rows") - F.col("issue_rows")
    false_now, false_before = F.col("n") - F.col("pos"), F.col("__seen") - F.col("__hits") - (F.col("n") - F.col("pos"))
    # Area per distinct score: positives ranked above, ties count half.
    below = F.col("pos") * (negatives - false_before - false_now * F.lit(0.5))
    precision_gain = (F.col("pos") / F.col("issue_rows")) * (F.col("__hits") / F.col("__seen"))
    summed = curve.groupBy(*by).agg(F.max("rows").alias("rows"), F.max("issue_rows").alias("issue_rows"),
                                    F.sum(F.when(F.col("issue_rows") > 0, precision_gain)).alias("ap"), F.sum(below).alias("area"))
    both = (F.col("issue_rows") > 0) & (F.col("issue_rows") < F.col("rows"))
    area = F.col("area") / (F.col("issue_rows") * (F.col("rows") - F.col("issue_rows")))
    return summed.select(*by, "rows", "issue_rows", F.when(both, F.col("ap")).alias("average_precision"), F.when(both, area).alias("roc_auc"))


def score_summary(scores: DataFrame, *, score: str, split: str = "split", quantile: float = 0.99) -> DataFrame:
    """Per split: counts, error level and F1 at the good-validation quantile."""
    scores = settle(scores.select(split, score, "is_good", "is_issue", "qc_label"))
    limits = good_thresholds(scores.where(F.col(split) == "validation"), score, [quantile])
    metrics = threshold_metrics(scores, limits, score=score, split=split, issue_labels=[], levels=grouped_quantiles(scores, score, LEVELS, by=split))
    return metrics.select(split, "rows", "issue_rows", "predicted_anomaly_rows", "median_abs_error_scaled", "p95_abs_error_scaled",
                          F.col("f1").alias("forecast_anomaly_f1"), F.col("threshold").alias("forecast_error_threshold"))


def error_histogram(scores: DataFrame, *, score: str, split: str = "split", threshold: float, bins: int = 44) -> DataFrame:
    """Good and issue rows per error bin from 0 to max(p99.5, threshold); bin `bins` holds what lies above."""
    scores = settle(scores.select(split, score, "is_good", "is_issue"))
    tops = {k: max(xs[0], threshold, 1e-6) for k, xs in grouped_quantiles(scores, score, [0.995], by=split).items() if xs[0] is not None}
    top = F.lit(None).cast("double")
    for name, value in tops.items():
        top = F.when(F.col(split) == name, F.lit(value)).otherwise(top)
    width = top / bins
    bin_index = F.when(F.col(score) > top, bins).otherwise(F.least(F.floor(F.col(score) / width), F.lit(bins - 1)))
    return (scores.where(F.col(score) >= 0).groupBy(split, bin_index.alias("bin"))
            .agg(F.count_if("is_good").alias("good_rows"), F.count_if("is_issue").alias("issue_rows")))
