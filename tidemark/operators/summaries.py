"""Report tables: label accounting, split balance, time bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import is_issue, is_reviewed, label_id
from tidemark.operators.cleaning import attach_small, union_all
from tidemark.operators.ordering import _constant, search_bounds, arrange, with_position
from tidemark.operators.splits import SPLITS, contiguous_cut, slot_schedule, slot_split, source_ranks
from tidemark.profiles import Profile
from tidemark.session import settle


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0)), digits)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, unlabelled rows left out."""
    value = label_id(F.col(f"`{label}`"))
    return df.where(value.isNotNull()).groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def compare_distributions(full: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """Label counts of a dataset next to those of a loaded sample, zero-filled."""
    a = label_distribution(full, label).withColumnRenamed("rows", "full_cache")
    b = label_distribution(sample, label).withColumnRenamed("rows", "loaded_sample")
    joined = a.join(b, "label", "full")
    return joined.select("label", F.coalesce("full_cache", F.lit(0)).alias("full_cache"), F.coalesce("loaded_sample", F.lit(0)).alias("loaded_sample"))


def split_distribution(splits: DataFrame, label: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of each label, one pair of columns per split.

    Shares are taken on the label table, which has one row per label.
    """
    value = label_id(F.col(f"`{label}`"))
    counts = (splits.where(value.isNotNull()).groupBy(*by, value.alias("label"))
              .agg(*[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in SPLITS]))
    over = Window.partitionBy(*(by or [F.lit(0)]))
    shares = []
    for s in SPLITS:
        total = F.sum(f"{s}_rows").over(over)
        shares.append(F.when(total > 0, F.col(f"{s}_rows") / total).otherwise(F.lit(0.0)).alias(f"{s}_share"))
    return counts.select(*by, "label", *[f"{s}_rows" for s in SPLITS], *shares)


def issue_composition(splits: DataFrame, label: str, issue: Sequence[int], *, by: Sequence[str] = ()) -> DataFrame:
    """Label shares among the issue rows of each split."""
    return split_distribution(splits.where(is_issue(F.col(f"`{label}`"), issue)), label, by=by)


def contiguous_label_counts(df: DataFrame, label: str, *, order: Sequence[str], train: float, validation: float, by: Sequence[str] = ()) -> DataFrame:
    """Label counts of an early, middle and late split, from the label and order columns alone."""
    narrow = df.select(*[f"`{c}`" for c in dict.fromkeys([*by, *order, label])])
    placed = with_position(narrow, by=by, order=order, name="__pos", total="__n")
    return split_distribution(placed.withColumn("split", contiguous_cut(F.col("__pos"), F.col("__n"), train, validation)), label)


def share_gap(distribution: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Largest and mean total variation between the splits' label shares."""
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1:]]
    gaps = distribution.groupBy(*by).agg(
        *[(F.sum(F.abs(F.col(f"{a}_share") - F.col(f"{b}_share"))) / 2).alias(f"g{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.col(f"g{i}") for i in range(len(pairs))]
    mean = reduce(lambda x, y: x + y, each) / len(each)
    return gaps.select(*by, F.greatest(*each).alias("max_pairwise_total_variation"), mean.alias("mean_pairwise_total_variation"))


def issue_adequacy(splits: DataFrame, label: str, issue: Sequence[int], *, min_issue_rows: int, min_issue_share_pct: float,
                   min_rows_per_issue_label: int, by: Sequence[str] = ()) -> DataFrame:
    """Does each split hold enough issue rows to judge a model?"""
    value = label_id(F.col(f"`{label}`"))
    counts = splits.where(value.isNotNull()).groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(value.isin(list(issue))).alias("issue_rows"),
        *[F.count_if(value == v).alias(f"flag_{v}_count") for v in issue])
    counts = counts.withColumn("issue_share_pct", _percent(F.col("issue_rows"), F.col("rows")))
    rows_ok = F.col("issue_rows") >= min_issue_rows
    share_ok = F.col("issue_share_pct") >= min_issue_share_pct
    labels_ok = reduce(lambda a, b: a & b, [F.col(f"flag_{v}_count") >= min_rows_per_issue_label for v in issue], F.lit(True))
    return counts.select(*by, "split", "rows", "issue_rows", "issue_share_pct", rows_ok.alias("meets_issue_row_floor"),
                         share_ok.alias("meets_issue_share_floor"), labels_ok.alias("meets_per_issue_label_floor"),
                         (rows_ok & share_ok & labels_ok).alias("adequate_for_model_selection"),
                         *[f"flag_{v}_count" for v in issue])


def strategy_detail(adequacy: DataFrame) -> DataFrame:
    """One row per strategy with each split's rows, issue rows, share and yes/no verdict."""
    columns = []
    for s in SPLITS:
        here = F.col("split") == s
        columns += [F.max(F.when(here, F.col(c))).alias(f"{s}_{c}") for c in ("rows", "issue_rows", "issue_share_pct")]
        columns.append(F.max(F.when(here, F.when(F.col("adequate_for_model_selection"), "yes").otherwise("no"))).alias(f"{s}_ok"))
    return adequacy.groupBy("strategy").agg(*columns)


def compare_strategies(splits: DataFrame, label: str, issue: Sequence[int], **floors) -> DataFrame:
    """Gap, row counts and validation adequacy for each strategy in one frame."""
    by = ["strategy"]
    gap = share_gap(split_distribution(splits, label, by=by), by=by)
    detail = strategy_detail(issue_adequacy(splits, label, issue, by=by, **floors))
    return gap.join(detail, "strategy").select(
        "strategy", F.col("max_pairwise_total_variation").alias("max_split_gap"), F.col("mean_pairwise_total_variation").alias("mean_split_gap"),
        "train_rows", "validation_rows", "test_rows", "validation_issue_rows", "validation_issue_share_pct", "validation_ok")


def split_overview(splits: DataFrame, profile: Profile, *, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, issue rows, issue share and time span per split."""
    issue = is_issue(F.col(f"`{profile.target}`"), profile.issue)
    rows, bad = F.count(F.lit(1)), F.count_if(issue)
    return splits.groupBy(*by).agg(rows.alias("rows"), bad.alias("issue_rows"), _percent(bad, rows).alias("issue_share_pct"),
                                   F.min(profile.time).alias("time_start"), F.max(profile.time).alias("time_end"))


def time_span(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("time_start"), F.max(time).alias("time_end"))


def subset_overview(subsets: DataFrame, profile: Profile, *, label: str = "model_target", balanced_share: float,
                    available_issue_rows: int) -> DataFrame:
    """Rows, issue share, wanted share and best possible share per training subset."""
    rows, issue = F.count(F.lit(1)), F.count_if(is_issue(F.col(label), profile.issue))
    wanted = F.when(F.col("subset") == "balanced_reviewed", F.lit(round(100 * balanced_share, 2)))
    table = subsets.groupBy("subset").agg(rows.alias("rows"), issue.alias("issue_rows"), F.min(profile.time).alias("time_start"),
                                          F.max(profile.time).alias("time_end"))
    return table.select("subset", "rows", "issue_rows", _percent(F.col("issue_rows"), F.col("rows")).alias("issue_share_pct"),
                        wanted.alias("target_issue_share_pct"),
                        _percent(F.least(F.lit(available_issue_rows), F.col("rows")), F.col("rows")).alias("max_possible_issue_share_pct"),
                        "time_start", "time_end")


def row_funnel(df: DataFrame, modelled: DataFrame, profile: Profile) -> DataFrame:
    """Selected, reviewed and modelled rows, with the issue share of each step."""
    label = F.col(f"`{profile.target}`")
    issue = is_issue(label, profile.issue)
    step = lambda name, frame: frame.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("rows"), F.count_if(issue).alias("issue_rows"))
    reviewed = df.where(is_reviewed(label, profile.good, profile.issue))
    steps = union_all([step("selected cache rows", df), step("usable reviewed rows", reviewed), step("reviewed modelling rows", modelled)])
    selected = F.max("rows").over(Window.partitionBy(F.lit(0)))
    return steps.select("step", "rows", F.round(100.0 * F.col("rows") / F.greatest(selected, F.lit(1)), 2).alias("share_of_selected_pct"),
                        "issue_rows", F.round(100.0 * F.col("issue_rows") / F.greatest(F.col("rows"), F.lit(1)), 3).alias("issue_share_pct"))


def funnel_labels(df: DataFrame, modelled: DataFrame, profile: Profile) -> DataFrame:
    """Label counts and shares at the three steps of the funnel."""
    value = label_id(F.col(f"`{profile.target}`"))
    reviewed = df.where(is_reviewed(value, profile.good, profile.issue))
    names = ("selected_cache_rows", "usable_reviewed_rows", "reviewed_model_rows")
    tagged = union_all([frame.where(value.isNotNull()).groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias(name))
                        for name, frame in zip(names, (df, reviewed, modelled), strict=True)])
    counts = tagged.groupBy("label").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    over = Window.partitionBy(F.lit(0))
    return counts.select("label", *names, *[(F.col(n) / F.sum(n).over(over)).alias(f"{n}_share") for n in names])


# --- time bins ---------------------------------------------------------------

def time_bin_edges(df: DataFrame, time: str, label: str, bins: int) -> list[int]:
    """Equal-width bin edges in whole microseconds, ends included, repeats dropped."""
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    found = df.where(F.col(f"`{time}`").isNotNull() & F.col(f"`{label}`").isNotNull()).agg(F.min(micros), F.max(micros), F.count(F.lit(1))).first()
    low, high, rows = found
    if not rows:
        return []
    bins = min(max(bins, 1), rows)
    edges = sorted({low + i * (high - low) // bins for i in range(bins + 1)})
    return edges if len(edges) > 1 else [low, low + 1]


def with_time_bin(df: DataFrame, time: str, edges: Sequence[int]) -> DataFrame:
    """Right-closed bin number; the first bin also holds its left edge."""
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    inner = list(edges[1:-1])
    index = search_bounds(inner, "bigint", micros - 1)
    return df.withColumn("bin_index", index)


def time_bin_counts(df: DataFrame, profile: Profile, bins: int = 24) -> DataFrame:
    """Rows and share of each label in each non-empty time bin."""
    value = label_id(F.col(f"`{profile.target}`"))
    edges = time_bin_edges(df, profile.time, profile.target, bins)
    binned = with_time_bin(df.where(F.col(profile.time).isNotNull() & value.isNotNull()), profile.time, edges)
    counts = binned.groupBy("bin_index", value.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("bin_index")))


def time_bin_summary(df: DataFrame, profile: Profile, bins: int = 24) -> DataFrame:
    """Reviewed and issue accounting, and the leading label, per time bin."""
    value = label_id(F.col(f"`{profile.target}`"))
    edges = time_bin_edges(df, profile.time, profile.target, bins)
    reviewed, issue = is_reviewed(value, profile.good, profile.issue), is_issue(value, profile.issue)
    binned = with_time_bin(df.where(F.col(profile.time).isNotNull() & value.isNotNull()), profile.time, edges)
    per_label = binned.groupBy("bin_index", value.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(reviewed).alias("r"), F.count_if(issue).alias("i"))
    leader = F.max_by("label", F.when(F.col("r") > 0, F.struct("n", -F.col("label"))))
    table = per_label.groupBy("bin_index").agg(F.sum("n").alias("rows"), F.sum("r").alias("reviewed_rows"), F.sum("i").alias("issue_rows"),
                                               leader.alias("dominant_label"))
    edge = lambda i: F.timestamp_micros(F.get(_constant(list(edges), "bigint"), i))
    start, end = edge(F.col("bin_index")), edge(F.col("bin_index") + 1)
    shape = "yyyy-MM-dd HH:mm"
    return table.select("bin_index", start.alias("time_start"), end.alias("time_end"),
                        F.concat(F.date_format(start, shape), F.lit(" -> "), F.date_format(end, shape)).alias("time_window"),
                        "rows", "reviewed_rows", (F.col("rows") - F.col("reviewed_rows")).alias("unreviewed_rows"),
                        _percent(F.col("reviewed_rows"), F.col("rows")).alias("reviewed_share_pct"), "issue_rows",
                        _percent(F.col("issue_rows"), F.col("reviewed_rows")).alias("issue_share_pct"), "dominant_label")


def summary_bin_count(requested: int, parts: int) -> int:
    return min(requested, max(8, parts * 2))


def issue_bin_composition(df: DataFrame, profile: Profile, bins: int = 24) -> DataFrame:
    """Label shares among the issue rows of each time bin."""
    counts = time_bin_counts(df, profile, bins).where(F.col("label").isin(list(profile.issue)))
    return counts.select("bin_index", "label", "rows", (F.col("rows") / F.sum("rows").over(Window.partitionBy("bin_index"))).alias("share"))


def scan_block_sizes(df: DataFrame, profile: Profile, label: str, *, sizes: Sequence[int] = (512, 1024, 2048, 4096),
                     train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Interleaved-split balance for several block sizes, best first; each row has one position for all sizes."""
    blocks = {s: F.ceil(F.col("source_rows") / s) for s in sizes}
    sources = settle(source_ranks(df, profile))
    seq = arrange(sources, order=["source_rank"]).accumulate(**{f"__upto{s}": ("sum", n) for s, n in blocks.items()})
    starts = seq.rows().select(profile.source, F.array(*[F.struct(F.lit(s).alias("size"), (F.col(f"__upto{s}") - n).alias("start")) for s, n in blocks.items()]).alias("__starts"))
    placed = with_position(df.select(*[f"`{c}`" for c in dict.fromkeys([profile.source, *profile.source_order, label])]), by=[profile.source], order=profile.source_order, name="__pos")
    each = attach_small(placed, starts, [profile.source]).select(label, "__pos", F.explode("__starts").alias("__s"))
    slot = slot_split(F.col("__s.start") + F.floor(F.col("__pos") / F.col("__s.size")), slot_schedule(train, validation))
    trials = each.groupBy(slot.alias("split"), label, F.col("__s.size").alias("block_rows")).agg(F.count(F.lit(1)).alias("n"))
    value = label_id(F.col(f"`{label}`"))
    counts = trials.where(value.isNotNull()).groupBy("block_rows", value.alias("label")).agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_rows") for s in SPLITS])
    over = Window.partitionBy("block_rows")
    shares = counts.select("block_rows", "label", *[f"{s}_rows" for s in SPLITS],
                           *[F.coalesce(F.try_divide(F.col(f"{s}_rows"), F.sum(f"{s}_rows").over(over)), F.lit(0.0)).alias(f"{s}_share") for s in SPLITS])
    totals = counts.groupBy("block_rows").agg(*[F.sum(f"{s}_rows").alias(f"{s}_rows") for s in SPLITS])
    return (share_gap(shares, by=["block_rows"]).join(totals, "block_rows")
            .orderBy("max_pairwise_total_variation", "mean_pairwise_total_variation", "block_rows"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("window_count"), F.avg("issue_rate").alias("mean_issue_rate"), F.max("issue_rate").alias("max_issue_rate"),
        F.avg("distance_to_centroid").alias("avg_distance"), F.min("window_start").alias("first_window"), F.max("window_end").alias("last_window"))


def cluster_counts_between(clustered: DataFrame, start: str, end: str) -> DataFrame:
    """Windows of each cluster that meet a closed time range, and their mean issue rate."""
    low, high = (F.lit(t).cast("timestamp") for t in (start, end))
    inside = clustered.where((F.col("window_end").cast("timestamp") >= low) & (F.col("window_start").cast("timestamp") <= high))
    return inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("window_count"), F.avg("issue_rate").alias("mean_issue_rate"))


def cluster_means(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    return clustered.groupBy("cluster").agg(*[F.avg(f"`{c}`").alias(c) for c in columns])


def closest_members(clustered: DataFrame, count: int, tie: Sequence[str]) -> DataFrame:
    """The windows nearest to each cluster centre.

    Partial top-k runs before the shuffle (a window group limit), so a large
    cluster sends only its few best rows.
    """
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("distance_to_centroid"), F.col("issue_rate").desc(), *tie))
    return clustered.withColumn("rank", rank).where(F.col("rank") <= count)


def interesting_windows(clustered: DataFrame, tie: Sequence[str], count: int = 10) -> DataFrame:
    """Top windows by issue rate, then by distance to the centre."""
    return clustered.orderBy(F.col("issue_rate").desc(), F.col("distance_to_centroid").desc(), *tie).limit(count)


def misclassified(scored: DataFrame, order: Sequence[str], *, truth: str = "model_target", prediction: str = "prediction", count: int = 12) -> DataFrame:
    return scored.where(F.col(prediction) != F.col(truth)).orderBy(*order).limit(count)


def error_rate(scored: DataFrame, *, truth: str = "model_target", prediction: str = "prediction") -> DataFrame:
    wrong = F.col(prediction) != F.col(truth)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("wrong_rows"), F.avg(wrong.cast("double")).alias("error_rate"))
