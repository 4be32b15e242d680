"""Training subsets: spread, issue-focused and balanced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import is_issue, is_reviewed, label_id
from tidemark.operators.cleaning import attach_small, first_per_key, reviewed_target_frame, union_all
from tidemark.operators.ordering import arrange, spread_keep
from tidemark.operators.splits import split_by_strategy
from tidemark.profiles import Profile
from tidemark.session import settle


def _order(profile: Profile, by: Sequence[str]) -> list[str]:
    return [c for c in profile.global_order if c not in by]


def _take(df: DataFrame, limit: Column | int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Evenly spaced take whose limit may differ from group to group."""
    seq = arrange(df, by=by, order=order)
    seq = seq.with_columns({"__pos": seq.position(), "__n": seq.total()})
    return seq.rows().where(spread_keep(F.col("__pos"), F.col("__n"), limit)).drop("__pos", "__n")


def time_spread(df: DataFrame, profile: Profile, rows_limit: int, *, by: Sequence[str] = ()) -> DataFrame:
    return _take(df, rows_limit, by, _order(profile, by))


def issue_focused(df: DataFrame, profile: Profile, rows_limit: int, issue_rows: int, *, label: str | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """A spread base plus spread issue rows, without repeats, spread to the limit."""
    by, order = list(by), _order(profile, by)
    issue = is_issue(F.col(f"`{label or profile.target}`"), profile.issue)
    seq = arrange(df, by=by, order=order, tallies={"issue": issue})
    seq = seq.with_columns({"__pos": seq.position(), "__n": seq.total(), "__ri": seq.running("issue"), "__ni": seq.total("issue")})
    base = spread_keep(F.col("__pos"), F.col("__n"), max(rows_limit - issue_rows, 0))
    extra = issue & spread_keep(F.col("__ri") - 1, F.col("__ni"), issue_rows)
    whole = F.col("__n") <= rows_limit
    picked = (seq.rows().withColumns({"__whole": whole, "__base": base}).where(whole | base | extra)
              .drop("__pos", "__n", "__ri", "__ni"))
    picked = settle(picked)
    keys = [profile.source, profile.time]
    sample = picked.where(~F.col("__whole")).withColumn("__late", ~F.col("__base"))
    sample = first_per_key(sample, keys, ["__late", *order])
    sample = _take(sample, rows_limit, by, order)
    return union_all([picked.where("__whole"), sample.drop("__late")]).drop("__whole", "__base")


def balanced_reviewed(df: DataFrame, profile: Profile, rows_limit: int, issue_share: float, *, label: str | None = None,
                      good: Sequence[int] | None = None, issue: Sequence[int] | None = None, by: Sequence[str] = (),
                      stratify: bool = True) -> DataFrame:
    """A chosen good/issue mix: issue quota first, good rows for the rest.

    `stratify` spreads each side over its labels and refills from reviewed
    rows; without it sides are spread as a whole and any row may refill. One
    layout of the data serves all groups of `by`; what follows works on at most
    a few times the row limit per group.
    """
    if not 0 < issue_share < 1:
        raise ValueError("issue_share must lie strictly between 0 and 1")
    by, order = list(by), _order(profile, by)
    good, issue = list(good or profile.good), list(issue or profile.issue)
    value = label_id(F.col(f"`{label or profile.target}`"))
    sides = {"good": good, "issue": issue}
    side = F.when(value.isin(good), "good").when(value.isin(issue), "issue")

    # Group and label counts first; quotas follow from them, one row per group.
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(side == name).alias(f"__n_{name}") for name in sides],
        *[F.count_if(value == v).alias(f"__n_label{v}") for v in sorted({*good, *issue})])
    counts = counts.withColumn("__q_issue", F.least(F.lit(round(rows_limit * issue_share)), F.col("__n_issue")))
    counts = counts.withColumn("__q_good", F.lit(rows_limit) - F.col("__q_issue"))
    for name, members in sides.items():
        present = sum((F.col(f"__n_label{v}") > 0).cast("int") for v in members)
        each = F.greatest(F.ceil(F.col(f"__q_{name}") / F.greatest(present, F.lit(1))), F.lit(1))
        counts = counts.withColumn(f"__e_{name}", each.cast("bigint"))
    quotas = [c for c in counts.columns if c not in by]
    counts = settle(counts)
    if by:
        known = attach_small(df, counts, by)
    else:
        known = df.withColumns({name: F.lit(amount) for name, amount in counts.first().asDict().items()})

    def per_label(column):
        chosen = F.lit(None).cast("bigint")
        for members in sides.values():
            for v in members:
                chosen = F.when(F.col("__v") == v, column(v)).otherwise(chosen)
        return chosen

    def per_side(prefix):
        return F.when(F.col("__side") == "good", F.col(f"{prefix}_good")).when(F.col("__side") == "issue", F.col(f"{prefix}_issue"))

    known = known.withColumns({"__v": value, "__side": side}).withColumns({
        "__size": per_side("__n"), "__target": per_side("__q"), "__each": per_side("__e"),
        "__lsize": per_label(lambda v: F.col(f"__n_label{v}")),
        "__empty": (F.col("__n_good") + F.col("__n_issue") == 0) if stratify else F.lit(False),
    }).drop(*[q for q in quotas if q != "__n"])
    tallies = {name: F.coalesce(F.col("__side") == name, F.lit(False)) for name in sides}
    if stratify:
        tallies |= {f"label{v}": F.coalesce(F.col("__v") == v, F.lit(False)) for v in sorted({*good, *issue})}
    seq = arrange(known, by=by, order=order, tallies=tallies)
    seq = seq.with_columns({"__pos": seq.position(), **{f"__r_{t}": seq.position(t) for t in tallies}})
    rows = seq.rows()

    helpers = ["__pos", "__n", "__v", "__size", "__each", "__lsize", "__empty", *[f"__r_{t}" for t in tallies]]
    in_side = F.col("__side").isNotNull()
    spare = in_side & spread_keep(per_side("__r"), F.col("__size"), F.col("__target"))
    first = (in_side & (F.col("__target") > 0) & spread_keep(per_label(lambda v: F.col(f"__r_label{v}")), F.col("__lsize"), F.col("__each"))
             if stratify else spare)
    whole = (F.col("__n") <= rows_limit) | (F.col("__empty") & spread_keep(F.col("__pos"), F.col("__n"), rows_limit))
    flagged = rows.withColumns({"__whole": whole, "__first": first, "__spare": spare})
    pool = settle(flagged.where(F.col("__whole") | F.col("__first") | F.col("__spare")).drop(*helpers, "__spare"))
    done = pool.where("__whole")
    pool = pool.where(~F.col("__whole"))

    keys = [profile.source, profile.time]
    pool = pool.withColumn("__late", ~F.col("__first"))
    pool = first_per_key(pool, ["__side", *keys], ["__late", *order])
    groups = [*by, "__side"]
    short = pool.groupBy(*groups).agg((F.count_if("__first") < F.max("__target")).alias("__refill"))
    pool = pool.join(short, groups).where(F.col("__first") | F.col("__refill"))
    sample = _take(pool, F.col("__target"), groups, order)
    sample = settle(first_per_key(sample, keys, ["__side", *order]).select(*df.columns))

    have = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("__have")) if by else None
    if by:
        lacking = have.where(F.col("__have") < rows_limit)
        if not lacking.isEmpty():
            candidates = df.join(F.broadcast(lacking) if lacking.count() <= 100_000 else lacking, by)
            sample = union_all([sample, _refill(candidates, sample, profile, value, good, issue, stratify, keys, by, order,
                                                F.lit(rows_limit) - F.col("__have")).drop("__have")])
    else:
        missing = rows_limit - sample.count()
        if 0 < missing < rows_limit:
            sample = union_all([sample, _refill(df, sample, profile, value, good, issue, stratify, keys, by, order, F.lit(missing))])
    return union_all([done.select(*df.columns), sample])


def _refill(candidates, sample, profile, value, good, issue, stratify, keys, by, order, limit) -> DataFrame:
    if stratify:
        candidates = candidates.where(is_reviewed(value, good, issue))
    left = candidates.join(sample.select(*keys), keys, "left_anti").select(*candidates.columns)
    return first_per_key(_take(left, limit, by, order), keys, order)


def subsample(df: DataFrame, profile: Profile, strategy: str, rows_limit: int | None, *, issue_rows: int = 0,
              issue_share: float = 0.5, label: str | None = None, good: Sequence[int] | None = None,
              issue: Sequence[int] | None = None, by: Sequence[str] = (), stratify: bool = True) -> DataFrame:
    """Dispatch by strategy name; `by` applies it inside each part."""
    if rows_limit is None or strategy == "full_train":
        return df
    if strategy == "time_spread":
        return time_spread(df, profile, rows_limit, by=by)
    if strategy == "issue_focused":
        return issue_focused(df, profile, rows_limit, issue_rows, label=label, by=by)
    if strategy == "balanced_reviewed":
        return balanced_reviewed(df, profile, rows_limit, issue_share, label=label, good=good, issue=issue, by=by, stratify=stratify)
    raise ValueError(f"unknown sampling strategy: {strategy}")


def timeline_points(splits: DataFrame, profile: Profile, max_points: int, *, groups: Sequence[str] = ("strategy", "split")) -> DataFrame:
    """Evenly spaced times of each split of each strategy."""
    return _take(splits.where(F.col(profile.time).isNotNull()), max_points, list(groups), profile.global_order)


def zoom_points(split: DataFrame, profile: Profile, zoom_rows: int, max_points: int) -> DataFrame:
    """A local row window around 45 % of the timeline, thinned per split."""
    seq = arrange(split, order=profile.global_order)
    rows = seq.with_columns({"__pos": seq.position(), "__n": seq.total()}).rows()
    size = F.greatest(F.lit(1), F.least(F.lit(zoom_rows), F.col("__n")))
    start = F.greatest(F.lit(0), F.floor(F.col("__n") * F.lit(0.45)) - F.floor(size / 2))
    stop = F.least(F.col("__n"), start + size)
    start = F.greatest(F.lit(0), stop - size)
    window = rows.where((F.col("__pos") >= start) & (F.col("__pos") < stop)).drop("__pos", "__n")
    return _take(window, max_points, ["split"], profile.global_order)


def modelling_split(df: DataFrame, profile: Profile, *, strategy: str, row_limit: int | None = None, subset: str = "full_train",
                    subset_rows: int | None = None, train: float = 0.70, validation: float = 0.15, **options) -> DataFrame:
    """Reviewed rows with target and split, ready for a fit.

    Only the key and label columns go through target, split and training subset;
    wide feature rows join the result by key afterwards (`features_for_splits`).
    The limits are opt-in; validation and test keep all their rows.
    """
    narrow = df.select(*[f"`{c}`" for c in dict.fromkeys([profile.time, profile.source, *profile.tie_break, profile.target])])
    cut = settle(split_by_strategy(reviewed_target_frame(narrow, profile, row_limit), profile, strategy, train, validation, **options))
    chosen = subsample(cut.where("split = 'train'"), profile, subset, subset_rows)
    return chosen.unionByName(cut.where("split <> 'train'"))
