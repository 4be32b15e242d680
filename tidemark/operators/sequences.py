"""Fixed and forecast windows over consecutive rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import finite, is_issue, label_id
from tidemark.operators.ordering import arrange, evenly_spaced_take, spread_keep, with_position
from tidemark.profiles import Profile
from tidemark.session import settle

WORST, MAJORITY = "worst", "majority"


# --- next-value forecast windows --------------------------------------------

def forecast_rows(df: DataFrame, profile: Profile, *, features: Sequence[str], target: str, lookback: int,
                  max_gap_seconds: float, good_only: bool = False, by: Sequence[str] = (), with_history: bool = False) -> DataFrame:
    """All rows with `row_index` and `is_end`: may the row end a window?

    A window is `lookback` usable rows and the usable end row, with every time
    step between them within the limit. The last unusable row and the last
    broken step so far tell this in constant work per row, for any lookback.
    """
    groups = [*by, profile.source]
    seq = arrange(df, by=groups, order=profile.source_order, back=lookback)
    here = seq.window()
    micros = F.unix_micros(F.col(f"`{profile.time}`").cast("timestamp"))
    usable = finite(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, target])])
    if good_only:
        usable = usable & F.coalesce(label_id(F.col(f"`{profile.target}`")).isin(list(profile.good)), F.lit(False))
    local = F.row_number().over(here)
    step = micros - F.lag(micros).over(here)
    seq = seq.with_columns({"row_index": seq.position(), "__n": local, "__usable": usable,
                            "__linked": F.coalesce(step <= int(max_gap_seconds * 1_000_000), F.lit(True))})
    so_far = seq.window(Window.unboundedPreceding, Window.currentRow)
    seq = seq.with_columns({
        "__bad": F.coalesce(F.max(F.when(~F.col("__usable"), F.col("__n"))).over(so_far), F.lit(0)),
        "__cut": F.coalesce(F.max(F.when(~F.col("__linked"), F.col("__n"))).over(so_far), F.lit(0)),
    })
    if with_history:
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
        seq = seq.with_columns({"history": F.collect_list(values).over(seq.window(-lookback, -1))})
    ends = (F.col("__n") > lookback) & (F.col("__bad") < F.col("__n") - lookback) & (F.col("__cut") <= F.col("__n") - lookback)
    return seq.rows().withColumn("is_end", ends).drop("__n", "__usable", "__linked", "__bad", "__cut")


def choose_ends(ends: DataFrame, profile: Profile, *, limit: int | None, mode: str = "spread", seed: int = 21,
                by: Sequence[str] = (), tie: str = "row_index") -> DataFrame:
    """At most `limit` end rows per source: spread, random or issue-enriched."""
    if limit is None:
        return ends
    groups = [*by, profile.source]
    if mode == "random":
        ranked = ends.withColumn("__draw", F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in [*groups, tie]], F.lit(str(seed)))))
        placed = with_position(ranked, by=groups, order=["__draw", tie], name="__pos")
        return placed.where(F.col("__pos") < limit).drop("__draw", "__pos")
    issue = is_issue(F.col(f"`{profile.target}`"), profile.issue)
    seq = arrange(ends, by=groups, order=[tie], tallies={"issue": issue, "good": ~issue})
    pos, n = seq.position(), seq.total()
    if mode == "spread":
        keep = spread_keep(F.col("__pos"), F.col("__n"), limit)
    elif mode == "issue_enriched":
        spread_issue = F.col("__issue") & spread_keep(F.col("__ri") - 1, F.col("__ni"), limit)
        fill_good = F.col("__issue") | spread_keep(F.col("__rg") - 1, F.col("__n") - F.col("__ni"), F.lit(limit) - F.col("__ni"))
        keep = F.when(F.col("__n") <= limit, True).when(F.col("__ni") >= limit, spread_issue).otherwise(fill_good)
    else:
        raise ValueError(f"unknown end-row sampling mode: {mode}")
    extra = {"__pos": pos, "__n": n, "__issue": issue, "__ri": seq.running("issue"), "__rg": seq.running("good"), "__ni": seq.total("issue")}
    return seq.with_columns(extra).rows().where(keep).drop(*extra)


def attach_history(rows: DataFrame, ends: DataFrame, profile: Profile, *, features: Sequence[str], lookback: int,
                   by: Sequence[str] = ()) -> DataFrame:
    """Add `history`, the `lookback` feature rows before each chosen end row.

    Only rows that a chosen window needs are moved: each end asks for its
    positions, which meet the readings on (group, row_index), a unique key.
    """
    groups = [*by, profile.source]
    keys = [*groups, "row_index"]
    wanted = ends.select(*[f"`{c}`" for c in groups], F.col("row_index").alias("__end"),
                         F.explode(F.sequence(F.col("row_index") - lookback, F.col("row_index") - 1)).alias("row_index"))
    values = rows.select(*[f"`{c}`" for c in keys], F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("__values"))
    history = (wanted.join(values, keys).groupBy(*[f"`{c}`" for c in groups], "__end")
               .agg(F.array_sort(F.collect_list(F.struct("row_index", "__values"))).alias("__steps"))
               .select(*[f"`{c}`" for c in groups], F.col("__end").alias("row_index"),
                       F.transform("__steps", lambda s: s["__values"]).alias("history")))
    return ends.join(history, keys)


def forecast_windows(df: DataFrame, profile: Profile, *, features: Sequence[str], target: str, lookback: int,
                     max_gap_seconds: float, good_only: bool = False, limit: int | None = None, mode: str = "spread",
                     seed: int = 21, by: Sequence[str] = ()) -> DataFrame:
    """Next-value windows: metadata, target value, label flags and history.

    With a limit each source gives at most ceil(limit / sources) windows and
    the union is thinned evenly to the limit again.
    """
    rows = forecast_rows(df, profile, features=features, target=target, lookback=lookback,
                         max_gap_seconds=max_gap_seconds, good_only=good_only, by=by, with_history=limit is None)
    ends = rows.where("is_end")
    if limit is not None:
        sources = max(df.select(f"`{profile.source}`").distinct().count(), 1)
        kept = [*by, profile.source, profile.time, *profile.tie_break, profile.target, target, "row_index"]
        ends = settle(ends.select(*[f"`{c}`" for c in dict.fromkeys(kept)]))
        ends = choose_ends(ends, profile, limit=max(1, math.ceil(limit / sources)), mode=mode, seed=seed, by=by)
        ends = evenly_spaced_take(ends, limit, by=by, order=[profile.source, "row_index"])
    label = label_id(F.col(f"`{profile.target}`"))
    ends = ends.select(*[f"`{c}`" for c in dict.fromkeys([*by, profile.source, profile.time, *profile.tie_break])], "row_index",
                       *(["history"] if limit is None else []), F.col(f"`{target}`").cast("double").alias("target_value"), label.alias("qc_label"),
                       F.coalesce(label.isin(list(profile.good)), F.lit(False)).alias("is_good"),
                       is_issue(label, profile.issue).alias("is_issue"))
    return ends if limit is None else attach_history(rows, ends, profile, features=features, lookback=lookback, by=by)


def contiguous_blocks(df: DataFrame, profile: Profile, *, max_rows: int, block_rows: int, lookback: int) -> DataFrame:
    """A row budget as whole blocks of neighbouring rows, spread over sources and time.

    The choice is made on the block table; rows then find their block by key.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return df
    size = max(block_rows, lookback + 1)
    placed = with_position(df, by=[profile.source], order=profile.source_order, name="__pos")
    placed = placed.withColumns({"__block": F.floor(F.col("__pos") / size), "__in": F.col("__pos") % size})
    blocks = (placed.groupBy(profile.source, "__block").agg(F.count(F.lit(1)).alias("__rows"))
              .where(F.col("__rows") >= lookback + 1))
    chosen = evenly_spaced_take(blocks, max(1, math.ceil(max_rows / size)), order=[profile.source, "__block"])
    seq = arrange(chosen, order=[profile.source, "__block"])
    budget = seq.accumulate(__upto=("sum", F.col("__rows"))).rows().withColumn("__before", F.col("__upto") - F.col("__rows"))
    return (placed.join(budget, [profile.source, "__block"])
            .where(F.col("__before") + F.col("__in") < max_rows).select(*[f"`{c}`" for c in df.columns]))


# --- fixed sequence windows --------------------------------------------------

def fixed_windows(df: DataFrame, profile: Profile, *, features: Sequence[str], label: str, size: int,
                  by: Sequence[str] = ()) -> DataFrame:
    """Non-overlapping windows of exactly `size` complete rows per source.

    Gives `window_index`, `steps` (rows of feature values) and `labels`.
    """
    groups = [*by, profile.source]
    complete = df.dropna(subset=[*features, label, profile.time, profile.source])
    placed = with_position(complete, by=groups, order=profile.source_order, name="__pos")
    step = F.struct("__pos", F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
                    label_id(F.col(f"`{label}`")).alias("y"))
    return (placed.groupBy(*[f"`{c}`" for c in groups], F.floor(F.col("__pos") / size).alias("window_index"))
            .agg(F.min(profile.time).alias("window_start"), F.max(profile.time).alias("window_end"),
                 F.array_sort(F.collect_list(step)).alias("__steps"))
            .where(F.size("__steps") == size)
            .withColumns({"steps": F.transform("__steps", lambda s: s["x"]), "labels": F.transform("__steps", lambda s: s["y"])})
            .drop("__steps"))


def window_label(labels: Column, mode: str) -> Column:
    """One label for a window's label array; severity grows with the label id."""
    present = F.array_compact(labels)
    if mode == WORST:
        chosen = F.array_max(present)
    else:
        tallied = F.transform(F.array_distinct(present),
                              lambda v: F.struct(F.size(F.filter(present, lambda x: x == v)).alias("n"), v.alias("v")))
        chosen = F.array_max(tallied)["v"]
    return F.coalesce(chosen, F.lit(1))


def sequence_bundle(df: DataFrame, profile: Profile, *, features: Sequence[str], label: str, size: int,
                    task: str = "multiclass", output: str = "window", reduction: str = WORST,
                    split: str = "split") -> tuple[DataFrame, list[int]]:
    """Windows with training targets: dense class index, or binary any-issue.

    Windows never cross a split or a source. The class list is shared by all
    splits; it is as short as the label domain, so the driver may hold it.
    """
    windows = settle(fixed_windows(df, profile, features=features, label=label, size=size, by=[split]))
    if task == "binary":
        target = F.array_max("labels") if output == "window" else F.col("labels")
        return windows.withColumn("y", target), [0, 1]
    value = window_label(F.col("labels"), reduction) if output == "window" else F.col("labels")
    windows = windows.withColumn("y_label", value)
    flat = windows.select("y_label") if output == "window" else windows.select(F.explode("y_label").alias("y_label"))
    classes = sorted(r[0] for r in flat.distinct().collect())
    listed = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<int>")
    index = lambda v: (F.array_position(listed, v) - 1).cast("int")
    target = index(F.col("y_label")) if output == "window" else F.transform("y_label", index)
    return windows.withColumn("y", target), classes


def channel_statistics(windows: DataFrame, channels: int) -> DataFrame:
    """Mean and population deviation (+1e-6) of each channel over all steps."""
    steps = windows.select(F.explode("steps").alias("step")).select(F.posexplode("step").alias("channel", "value"))
    return (steps.groupBy("channel").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") + F.lit(1e-6)).alias("std"))
            .where(F.col("channel") < channels))


def normalise_windows(windows: DataFrame, channels: int, *, split: str = "split", fit_on: str = "train") -> DataFrame:
    """Scale every window by the training windows' channel statistics."""
    fitted = {r["channel"]: (r["mean"], r["std"]) for r in channel_statistics(windows.where(F.col(split) == fit_on), channels).collect()}
    mean = F.array(*[F.lit(fitted[c][0]) for c in range(channels)])
    std = F.array(*[F.lit(fitted[c][1]) for c in range(channels)])
    scaled = F.transform("steps", lambda step: F.transform(step, lambda v, c: (v - F.get(mean, c)) / F.get(std, c)))
    return windows.withColumn("steps", scaled)
