"""Choosing rows: by key, by time range, by context around events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import label_id
from tidemark.operators.cleaning import attach_small, between_times, first_per_key, reviewed_target_frame
from tidemark.operators.intervals import label_runs
from tidemark.operators.ordering import arrange, evenly_spaced_take, with_position
from tidemark.profiles import Profile
from tidemark.session import settle


# --- joins by row key --------------------------------------------------------

def select_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the selection; repeats there have no effect."""
    return df.join(keys.select(*on), list(on), "left_semi")


def features_for_splits(df: DataFrame, splits: DataFrame, profile: Profile) -> DataFrame:
    """Feature rows with the split, target and issue flag of their key."""
    on = [profile.source, profile.time]
    return df.join(splits.select(*on, "split", "model_target", "issue"), on, "inner")


def materialise_splits(df: DataFrame, splits: DataFrame, profile: Profile) -> DataFrame:
    """Wide reviewed rows of each split from its narrow keys."""
    on = [profile.source, profile.time]
    wide = df.join(splits.select(*on, "split").distinct(), on, "inner")
    return reviewed_target_frame(wide, profile)


def not_selected(df: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(selected.select(*on), list(on), "left_anti")


def interval_origin(splits: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Which splits an interval overlaps: one name, `mixed (...)` or outside."""
    spans = splits.groupBy("split").agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    hit = F.when((low <= F.col("hi")) & (high >= F.col("lo")), F.struct(rank.alias("r"), F.col("split").alias("s")))
    names = F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["s"])
    found = spans.agg(names.alias("names"))
    text = (F.when(F.size("names") == 0, "outside modeled range").when(F.size("names") == 1, F.get("names", F.lit(0)))
            .otherwise(F.concat(F.lit("mixed ("), F.array_join("names", ", "), F.lit(")"))))
    return found.select(text.alias("origin"))


def rows_in_windows(rows: DataFrame, windows: DataFrame, profile: Profile, window_rows: int) -> DataFrame:
    """Label counts inside chosen windows, by source and window number.

    The window number is a key on both sides, so this is an equi-join.
    """
    placed = with_position(rows, by=[profile.source], order=profile.source_order, name="__pos")
    placed = placed.withColumn("window_id", F.floor(F.col("__pos") / window_rows))
    value = label_id(F.col(f"`{profile.target}`"))
    keys = [profile.source, "window_id"]
    inside = placed.where(value.isNotNull()).join(windows.select(*keys).distinct(), keys)
    return inside.groupBy(*keys, value.alias("label")).agg(F.count(F.lit(1)).alias("rows"))


# --- panels around a time or an event ----------------------------------------

def context_panel(df: DataFrame, profile: Profile, center_time: str, points: int, *, by_source: bool = True) -> DataFrame:
    """`points` rows centred on the row closest to a time, per source, clipped at its ends.

    Rows have positions, so the panel is a range of them: no window runs over
    all rows on one side of the centre.
    """
    by = [profile.source] if by_source else []
    order = profile.source_order if by_source else profile.global_order
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    placed = with_position(df, by=by, order=order, name="__pos", total="__n")
    distance = F.abs(micros(F.col(profile.time)) - micros(F.lit(center_time)))
    nearest = placed.groupBy(*by).agg(F.min(F.struct(distance.alias("d"), F.col("__pos").alias("at")))["at"].alias("__at"))
    if by:
        around = attach_small(placed, nearest, by)
    else:
        around = placed.withColumn("__at", F.lit(nearest.first()["__at"]).cast("bigint"))
    start = F.greatest(F.col("__at") - points // 2, F.lit(0))
    stop = F.least(start + points, F.col("__n"))
    start = F.greatest(F.least(start, stop - points), F.lit(0))
    return around.where((F.col("__pos") >= start) & (F.col("__pos") < stop)).select(*[f"`{c}`" for c in df.columns])


def event_panels(df: DataFrame, profile: Profile, classes: Sequence[int], points: int) -> tuple[DataFrame, DataFrame]:
    """Positioned rows, and for each run of a requested label the panel around it."""
    placed = with_position(df, by=[profile.source], order=profile.source_order, name="row_index", total="source_rows")
    value = F.coalesce(label_id(F.col(f"`{profile.target}`")), F.lit(-1))
    runs = label_runs(df, time=profile.time, label=value, order=profile.source_order, by=[profile.source],
                      keep=F.col("label").isin(list(classes)))
    totals = placed.groupBy(profile.source).agg(F.max("source_rows").alias("source_rows"))
    middle = F.floor((F.col("first_row") + F.col("last_row")) / 2)
    start = F.greatest(middle - points // 2, F.lit(0))
    stop = F.least(start + points, F.col("source_rows"))
    start = F.when(stop - start < points, F.greatest(stop - points, F.lit(0))).otherwise(start)
    panels = runs.join(totals, profile.source).select(
        profile.source, "label", "first_row", "last_row", "first_time", middle.alias("middle_row"), start.alias("panel_start"), stop.alias("panel_stop"))
    return placed, panels


def flag_context_sample(df: DataFrame, profile: Profile, classes: Sequence[int], points: int, max_windows: int) -> DataFrame:
    """Rows around the first `max_windows` runs of each class, each row once."""
    placed, panels = event_panels(df, profile, classes, points)
    chosen = with_position(panels, by=["label"], order=[profile.source, "first_row"], name="__rank").where(F.col("__rank") < max_windows)
    spots = (chosen.select(profile.source, F.explode(F.sequence(F.col("panel_start"), F.col("panel_stop") - 1)).alias("row_index")).distinct())
    rows = placed.join(spots, [profile.source, "row_index"], "left_semi").select(*[f"`{c}`" for c in df.columns])
    return first_per_key(rows, [profile.source, profile.time], profile.tie_break)


def panel_scores(df: DataFrame, profile: Profile, classes: Sequence[int], points: int, *, measurement: str,
                 secondary: str | None = None, avoid: Sequence[int] = ()) -> DataFrame:
    """Score of the example panel around every run of the requested labels.

    Shares inside a panel are differences of running counts at its two ends,
    so each run needs two key lookups, whatever the panel length.
    """
    needed = [profile.source, profile.time, *profile.tie_break, profile.target, measurement, *([secondary] if secondary else [])]
    unique = settle(first_per_key(df.select(*[f"`{c}`" for c in dict.fromkeys(needed)]), [profile.source, profile.time], profile.tie_break))
    value = F.coalesce(label_id(F.col(f"`{profile.target}`")), F.lit(-1))
    counted = {"m": F.col(measurement).isNotNull()} | ({"s": F.col(secondary).isNotNull()} if secondary else {})
    counted |= {f"f{v}": value == v for v in dict.fromkeys([*classes, *avoid])}
    seq = arrange(unique, by=[profile.source], order=profile.source_order, tallies=counted)
    ladder = settle(seq.with_columns({"row_index": seq.position(), **{f"c_{t}": seq.running(t) for t in counted}}).rows()
                    .select(profile.source, "row_index", F.unix_micros(F.col(profile.time).cast("timestamp")).alias("t"), *[f"c_{t}" for t in counted]))
    _, panels = event_panels(unique, profile, classes, points)
    names = ["t", *[f"c_{t}" for t in counted]]
    low = ladder.select(profile.source, F.col("row_index").alias("panel_start"), F.col("t").alias("lo_t"))
    ends = ladder.select(profile.source, (F.col("row_index") + 1).alias("panel_stop"), *[F.col(n).alias(f"hi_{n}") for n in names])
    # Running counts just before the panel: those at its first row minus the row itself.
    before = ladder.select(profile.source, (F.col("row_index") + 1).alias("panel_start"), *[F.col(n).alias(f"pre_{n}") for n in names if n != "t"])
    joined = (panels.join(low, [profile.source, "panel_start"])
              .join(ends, [profile.source, "panel_stop"]).join(before, [profile.source, "panel_start"], "left"))
    size = F.col("panel_stop") - F.col("panel_start")
    inside = lambda t: F.col(f"hi_c_{t}") - F.coalesce(F.col(f"pre_c_{t}"), F.lit(0))
    own, avoided = F.lit(0), F.lit(0)
    for v in dict.fromkeys([*classes, *avoid]):
        own = own + F.when(F.col("label") == v, inside(f"f{v}")).otherwise(0)
        if v in avoid:
            avoided = avoided + F.when(F.col("label") != v, inside(f"f{v}")).otherwise(0)
    minutes = F.greatest(F.lit(0.0), (F.col("hi_t") - F.col("lo_t")) / 1e6) / F.greatest(size - 1, F.lit(1)) / 60.0
    place = (F.col("middle_row") - F.col("panel_start")) / F.greatest(size - 1, F.lit(1))
    shares = {"measurement_share": inside("m") / size, "secondary_share": (inside("s") / size) if secondary else F.lit(0.0),
              "target_share": own / size, "avoid_share": avoided / size, "gap_minutes": minutes, "target_position": place}
    # The weights of the panel score.
    score = (F.col("measurement_share") * 3.0 + F.col("secondary_share") * 0.5 + F.least("target_share", F.lit(0.25)) * 2.0
             - F.col("avoid_share") * 6.0 - F.log1p("gap_minutes") * 0.8 - F.abs(F.col("target_position") - 0.5) * 4.0)
    scored = joined.withColumns(shares).withColumn("score", score)
    return scored.select(profile.source, "label", "first_row", "middle_row", "panel_start", "panel_stop",
                         F.timestamp_micros("lo_t").alias("panel_from"), F.timestamp_micros("hi_t").alias("panel_to"), *shares, "score")


def best_panels(df: DataFrame, profile: Profile, classes: Sequence[int], points: int, **options) -> DataFrame:
    """Best panel per label; time already shown for an earlier label costs score.

    The choice depends on the panels picked before, so it runs label by label
    (the label domain is small), each time as one aggregate over all candidates.
    """
    scored = settle(panel_scores(df, profile, classes, points, **options))
    used, chosen = [], None
    for label in classes:
        start, end = F.unix_micros("panel_from"), F.unix_micros("panel_to")
        penalty = F.lit(0.0)
        for a, b in used:
            overlap = F.greatest(F.lit(0), F.least(end, F.lit(b)) - F.greatest(start, F.lit(a))) / 1e6
            penalty = penalty + overlap / F.greatest(F.lit(1.0), (end - start) / 1e6)
        final = scored.where(F.col("label") == label).withColumn("score", F.col("score") - penalty * 8.0)
        best = final.orderBy(F.col("score").desc(), profile.source, "first_row").limit(1)
        row = best.select(start.alias("a"), end.alias("b")).first()
        if row is None:
            continue
        used.append((row["a"], row["b"]))
        chosen = best if chosen is None else chosen.unionByName(best)
    if chosen is None:
        raise ValueError("none of the requested labels occurs")
    return chosen


# --- time ranges -------------------------------------------------------------

def select_range(df: DataFrame, profile: Profile, *, start: str | None = None, end: str | None = None, auto: bool = True,
                 max_points: int = 800, preferred: Sequence[int] = (4, 3, 9), max_hours: float | None = 6.0,
                 thin_to: int | None = None) -> tuple[DataFrame, dict]:
    """Rows of an explicit or representative interval, and how it was chosen.

    The full range (`auto` off, no bounds) is every row unless `thin_to` asks for an
    even sample. Automatic choice centres on the middle occurrence of the first preferred
    label present. Only the chosen centre (one row) reaches the driver.
    """
    if start or end:
        return between_times(df, profile.time, start, end), {"mode": "explicit", "label": None}
    if not auto:
        return df if thin_to is None else evenly_spaced_take(df, thin_to, order=profile.global_order), {"mode": "manual-full-range", "label": None}
    value = label_id(F.col(f"`{profile.target}`"))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(value == v).alias(f"n{v}") for v in preferred]).first()
    label = next((v for v in preferred if counts[f"n{v}"]), None)
    tallies = {"hit": F.coalesce(value == label, F.lit(False))} if label is not None else {}
    seq = arrange(df, order=profile.global_order, tallies=tallies)
    columns = {"__pos": seq.position(), "__hit": seq.running("hit")} if tallies else {"__pos": seq.position()}
    placed = seq.with_columns(columns).rows()
    middle = ((value == label) & (F.col("__hit") == counts[f"n{label}"] // 2 + 1)) if label is not None else (F.col("__pos") == counts["n"] // 2)
    spot = placed.where(middle).select("__pos", F.unix_micros(F.col(profile.time).cast("timestamp")).alias("t")).first()
    points = min(max_points, counts["n"])

    def rows_around(frame: DataFrame, at: int, rows: int) -> DataFrame:
        first = max(at - points // 2, 0)
        last = min(first + points, rows)
        return frame.where(F.col("__pos").between(max(last - points, 0), last - 1))

    chosen = {"mode": "auto", "label": label}
    if max_hours is None:
        return rows_around(placed, spot["__pos"], counts["n"]).select(*df.columns), chosen
    half = int(max_hours * 3_600_000_000 / 2)
    low, high = F.timestamp_micros(F.lit(spot["t"] - half)), F.timestamp_micros(F.lit(spot["t"] + half))
    if df.schema[profile.time].dataType.typeName() == "timestamp_ntz":
        low, high = low.cast("timestamp_ntz"), high.cast("timestamp_ntz")
    near = df.where(F.col(profile.time).between(low, high))
    rows = near.count()
    if rows <= max_points:
        return near, chosen
    placed = with_position(near, order=profile.global_order, name="__pos")
    return rows_around(placed, rows // 2, rows).select(*df.columns), chosen
