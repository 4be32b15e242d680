"""Splits, their reports, label accounting and score metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, metrics, ordering, sampling, splits, summaries
from tidemark.plans.registry import ISSUE, PROFILE, READINGS, SCORES, query, r9, readings, scores, spread_sql

W = "PARTITION BY source_file ORDER BY ts, row_id"
G = "ORDER BY ts, source_file, row_id"
SPLITS = ("train", "validation", "test")
REVIEWED = READINGS + ", reviewed AS (SELECT row_id, ts, source_file, CAST(qc AS BIGINT) AS qc FROM readings WHERE qc IN (1, 3, 4, 9))"


def cut_sql(pos: str, n: str) -> str:
    return (f"CASE WHEN {pos} < floor({n} * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN {pos} < floor({n} * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'validation' ELSE 'test' END")


def slot_sql(index: str, kind: str = "spread") -> str:
    """Split of a block: 14, 3 and 3 slots of 20, each split's evenly over the cycle, or one split after the other."""
    place = "(CAST(k AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(c AS DOUBLE), ord" if kind == "spread" else "ord, k"
    return (f"(SELECT list(split ORDER BY {place}) FROM (SELECT *, unnest(range(1, c + 1)) AS k FROM (VALUES ('train', 14, 0), ('validation', 3, 1), ('test', 3, 2)) t(split, c, ord)))"
            f"[CAST({index} % 20 AS BIGINT) + 1]")


# Slots of cycles of 3 to 20 episodes: whole parts of the shares, at least one, the rest by largest remainder.
EPISODE_SLOTS = """, ideals AS (SELECT cycle, split, ord, share * cycle AS ideal, greatest(1, CAST(floor(share * cycle) AS BIGINT)) AS least_slots FROM range(3, 21) t(cycle),
(VALUES ('train', CAST(0.7 AS DOUBLE), 0), ('validation', CAST(0.15 AS DOUBLE), 1), ('test', CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE) - CAST(0.15 AS DOUBLE), 2)) s(split, share, ord)),
slot_counts AS (SELECT cycle, split, ord, least_slots + CASE WHEN row_number() OVER (PARTITION BY cycle ORDER BY ideal - least_slots DESC, ord) <= left_over THEN 1 ELSE 0 END
+ CASE WHEN left_over < 0 AND row_number() OVER (PARTITION BY cycle ORDER BY least_slots DESC, ord) = 1 THEN left_over ELSE 0 END AS c
FROM (SELECT *, cycle - sum(least_slots) OVER (PARTITION BY cycle) AS left_over FROM ideals)),
slots AS (SELECT cycle, split, row_number() OVER (PARTITION BY cycle ORDER BY (CAST(k AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(c AS DOUBLE), ord) - 1 AS slot
FROM (SELECT *, unnest(range(1, CAST(c AS BIGINT) + 1)) AS k FROM slot_counts))"""


GLOBAL = REVIEWED + f", split AS (SELECT row_id, ts, source_file, qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({G}) - 1 AS p, count(*) OVER () AS n FROM reviewed))"
PER_SOURCE = REVIEWED + f", split AS (SELECT row_id, ts, source_file, qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY source_file) AS n FROM reviewed))"


def interleaved_sql(block: int, kind: str = "spread", name: str = "split") -> str:
    return f""", sources_{name} AS (SELECT source_file, min(ts) AS first_ts, CAST(ceil(count(*) / CAST({block} AS DOUBLE)) AS BIGINT) AS blocks FROM reviewed GROUP BY source_file),
offsets_{name} AS (SELECT source_file, CAST(sum(blocks) OVER (ORDER BY first_ts, source_file) - blocks AS BIGINT) AS off FROM sources_{name}),
{name} AS (SELECT row_id, ts, source_file, qc, {slot_sql(f'(off + p // {block})', kind)} AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS p FROM reviewed) JOIN offsets_{name} USING (source_file))"""


ROWS = " SELECT row_id, ts, source_file, qc, split FROM split"


def reviewed(spark, sf):
    return cleaning.reviewed_rows(readings(spark, sf), PROFILE).select("row_id", "ts", "source_file", "qc")


@query("sp1_global_contiguous", GLOBAL + ROWS)
def global_contiguous(spark, sf):
    return splits.split_by_strategy(reviewed(spark, sf), PROFILE, "global_contiguous")


@query("sp2_per_source_contiguous", PER_SOURCE + ROWS)
def per_source(spark, sf):
    return splits.split_by_strategy(reviewed(spark, sf), PROFILE, "per_source_contiguous")


@query("sp3_interleaved_blocks", REVIEWED + interleaved_sql(64) + ROWS)
def interleaved(spark, sf):
    return splits.split_by_strategy(reviewed(spark, sf), PROFILE, "interleaved_blocks", block_rows=64)


@query("sp3b_interleaved_runs", REVIEWED + interleaved_sql(64, "runs") + ROWS)
def interleaved_runs(spark, sf):
    return splits.interleaved_blocks(reviewed(spark, sf), PROFILE, 0.70, 0.15, block_rows=64, schedule="runs")


def _episode_split(spark, sf, purge=8):
    return splits.split_by_strategy(reviewed(spark, sf), PROFILE, "episode_aware", block_rows=32, context_rows=6, merge_gap_rows=4, purge_gap_rows=purge)


def episode_units_sql(block: int = 32, context: int = 6, merge: int = 4) -> str:
    return REVIEWED + EPISODE_SLOTS + f""", numbered AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY source_file) AS n, qc IN (3, 4, 9) AS bad FROM reviewed),
marks AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY source_file ORDER BY pos) - 1 <= {max(merge, 2 * context)} THEN 0 ELSE 1 END AS opens FROM numbered WHERE bad),
episodes AS (SELECT source_file, greatest(min(pos) - {context}, 0) AS lo, least(max(pos) + {context + 1}, min(n)) AS hi, min(n) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY source_file ORDER BY pos) AS e FROM marks) GROUP BY source_file, e),
gaps AS (SELECT source_file, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM episodes WINDOW w AS (PARTITION BY source_file ORDER BY lo) UNION ALL SELECT source_file, max(hi), max(n) FROM episodes GROUP BY source_file),
ranks AS (SELECT source_file, row_number() OVER (ORDER BY min(ts), source_file) AS rk, count(*) AS rows FROM reviewed GROUP BY source_file),
dealt AS (SELECT source_file, lo, hi, row_number() OVER (ORDER BY rk, lo) - 1 AS i, count(*) OVER () AS m FROM episodes JOIN ranks USING (source_file)),
named AS (SELECT source_file, lo, hi, split FROM dealt JOIN slots ON cycle = greatest(3, least(m, 20)) AND slot = i % cycle),
blocks AS (SELECT source_file, s AS lo, least(s + {block}, hi) AS hi, row_number() OVER (ORDER BY rk, s) - 1 AS i FROM (SELECT source_file, hi, unnest(range(lo, hi, {block})) AS s FROM gaps WHERE lo < hi) JOIN ranks USING (source_file)),
goal AS (SELECT CAST(sum(rows) AS DOUBLE) * CAST(0.7 AS DOUBLE) AS t1, CAST(sum(rows) AS DOUBLE) * CAST(0.15 AS DOUBLE) AS t2, greatest(CAST(sum(rows) AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE) - CAST(0.15 AS DOUBLE)), CAST(0 AS DOUBLE)) AS t3 FROM ranks),
start AS (SELECT CAST(coalesce(sum(hi - lo) FILTER (split = 'train'), 0) AS DOUBLE) AS c1, CAST(coalesce(sum(hi - lo) FILTER (split = 'validation'), 0) AS DOUBLE) AS c2, CAST(coalesce(sum(hi - lo) FILTER (split = 'test'), 0) AS DOUBLE) AS c3 FROM named),
lack AS (SELECT greatest(t1 - c1, CAST(0 AS DOUBLE)) AS q1, greatest(t2 - c2, CAST(0 AS DOUBLE)) AS q2, greatest(t3 - c3, CAST(0 AS DOUBLE)) AS q3 FROM goal, start),
filled AS (SELECT *, sum(hi - lo) OVER (ORDER BY reverse(lpad(bin(i), 48, '0'))) - CAST(hi - lo AS DOUBLE) / 2 AS middle, CAST(sum(hi - lo) OVER () AS DOUBLE) AS clean_rows FROM blocks),
units AS (SELECT source_file, lo, hi, 'episode' AS kind, split FROM named UNION ALL SELECT source_file, lo, hi, 'clean',
CASE WHEN q1 + q2 + q3 = 0 OR middle < clean_rows * (q1 / (q1 + q2 + q3)) THEN 'train' WHEN middle < clean_rows * ((q1 + q2) / (q1 + q2 + q3)) THEN 'validation' ELSE 'test' END FROM filled, lack)"""


def episode_split_sql(block: int = 32, context: int = 6, merge: int = 4, purge: int = 8) -> str:
    return episode_units_sql(block, context, merge) + f""", trimmed AS (SELECT source_file, split, lo + CASE WHEN lag(split) OVER w <> split THEN {purge // 2} ELSE 0 END AS lo, hi - CASE WHEN lead(split) OVER w <> split THEN {purge - purge // 2} ELSE 0 END AS hi
FROM units WINDOW w AS (PARTITION BY source_file ORDER BY lo)),
split AS (SELECT r.row_id, r.ts, r.source_file, r.qc, t.split FROM numbered r JOIN trimmed t ON r.source_file = t.source_file AND r.pos >= t.lo AND r.pos < t.hi)"""


EPISODE_UNITS, EPISODE_SPLIT = episode_units_sql(), episode_split_sql()


@query("sp4_episode_aware", EPISODE_SPLIT + ROWS)
def episode_aware(spark, sf):
    return _episode_split(spark, sf)


@query("sp4_episode_units", EPISODE_UNITS + ' SELECT source_file, lo AS start, hi AS "end", kind, split FROM units')
def episode_units(spark, sf):
    rows = reviewed(spark, sf)
    placed = splits.place_issues(rows, PROFILE, F.col("qc").isin(*ISSUE))
    found, clean = splits.split_units(placed, PROFILE, context_rows=6, merge_gap_rows=4)
    return splits.assign_units(found, clean, splits.source_ranks(rows, PROFILE), PROFILE, 0.70, 0.15, block_rows=32)


@query("sp5_modelling_split", REVIEWED.replace(" FROM readings WHERE", " FROM readings WHERE") + f""", limited AS ({spread_sql('reviewed', 5000)}),
split AS (SELECT row_id, ts, source_file, qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY source_file) AS n FROM limited)),
train AS ({spread_sql('split', 900, where="split = 'train'")})
SELECT split, count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows, min(ts) AS time_start, max(ts) AS time_end FROM (SELECT split, qc, ts FROM train UNION ALL SELECT split, qc, ts FROM split WHERE split <> 'train') GROUP BY split""")
def modelling_split(spark, sf):
    final = sampling.modelling_split(reviewed(spark, sf), PROFILE, strategy="per_source_contiguous", row_limit=5000, subset="time_spread", subset_rows=900)
    return summaries.split_overview(final, PROFILE).drop("issue_share_pct")


# --- label accounting --------------------------------------------------------

def _sum_rows(split_cte: str, label: str = "qc") -> str:
    counts = ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_rows" for s in SPLITS)
    return f", counts AS (SELECT {label} AS label, {counts} FROM {split_cte} GROUP BY {label})"


def _shares(over: str = "") -> str:
    return ", ".join(r9(f"CASE WHEN sum({s}_rows) OVER ({over}) > 0 THEN {s}_rows / CAST(sum({s}_rows) OVER ({over}) AS DOUBLE) ELSE 0 END", f"{s}_share") for s in SPLITS)


@query("a02_label_distribution", READINGS + f", taken AS ({spread_sql('readings', 900)}), a AS (SELECT qc AS label, count(*) AS c FROM readings GROUP BY qc), b AS (SELECT qc AS label, count(*) AS c FROM taken GROUP BY qc) "
       "SELECT CAST(a.label AS BIGINT) AS label, a.c AS full_cache, coalesce(b.c, 0) AS loaded_sample FROM a LEFT JOIN b USING (label)")
def distribution(spark, sf):
    rows = readings(spark, sf)
    return summaries.compare_distributions(rows, ordering.evenly_spaced_take(rows, 900, order=PROFILE.global_order), "qc")


@query("a03_split_distribution", PER_SOURCE + _sum_rows("split") + f" SELECT label, train_rows, validation_rows, test_rows, {_shares()} FROM counts")
def split_distribution(spark, sf):
    return summaries.split_distribution(per_source(spark, sf), "qc")


@query("a03_issue_composition", PER_SOURCE + ", bad AS (SELECT * FROM split WHERE qc IN (3, 4, 9))" + _sum_rows("bad") + f" SELECT label, train_rows, validation_rows, test_rows, {_shares()} FROM counts")
def issue_composition(spark, sf):
    return summaries.issue_composition(per_source(spark, sf), "qc", ISSUE)


BINS = READINGS + """, span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM readings), edges AS (SELECT i, lo + i * (hi - lo) // 24 AS edge FROM span, range(25) AS r(i)),
binned AS (SELECT r.*, (SELECT count(*) FROM edges e WHERE e.i BETWEEN 1 AND 23 AND e.edge < r.ts) AS bin_index FROM readings r)"""


@query("a04_time_bin_counts", BINS + f" SELECT bin_index, CAST(qc AS BIGINT) AS label, count(*) AS rows, {r9('count(*) / CAST(sum(count(*)) OVER (PARTITION BY bin_index) AS DOUBLE)', 'share')} FROM binned GROUP BY bin_index, qc")
def bin_counts(spark, sf):
    return summaries.time_bin_counts(readings(spark, sf), PROFILE, 24)


@query("a05_time_bin_summary", BINS + f""", per_label AS (SELECT bin_index, qc, count(*) AS c FROM binned WHERE qc IN (1, 3, 4, 9) GROUP BY bin_index, qc),
lead_label AS (SELECT bin_index, qc FROM (SELECT *, row_number() OVER (PARTITION BY bin_index ORDER BY c DESC, qc) AS rk FROM per_label) WHERE rk = 1)
SELECT b.bin_index, min(e1.edge) AS time_start, min(e2.edge) AS time_end, strftime(make_timestamp(min(e1.edge)), '%Y-%m-%d %H:%M') || ' -> ' || strftime(make_timestamp(min(e2.edge)), '%Y-%m-%d %H:%M') AS time_window,
count(*) AS rows, count(*) FILTER (b.qc IN (1, 3, 4, 9)) AS reviewed_rows, count(*) FILTER (b.qc NOT IN (1, 3, 4, 9)) AS unreviewed_rows,
{r9("round(100.0 * count(*) FILTER (b.qc IN (1, 3, 4, 9)) / count(*), 2)", 'reviewed_share_pct')}, count(*) FILTER (b.qc IN (3, 4, 9)) AS issue_rows,
{r9("round(100.0 * count(*) FILTER (b.qc IN (3, 4, 9)) / count(*) FILTER (b.qc IN (1, 3, 4, 9)), 2)", 'issue_share_pct')}, CAST(min(l.qc) AS BIGINT) AS dominant_label
FROM binned b JOIN edges e1 ON e1.i = b.bin_index JOIN edges e2 ON e2.i = b.bin_index + 1 LEFT JOIN lead_label l USING (bin_index) GROUP BY b.bin_index""")
def bin_summary(spark, sf):
    return summaries.time_bin_summary(readings(spark, sf), PROFILE, summaries.summary_bin_count(24, 12))


@query("a05_issue_bin_composition", BINS + f" SELECT bin_index, CAST(qc AS BIGINT) AS label, count(*) AS rows, {r9('count(*) / CAST(sum(count(*)) OVER (PARTITION BY bin_index) AS DOUBLE)', 'share')} FROM binned WHERE qc IN (3, 4, 9) GROUP BY bin_index, qc")
def issue_bins(spark, sf):
    return summaries.issue_bin_composition(readings(spark, sf), PROFILE, 24)


GAP = ", shares AS (SELECT label, " + ", ".join(f"{s}_rows / CAST(sum({s}_rows) OVER () AS DOUBLE) AS {s}_share" for s in SPLITS) + " FROM counts), gaps AS (SELECT sum(abs(train_share - validation_share)) / 2 AS a, sum(abs(train_share - test_share)) / 2 AS b, sum(abs(validation_share - test_share)) / 2 AS c FROM shares)"


@query("a06_split_share_gap", GLOBAL + _sum_rows("split") + GAP + f" SELECT {r9('greatest(a, b, c)', 'max_pairwise_total_variation')}, {r9('(a + b + c) / 3', 'mean_pairwise_total_variation')} FROM gaps")
def share_gap(spark, sf):
    return summaries.share_gap(summaries.split_distribution(global_contiguous(spark, sf), "qc"))


FLOORS = {"min_issue_rows": 200, "min_issue_share_pct": 15.0, "min_rows_per_issue_label": 60}


def adequacy_sql(source: str, by: str = "") -> str:
    return f""", tallies_{source} AS (SELECT {by}split, count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows, round(100.0 * count(*) FILTER (qc IN (3, 4, 9)) / count(*), 2) AS pct,
count(*) FILTER (qc = 3) AS flag_3_count, count(*) FILTER (qc = 4) AS flag_4_count, count(*) FILTER (qc = 9) AS flag_9_count FROM {source} GROUP BY {by}split),
adequacy_{source} AS (SELECT {by}split, rows, issue_rows, {r9('pct', 'issue_share_pct')}, issue_rows >= 200 AS meets_issue_row_floor, pct >= 15 AS meets_issue_share_floor, least(flag_3_count, flag_4_count, flag_9_count) >= 60 AS meets_per_issue_label_floor,
issue_rows >= 200 AND pct >= 15 AND least(flag_3_count, flag_4_count, flag_9_count) >= 60 AS adequate_for_model_selection, flag_3_count, flag_4_count, flag_9_count FROM tallies_{source})"""


@query("a07_issue_adequacy", PER_SOURCE + adequacy_sql("split") + " SELECT * FROM adequacy_split")
def adequacy(spark, sf):
    return summaries.issue_adequacy(per_source(spark, sf), "qc", ISSUE, **FLOORS)


TWO = (REVIEWED + interleaved_sql(64, name="blocks_split") + f", source_split AS (SELECT row_id, ts, source_file, qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY source_file) AS n FROM reviewed)), "
       "tagged AS (SELECT 'interleaved_blocks' AS strategy, * FROM blocks_split UNION ALL SELECT 'per_source_contiguous', * FROM source_split)")


def two_strategies(spark, sf):
    pair = {"interleaved_blocks": interleaved(spark, sf), "per_source_contiguous": per_source(spark, sf)}
    return cleaning.union_all([frame.withColumn("strategy", F.lit(name)) for name, frame in pair.items()])


DETAIL = ", ".join(f"max(rows) FILTER (split = '{s}') AS {s}_rows, max(issue_rows) FILTER (split = '{s}') AS {s}_issue_rows, max(issue_share_pct) FILTER (split = '{s}') AS {s}_issue_share_pct, "
                   f"max(CASE WHEN adequate_for_model_selection THEN 'yes' ELSE 'no' END) FILTER (split = '{s}') AS {s}_ok" for s in SPLITS)


@query("a08_strategy_detail", TWO + adequacy_sql("tagged", "strategy, ") + f" SELECT strategy, {DETAIL} FROM adequacy_tagged GROUP BY strategy")
def strategy_detail(spark, sf):
    return summaries.strategy_detail(summaries.issue_adequacy(two_strategies(spark, sf), "qc", ISSUE, by=["strategy"], **FLOORS))


COMPARE = (adequacy_sql("tagged", "strategy, ") + ", counts AS (SELECT strategy, qc AS label, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_rows" for s in SPLITS) + " FROM tagged GROUP BY strategy, qc), "
           "shares AS (SELECT strategy, label, " + ", ".join(f"{s}_rows / CAST(sum({s}_rows) OVER (PARTITION BY strategy) AS DOUBLE) AS {s}_share" for s in SPLITS) + " FROM counts), "
           "gaps AS (SELECT strategy, sum(abs(train_share - validation_share)) / 2 AS a, sum(abs(train_share - test_share)) / 2 AS b, sum(abs(validation_share - test_share)) / 2 AS c FROM shares GROUP BY strategy) "
           f"SELECT strategy, {r9('max(greatest(a, b, c))', 'max_split_gap')}, {r9('max((a + b + c) / 3)', 'mean_split_gap')}, "
           + ", ".join(f"max(rows) FILTER (split = '{s}') AS {s}_rows" for s in SPLITS)
           + ", max(issue_rows) FILTER (split = 'validation') AS validation_issue_rows, max(issue_share_pct) FILTER (split = 'validation') AS validation_issue_share_pct, "
           "max(CASE WHEN adequate_for_model_selection THEN 'yes' ELSE 'no' END) FILTER (split = 'validation') AS validation_ok FROM gaps JOIN adequacy_tagged USING (strategy) GROUP BY strategy")


@query("sp6_compare_strategies", TWO + COMPARE)
def compare_strategies(spark, sf):
    return summaries.compare_strategies(two_strategies(spark, sf), "qc", ISSUE, **FLOORS)


# All four strategies under one name each; the episode split brings its own steps.
FOUR = (EPISODE_SPLIT.replace("split AS (SELECT r.row_id", "by_episode AS (SELECT r.row_id") + interleaved_sql(64, name="by_block")
        + f", by_time AS (SELECT qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({G}) - 1 AS p, count(*) OVER () AS n FROM reviewed))"
        + f", by_source AS (SELECT qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY source_file) AS n FROM reviewed))"
        + ", tagged AS (" + " UNION ALL ".join(f"SELECT '{s}' AS strategy, qc, split FROM {t}" for s, t in
                                              zip(splits.STRATEGIES, ("by_time", "by_source", "by_block", "by_episode"), strict=True)) + ")")


@query("sp6_compare_all_strategies", FOUR + COMPARE.replace("gaps", "split_gaps"))
def compare_all(spark, sf):
    rows, options = reviewed(spark, sf), {"interleaved_blocks": {"block_rows": 64}, "episode_aware": {"block_rows": 32, "context_rows": 6, "merge_gap_rows": 4, "purge_gap_rows": 8}}
    cut = [splits.split_by_strategy(rows, PROFILE, s, **options.get(s, {})).withColumn("strategy", F.lit(s)) for s in splits.STRATEGIES]
    return summaries.compare_strategies(cleaning.union_all(cut), "qc", ISSUE, **FLOORS)


FUNNEL = READINGS + f", reviewed AS (SELECT * FROM readings WHERE qc IN (1, 3, 4, 9)), modelled AS ({spread_sql('reviewed', 4000)})"


@query("a09_row_funnel", FUNNEL + f""", steps AS (SELECT 'selected cache rows' AS step, count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows FROM readings
UNION ALL SELECT 'usable reviewed rows', count(*), count(*) FILTER (qc IN (3, 4, 9)) FROM reviewed UNION ALL SELECT 'reviewed modelling rows', count(*), count(*) FILTER (qc IN (3, 4, 9)) FROM modelled)
SELECT step, rows, {r9('round(100.0 * rows / max(rows) OVER (), 2)', 'share_of_selected_pct')}, issue_rows, {r9('round(100.0 * issue_rows / rows, 3)', 'issue_share_pct')} FROM steps""")
def funnel(spark, sf):
    rows = readings(spark, sf)
    return summaries.row_funnel(rows, cleaning.reviewed_target_frame(rows, PROFILE, 4000), PROFILE)


@query("a09_funnel_labels", FUNNEL + f""", merged AS (SELECT qc, 1 AS a, 0 AS b, 0 AS c FROM readings UNION ALL SELECT qc, 0, 1, 0 FROM reviewed UNION ALL SELECT qc, 0, 0, 1 FROM modelled),
counts AS (SELECT CAST(qc AS BIGINT) AS label, CAST(sum(a) AS BIGINT) AS selected_cache_rows, CAST(sum(b) AS BIGINT) AS usable_reviewed_rows, CAST(sum(c) AS BIGINT) AS reviewed_model_rows FROM merged GROUP BY qc)
SELECT *, {r9('selected_cache_rows / CAST(sum(selected_cache_rows) OVER () AS DOUBLE)', 'selected_cache_rows_share')}, {r9('usable_reviewed_rows / CAST(sum(usable_reviewed_rows) OVER () AS DOUBLE)', 'usable_reviewed_rows_share')},
{r9('reviewed_model_rows / CAST(sum(reviewed_model_rows) OVER () AS DOUBLE)', 'reviewed_model_rows_share')} FROM counts""")
def funnel_labels(spark, sf):
    rows = readings(spark, sf)
    return summaries.funnel_labels(rows, cleaning.reviewed_target_frame(rows, PROFILE, 4000), PROFILE)


OVERVIEW = f"count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows, {r9('round(100.0 * count(*) FILTER (qc IN (3, 4, 9)) / count(*), 2)', 'issue_share_pct')}, min(ts) AS time_start, max(ts) AS time_end"


@query("a10_split_overview", TWO + f" SELECT strategy, split, {OVERVIEW} FROM tagged GROUP BY strategy, split")
def split_overview(spark, sf):
    return summaries.split_overview(two_strategies(spark, sf), PROFILE, by=["strategy", "split"])


@query("a11_contiguous_label_counts", READINGS + f", split AS (SELECT qc, {cut_sql('p', 'n')} AS split FROM (SELECT *, row_number() OVER (ORDER BY source_file, ts, row_id) - 1 AS p, count(*) OVER () AS n FROM readings))"
       + _sum_rows("split", "CAST(qc AS BIGINT)") + f" SELECT label, train_rows, validation_rows, test_rows, {_shares()} FROM counts")
def contiguous_counts(spark, sf):
    return summaries.contiguous_label_counts(readings(spark, sf), "qc", order=["source_file", "ts", "row_id"], train=0.70, validation=0.15)


def scan_sql() -> str:
    parts = "".join(interleaved_sql(b, name=f"s{b}") for b in (32, 64, 128))
    union = " UNION ALL ".join(f"SELECT {b} AS block_rows, qc, split FROM s{b}" for b in (32, 64, 128))
    counts = ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_rows" for s in SPLITS)
    shares = ", ".join(f"{s}_rows / CAST(sum({s}_rows) OVER (PARTITION BY block_rows) AS DOUBLE) AS {s}_share" for s in SPLITS)
    return (parts + f", trials AS ({union}), counts AS (SELECT block_rows, qc, {counts} FROM trials GROUP BY block_rows, qc), shares AS (SELECT *, {shares} FROM counts), "
            "gaps AS (SELECT block_rows, sum(abs(train_share - validation_share)) / 2 AS a, sum(abs(train_share - test_share)) / 2 AS b, sum(abs(validation_share - test_share)) / 2 AS c, "
            + ", ".join(f"CAST(sum({s}_rows) AS BIGINT) AS {s}_rows" for s in SPLITS) + " FROM shares GROUP BY block_rows) "
            f"SELECT CAST(block_rows AS BIGINT) AS block_rows, {r9('greatest(a, b, c)', 'max_pairwise_total_variation')}, {r9('(a + b + c) / 3', 'mean_pairwise_total_variation')}, train_rows, validation_rows, test_rows FROM gaps")


@query("a12_scan_block_sizes", REVIEWED + scan_sql())
def scan_blocks(spark, sf):
    return summaries.scan_block_sizes(reviewed(spark, sf), PROFILE, "qc", sizes=(32, 64, 128))


@query("a20_time_span", READINGS + " SELECT source_file, count(*) AS rows, min(ts) AS time_start, max(ts) AS time_end FROM readings GROUP BY source_file")
def time_span(spark, sf):
    return summaries.time_span(readings(spark, sf), "ts", ["source_file"])


@query("a22_subset_overview", REVIEWED + f", spread AS ({spread_sql('reviewed', 1000)}), tagged AS (SELECT 'full_train' AS subset, qc, ts FROM reviewed UNION ALL SELECT 'time_spread', qc, ts FROM spread), avail AS (SELECT count(*) AS k FROM reviewed WHERE qc IN (3, 4, 9)) "
       f"SELECT subset, count(*) AS rows, count(*) FILTER (qc IN (3, 4, 9)) AS issue_rows, {r9('round(100.0 * count(*) FILTER (qc IN (3, 4, 9)) / count(*), 2)', 'issue_share_pct')}, CAST(NULL AS DOUBLE) AS target_issue_share_pct, "
       f"{r9('round(100.0 * least(min(k), count(*)) / count(*), 2)', 'max_possible_issue_share_pct')}, min(ts) AS time_start, max(ts) AS time_end FROM tagged, avail GROUP BY subset")
def subset_overview(spark, sf):
    rows = cleaning.reviewed_target_frame(reviewed(spark, sf), PROFILE)
    subsets = cleaning.union_all([sampling.subsample(rows, PROFILE, name, 1000).withColumn("subset", F.lit(name)) for name in ("full_train", "time_spread")])
    return summaries.subset_overview(subsets, PROFILE, balanced_share=0.4, available_issue_rows=rows.where("issue = 1").count())


@query("t12_timeline_points", TWO + f", numbered AS ({spread_sql('tagged', 150, by='strategy, split')}) SELECT strategy, split, row_id, ts FROM numbered")
def timeline(spark, sf):
    return sampling.timeline_points(two_strategies(spark, sf), PROFILE, 150).select("strategy", "split", "row_id", "ts")


@query("t12_zoom_points", REVIEWED + interleaved_sql(64) + f""", placed AS (SELECT *, row_number() OVER ({G}) - 1 AS p, count(*) OVER () AS n FROM split),
zoom AS (SELECT row_id, ts, source_file, split FROM placed WHERE p >= greatest(0, least(n, greatest(0, CAST(floor(n * CAST(0.45 AS DOUBLE)) AS BIGINT) - 600) + 1200) - 1200) AND p < least(n, greatest(0, CAST(floor(n * CAST(0.45 AS DOUBLE)) AS BIGINT) - 600) + 1200)),
taken AS ({spread_sql('zoom', 100, by='split')}) SELECT split, row_id, ts FROM taken""")
def zoom(spark, sf):
    return sampling.zoom_points(interleaved(spark, sf).drop("qc"), PROFILE, 1200, 100).select("split", "row_id", "ts")


# --- metrics -----------------------------------------------------------------

REPORT = SCORES + """, tallied AS (SELECT label, sum(a) AS actual, sum(p) AS guessed, sum(h) AS hits FROM (SELECT qc_label AS label, 1 AS a, 0 AS p, CAST(qc_label = prediction AS INT) AS h FROM scores
UNION ALL SELECT prediction, 0, 1, 0 FROM scores) GROUP BY label), report AS (SELECT label, CASE WHEN guessed > 0 THEN hits / CAST(guessed AS DOUBLE) ELSE 0 END AS precision, CASE WHEN actual > 0 THEN hits / CAST(actual AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN actual + guessed > 0 THEN 2 * hits / CAST(actual + guessed AS DOUBLE) ELSE 0 END AS f1, CAST(actual AS BIGINT) AS support, CAST(guessed AS BIGINT) AS guessed FROM tallied)"""


@query("a14_classification_report", REPORT + f" SELECT CAST(label AS BIGINT) AS label, {r9('precision', 'precision')}, {r9('recall', 'recall')}, {r9('f1', 'f1')}, support FROM report")
def report(spark, sf):
    return metrics.classification_report(scores(spark, sf), "qc_label", "prediction")


@query("a14_macro_f1", REPORT + f" SELECT {r9('avg(f1)', 'f1')} FROM report")
def macro_f1(spark, sf):
    return metrics.f1_score(scores(spark, sf), "qc_label", "prediction")


@query("a14_confusion_matrix", SCORES + ", known AS (SELECT * FROM scores WHERE qc_label IN (1, 3, 4, 9) AND prediction IN (1, 3, 4, 9)) SELECT CAST(qc_label AS BIGINT) AS label, "
       + ", ".join(r9(f"count(*) FILTER (prediction = {v}) / CAST(count(*) AS DOUBLE)", f"pred_{v}") for v in (1, 3, 4, 9)) + " FROM known GROUP BY qc_label")
def confusion(spark, sf):
    return metrics.confusion_matrix(scores(spark, sf), "qc_label", "prediction", [1, 3, 4, 9])


@query("a21_predicted_label_counts", REPORT + " SELECT CAST(label AS BIGINT) AS label, support AS true_rows, guessed AS predicted_rows FROM report")
def label_counts(spark, sf):
    return metrics.predicted_label_counts(scores(spark, sf), "qc_label", "prediction")


@query("a24_class_weights", READINGS + f" SELECT CAST(qc AS BIGINT) AS qc, count(*) AS rows, {r9('sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE)', 'weight')} FROM readings GROUP BY qc")
def class_weights(spark, sf):
    return metrics.class_weights(readings(spark, sf), "qc")


@query("a24_positive_weight", SCORES + f" SELECT {r9('count(*) FILTER (NOT is_issue) / CAST(count(*) FILTER (is_issue) AS DOUBLE)', 'positive_weight')} FROM scores")
def positive_weight(spark, sf):
    return metrics.positive_weight(scores(spark, sf).withColumn("y", F.col("is_issue").cast("int")), "y")


def threshold_sql(limits: str) -> str:
    recalls = ", ".join(f"count(*) FILTER (qc_label = {v}) AS label_{v}_rows, {r9(f'count(*) FILTER (qc_label = {v} AND error >= threshold) / CAST(count(*) FILTER (qc_label = {v}) AS DOUBLE)', f'label_{v}_recall')}" for v in (3, 4, 9))
    return f"""{limits} SELECT split, count(*) AS rows, count(*) FILTER (is_issue) AS issue_rows, threshold_source, {r9('threshold', 'threshold')}, count(*) FILTER (error >= threshold) AS predicted_anomaly_rows,
{r9('count(*) FILTER (error >= threshold AND is_issue) / CAST(count(*) FILTER (error >= threshold) AS DOUBLE)', 'precision')}, {r9('count(*) FILTER (error >= threshold AND is_issue) / CAST(count(*) FILTER (is_issue) AS DOUBLE)', 'recall')},
{r9('2 * count(*) FILTER (error >= threshold AND is_issue) / CAST(count(*) FILTER (error >= threshold) + count(*) FILTER (is_issue) AS DOUBLE)', 'f1')}, {recalls},
{r9('quantile_cont(error, 0.5)', 'median_abs_error_scaled')}, {r9('quantile_cont(error, 0.95)', 'p95_abs_error_scaled')} FROM scores, limits GROUP BY split, threshold_source, threshold"""


@query("a15_threshold_metrics", SCORES + threshold_sql(", limits AS (SELECT 'fixed' AS threshold_source, CAST(1.25 AS DOUBLE) AS threshold)"))
def threshold_metrics(spark, sf):
    return metrics.threshold_metrics(scores(spark, sf), {"fixed": 1.25}, score="error", issue_labels=ISSUE)


SWEEP = (", valid AS (SELECT * FROM scores WHERE split = 'validation'), fractions AS (SELECT CASE WHEN i = 249 THEN CAST(0.999 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) + i * ((CAST(0.999 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / 249) END AS q FROM range(250) AS r(i)), "
         "ordered AS (SELECT list(error ORDER BY error) AS es, count(*) AS n FROM valid), "
         "candidates AS (SELECT DISTINCT es[lo + 1] * (1 - (spot - lo)) + coalesce(es[lo + 2], 0) * (spot - lo) AS threshold FROM (SELECT es, (n - 1) * q AS spot, CAST(floor((n - 1) * q) AS BIGINT) AS lo FROM fractions, ordered)), "
         "tried AS (SELECT threshold, 2 * count(*) FILTER (error >= threshold AND is_issue) / CAST(count(*) FILTER (error >= threshold) + count(*) FILTER (is_issue) AS DOUBLE) AS f1 FROM valid, candidates GROUP BY threshold), "
         "best AS (SELECT threshold FROM tried ORDER BY f1 DESC, threshold LIMIT 1), limits AS (SELECT 'validation_f1_optimized' AS threshold_source, threshold FROM best"
         + "".join(f" UNION ALL SELECT 'good_q{q:g}', quantile_cont(error, {q}) FROM valid WHERE is_good" for q in metrics.GOOD_QUANTILES) + ")")


@query("a16_threshold_sweep", SCORES + threshold_sql(SWEEP))
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(scores(spark, sf), score="error", issue_labels=ISSUE)


@query("a17_ranking_metrics", SCORES + f""", steps AS (SELECT split, error, count(*) AS n, count(*) FILTER (is_issue) AS p FROM scores GROUP BY split, error),
curve AS (SELECT *, sum(n) OVER w AS seen, sum(p) OVER w AS hits, sum(n) OVER (PARTITION BY split) AS rows, sum(p) OVER (PARTITION BY split) AS pos FROM steps WINDOW w AS (PARTITION BY split ORDER BY error DESC))
SELECT split, CAST(min(rows) AS BIGINT) AS rows, CAST(min(pos) AS BIGINT) AS issue_rows, {r9('sum(p / CAST(pos AS DOUBLE) * hits / CAST(seen AS DOUBLE))', 'average_precision')},
{r9('sum(p * ((rows - pos) - (seen - hits) + (n - p) / CAST(2 AS DOUBLE))) / CAST(min(pos * (rows - pos)) AS DOUBLE)', 'roc_auc')} FROM curve GROUP BY split""")
def ranking(spark, sf):
    return metrics.ranking_metrics(scores(spark, sf), score="error")


@query("a18_score_summary", SCORES + f""", limits AS (SELECT quantile_cont(error, 0.99) AS threshold FROM scores WHERE split = 'validation' AND is_good)
SELECT split, count(*) AS rows, count(*) FILTER (is_issue) AS issue_rows, count(*) FILTER (error >= threshold) AS predicted_anomaly_rows, {r9('quantile_cont(error, 0.5)', 'median_abs_error_scaled')}, {r9('quantile_cont(error, 0.95)', 'p95_abs_error_scaled')},
{r9('2 * count(*) FILTER (error >= threshold AND is_issue) / CAST(count(*) FILTER (error >= threshold) + count(*) FILTER (is_issue) AS DOUBLE)', 'forecast_anomaly_f1')}, {r9('min(threshold)', 'forecast_error_threshold')} FROM scores, limits GROUP BY split""")
def score_summary(spark, sf):
    return metrics.score_summary(scores(spark, sf), score="error")


@query("a19_error_histogram", SCORES + """, tops AS (SELECT split, greatest(quantile_cont(error, 0.995), 1.25) AS top FROM scores GROUP BY split)
SELECT s.split, CASE WHEN error > top THEN 44 ELSE least(CAST(floor(error / (top / 44)) AS BIGINT), 43) END AS bin, count(*) FILTER (is_good) AS good_rows, count(*) FILTER (is_issue) AS issue_rows FROM scores s JOIN tops USING (split) GROUP BY ALL""")
def error_histogram(spark, sf):
    return metrics.error_histogram(scores(spark, sf), score="error", threshold=1.25)


@query("f07_quantiles", READINGS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT source_file, CAST({q} AS DOUBLE) AS fraction, {r9(f'quantile_cont(m1, {q})', 'quantile')} FROM readings GROUP BY source_file" for q in (0.0, 0.25, 0.5, 0.9, 0.995, 1.0)) + ")")
def quantiles(spark, sf):
    return metrics.exact_quantiles(readings(spark, sf), F.col("m1"), [0.0, 0.25, 0.5, 0.9, 0.995, 1.0], by="source_file")
