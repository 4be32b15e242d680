"""Every query with an SQL counterpart, compared in DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    text, good, _ = compare(spark, connection, name, queries()[name], ORACLES[name], SF)
    assert good, text


# The operators that cross chunk edges, once more with many tiny chunks.
EDGES = ["a01_window_features", "w04_rolling_features_global", "w05_label_runs", "w07_merge_labelled_intervals", "w09_issue_episodes", "w11_forecast_windows",
         "t04_balanced_stratified_subset", "sp4_episode_aware", "j01_nearest_join", "a16_threshold_sweep", "a17_ranking_metrics", "t11_panel_scores"]


@pytest.mark.parametrize("name", EDGES)
def test_matches_sql_in_small_chunks(small_chunks, connection, name):
    text, good, _ = compare(small_chunks, connection, name, queries()[name], ORACLES[name], SF)
    assert good, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
