from __future__ import annotations

import pytest

import __spark_entry__ as entry
from quantsieve.plans.queries import ORACLES, QUERIES
from tests.conftest import rows

#: One of each kind here; the full list runs against the SQL in the driver's gate.
CHECKED = ["transform_all", "metric_mscore", "factor_scores", "factor_decel_factor", "rank_straight", "rank_inverted", "rank_all_null", "percentrank_inc", "scored_universe", "mscore_flag", "overall_score_scenarios", "config_weight_check", "sector_relative_scores", "screen_table", "screen_topk", "screen_topk_per_sector", "screen_filter_sector", "screen_filter_mcap", "screen_filter_score", "screen_count", "screen_bounds", "screen_facets_sector", "screen_facets_industry", "screen_export", "drill_lookup", "drill_card", "drill_chart_rows", "drill_report", "ingest_multi_file", "ingest_clean_loc", "ingest_scan", "ingest_missing_columns", "refresh_uploads", "rescore_late_rows", "quality_schema_changes", "screen_facets_ticker", "stage_raw_roundtrip", "stage_scored_roundtrip", "stage_snapshots", "quality_null_rates", "quality_counts", "quality_missing_columns", "quality_report", "quality_outliers", "parity_factors", "parity_summary", "parity_overall", "parity_mscore", "parity_coverage", "trend_scores", "trend_factors", "backtest_deciles"]


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_nan_anywhere(spark, sf_dir):
    df = QUERIES["scored_universe"](spark, sf_dir).toPandas()
    assert not any(v != v and v is not None and df[c].dtype == object for c in df for v in df[c])


def test_screen_order(spark, sf_dir):
    got = [(-r["overall_score"], r["ticker"]) for r in QUERIES["screen_table"](spark, sf_dir).collect()]
    assert got == sorted(got)
