"""Parity with DuckDB on the smallest tables; PANELSPARK_FULL=1 runs every registered query."""

from __future__ import annotations

import os

import pytest

from panelspark.plans import load_all

from .check import compare, connect

SF = os.environ.get("PANELSPARK_SF", "/root/testdata/sf0.001")
QUICK = """weekly_panel momentum_ic_summary ts_mean_sum_max_min ts_skew ts_rank ts_decay_ewm ts_corr window_drawdown
volume_z_split_invariant cs_rank_pct cs_winsor cs_factorneut rank_to_unit market_neutral_target top_n_mask ic_decay
book_nonoverlapping book_staggered decile_backtest sort_group_returns monotonic_relation_test regime_filter
regime_regression mixture_responsibilities spell_membership membership_rollback link_on_date link_ambiguities
sector_on_date company_market_equity availability_dates pit_fundamentals earnings_surprise carry_forward_staleness
execution_lagged_label walk_forward_folds calendar_year_folds balanced_sample holm benjamini_hochberg sharpe_and_psr
missing_return_split panel_validation weighted_ridge calendar_features seasonality_2_5 earnings_timing
alpha_reversal_earnings_gated read_delimited stream_incremental_extract stream_regime_filter""".split()
ALL = load_all()
NAMES = [n for n, q in ALL.items() if q.sql] if os.environ.get("PANELSPARK_FULL") else QUICK


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    q = ALL[name]
    ok, message = compare(q.run(spark, SF), duck, q.sql)
    assert ok, message


def test_every_query_builds_without_a_session_at_import():
    assert len(ALL) > 250
    assert all(q.sql is None or q.sql.strip() for q in ALL.values())
