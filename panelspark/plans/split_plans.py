"""Twins of registered queries that take the cross-section's split plan whatever the number of names.

The split plan is the one for groups that no bound covers. Its rows have to equal the oracle's like those of the window
plan, so each twin is registered with the same SQL.
"""

from __future__ import annotations

from .registry import REGISTRY, Query

NAMES = """cs_rank_pct cs_winsor cs_factorneut cs_indneut within_sector_rank rank_to_unit market_neutral_target top_n_mask
prediction_metrics rank_ic_ordinal_ties momentum_ic_summary ic_decay quantile_legs book_staggered decile_backtest
sort_group_returns alpha_fitness terminals holm benjamini_hochberg cs_rank_ordinal cs_remove_middle top_n_per_group half_sample_ics
long_short_by_date run_report training_table cross_section_inputs""".split()
SETTING = "panelspark.crosssection.plan"


def _twin(query: Query) -> Query:
    def run(spark, sf_dir):
        before = spark.conf.get(SETTING, None)
        spark.conf.set(SETTING, "split")
        try:
            return query.run(spark, sf_dir)
        finally:
            spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)

    return Query(f"{query.name}_split_plan", run, query.sql)


def add_twins() -> None:
    for name in NAMES:
        if f"{name}_split_plan" not in REGISTRY:
            twin = _twin(REGISTRY[name])
            REGISTRY[twin.name] = twin
