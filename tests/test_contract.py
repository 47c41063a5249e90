"""The registered queries against their checking SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from tickloom.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_mod.queries(), entry_mod.oracle_sql()
# a spread over all modules; the whole list runs with `python -m tickloom.oracle_check`
SAMPLE = ["listed_instruments", "normalised_bars", "panel_volatility", "pattern_retest", "forward_labels", "snapshot_append", "indicator_adx",
          "fundamental_quality", "industry_heat", "hard_veto", "pick_returns", "catalog_sql", "dual_list", "theme_named_stocks", "merged_verdicts",
          "statement_store", "pick_splits", "market_sentiment", "factor_card", "evidence_chunks"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry_runs(spark):
    assert "composite_score" in entry_mod.entry(spark).columns
