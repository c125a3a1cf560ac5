"""Queries against their SQL at the smallest scale; the names cover every module."""

import math

import pytest
from conftest import DATA, WIDE

from xpanel import catalog

NAMES = [
    "s1_bars", "s2_macro", "f_regression", "f_time_place", "f_weighted_spread", "f_market_relative", "f_higher_moments", "f_flow", "f_macro", "j3_macro_join", "j2_asof_union",
    "f_forward_labels", "x2_tail_labels", "x3_relevance_grades", "x4_daily_rank_ic", "x7_bucket_returns", "m1_windows", "m3_select_features", "m9_dedupe_scores",
    "m5_reweighting",
]
WIDE_NAMES = ["x6_topk_return", "x8_long_short", "j7_rebalance_map", "a3_staggered_portfolio", "a4_long_excess", "a5_perf_stats", "a6_portfolio_report", "a7_equity_curve", "a8_significance"]


def canonical(df):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df)]
    return list(df), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = canonical(catalog.queries()[name](spark, DATA).toPandas())
    want = canonical(duck.execute(catalog.oracle_sql()[name]).fetchdf())
    assert got == want


@pytest.mark.parametrize("name", WIDE_NAMES)
def test_portfolio_query_equals_sql(spark, wide_duck, name):
    got = canonical(catalog.queries()[name](spark, WIDE).toPandas())
    assert len(got[1]) > 0 and got == canonical(wide_duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
