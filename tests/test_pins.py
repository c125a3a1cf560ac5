"""Hand-made frames for the rules that Spark does not give by default."""

import datetime as dt
import math
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from xpanel import catalog
from xpanel.functions import exprs
from xpanel.operators import factors, models, panel, portfolio, stats, walkforward, xsection
from xpanel.sources import tables

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, volumes=None, symbol="A"):
    volumes = volumes or [100.0] * len(closes)
    return spark.createDataFrame([(symbol, day(i), c, c, c, c, v) for i, (c, v) in enumerate(zip(closes, volumes))], BARS)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("date").select(*columns).collect()]


def test_safe_div_in_warm_up_and_on_zero(spark):
    got = rows(factors.price_family(factors.with_returns(bars(spark, [10.0] * 6)), "momentum", (5,)), "MA_5", "ROC_5")
    assert got[:4] == [(-1.0, 0.0)] * 4 and got[4] == (0.0, 0.0)


def test_constant_price_gives_nulls_and_zeros(spark):
    r = factors.with_returns(bars(spark, [10.0] * 8))
    assert rows(factors.price_family(r, "regression", (5,)), "BETA_5", "RSQR_5", "RESI_5")[-1] == (None, None, None)
    assert rows(factors.price_family(r, "price_place", (5,)), "RSV_5", "MAX_5")[-1] == (0.0, 0.0)
    assert rows(factors.price_family(r, "price_volume", (5,)), "CORR_5")[-1] == (None,)


def test_regression_of_a_line(spark):
    r = factors.price_family(factors.with_returns(bars(spark, [10.0 + i for i in range(6)])), "regression", (5,))
    beta, rsqr, resi = rows(r, "BETA_5", "RSQR_5", "RESI_5")[4]
    assert beta == pytest.approx(0.1) and rsqr == pytest.approx(1.0) and resi == pytest.approx(0.0, abs=1e-12)


def test_first_of_tied_extremes(spark):
    r = factors.price_family(factors.with_returns(bars(spark, [1.0, 5.0, 5.0, 2.0, 1.0])), "time_place", (5,))
    assert rows(r, "IMAX_5", "IMIN_5")[-1] == (3 / 5, 4 / 5)


def test_counts_start_a_row_before_sums(spark):
    r = factors.with_returns(bars(spark, [1.0, 2.0, 3.0, 2.0, 3.0, 4.0]))
    got = rows(factors.price_family(factors.price_family(r, "up_down_counts", (5,)), "up_down_sums", (5,)), "CNTP_5", "SUMP_5")
    assert got[4][0] == pytest.approx(3 / 5) and got[4][1] is None and got[5][1] is not None


def test_zero_volume(spark):
    r = factors.weighted_spread(factors.with_returns(bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [0.0] * 5)))
    assert rows(r, "WVMA_5")[-1] == (0.0,)


def test_clip_keeps_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x UNION ALL SELECT -1D")
    assert {r[0] for r in df.select(exprs.at_least(F.col("x"), 0)).collect()} == {None, 0.0}


def test_average_rank_and_correlation_of_ties(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("d", 3.0)], "date string, v double")
    assert sorted(r[0] for r in df.select(exprs.average_rank("v", "date")).collect()) == [1.5, 1.5, 3.0]
    assert df.groupBy("date").agg(exprs.group_correlation("v", "v")).first()[1] == pytest.approx(1.0)
    assert df.withColumn("c", F.lit(2.0)).groupBy("date").agg(exprs.group_correlation("v", "c")).first()[1] is None


def test_asof_takes_the_latest_known_value(spark):
    left = bars(spark, [1.0, 2.0, 3.0]).select("symbol", "date")
    right = spark.createDataFrame([("A", day(-1), 7.0), ("A", day(1), 8.0)], "symbol string, date date, v double")
    assert rows(factors.asof_join(left, right, "symbol", ["v"]), "v") == [(7.0,), (8.0,), (8.0,)]


def test_months_stay_clamped_and_windows_do_not_leak():
    w = walkforward.window_bounds(dt.date(2023, 1, 31), dt.date(2024, 12, 31), train=1, step=1)
    starts = [x[1] for x in w]
    assert starts[1] == dt.date(2023, 2, 28) and starts[2] == dt.date(2023, 3, 28)
    assert all(x[2] < x[3] and x[4] == x[5] for x in w)


#: The last train date's bound and the test ranges of the published report's 19 monthly windows, from 2023-09-27.
PUBLISHED_TRAIN_ENDS = [dt.date(2024 + (8 + i) // 12, (8 + i) % 12 + 1, 17) for i in range(19)]
PUBLISHED_TESTS = [(dt.date(2024 + (9 + i) // 12, (9 + i) % 12 + 1, 27), dt.date(2024 + (10 + i) // 12, (10 + i) % 12 + 1, 27)) for i in range(19)]


def test_windows_are_the_published_ones():
    w = walkforward.window_bounds(dt.date(2023, 9, 27), dt.date(2026, 6, 20))
    assert w[0][1:] == (dt.date(2023, 9, 27), dt.date(2024, 9, 17), dt.date(2024, 10, 2), dt.date(2024, 10, 27), dt.date(2024, 10, 27), dt.date(2024, 11, 27))
    assert [x[2] for x in w] == PUBLISHED_TRAIN_ENDS and [(x[5], x[6]) for x in w] == PUBLISHED_TESTS
    assert w[-1][2] == dt.date(2026, 3, 17) and w[-1][5:] == (dt.date(2026, 4, 27), dt.date(2026, 5, 27))


def test_excess_weight_is_handed_on_in_equal_parts():
    assert walkforward.capped({"a": 0.7, "b": 0.2, "c": 0.08, "d": 0.02}) == pytest.approx({"a": 0.4, "b": 0.3, "c": 0.18, "d": 0.12})
    assert walkforward.capped({"a": 0.7, "b": 0.3}) == pytest.approx({"a": 0.5, "b": 0.5})


def test_cap(spark):
    assert walkforward.capped({"a": 5.0}) == {"a": 1.0}
    assert walkforward.capped({"a": 5.0, "b": 5.0}) == {"a": 0.5, "b": 0.5}
    got = walkforward.capped({"a": 6.0, "b": 2.0, "c": 2.0})
    assert got["a"] == pytest.approx(0.4) and sum(got.values()) == pytest.approx(1.0)


def test_quantile_grades_with_thin_days_and_ties(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 1.0), ("2024-01-01", "B", 2.0)] + [("2024-01-02", s, 3.0) for s in "ABCDE"] + [("2024-01-03", s, float(i)) for i, s in enumerate("ABCDE")], "date string, symbol string, y double")
    got = {(r.date, r.symbol): r.grade for r in xsection.relevance_grades(df, "y").collect()}
    assert got[("2024-01-01", "A")] == 2 and got[("2024-01-02", "C")] == 2
    assert [got[("2024-01-03", s)] for s in "ABCDE"] == [0, 1, 2, 3, 4]


def newey(x, lag=5):
    n, m = len(x), sum(x) / len(x)
    d = [v - m for v in x]
    lrv = sum(v * v for v in d) / n
    for k in range(1, lag + 1):
        lrv += 2 * (1 - k / (lag + 1)) * sum(a * b for a, b in zip(d[k:], d[:-k])) / (n - k)
    return m / math.sqrt(max(lrv, 1e-12) / n)


def test_newey_west(spark):
    x = [math.sin(i) + 0.3 for i in range(30)]
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate(x)], "date date, v double")
    assert stats.newey_west(df, "v").first()["t_nw"] == pytest.approx(newey(x))
    assert stats.newey_west(df.limit(10), "v").first()["t_nw"] == 0.0
    assert stats.normal_p_value(spark.sql("SELECT 1.959964D AS t_nw")).first()["p_value"] == pytest.approx(0.05, abs=1e-6)


#: cs_ic, icir and spread_net of 19 published test windows, and their published averages.
PUBLISHED = [
    (0.0227, 0.2133, 0.5542),
    (0.0018, 0.013, -0.414),
    (-0.0215, -0.1537, -6.3181),
    (-0.026, -0.2297, -2.5191),
    (-0.0915, -0.2652, 1.5532),
    (0.0592, 0.2786, 1.3632),
    (0.0893, 0.4716, 0.4737),
    (-0.0203, -0.1711, 0.3564),
    (0.0022, 0.0357, 1.213),
    (-0.0428, -0.6269, 0.5875),
    (-0.0118, -0.2269, 1.5056),
    (0.0212, 0.222, 0.2415),
    (-0.0293, -0.089, 1.055),
    (0.0452, 0.1648, 1.9097),
    (0.0055, 0.0793, 9.3738),
    (0.0175, 0.207, 2.0544),
    (0.0316, 0.1401, 1.7814),
    (0.1616, 1.7499, 6.7146),
    (0.0911, 0.6617, 3.6105),
]
HEADLINE = dict(avg_cs_ic=0.0161, avg_cs_icir=0.1302, avg_spread_net=1.3209, pct_positive_spread_net=0.8421)


def test_significance_of_published_windows(spark):
    windows = spark.createDataFrame(PUBLISHED, "cs_ic double, icir double, spread_net double")
    ics = spark.createDataFrame([(day(i), 0.01 * math.sin(i)) for i in range(30)], "date date, ic double")
    got = stats.significance_summary(windows, ics).first()
    for k, v in HEADLINE.items():
        assert got[k] == pytest.approx(v, abs=1e-3 if k == "avg_spread_net" else 1e-4)
    assert got["n_windows"] == 19 and not got["is_significant"]


def brute_portfolio(data, k, rebal, cost):
    dates, out = sorted({d for d, *_ in data}), {}
    by = {d: sorted([r for r in data if r[0] == d], key=lambda r: (-r[2], r[1])) for d in dates}
    for offset in range(rebal):
        hold = None
        for i, d in enumerate(dates):
            g, c = by[d], 0.0
            if len(g) < 4 * k:
                continue
            if hold is None or i % rebal == offset:
                new = {r[1] for r in g[:k]}
                if hold is not None:
                    c = (1 - len(new & hold) / k) * 2 * cost / 10000 * 100
                hold = new
            held = [r[3] for r in g if r[1] in hold]
            if held:
                out.setdefault(d, []).append(sum(held) / len(held) - c)
    return {d: sum(v) / len(v) for d, v in out.items()}


def test_staggered_portfolio_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    data = [(day(i), f"S{s}", round(rng.random(), 3), rng.gauss(0, 1)) for i in range(14) for s in range(9) if not (i == 4 and s > 4) and rng.random() > 0.03]
    df = spark.createDataFrame(data, "date date, symbol string, score double, y double")
    got = {r["date"]: r["ret"] for r in portfolio.staggered_portfolio(df, "y", 2, 5, (10,)).collect()}
    want = brute_portfolio(data, 2, 5, 10)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_no_look_ahead(spark):
    closes = [10 + math.sin(i) * 3 + i * 0.1 for i in range(70)]
    make = lambda c: factors.price_family(factors.with_returns(bars(spark, c)), "regression", (20,))
    assert rows(make(closes), "BETA_20", "RESI_20")[:50] == rows(make(closes[:50]), "BETA_20", "RESI_20")


def test_universe_cleaning(spark):
    df = spark.createDataFrame([(0, " BRK.B ", " Fin "), (1, "BRK-B", "Other"), (2, None, "x")], "ord int, symbol string, sector string")
    assert [tuple(r) for r in tables.clean_universe(df).collect()] == [(0, "BRK-B", "Fin")]


def test_macro_markers_are_dropped(spark):
    df = spark.createDataFrame([("V", "2024-01-01", "."), ("V", "2024-01-02", ""), ("V", "2024-01-03", "1.5"), ("V", "bad", "2")], "series_id string, date string, value string")
    assert [r["value"] for r in tables.clean_macro(df).collect()] == [1.5]


def test_panel_without_optional_blocks_keeps_rows_and_reads_back(spark, tmp_path):
    closes = [100 + 5 * math.sin(i / 3) + i * 0.2 for i in range(110)]
    b = bars(spark, closes, [100.0 + (i * 37) % 50 for i in range(110)]).withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 1)
    built = panel.build_panel(b)
    assert len(panel.model_inputs(built)) == 165 + 24 + 5  # price, single-symbol extras, event proxies
    tables.write_panel(built, str(tmp_path / "p"))
    back = tables.read_panel(spark, str(tmp_path / "p"), ["symbol", "date", "ROC_20"])
    assert back.count() == built.count() > 0
    assert "ROC_20" in panel.project(built).columns


def test_models_learn_a_planted_signal(spark):
    import random

    rng = random.Random(1)
    data = [(day(i), f"S{s}", x := rng.random(), rng.random(), 5 * x + rng.random() * 0.1) for i in range(40) for s in range(10)]
    df = spark.createDataFrame(data, "date date, symbol string, x double, z double, future_return_5d double")
    train, val = df.filter(F.col("date") < day(30)), df.filter(F.col("date") >= day(30))
    fitted, metrics = models.fit_horizons(train, val, ["x", "z"], (5,), trees=5)
    assert metrics.first()["ic"] > 0.9
    assert models.feature_importance(spark, fitted, ["x", "z"]).first()["feature"] == "x"
    assert models.fit_horizons(train.limit(5), val, ["x"], (5,)) == ({}, None)
    w = models.residual_weights(train, ["x", "z"], "future_return_5d", 1, 0.5, 2)
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_empty_inputs(spark):
    empty = bars(spark, [])
    assert panel.build_panel(empty).count() == 0
    scored = spark.createDataFrame([], "date date, symbol string, score double, y double")
    assert xsection.daily_rank_ic(scored, "score", "y", 5).count() == 0
    assert portfolio.staggered_portfolio(scored, "y", 2).count() == 0


def test_walk_forward_query_tests_the_whole_history(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog.jobs, "walk_forward", lambda spark, rows, *a, **k: seen.update(k) or spark.range(1))
    catalog.m6_walk_forward(spark, DATA)
    bounds = walkforward.window_bounds(dt.date(2020, 1, 1), dt.date(2026, 5, 1), **(seen.get("steps") or {}))
    assert len(bounds) >= 60 and all(a[6] == b[5] for a, b in zip(bounds, bounds[1:]))


def test_regime_query_takes_the_regime(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog.models, "regime_model", lambda spark, rows, *a, **k: seen.update(k) or spark.range(1))
    catalog.m13_regime_model(spark, DATA)
    assert seen.get("threshold", 0.0) == 0 and seen.get("least", (500, 300, 50)) == (500, 300, 50)


def test_overlapping_windows_give_one_score(spark):
    twice = [(r["date"], r["symbol"], r["window"]) for r in catalog._blend(spark, DATA, catalog.OVERLAPPING).collect()]
    last = {}
    for day, symbol, window in twice:
        last[day, symbol] = max(window, last.get((day, symbol), -1))
    got = Counter((str(r["date"]), r["symbol"], r["window"]) for r in catalog.m9_overlapping_scores(spark, DATA).collect())
    assert len(twice) > len(last) and got == Counter((str(d), s, w) for (d, s), w in last.items())


def test_whole_universe_is_cleaned_beyond_the_first_rows(spark):
    path = "/root/testdata/sf0.01"
    first, whole = ({r["symbol"] for r in q(spark, path).collect()} for q in (catalog.s3_universe, catalog.s3_whole_universe))
    assert first < whole and len(whole) == 100
