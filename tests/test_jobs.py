"""Rolling windows, places, readers and the batch jobs against plain computations."""

import datetime as dt
import json
import math
import random
import statistics
from glob import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from xpanel.functions.places import medians, value_places, with_average_rank
from xpanel.functions.rolling import Rolling
from xpanel.operators import factors, models, panel, walkforward
from xpanel.plans import jobs
from xpanel.sources import tables

DAY = dt.date(2020, 1, 6)


def series(spark, values, symbol="A"):
    rows = [(symbol, DAY + dt.timedelta(days=i), a, b) for i, (a, b) in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, a double, b double")


@pytest.mark.parametrize("w", [5, 10, 20, 30, 60])
def test_wide_windows_equal_pandas(spark, w):
    rng = random.Random(w)
    values = [(rng.choice([None, 1e6]) if rng.random() < 0.03 else 1e6 + rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(200)]
    r = Rolling()
    made = {"sum": r.total("a", w), "hi": r.highest("a", w), "lo": r.lowest("a", w), "sd": r.std("a", w), "corr": r.correlation("a", "b", w)}
    got = r.add(series(spark, values)).withColumns(made).select("date", *made).orderBy("date").toPandas()
    a, b = (pd.Series([v[i] for v in values], dtype=float) for i in (0, 1))
    roll = a.rolling(w)
    want = {"sum": roll.sum(), "hi": roll.max(), "lo": roll.min(), "sd": pd.Series([a[i - w + 1 : i + 1].std() if i >= w - 1 and a[i - w + 1 : i + 1].notna().all() else np.nan for i in range(len(a))])}
    want["corr"] = pd.Series([np.corrcoef(a[i - w + 1 : i + 1], b[i - w + 1 : i + 1])[0, 1] if i >= w - 1 and a[i - w + 1 : i + 1].notna().all() else np.nan for i in range(len(a))])
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x, rtol=1e-7, atol=1e-9, err_msg=name)


def test_constant_windows_have_no_spread(spark):
    r = Rolling()
    made = {"sd": r.std("a", 60), "corr": r.correlation("a", "b", 60)}
    got = r.add(series(spark, [(0.1, float(i)) for i in range(70)])).withColumns(made).orderBy("date").collect()
    assert got[-1]["sd"] == 0.0 and got[-1]["corr"] is None and got[58]["sd"] is None


def test_places_ranks_and_medians_equal_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([None, 1.0, 2.0, rng.random(), rng.gauss(0, 50)])) for _ in range(3000)] + [("one", 7.0)]
    df, pdf = spark.createDataFrame(rows, "k string, v double"), pd.DataFrame(rows, columns=["k", "v"])
    want = sorted(zip(pdf["k"], pdf["v"], pdf.groupby("k")["v"].rank()), key=str)
    got = sorted(((r["k"], math.nan if r["v"] is None else r["v"], math.nan if r["r"] is None else r["r"]) for r in with_average_rank(df, "v", "r", "k").collect()), key=str)
    assert list(map(str, got)) == list(map(str, want))
    assert {r["k"]: r["m"] for r in medians(df, "v", "m", "k").collect()} == pytest.approx(pdf.groupby("k")["v"].median().to_dict())
    assert value_places(df.filter("k = 'one'"), "v", "k").first()[1:] == (7.0, 1, 0, 1)
    assert with_average_rank(df.limit(0), "v", "r", "k").count() == 0


def test_asof_join_without_a_key(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 5, 9)] + [("B", dt.date(2024, 1, 5))], "symbol string, date date")
    right = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0), (dt.date(2024, 1, 5), 2.0), (dt.date(2024, 1, 7), 3.0)], "date date, v double")
    got = {(r["symbol"], r["date"].day): r["v"] for r in factors.asof_join(left, right, None, ["v"]).collect()}
    assert got == {("A", 1): None, ("A", 5): 2.0, ("A", 9): 3.0, ("B", 5): 2.0}


def test_readers_reject_broken_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("series_id,date,value\nVIXCLS,2024-01-02,13.5\nVIXCLS,2024-01-03,.\nVIXCLS,bad,1\nVIXCLS,2024-01-04,\n")
    assert [tuple(r) for r in tables.read_macro(spark, str(tmp_path / "m.csv")).collect()] == [("VIXCLS", dt.date(2024, 1, 2), 13.5)]
    (tmp_path / "u.csv").write_text("symbol,sector,snapshot_date\n BRK.B ,Financials ,2024-01-01\nBRK-B,Other,2024-01-01\nAAPL,Tech,2024-01-01\n")
    assert sorted((r["symbol"], r["sector"]) for r in tables.read_universe(spark, str(tmp_path / "u.csv")).collect()) == [("AAPL", "Tech"), ("BRK-B", "Financials")]
    assert [r["symbol"] for r in tables.read_universe(spark, str(tmp_path / "u.csv"), 1).collect()] == ["BRK-B"]
    spark.createDataFrame([("A", DAY, 1.0, 1.0, 1.0, 1.0, 1.0), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0), ("B", None, 1.0, 1.0, 1.0, 1.0, 1.0)], tables.BARS).write.parquet(str(tmp_path / "bars"))
    assert [r["symbol"] for r in tables.read_bars(spark, str(tmp_path / "bars")).collect()] == ["A"]


def test_stacked_panels_keep_all_columns(spark):
    a, b = spark.createDataFrame([("A", 1.0)], "symbol string, x double"), spark.createDataFrame([("B", 2.0)], "symbol string, y double")
    assert sorted(map(tuple, tables.stack([a, b]).collect())) == [("A", 1.0, None), ("B", None, 2.0)]


def test_panel_makes_only_what_is_asked_for(spark):
    rng = random.Random(1)
    rows = [("A", DAY + dt.timedelta(days=i), *[100 + rng.random() for _ in range(4)], 10.0 + rng.random()) for i in range(120)]
    bars = spark.createDataFrame([(s, d, o, max(o, h, lo, c), min(o, h, lo, c), c, v) for s, d, o, h, lo, c, v in rows], tables.BARS)
    some = panel.build_panel(bars, only=("MA_5", "MFI_14"))
    assert set(some.columns) == {"symbol", "date", "close", "MA_5", "MFI_14", *(f"future_{k}_{h}d" for k in ("return", "up") for h in factors.HORIZONS)}
    assert some.count() > panel.build_panel(bars).count() > 0  # rows that lack other factors stay


def learnable(spark, days=420, names=12):
    rng = random.Random(7)
    rows = []
    for d in range(days):
        for s in range(names):
            x = rng.gauss(0, 1)
            rows.append((DAY + dt.timedelta(days=d), f"S{s:02d}", x, *[rng.gauss(0, 1) + 0.3 * x for _ in range(4)], 2 * x + rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "date date, symbol string, ROCP_1 double, f2 double, f3 double, f4 double, f5 double, future_return_5d double")


FEATURES = ["ROCP_1", "f2", "f3", "f4", "f5"]
STEPS = dict(train=6, val=2, test=2, step=2)


def reports(path):
    return [json.loads(line) for f in glob(f"{path}/*.json") for line in open(f)]


@pytest.mark.parametrize("task", models.TASKS)
def test_walk_forward_writes_scores_and_window_reports(spark, tmp_path, task):
    rows = learnable(spark)
    got = jobs.walk_forward(spark, rows, FEATURES, str(tmp_path), trees=4, k=2, steps=STEPS, task=task).first()
    bounds = walkforward.window_bounds(DAY, DAY + dt.timedelta(days=419), **STEPS)
    windows = reports(tmp_path / "window_reports")
    assert [w["window"] for w in sorted(windows, key=lambda w: w["window"])] == [b[0] for b in bounds] and got["n_windows"] == len(bounds)
    assert all(w["n_features"] == 5 and w["cs_ic"] > 0.3 and w["spread"] > 0 and w["dir_acc"] > 0.5 for w in windows)
    assert {(w["test_start"], w["test_end"]) for w in windows} == {(str(b[5]), str(b[6])) for b in bounds}
    assert got["avg_dir_acc"] == pytest.approx(statistics.mean(w["dir_acc"] for w in windows)) and got["std_dir_acc"] == pytest.approx(statistics.pstdev(w["dir_acc"] for w in windows))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.groupBy("date", "symbol").count().filter("count > 1").isEmpty() and scores.count() == 12 * sum((b[6] - b[5]).days for b in bounds)


def test_walk_forward_on_neutral_labels_with_two_families(spark, tmp_path):
    """Labels moved by a date's own shift: the models are fitted for labels without it, scores are measured against the labels as they are."""
    rows = learnable(spark).withColumn("future_return_5d", F.col("future_return_5d") + 50 * F.sin(F.dayofyear("date").cast("double")))
    families = {"linear": models.SparkEstimator("linear"), "boosted": models.SparkEstimator(trees=4)}
    got = jobs.walk_forward(spark, rows, FEATURES, str(tmp_path), k=2, steps=STEPS, families=families, neutral=True).first()
    assert got["avg_cs_ic"] > 0.5
    made = spark.read.parquet(*glob(f"{tmp_path}/predictions/*/test"))
    assert {r["model"] for r in made.select("model").distinct().collect()} == {"5d:linear", "5d:boosted"}
    assert made.join(rows.select("date", "symbol", F.col("future_return_5d").alias("given")), ["date", "symbol"]).filter("given <> future_return_5d").isEmpty()
    assert made.agg(F.max(F.abs("prediction"))).first()[0] < 20


def test_thin_windows_are_left_out(spark, tmp_path):
    few = (F.col("symbol") == "S00") & (F.dayofyear("date") % 2 == 0)  # 15 rows a month
    thin = learnable(spark).filter(few | (F.col("date") < DAY + dt.timedelta(days=300)))
    jobs.walk_forward(spark, thin, FEATURES, str(tmp_path), trees=2, k=2, steps=STEPS | dict(val=1, test=1, step=1, train=3))
    for w in reports(tmp_path / "window_reports"):
        assert dt.date.fromisoformat(w["test_start"]) < DAY + dt.timedelta(days=300)


def test_tail_walk_forward_and_comparison_over_common_dates(spark, tmp_path):
    rows = learnable(spark, names=20)
    tail = jobs.tail_walk_forward(spark, rows, FEATURES, str(tmp_path), "future_return_5d", 4, steps=STEPS)
    other = rows.filter(F.col("date") > DAY + dt.timedelta(days=300)).withColumn("score", -F.col("ROCP_1"))
    got = {r["name"]: r for r in jobs.compare_scores({"tail": tail, "other": other}, "future_return_5d", 5, (2,), 2).collect()}
    days = {r["date"] for r in tail.select("date").distinct().collect()} & {r["date"] for r in other.select("date").distinct().collect()}
    assert got["tail"]["n_days"] == got["other"]["n_days"] == len(days)
    assert got["tail"]["cs_ic"] > 0.3 and got["tail"]["spread_2"] > 0 and got["other"]["cs_ic"] < -0.5 and got["other"]["spread_2"] < 0


def test_portfolio_from_written_scores(spark, tmp_path):
    rows = learnable(spark, days=40, names=20).withColumnRenamed("future_return_5d", "future_return_1d")
    tables.write_scores(rows.select("date", "symbol", F.col("ROCP_1").alias("score")), str(tmp_path / "s"))
    bench = spark.createDataFrame([(DAY + dt.timedelta(days=i), 100.0 + 0.01 * i) for i in range(41)], "date date, close double")
    got = {r["cost_bps"]: r for r in jobs.portfolio_report(spark.read.parquet(str(tmp_path / "s")), rows, bench, 5).collect()}
    assert set(got) == {10.0, 20.0, 30.0} and all(r["n_days"] == 40 for r in got.values())
    assert got[10.0]["total_return_pct"] > got[20.0]["total_return_pct"] > got[30.0]["total_return_pct"] and got[10.0]["excess_ann_pct"] > 0
