"""Layout of written tables: what a later pass need not move or write again."""

import datetime as dt
import os
import random

from conftest import DATA
from pyspark.sql import functions as F

from xpanel.operators import factors, panel
from xpanel.sources import adapter, tables


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_factor_pass_over_written_bars_has_no_exchange(spark, tmp_path):
    bars, path = adapter.bars(spark, DATA), str(tmp_path / "bars")
    tables.write_bars(bars, "bars_of_a_test", path, 8)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 8
    names = panel.CORE[:12]
    make = lambda df: panel.build_panel(df, only=names)
    want = sorted(map(tuple, make(bars).collect()))
    for known in (True, False):
        if not known:  # another session: the folder alone
            spark.sql("DROP TABLE bars_of_a_test")
        built = make(tables.open_bars(spark, "bars_of_a_test", path, 8))
        assert "Exchange" not in plan_of(built) and "Exchange" in plan_of(make(bars))
        assert sorted(map(tuple, built.collect())) == want
    spark.sql("DROP TABLE bars_of_a_test")
    assert factors.with_returns(spark.read.parquet(path)).count() == bars.count()


def files_by_year(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("year=")}


def test_a_new_month_rewrites_its_year_alone(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=9 * i) for i in range(120)]
    rows = [(d, s, rng.random(), rng.random()) for d in days for s in "abc"]
    frame = lambda r: spark.createDataFrame(r, "date date, symbol string, close double, f double")
    old, new = [r for r in rows if r[0] < dt.date(2022, 6, 1)], [r for r in rows if r[0] >= dt.date(2022, 6, 1)]
    tables.write_panel(frame(old), path)
    before = files_by_year(path)
    assert set(before) == {"year=2020", "year=2021", "year=2022"}
    corrected = (old[-1][0], old[-1][1], -1.0, -2.0)
    tables.merge_panel(frame([*new, corrected]), path)
    after = files_by_year(path)
    assert {y for y in after if after[y] != before.get(y)} == {"year=2022"}
    got = sorted(map(tuple, tables.read_panel(spark, path, ["date", "symbol", "close", "f"]).collect()))
    assert got == sorted([*old[:-1], corrected, *new])
    tables.merge_panel(frame([(dt.date(2023, 1, 2), "a", 1.0, 2.0)]).withColumn("g", F.lit(3.0)), path)
    assert {y for y in files_by_year(path) if files_by_year(path)[y] != after.get(y)} == {"year=2023"}


def test_a_panel_is_written_without_an_exchange_of_its_rows(spark, tmp_path, monkeypatch):
    seen = []
    made = tables._by_year
    rows = spark.range(60).selectExpr("date_add(date'2020-01-01', cast(id * 20 as int)) AS date", "concat('s', id % 3) AS symbol", "cast(id AS double) AS f").repartition(3, "symbol")
    monkeypatch.setattr(tables, "_by_year", lambda df: seen.append(made(df)) or seen[-1])
    tables.write_panel(rows, str(tmp_path))
    assert seen[0]._df._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1  # the rows' own
    assert set(files_by_year(str(tmp_path))) == {"year=2020", "year=2021", "year=2022", "year=2023"}
    assert sorted(map(tuple, tables.read_panel(spark, str(tmp_path), rows.columns).collect())) == sorted(map(tuple, rows.collect()))
