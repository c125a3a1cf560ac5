"""Named queries over the driver tables and their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xpanel import oracle
from xpanel.functions.exprs import change, rounded
from xpanel.functions.rolling import Rolling
from xpanel.operators import factors, models, panel, portfolio, ranks, stats, walkforward, xsection
from xpanel.plans import jobs, publish
from xpanel.sources import adapter, scratch, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ("date",)):
    """Register a query; its date columns leave as text (ISO), in the SQL too, so that engines need not agree on a date type."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "date"})

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            texts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return register


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.with_returns(adapter.bars(spark, sf_dir))


def _only(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return rounded(df.select("symbol", "date", *names), digits)


@query(f"WITH {oracle.BARS.strip()} SELECT * FROM bars")
def s1_bars(spark, sf_dir):
    return adapter.bars(spark, sf_dir)


@query(f"WITH {oracle.BARS.strip()} SELECT * FROM bars")
def s1_read_bars(spark, sf_dir):
    """Bars written as a table, with rows that lack a key among them, and read by the reader."""
    path, bars = scratch.folder(spark), adapter.bars(spark, sf_dir)
    broken = bars.limit(5).withColumn("symbol", F.lit(None).cast("string")).unionByName(bars.limit(5).withColumn("date", F.lit(None).cast("date")))
    bars.unionByName(broken).write.parquet(path)
    return tables.read_bars(spark, path)


def _family(family: str) -> Query:
    def run(spark, sf_dir):
        return _only(factors.price_family(_returns(spark, sf_dir), family), factors.price_names(family))

    run.__name__ = f"f_{family}"
    return run


for _name in factors.PRICE_FAMILIES:
    query(oracle.family(_name))(_family(_name))


@query(oracle.weighted_spread())
def f_weighted_spread(spark, sf_dir):
    """In prices, of the order of 10^4: four decimals are nine digits in all."""
    return _only(factors.weighted_spread(_returns(spark, sf_dir)), [f"WVMA_{w}" for w in factors.WIDTHS], 4)


def _aligned(spark, sf_dir):
    bars = scratch.kept(adapter.bars(spark, sf_dir))
    return factors.align_bench(factors.with_returns(bars), adapter.bench(spark, sf_dir, bars))


@query(oracle.aligned())
def j1_asof_benchmarks(spark, sf_dir):
    return _only(_aligned(spark, sf_dir), [f"{p}_{t}" for t in oracle.TICKERS for p in ("px", "r")])


def significant(x: Column) -> Column:
    """Six significant digits, six decimals below 1: for values of many orders (ratios to sums near zero, compounded returns)."""
    return F.when(F.abs(x) < 1, F.round(x + 1e-9, 6) + 0.0).when(x.isNotNull(), F.format_string("%.5e", x).cast("double"))


def _significant(*names: str) -> str:
    return ", ".join(f"{oracle.significant(n)} AS {n}" for n in names)


def _extra(name: str, sql: str, make: Callable[[Rolling], dict], source: Callable = _returns, ratios: str | None = None) -> None:
    """ratios: the start of the names that are given by significant digits."""

    def run(spark, sf_dir):
        names = list(make(Rolling()))
        made = factors.with_factors(source(spark, sf_dir), make)
        return _only(made.withColumns({k: significant(F.col(k)) for k in names if ratios and k.startswith(ratios)}), names)

    run.__name__ = name
    query(sql)(run)


_extra("f_market_relative", oracle.market_relative(), factors.market_relative, _aligned, "RS_")
_extra("f_etf_relative", oracle.etf_relative(), factors.etf_relative, _aligned, "RS_")
_extra("f_lead_signals", oracle.lead_signals(), factors.lead_signals, _aligned)
_extra("f_higher_moments", oracle.higher_moments(), factors.higher_moments)
_extra("f_volatility", oracle.volatility(), factors.volatility)
_extra("f_relative_volume", oracle.relative_volume(), factors.relative_volume)
_extra("f_gaps_intraday", oracle.gaps(), lambda r: factors.gaps(r) | factors.intraday(r))


@query(oracle.flow())
def f_flow(spark, sf_dir):
    return _only(factors.flow(_returns(spark, sf_dir)), factors.FLOW)


@query(oracle.event_proxies())
def f_event_proxies(spark, sf_dir):
    return _only(factors.event_proxies(_returns(spark, sf_dir)), factors.EVENTS)


def _macro(spark, sf_dir):
    return factors.macro_features(adapter.bars(spark, sf_dir).select("date"), tables.clean_macro(adapter.macro(spark, sf_dir)))


@query(oracle.macro())
def f_macro(spark, sf_dir):
    return rounded(_macro(spark, sf_dir))


@query(oracle.macro_join())
def j3_macro_join(spark, sf_dir):
    return _only(factors.join_macro(adapter.bars(spark, sf_dir), _macro(spark, sf_dir)), oracle.MACRO_NAMES)


@query(oracle.labels())
def f_forward_labels(spark, sf_dir):
    return _only(factors.forward_labels(adapter.bars(spark, sf_dir)), [f"future_{k}_{h}d" for h in factors.HORIZONS for k in ("return", "up")])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close, score (20-week return), future_return_1d, future_return_5d; complete rows."""
    rows = _returns(spark, sf_dir).withColumn("score", change("close", 20))
    rows = factors.forward_labels(rows, (1, 5))
    return rows.select("symbol", "date", "close", "score", "future_return_1d", "future_return_5d").dropna()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f_forward_labels(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- sources, filters, joins ------------------------------------------------------------------------------------------


@query("SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM (WITH " + oracle.MACRO.strip() + " SELECT * FROM macro)", dates=())
def s2_macro(spark, sf_dir):
    return tables.clean_macro(adapter.macro(spark, sf_dir))


@query(f"WITH {oracle.PLACES.strip(', ').strip()} SELECT ord, replace(trim(symbol), '.', '-') AS symbol, trim(sector) AS sector FROM places WHERE ord < 50", dates=())
def s3_universe(spark, sf_dir):
    return tables.clean_universe(adapter.universe(spark, sf_dir).filter("ord < 50"))


@query("SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM (WITH " + oracle.MACRO.strip() + " SELECT * FROM macro)", dates=())
def s2_read_macro(spark, sf_dir):
    """Observations written as text, with missing markers and bad dates among them, and read by the reader."""
    path, rows = scratch.folder(spark), adapter.macro(spark, sf_dir).select("series_id", "date", "value")
    missing = rows.limit(3).withColumn("value", F.lit(".")).unionByName(rows.limit(3).withColumn("value", F.lit(""))).unionByName(rows.limit(3).withColumn("date", F.lit("n/a")))
    rows.unionByName(missing).write.csv(path, header=True)
    return tables.read_macro(spark, path)


@query(f"WITH {oracle.PLACES.strip(', ').strip()} SELECT replace(trim(symbol), '.', '-') AS symbol, trim(sector) AS sector FROM places", dates=())
def s3_whole_universe(spark, sf_dir):
    """The whole snapshot written as text and read by the reader."""
    path = scratch.folder(spark)
    places = adapter.universe(spark, sf_dir)
    places.select(F.concat(F.lit(" "), "symbol").alias("symbol"), "sector", F.lit("2024-01-01").alias("snapshot_date")).write.csv(path, header=True)
    return tables.read_universe(spark, path).drop("ord")


@query(f"WITH {oracle.PLACES.strip(', ').strip()} SELECT sector, count(*) AS names FROM places GROUP BY sector", dates=())
def j10_sector_counts(spark, sf_dir):
    return adapter.universe(spark, sf_dir).groupBy("sector").agg(F.count("*").alias("names"))


@query(f"WITH {oracle.BARS.strip()}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars FROM bars) SELECT * EXCLUDE (bars) FROM n WHERE bars >= 280")
def p2_minimum_history(spark, sf_dir):
    return panel.minimum_history(adapter.bars(spark, sf_dir), 270, 10)


@query(f"WITH {oracle.SCORED.strip()} SELECT symbol, date, close, round(score + 1e-9, 6) + 0.0 AS score, round(future_return_1d + 1e-9, 6) + 0.0 AS future_return_1d, round(future_return_5d + 1e-9, 6) + 0.0 AS future_return_5d FROM scored")
def p3_complete_rows(spark, sf_dir):
    return rounded(scored(spark, sf_dir))


@query(
    f"""WITH {oracle.MACRO.strip()}, p AS (SELECT b.*, f.VIX_PERCENTILE FROM bars b ASOF LEFT JOIN features f ON b.date >= f.date)
    SELECT count(*) FILTER (VIX_PERCENTILE > 0) AS rows, count(DISTINCT date) FILTER (VIX_PERCENTILE > 0) AS days,
           round(count(*) FILTER (VIX_PERCENTILE > 0) / count(*) + 1e-9, 6) + 0.0 AS share FROM p""",
    dates=(),
)
def p7_regime_share(spark, sf_dir):
    joined = factors.join_macro(adapter.bars(spark, sf_dir), _macro(spark, sf_dir))
    return rounded(walkforward.regime_summary(joined, "VIX_PERCENTILE"))


@query(f"WITH {oracle.BARS.strip()} SELECT symbol, date, close, date >= CAST((SELECT max(date) FROM bars) - INTERVAL 1 MONTH AS DATE) AS holdout FROM bars")
def p11_last_month_split(spark, sf_dir):
    return walkforward.last_month(adapter.bars(spark, sf_dir).select("symbol", "date", "close"))


@query(
    f"""WITH {oracle.MACRO.strip()}, m AS (SELECT b.symbol, b.date, arg_max(m.value, m.date) AS value FROM bars b LEFT JOIN macro m ON m.series_id = 'VIXCLS' AND m.date <= b.date GROUP BY b.symbol, b.date)
    SELECT symbol, date, round(value + 1e-9, 6) + 0.0 AS value FROM m"""
)
def j2_asof_union(spark, sf_dir):
    """The as-of join for right sides of any length: stacked and carried forward over the calendar."""
    rows = adapter.bars(spark, sf_dir).select("symbol", "date")
    vix = tables.clean_macro(adapter.macro(spark, sf_dir)).filter("series_id = 'VIXCLS'")
    return rounded(factors.asof_join(rows, vix.select("date", "value"), None, ["value"]))


# --- cross-section ----------------------------------------------------------------------------------------------------

K = 10  #: names held; the smallest tables have fewer than the 4 * K a day that a portfolio asks for
_S = f"WITH {oracle.SCORED.strip()}"
_R = lambda *names: ", ".join(f"round({n} + 1e-9, 6) + 0.0 AS {n}" for n in names)
_RANKS = """, ranks AS (
  SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2 AS rs,
         rank() OVER (PARTITION BY date ORDER BY future_return_5d) + (count(*) OVER (PARTITION BY date, future_return_5d) - 1) / 2 AS rl,
         count(*) OVER (PARTITION BY date) AS names FROM scored),
ic AS (SELECT date, covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) AS ic FROM ranks WHERE names >= 5 GROUP BY date)"""


@query(f"{_S} SELECT symbol, date, round(future_return_5d - avg(future_return_5d) OVER (PARTITION BY date) + 1e-9, 6) + 0.0 AS future_return_5d_neutral FROM scored")
def x1_neutral_labels(spark, sf_dir):
    return _only(xsection.neutralize_labels(scored(spark, sf_dir), ["future_return_5d"]), ["future_return_5d_neutral"])


@query(f"{_S}{_RANKS} SELECT symbol, date, CAST(CASE WHEN rl / names <= 0.2 THEN 0 WHEN rl / names >= 0.8 THEN 2 ELSE 1 END AS INTEGER) AS tail FROM ranks")
def x2_tail_labels(spark, sf_dir):
    return _only(xsection.tail_labels(scored(spark, sf_dir), "future_return_5d"), ["tail"])


def _edges(value: str) -> str:
    return f", edges AS (SELECT date, list_distinct(quantile_cont({value}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges, count(*) AS names FROM scored GROUP BY date)"


def _bucket(value: str) -> str:
    return f"CASE WHEN len(edges) > 1 THEN greatest(len(list_filter(edges, lambda e: e < {value})) - 1, 0) END"


@query(f"{_S}{_edges('future_return_5d')} SELECT symbol, date, CAST(coalesce(CASE WHEN names >= 5 THEN {_bucket('future_return_5d')} END, 2) AS INTEGER) AS grade FROM scored JOIN edges USING (date)")
def x3_relevance_grades(spark, sf_dir):
    return _only(xsection.relevance_grades(scored(spark, sf_dir), "future_return_5d"), ["grade"])


@query(f"{_S}{_RANKS} SELECT date, {_R('ic')} FROM ic WHERE ic IS NOT NULL")
def x4_daily_rank_ic(spark, sf_dir):
    return rounded(xsection.daily_rank_ic(scored(spark, sf_dir), "score", "future_return_5d", 5))


@query(f"{_S}{_RANKS} SELECT round(avg(ic) + 1e-9, 6) + 0.0 AS mean_ic, count(ic) AS n_days, round(avg(ic) / stddev_pop(ic) + 1e-9, 6) + 0.0 AS icir FROM ic", dates=())
def x4_ic_summary(spark, sf_dir):
    return rounded(xsection.ic_summary(xsection.daily_rank_ic(scored(spark, sf_dir), "score", "future_return_5d", 5)))


@query(
    f"""{_S}, pooled AS (
      SELECT year(date) AS year, rank() OVER (PARTITION BY year(date) ORDER BY score) + (count(*) OVER (PARTITION BY year(date), score) - 1) / 2 AS rs,
             rank() OVER (PARTITION BY year(date) ORDER BY future_return_5d) + (count(*) OVER (PARTITION BY year(date), future_return_5d) - 1) / 2 AS rl FROM scored)
    SELECT CAST(year AS INTEGER) AS year, round(covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) + 1e-9, 6) + 0.0 AS ic, count(*) AS n_rows FROM pooled GROUP BY year HAVING count(*) > 10""",
    dates=(),
)
def x5_pooled_rank_ic(spark, sf_dir):
    return rounded(xsection.pooled_rank_ic(scored(spark, sf_dir).withColumn("year", F.year("date")), "score", "future_return_5d", "year"))


_ENDS = """, ends AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS top_place, count(*) OVER (PARTITION BY date) AS names FROM scored)"""


def _daily(k: int, least: int, label: str) -> str:
    return f"""(SELECT date, avg({label}) FILTER (top_place <= {k}) AS top, avg({label}) FILTER (names - top_place + 1 <= {k}) AS bottom FROM ends WHERE names >= {least} GROUP BY date)"""


@query(
    f"""{_S}{_ENDS}, d AS (SELECT *, top - bottom AS spread FROM {_daily(K, 2 * K, 'future_return_5d')})
    SELECT {_R('top_k_return', 'bottom_k_return', 'spread', 'pct_positive_spread', 'pct_positive_spread_net')}, n_days, round(spread - 0.2 + 1e-9, 6) + 0.0 AS spread_net,
           round((spread - 0.2) / sd * sqrt(252) + 1e-9, 6) + 0.0 AS long_short_sharpe
    FROM (SELECT avg(top) AS top_k_return, avg(bottom) AS bottom_k_return, avg(spread) AS spread, stddev_pop(spread) AS sd, avg((spread > 0)::INT) * 100 AS pct_positive_spread,
                 avg((spread - 0.2 > 0)::INT) * 100 AS pct_positive_spread_net, count(*) AS n_days FROM d)""",
    dates=(),
)
def x6_topk_return(spark, sf_dir):
    return rounded(xsection.topk_return(scored(spark, sf_dir), "future_return_5d", K, 10))


@query(
    f"""{_S}{_edges('score')}, placed AS (SELECT date, future_return_5d AS r, {_bucket('score')} AS bucket FROM scored JOIN edges USING (date) WHERE names >= 10),
    daily AS (SELECT date, bucket, avg(r) AS r FROM placed WHERE bucket IS NOT NULL GROUP BY date, bucket),
    m AS (SELECT bucket, avg(r) AS avg_return, CASE WHEN count(*) > 1 THEN stddev_pop(r) END AS std_return, count(*) AS days FROM daily GROUP BY bucket),
    f AS (SELECT *, round(avg_return, 4) < lag(round(avg_return, 4)) OVER (ORDER BY bucket) AS falls FROM m)
    SELECT CAST(bucket + 1 AS INTEGER) AS bucket, {_R('avg_return', 'std_return')}, days, NOT coalesce(bool_or(falls) OVER (), false) AS is_monotonic,
           round(arg_max(avg_return, bucket) OVER () - arg_min(avg_return, bucket) OVER () + 1e-9, 6) + 0.0 AS spread_top_bottom
    FROM f""",
    dates=(),
)
def x7_bucket_returns(spark, sf_dir):
    return rounded(xsection.bucket_returns(scored(spark, sf_dir), "future_return_5d"))


def _nw(source: str, value: str, key: str, lag: int = 5, least: int = 20) -> str:
    """key, n, mean, t_plain, t_nw."""
    terms = " + ".join(f"2 * {1 - k / (lag + 1)!r} * coalesce(avg(d * p{k}), 0)" for k in range(1, lag + 1))
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY {key} ORDER BY date) AS p{k}" for k in range(1, lag + 1))
    return f"""(SELECT {key}, n, mean, CASE WHEN n < {least} OR g0 <= 1e-12 THEN 0 ELSE mean / sqrt(g0 / n) END AS t_plain, CASE WHEN n < {least} THEN 0 ELSE mean / sqrt(greatest(lrv, 1e-12) / n) END AS t_nw
      FROM (SELECT {key}, count(*) AS n, avg(x) AS mean, avg(d * d) AS g0, avg(d * d) + {terms} AS lrv
            FROM (SELECT *, {lags} FROM (SELECT {key}, date, {value} AS x, {value} - avg({value}) OVER (PARTITION BY {key}) AS d FROM {source} WHERE {value} IS NOT NULL)) GROUP BY {key}))"""


@query(
    f"""{_S}{_ENDS}, d AS (SELECT 5 AS k, date, top - bottom AS spread FROM {_daily(5, 20, 'future_return_1d')} UNION ALL SELECT 10, date, top - bottom FROM {_daily(10, 40, 'future_return_1d')}),
    g AS (SELECT k, avg(spread) / nullif(stddev_pop(spread), 0) * sqrt(252) AS sharpe FROM d GROUP BY k)
    SELECT CAST(k AS INTEGER) AS k, n, {_R('mean', 'sharpe', 't_nw')} FROM {_nw('d', 'spread', 'k')} JOIN g USING (k)""",
    dates=(),
)
def x8_long_short(spark, sf_dir):
    return rounded(portfolio.long_short_spread(scored(spark, sf_dir), "future_return_1d", (5, K)))


@query(
    f"""{_S}, yy AS (SELECT *, year(date) AS year, median(score) OVER (PARTITION BY year(date)) AS mid FROM scored)
    SELECT CAST(year AS INTEGER) AS year, {_R('dir_acc', 'dir_acc_median', 'rmse')} FROM (
      SELECT year, avg(((score > 0) = (future_return_5d > 0))::INT) AS dir_acc, avg(((score > mid) = (future_return_5d > 0))::INT) AS dir_acc_median,
             sqrt(avg((score - future_return_5d) * (score - future_return_5d))) AS rmse FROM yy GROUP BY year)""",
    dates=(),
)
def x9_directional_accuracy(spark, sf_dir):
    return rounded(xsection.directional_accuracy(scored(spark, sf_dir).withColumn("year", F.year("date")), "score", "future_return_5d", "year"))


@query(f"{_S} SELECT date, count(*) AS names, round(avg(close) + 1e-9, 6) + 0.0 AS mean_weight FROM scored GROUP BY date")
def x11_group_sizes(spark, sf_dir):
    return rounded(xsection.group_sizes(scored(spark, sf_dir), "close"))


@query(
    """WITH s AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, avg(value) AS sentiment, count(*) AS news FROM events GROUP BY 1, 2),
    m AS (SELECT *, avg(sentiment) OVER d AS mid, stddev_pop(sentiment) OVER d AS sd, avg(news) OVER d AS mean_news FROM s WINDOW d AS (PARTITION BY date))
    SELECT date, symbol, round(least(greatest((sentiment - mid) / greatest(sd, 0.01), -3), 3) / 3 + 1e-9, 4) AS news_sent_cs, round(least(greatest(news / greatest(mean_news, 1) - 1, -1), 1) + 1e-9, 4) AS news_buzz_cs FROM m"""
)
def x12_sentiment(spark, sf_dir):
    return xsection.sentiment_cross_section(adapter.sentiment(spark, sf_dir))


# --- walk-forward -----------------------------------------------------------------------------------------------------

STEPS = dict(train=24, val=3, test=3, step=6)
OVERLAPPING = STEPS | dict(step=3)
IC_FEATURES = ["ROC_5", "MA_20", "STD_20", "RSV_20", "CNTP_20", "RVOL_5"]  #: of the models' queries
#: All price factors of all widths, of the queries that correlate and select.
PRICE_FEATURES = [k for f in oracle.FAMILIES.values() for w in oracle.WIDTHS for k in f(w)] + ["RVOL_5"]

_WINDOWS = """
b AS (SELECT min(date) AS first, max(date) AS last FROM scored),
w0 AS (
  WITH RECURSIVE w AS (
    SELECT 0 AS win, first AS train_start, last FROM b
    UNION ALL SELECT win + 1, CAST(train_start + INTERVAL 6 MONTH AS DATE), last FROM w WHERE win < 60)
  SELECT * FROM w),
w1 AS (SELECT *, CAST(train_start + INTERVAL 24 MONTH AS DATE) AS te FROM w0),
w2 AS (SELECT *, te - 10 AS train_end, te + 5 AS val_start, CAST(te + INTERVAL 3 MONTH AS DATE) AS val_end FROM w1),
wins AS (SELECT win, train_start, train_end, val_start, val_end, val_end AS test_start, CAST(val_end + INTERVAL 3 MONTH AS DATE) AS test_end FROM w2 WHERE CAST(val_end + INTERVAL 3 MONTH AS DATE) <= last),
tagged AS (
  SELECT s.*, win, 'train' AS role FROM scored s JOIN wins ON date >= train_start AND date < train_end
  UNION ALL SELECT s.*, win, 'val' FROM scored s JOIN wins ON date >= val_start AND date < val_end
  UNION ALL SELECT s.*, win, 'test' FROM scored s JOIN wins ON date >= test_start AND date < test_end)"""


def _tagged(spark, sf_dir, rows=None, steps=STEPS):
    rows = scored(spark, sf_dir) if rows is None else rows
    return walkforward.tag_windows(rows, walkforward.walk_forward_windows(spark, scored(spark, sf_dir), **steps))


@query(f"{_S}, {_WINDOWS} SELECT CAST(win AS INTEGER) AS \"window\", train_start, train_end, val_start, val_end, test_start, test_end FROM wins", dates=("train_start", "train_end", "val_start", "val_end", "test_start", "test_end"))
def m1_windows(spark, sf_dir):
    return walkforward.walk_forward_windows(spark, scored(spark, sf_dir), **STEPS)


@query(
    f"""{_S}, {_WINDOWS} SELECT CAST(win AS INTEGER) AS "window", count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val, count(*) FILTER (role = 'test') AS n_test
    FROM tagged GROUP BY win HAVING n_train >= 100 AND n_val >= 20 AND n_test >= 20""",
    dates=(),
)
def j6_window_rows(spark, sf_dir):
    return walkforward.usable_windows(_tagged(spark, sf_dir))


def _features(spark, sf_dir, names=tuple(IC_FEATURES)):
    rows = factors.forward_labels(_returns(spark, sf_dir), (5,))

    def make(r):
        made = {k: v for family in factors.PRICE_FAMILIES for w in factors.WIDTHS if any(k in names for k in factors.price_names(family, (w,))) for k, v in factors.price_factors(r, family, (w,)).items()}
        return {k: v for k, v in (made | factors.relative_volume(r)).items() if k in names}

    return factors.with_factors(rows, make).select("symbol", "date", "future_return_5d", *names)


def _ics(spark, sf_dir):
    rows, path = _features(spark, sf_dir, PRICE_FEATURES), scratch.folder(spark)
    rows = scratch.at(rows.select("date", "future_return_5d", *[(F.rint(F.col(c) * 1e9) / 1e9).alias(c) for c in PRICE_FEATURES]), path)  # sums of the same numbers in another order are ties
    ics = ranks.window_ic(rows, walkforward.walk_forward_windows(spark, scored(spark, sf_dir), **STEPS), PRICE_FEATURES, "future_return_5d")
    scratch.delete(spark, path)
    return ics


_F_SQL = {k: x for f in oracle.FAMILIES.values() for w in oracle.WIDTHS for k, x in f(w).items()}
_F_SQL["RVOL_5"] = oracle.sdiv("volume", oracle.low(oracle.avg("volume", 5), 1.0))
_IC_SQL = (
    f"{_S}, {_WINDOWS}, feats AS (SELECT symbol, date, (lead(close, 5) OVER s / close - 1) * 100 AS y, {', '.join(f'round_even(CAST({x} AS DOUBLE) * 1e9, 0) / 1e9 AS {k}' for k, x in _F_SQL.items())} FROM r {oracle.windows(*oracle.WIDTHS)})"
    + f""",
    long AS (UNPIVOT (SELECT win, y, {', '.join(_F_SQL)} FROM feats JOIN wins ON date >= train_start AND date < train_end) ON {', '.join(_F_SQL)} INTO NAME feature VALUE v),
    rk AS (SELECT win, feature, rank() OVER (PARTITION BY win, feature ORDER BY v) + (count(*) OVER (PARTITION BY win, feature, v) - 1) / 2 AS rv,
                  rank() OVER (PARTITION BY win, feature ORDER BY y) + (count(*) OVER (PARTITION BY win, feature, y) - 1) / 2 AS ry FROM long WHERE v IS NOT NULL AND y IS NOT NULL),
    ics AS (SELECT CAST(win AS INTEGER) AS "window", feature, covar_pop(rv, ry) / nullif(stddev_pop(rv) * stddev_pop(ry), 0) AS ic, count(*) AS n FROM rk GROUP BY win, feature HAVING count(*) >= 30)"""
)


@query(f'{_IC_SQL} SELECT "window", feature, {_R("ic")}, n FROM ics WHERE ic IS NOT NULL', dates=())
def m2_feature_ic(spark, sf_dir):
    return rounded(_ics(spark, sf_dir))


@query()
def m2_panel_ic(spark, sf_dir):
    """Every factor of the whole panel, over the job's own overlapping windows (12 months, a month apart)."""
    path = scratch.folder(spark)
    built = scratch.at(_panel(spark, sf_dir), path)
    ics = ranks.window_ic(built, walkforward.walk_forward_windows(spark, built), panel.model_inputs(built), "future_return_5d")
    scratch.delete(spark, path)
    return rounded(ics)


_SELECTED = f"""{_IC_SQL}, kept AS (SELECT *, feature LIKE 'RVOL\\_%' ESCAPE '\\' AS forced FROM ics WHERE ic IS NOT NULL AND (feature LIKE 'RVOL\\_%' ESCAPE '\\' OR abs(ic) >= 0.02)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY forced DESC, round(abs(ic), 9) DESC, feature) AS place FROM kept),
    chosen AS (SELECT * FROM placed WHERE forced OR place <= 80)"""


def _selected(spark, sf_dir):
    return walkforward.select_features(_ics(spark, sf_dir))


@query(f'{_SELECTED} SELECT "window", feature, {_R("ic")}, forced, CAST(place AS INTEGER) AS place FROM chosen', dates=())
def m3_select_features(spark, sf_dir):
    return rounded(_selected(spark, sf_dir))


@query(f"{_SELECTED} SELECT feature, count(*) AS windows FROM chosen GROUP BY feature ORDER BY windows DESC, feature LIMIT 30", dates=())
def m4_feature_frequency(spark, sf_dir):
    return walkforward.feature_frequency(_selected(spark, sf_dir))


@query(f'{_IC_SQL} SELECT "window", feature AS model, round(abs(ic) / sum(abs(ic)) OVER (PARTITION BY "window") + 1e-9, 6) + 0.0 AS weight FROM ics WHERE ic IS NOT NULL', dates=())
def m7_raw_weights(spark, sf_dir):
    return rounded(walkforward.raw_weights(_ics(spark, sf_dir).withColumnRenamed("feature", "model")))


_STACK = f"""{_S}, {_WINDOWS}, preds AS (SELECT win, date, symbol, 'a' AS model, score AS p FROM tagged WHERE role <> 'train' UNION ALL SELECT win, date, symbol, 'b', -close / 1000 FROM tagged WHERE role <> 'train'),
    blend AS (SELECT win, date, symbol, sum(p * CASE model WHEN 'a' THEN 0.6 ELSE 0.4 END) AS score FROM preds GROUP BY win, date, symbol)"""


def _blend(spark, sf_dir, steps=STEPS):
    rows = _tagged(spark, sf_dir, steps=steps).filter("role <> 'train'")
    preds = rows.select("window", "date", "symbol", F.lit("a").alias("model"), F.col("score").alias("prediction")).unionByName(rows.select("window", "date", "symbol", F.lit("b").alias("model"), (-F.col("close") / 1000).alias("prediction")))
    weights = rows.select("window").distinct().withColumn("w", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(0.6).alias("weight")), F.struct(F.lit("b").alias("model"), F.lit(0.4).alias("weight"))))).select("window", "w.*")
    return walkforward.ensemble_score(preds, weights)


@query(f'{_STACK} SELECT CAST(win AS INTEGER) AS "window", date, symbol, {_R("score")} FROM blend')
def m8_ensemble_score(spark, sf_dir):
    return rounded(_blend(spark, sf_dir))


@query(f'{_STACK} SELECT CAST(win AS INTEGER) AS "window", date, symbol, {_R("score")} FROM blend QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY win DESC) = 1')
def m9_dedupe_scores(spark, sf_dir):
    return rounded(walkforward.dedupe_scores(_blend(spark, sf_dir)))


@query(f'{_STACK} SELECT CAST(win AS INTEGER) AS "window", date, symbol, {_R("score")} FROM blend QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY win DESC) = 1'.replace("train_start + INTERVAL 6 MONTH", "train_start + INTERVAL 3 MONTH"))
def m9_overlapping_scores(spark, sf_dir):
    """Windows that overlap: each validation range is the test range of the window before, so a (date, symbol) has two scores."""
    return rounded(walkforward.dedupe_scores(_blend(spark, sf_dir, OVERLAPPING)))


@query(f"{_S}, {_WINDOWS} SELECT DISTINCT s.date FROM scored s JOIN tagged t ON s.date = t.date WHERE t.role = 'test'")
def u3_common_dates(spark, sf_dir):
    tested = _tagged(spark, sf_dir).filter("role = 'test'")
    return walkforward.common_dates(scored(spark, sf_dir), tested)[0].select("date").distinct()


# --- portfolio and statistics -----------------------------------------------------------------------------------------

_PLAN = f"""{_S}{_ENDS},
days AS (SELECT date, count(*) AS names, row_number() OVER (ORDER BY date) - 1 AS i FROM scored GROUP BY date),
td AS (SELECT tranche, date, i, row_number() OVER (PARTITION BY tranche ORDER BY date) = 1 OR i % 5 = tranche AS is_rebal FROM days, range(5) t(tranche) WHERE names >= {4 * K}),
plan AS (SELECT *, lag(active) OVER (PARTITION BY tranche ORDER BY date) AS previous FROM
  (SELECT *, max(CASE WHEN is_rebal THEN date END) OVER (PARTITION BY tranche ORDER BY date ROWS UNBOUNDED PRECEDING) AS active FROM td)),
best AS (SELECT date, symbol FROM ends WHERE names >= {4 * K} AND top_place <= {K}),
turn AS (SELECT p.tranche, p.date, 1 - count(o.symbol) / {K} AS turnover FROM plan p JOIN best n ON n.date = p.date LEFT JOIN best o ON o.date = p.previous AND o.symbol = n.symbol
         WHERE p.is_rebal AND p.previous IS NOT NULL GROUP BY p.tranche, p.date),
held AS (SELECT p.tranche, p.date, avg(s.future_return_1d) AS held FROM plan p JOIN best b ON b.date = p.active JOIN scored s ON s.date = p.date AND s.symbol = b.symbol GROUP BY p.tranche, p.date),
costs AS (SELECT unnest([10.0, 20.0, 30.0])::DOUBLE AS cost_bps),
port AS (SELECT cost_bps, date, avg(held - coalesce(turnover, 0) * 2 * cost_bps / 10000 * 100) AS ret FROM held LEFT JOIN turn USING (tranche, date), costs GROUP BY cost_bps, date)"""


@query(f"{_PLAN} SELECT CAST(tranche AS INTEGER) AS tranche, date, active, is_rebal FROM plan", dates=("date", "active"))
def j7_rebalance_map(spark, sf_dir):
    return portfolio.schedule(scored(spark, sf_dir), K).drop("previous")


@query(f"{_PLAN} SELECT CAST(tranche AS INTEGER) AS tranche, date, {_R('turnover')} FROM turn")
def j8_turnover(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(portfolio.turnover(portfolio.schedule(rows, K), portfolio.top_names(rows, K), K))


@query(f"{_PLAN} SELECT cost_bps, date, {_R('ret')} FROM port")
def a3_staggered_portfolio(spark, sf_dir):
    return rounded(portfolio.staggered_portfolio(scored(spark, sf_dir), "future_return_1d", K))


@query(
    f"""{_PLAN}, u AS (SELECT date, avg(future_return_1d) AS everything FROM scored GROUP BY date), ex AS (SELECT date, avg(held - everything) AS ex FROM held JOIN u USING (date) GROUP BY date),
    t AS (SELECT avg(coalesce(t, 0)) AS daily_turnover FROM (SELECT tranche, avg(turnover) / 5 AS t FROM (SELECT DISTINCT tranche FROM plan) LEFT JOIN turn USING (tranche) GROUP BY tranche)),
    net AS (SELECT cost_bps, date, daily_turnover, ex - daily_turnover * 2 * cost_bps / 10000 * 100 AS net FROM ex, t, costs),
    g AS (SELECT cost_bps, any_value(daily_turnover) AS daily_turnover, avg(net) * 252 AS ann_excess_pct, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe FROM net GROUP BY cost_bps)
    SELECT cost_bps, {_R('daily_turnover', 'ann_excess_pct', 'sharpe', 't_nw')} FROM g JOIN {_nw('net', 'net', 'cost_bps')} USING (cost_bps)""",
    dates=(),
)
def a4_long_excess(spark, sf_dir):
    return rounded(portfolio.long_excess(scored(spark, sf_dir), "future_return_1d", K))


def _perf(source: str, value: str, prefix: str = "") -> str:
    return f"""(SELECT cost_bps, (e - 1) * 100 AS {prefix}total_return_pct, (pow(e, 252 / n) - 1) * 100 AS {prefix}ann_return_pct, vol AS {prefix}ann_vol_pct, dd * 100 AS {prefix}max_drawdown_pct, n AS {prefix}n_days,
      coalesce((pow(e, 252 / n) - 1) * 100 / nullif(vol, 0), 0) AS {prefix}sharpe
      FROM (SELECT cost_bps, arg_max(equity, date) AS e, stddev_samp({value} / 100) * sqrt(252) * 100 AS vol, min(equity / peak - 1) AS dd, count(*) AS n
            FROM (SELECT *, max(equity) OVER (PARTITION BY cost_bps ORDER BY date) AS peak FROM (SELECT cost_bps, date, {value}, product(1 + {value} / 100) OVER (PARTITION BY cost_bps ORDER BY date) AS equity FROM {source})) GROUP BY cost_bps))"""


def _portfolio(spark, sf_dir):
    return portfolio.staggered_portfolio(scored(spark, sf_dir), "future_return_1d", K)


def _given(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.withColumns({n: significant(F.col(n)) for n in names}))


_PERF = ("total_return_pct", "ann_return_pct", "ann_vol_pct", "max_drawdown_pct", "sharpe")


@query(f"{_PLAN} SELECT cost_bps, n_days, {_significant(*_PERF)} FROM {_perf('port', 'ret')}", dates=())
def a5_perf_stats(spark, sf_dir):
    return _given(stats.perf_stats(_portfolio(spark, sf_dir), "ret", "cost_bps"), *_PERF)


_REPORT = (*_PERF, *(f"bench_{n}" for n in _PERF), "excess_ann_pct")
_SPY = f"""{oracle.BENCH}, spy AS (SELECT date, (lead(close) OVER (ORDER BY date) / close - 1) * 100 AS bench_ret FROM bench WHERE ticker = 'SPY'),
    both_ AS (SELECT cost_bps, date, ret, bench_ret, ret - bench_ret AS excess FROM port JOIN spy USING (date) WHERE bench_ret IS NOT NULL)"""


@query(
    f"""{_PLAN}{_SPY} SELECT cost_bps, n_days, {_significant(*_REPORT)}, {_R('excess_t_nw')}
    FROM (SELECT *, s.n_days AS n_days, mean * 252 AS excess_ann_pct, t_nw AS excess_t_nw FROM {_perf('both_', 'ret')} s JOIN {_perf('both_', 'bench_ret', 'bench_')} b USING (cost_bps) JOIN {_nw('both_', 'excess', 'cost_bps', 5, 0)} USING (cost_bps))""",
    dates=(),
)
def a6_portfolio_report(spark, sf_dir):
    spy = adapter.bench(spark, sf_dir, adapter.bars(spark, sf_dir)).filter(F.col("ticker") == adapter.MARKET)
    return _given(portfolio.portfolio_report(_portfolio(spark, sf_dir), portfolio.forward_benchmark(spy)), *_REPORT)


@query(
    f"""{_PLAN}, c AS (SELECT cost_bps, date, ret, product(1 + ret / 100) OVER (PARTITION BY cost_bps ORDER BY date) AS equity FROM port)
    SELECT cost_bps, date, {_significant('ret', 'equity')}, round(equity / max(equity) OVER (PARTITION BY cost_bps ORDER BY date) - 1 + 1e-9, 6) + 0.0 AS drawdown FROM c"""
)
def a7_equity_curve(spark, sf_dir):
    return _given(stats.equity_curve(_portfolio(spark, sf_dir), "ret", "cost_bps"), "ret", "equity")


@query(f"{_PLAN}, m AS (SELECT cost_bps, CAST(date_trunc('month', date) AS DATE) AS month, sum(ret) AS ret FROM port GROUP BY 1, 2) SELECT cost_bps, month, {_significant('ret')} FROM m", dates=("month",))
def a7_monthly_sums(spark, sf_dir):
    return _given(stats.monthly_sums(_portfolio(spark, sf_dir), "ret", "cost_bps"), "ret")


@query(f"{_S}{_RANKS} SELECT year, n, {_R('mean', 't_plain', 't_nw')} FROM {_nw('(SELECT CAST(year(date) AS INTEGER) AS year, date, ic FROM ic)', 'ic', 'year')}", dates=())
def a1_newey_west(spark, sf_dir):
    ics = xsection.daily_rank_ic(scored(spark, sf_dir), "score", "future_return_5d", 5).withColumn("year", F.year("date"))
    return rounded(stats.newey_west(ics, "ic", 5, 20, "year"))


def _erfc(x: str) -> str:
    poly = str(stats.ERFC[-1])
    for c in stats.ERFC[-2::-1]:
        poly = f"({c} + (1 / (1 + {x} / 2)) * {poly})"
    return f"(1 / (1 + {x} / 2)) * exp({poly} - {x} * {x})"


@query(
    f"""{_S}{_RANKS} SELECT n, {_R('mean', 't_plain', 't_nw')}, round({_erfc('z')} + 1e-9, 6) + 0.0 AS p_value
    FROM (SELECT *, abs(t_nw) / sqrt(2) AS z FROM {_nw('(SELECT 1 AS one, date, ic FROM ic)', 'ic', 'one')})""",
    dates=(),
)
def a2_p_values(spark, sf_dir):
    ics = xsection.daily_rank_ic(scored(spark, sf_dir), "score", "future_return_5d", 5)
    return rounded(stats.normal_p_value(stats.newey_west(ics, "ic")))


@query(
    f"""{_S}{_RANKS}{_ENDS}, d AS (SELECT year(date) AS y, date, top - bottom AS spread FROM {_daily(K, 2 * K, 'future_return_5d')}),
    w AS (SELECT avg(i.ic) AS cs_ic, avg(i.ic) / stddev_pop(i.ic) AS icir, any_value(s.spread_net) AS spread_net FROM ic i JOIN (SELECT y, avg(spread) - 0.2 AS spread_net FROM d GROUP BY y) s ON year(i.date) = s.y GROUP BY year(i.date)),
    g AS (SELECT avg(cs_ic) AS avg_cs_ic, avg(icir) AS avg_cs_icir, avg(spread_net) AS avg_spread_net, avg((spread_net > 0)::INT) AS pct_positive_spread_net, count(*) AS n_windows FROM w)
    SELECT {_R('avg_cs_ic', 'avg_cs_icir', 'avg_spread_net', 'pct_positive_spread_net')}, n_windows, n AS n_ic_days, {_R('t_plain', 't_nw')},
           avg_cs_ic >= 0.02 AND avg_cs_icir >= 0.3 AND avg_spread_net > 0 AND pct_positive_spread_net >= 0.55 AND t_nw >= 2 AS is_significant
    FROM g, {_nw('(SELECT 1 AS one, date, ic FROM ic)', 'ic', 'one')}""",
    dates=(),
)
def a8_significance(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("year", F.year("date"))
    ics = xsection.daily_rank_ic(rows, "score", "future_return_5d", 5).withColumn("year", F.year("date"))
    windows = xsection.ic_summary(ics, "year").join(xsection.topk_return(rows, "future_return_5d", K, 10, "year"), "year")
    return rounded(stats.significance_summary(windows.select(F.col("mean_ic").alias("cs_ic"), "icir", "spread_net"), ics))


@query(f"{_S} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS days FROM scored", dates=())
def a9_distinct_counts(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("days"))


# --- panel, models, sinks ---------------------------------------------------------------------------------------------


def _panel(spark, sf_dir, **options):
    prices = scratch.kept(adapter.bars(spark, sf_dir))
    return panel.build_panel(prices, adapter.bench(spark, sf_dir, prices), tables.clean_macro(adapter.macro(spark, sf_dir)), **options)


@query()
def s5_panel(spark, sf_dir):
    """The whole panel (factors, macro, labels), complete rows, written and read again."""
    path, built = scratch.folder(spark), _panel(spark, sf_dir)
    tables.write_panel(built, path)
    return spark.read.schema(built.schema).parquet(path)


@query(oracle.core_panel(panel.CORE))
def p8_core_projection(spark, sf_dir):
    """Core factors over price inputs alone: absent blocks do not remove rows, and factors not asked for are not made."""
    return rounded(panel.project(panel.build_panel(adapter.bars(spark, sf_dir), only=panel.CORE)))


TREES = 20  #: boosting rounds of the queries' models; the operators' default is 100
TILES = dict(train=12, val=3, test=3, step=3)  #: test ranges tile the history


@query(oracle.core_panel(panel.CORE))
def s4_read_panel(spark, sf_dir):
    """The core panel written by year, one half of the symbols after the other (each is made as it is written), and read again with its columns."""
    path = scratch.folder(spark)
    built = panel.project(panel.build_panel(scratch.kept(adapter.bars(spark, sf_dir)), only=panel.CORE))
    first = F.pmod(F.xxhash64("symbol"), F.lit(2)) == 0
    tables.write_panel(tables.stack([built.filter(first), built.filter(~first)]), path)
    return rounded(tables.read_panel(spark, path, built.columns))


@query(oracle.core_panel(panel.CORE))
def s5_merged_panel(spark, sf_dir):
    """The core panel from bars in buckets, written without its last month, which is then merged in: its year alone is written anew."""
    path, name = scratch.folder(spark), f"bars_{uuid.uuid4().hex}"
    tables.write_bars(adapter.bars(spark, sf_dir), name, f"{path}/bars", int(spark.conf.get("spark.sql.shuffle.partitions")))
    built = scratch.at(panel.project(panel.build_panel(spark.table(name), only=panel.CORE)), f"{path}/built")
    spark.sql(f"DROP TABLE {name}")
    last = walkforward.last_month(built)
    month = scratch.kept(last.filter("holdout").drop("holdout"))
    tables.write_panel(last.filter(~F.col("holdout")).drop("holdout"), f"{path}/panel")
    scratch.delete(spark, f"{path}/built", f"{path}/bars")
    with scratch.shuffles_released(spark):
        tables.merge_panel(month, f"{path}/panel")
    return rounded(tables.read_panel(spark, f"{path}/panel", built.columns))


def _model_rows(spark, sf_dir):
    return _features(spark, sf_dir).dropna()


@query()
def m5_residual_weights(spark, sf_dir):
    return models.residual_weights(scratch.kept(_model_rows(spark, sf_dir)), IC_FEATURES, "future_return_5d", 3, 0.5, TREES).select("symbol", "date", F.round("weight", 6).alias("weight"))


_DECAY = f"{_S}, z AS (SELECT symbol, date, abs(future_return_5d) AS r FROM scored), e AS (SELECT min(r) AS lo, max(r) AS hi FROM z), w AS (SELECT symbol, date, exp(-0.5 * (r - lo) / (hi - lo)) AS w FROM z, e)"


@query(f"{_DECAY} SELECT symbol, date, round(w / avg(w) OVER () + 1e-9, 6) + 0.0 AS weight FROM w")
def m5_reweighting(spark, sf_dir):
    """The reweighting step alone, with the label as residual."""
    rows = scored(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return _only(models.mean_one(models.reweight(rows, "future_return_5d")), ["weight"])


@query(f"{_S} SELECT symbol, date, round(score / 5 + 1e-9, 6) + 0.0 AS score FROM scored")
def p10_rescaled(spark, sf_dir):
    return _only(models.rescaled(scored(spark, sf_dir), "score"), ["score"])


@query()
def m6_walk_forward(spark, sf_dir):
    """The walk-forward job over the whole history, its own windows (test ranges abut); returns its summary (scores and reports are written)."""
    return rounded(jobs.walk_forward(spark, _model_rows(spark, sf_dir), IC_FEATURES, scratch.folder(spark), trees=TREES, min_ic=0.0, k=K))


@query()
def m10_tail_score(spark, sf_dir):
    """The tail model against the regression's walk-forward scores, both from their jobs, over the dates that both have."""
    rows, path = scratch.kept(_model_rows(spark, sf_dir)), scratch.folder(spark)
    tail = jobs.tail_walk_forward(spark, rows, IC_FEATURES, path, "future_return_5d", TREES, 0.0, steps=TILES, depth=4)
    jobs.walk_forward(spark, rows, IC_FEATURES, f"{path}/base", trees=TREES, min_ic=0.0, k=K, steps=TILES)
    base = spark.read.parquet(f"{path}/base/scores").join(rows.select("date", "symbol", "future_return_5d"), ["date", "symbol"])
    return rounded(jobs.compare_scores({"tail": tail, "regression": base}, "future_return_5d", 5, (1, K), K))


@query()
def m11_feature_importance(spark, sf_dir):
    rows = walkforward.last_month(scratch.kept(_model_rows(spark, sf_dir)))
    fitted = {"5d": models.fit_horizon(rows.filter(~F.col("holdout")), rows.filter("holdout"), IC_FEATURES, "future_return_5d", TREES)}
    return rounded(models.feature_importance(spark, fitted, IC_FEATURES))


@query()
def m12_final_model(spark, sf_dir):
    out = publish.final_model(spark, scratch.kept(_model_rows(spark, sf_dir)), IC_FEATURES, scratch.folder(spark), trees=TREES, min_ic=0.0)
    return rounded(out.drop("version"))


@query()
def m12_ranking_model(spark, sf_dir):
    """The final model as a ranking: grades as target, residual weights on the rows."""
    out = publish.final_model(spark, scratch.kept(_model_rows(spark, sf_dir)), IC_FEATURES, scratch.folder(spark), trees=TREES, min_ic=0.0, task="ranking")
    return rounded(out.drop("version"))


@query(
    f"""{_PLAN}{oracle.BENCH}, spy AS (SELECT date, (lead(close) OVER (ORDER BY date) / close - 1) * 100 AS bench_ret FROM bench WHERE ticker = 'SPY'),
    both_ AS (SELECT cost_bps, date, ret, bench_ret FROM port JOIN spy USING (date) WHERE bench_ret IS NOT NULL)
    SELECT cost_bps, count(*) AS n_days, {_R('mean_ret', 'mean_bench')} FROM (SELECT *, avg(ret) OVER (PARTITION BY cost_bps) AS mean_ret, avg(bench_ret) OVER (PARTITION BY cost_bps) AS mean_bench FROM both_) GROUP BY cost_bps, mean_ret, mean_bench""",
    dates=(),
)
def j4_scores_with_returns(spark, sf_dir):
    """Scores and returns as written tables, joined by date and symbol, held in tranches, beside the benchmark."""
    rows = scored(spark, sf_dir)
    path = scratch.folder(spark)
    tables.write_scores(rows.select("date", "symbol", "score"), f"{path}/scores")
    held = spark.read.parquet(f"{path}/scores").join(rows.select("date", "symbol", "future_return_1d"), ["date", "symbol"])
    spy = adapter.bench(spark, sf_dir, adapter.bars(spark, sf_dir)).filter(F.col("ticker") == adapter.MARKET)
    both = portfolio.staggered_portfolio(held, "future_return_1d", K).join(F.broadcast(portfolio.forward_benchmark(spy)), "date")
    return rounded(both.groupBy("cost_bps").agg(F.count("*").alias("n_days"), F.avg("ret").alias("mean_ret"), F.avg("bench_ret").alias("mean_bench")))


@query()
def m13_regime_model(spark, sf_dir):
    rows = scratch.kept(factors.join_macro(_model_rows(spark, sf_dir), _macro(spark, sf_dir).select("date", "VIX_PERCENTILE")))
    return rounded(models.regime_model(spark, rows, IC_FEATURES, trees=TREES))
