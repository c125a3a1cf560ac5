"""SQL for the factor queries: the same tables and formulas, written for another engine."""

from __future__ import annotations

WIDTHS = (5, 10, 20, 30, 60)

BARS = """
trades AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice AS price, l_quantity AS quantity,
         l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem),
bars AS (
  SELECT symbol, date, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, price) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, price) AS close, sum(quantity) AS volume
  FROM trades GROUP BY symbol, date)"""

RETURNS = (
    BARS
    + """,
r AS (SELECT *, close / lag(close) OVER s - 1 AS ret, row_number() OVER s AS nr FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date))"""
)

PLACES = """,
places AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey AS ord, r_name AS sector, r_regionkey, n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BENCH = (
    PLACES
    + """,
tagged AS (
  SELECT date, close, 'SPY' AS ticker FROM bars JOIN places USING (symbol)
  UNION ALL SELECT date, close, ['XLK', 'XLF', 'XLE', 'XLV', 'TLT'][r_regionkey + 1] FROM bars JOIN places USING (symbol)
  UNION ALL SELECT date, close, ['UUP', 'HYG', 'IEF', 'VIXY'][n_nationkey + 1] FROM bars JOIN places USING (symbol) WHERE n_nationkey < 4),
bench AS (SELECT date, ticker, avg(close) AS close FROM tagged GROUP BY date, ticker)"""
)

TICKERS = ("SPY", "XLK", "XLF", "XLE", "XLV", "TLT", "UUP", "HYG", "IEF", "VIXY")


def asof(source: str, key: str, names, prefix: str) -> str:
    """Scalar columns: the latest value at or before the calendar's date."""
    return ", ".join(f"(SELECT arg_max(b.{'close' if key == 'ticker' else 'value'}, b.date) FROM {source} b WHERE b.{key} = '{n}' AND b.date <= c.date) AS {prefix}{n}" for n in names)


ALIGNED = (
    RETURNS
    + BENCH
    + f""",
calendar AS (SELECT DISTINCT date FROM bars),
wide AS (SELECT c.date, {asof("bench", "ticker", TICKERS, "px_")} FROM calendar c),
a AS (SELECT r.*, {", ".join(f"px_{t}, px_{t} / lag(px_{t}) OVER s - 1 AS r_{t}" for t in TICKERS)} FROM r JOIN wide USING (date) WINDOW s AS (PARTITION BY symbol ORDER BY date))"""
)


def windows(*widths: int) -> str:
    frames = [f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted({*widths})]
    return "WINDOW s AS (PARTITION BY symbol ORDER BY date), " + ", ".join(frames)


def sdiv(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


def full(x: str, n: int, agg: str) -> str:
    return f"(CASE WHEN count({x}) OVER w{n} = {n} THEN {agg} OVER w{n} END)"


def avg(x: str, n: int) -> str:
    return full(x, n, f"avg({x})")


def total(x: str, n: int) -> str:
    return full(x, n, f"sum({x})")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x})")


def low(x: str, bound: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {bound}) END)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


def corr(x: str, y: str, n: int) -> str:
    r = f"covar_pop({x}, {y}) OVER w{n} / nullif(stddev_pop({x}) OVER w{n} * stddev_pop({y}) OVER w{n}, 0)"
    return f"(CASE WHEN count(CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN 1 END) OVER w{n} = {n} THEN {r} END)"


def back(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER s"


def pct(x: str, n: int) -> str:
    return f"({x} / nullif({back(x, n)}, 0) - 1)"


def flag(test: str) -> str:
    return f"coalesce(CAST({test} AS DOUBLE), 0.0)"


def significant(x: str) -> str:
    """Six significant digits, six decimals below 1."""
    return f"CASE WHEN abs({x}) < 1 THEN round({x} + 1e-9, 6) + 0.0 WHEN {x} IS NOT NULL THEN CAST(printf('%.5e', {x}) AS DOUBLE) END"


def select(factors: dict[str, str], source: str, ctes: str, widths, digits: int = 6) -> str:
    columns = ", ".join(f"round({x} + 1e-9, {digits}) + 0.0 AS {name}" for name, x in factors.items() if not name.startswith("RS_"))
    ratios = [name for name in factors if name.startswith("RS_")]
    if ratios:  # to sums near zero: of many orders
        exact = ", ".join(f"{factors[name]} AS {name}" for name in ratios)
        return f"WITH {ctes.strip()} SELECT * REPLACE ({', '.join(f'{significant(name)} AS {name}' for name in ratios)}) FROM (SELECT symbol, date, {', '.join([columns, exact])} FROM {source} {windows(*widths)})"
    return f"WITH {ctes.strip()} SELECT symbol, date, {columns} FROM {source} {windows(*widths)}"


def candle(w):
    o = avg("open", w)
    return {f"KMID_{w}": sdiv(f"{avg('close', w)} - {o}", o), f"KLEN_{w}": sdiv(f"{avg('high', w)} - {avg('low', w)}", o), f"KUP_{w}": sdiv(avg("(high - greatest(open, close))", w), o),
            f"KLOW_{w}": sdiv(avg("(least(open, close) - low)", w), o), f"KSFT_{w}": sdiv(avg("(2 * close - high - low)", w), o)}


def momentum(w):
    return {f"ROC_{w}": sdiv(f"close - {back('close', w)}", back("close", w)), f"MA_{w}": f"{sdiv('close', avg('close', w))} - 1"}


def dispersion(w):
    return {f"STD_{w}": sdiv(std("close", w), "close")}


def regression(w):
    ok = f"CASE WHEN count(close) OVER w{w} = {w} AND stddev_pop(close) OVER w{w} > 0 THEN"
    slope, first = f"regr_slope(close, nr) OVER w{w}", f"coalesce(nullif({back('close', w - 1)}, 0), 1)"
    return {f"BETA_{w}": f"{ok} {slope} / {first} END", f"RSQR_{w}": f"{ok} regr_r2(close, nr) OVER w{w} END",
            f"RESI_{w}": f"{ok} (close - avg(close) OVER w{w} - {slope} * {(w - 1) / 2}) / {first} END"}


def price_place(w):
    hi, lo = full("close", w, "max(close)"), full("close", w, "min(close)")
    return {f"RSV_{w}": sdiv(f"close - {lo}", f"{hi} - {lo}"), f"MAX_{w}": f"{sdiv('close', hi)} - 1", f"MIN_{w}": f"{sdiv('close', lo)} - 1",
            f"QTLU_{w}": f"CASE WHEN count(close) OVER w{w} = {w} THEN len(list_filter(list(close) OVER w{w}, lambda c: c < close)) / {w - 1} END",
            f"QTLD_{w}": f"CASE WHEN count(close) OVER w{w} = {w} THEN len(list_filter(list(close) OVER w{w}, lambda c: c > close)) / {w - 1} END"}


def time_place(w):
    top = full("close", w, "max(struct_pack(c := close, r := -nr))")
    bottom = full("close", w, "min(struct_pack(c := close, r := nr))")
    imax, imin = sdiv(f"nr + ({top}).r", str(w)), sdiv(f"nr - ({bottom}).r", str(w))
    return {f"IMAX_{w}": imax, f"IMIN_{w}": imin, f"IMXD_{w}": f"{imax} - {imin}"}


def price_volume(w):
    return {f"CORR_{w}": corr("close", "volume", w), f"CORD_{w}": corr("close", "ln(1 + volume)", w)}


def up_down_counts(w):
    up, down = avg(flag("ret > 0"), w), avg(flag("ret < 0"), w)
    return {f"CNTP_{w}": up, f"CNTN_{w}": down, f"CNTD_{w}": f"{up} - {down}"}


def up_down_sums(w):
    up, down = total(low("ret", 0), w), total(low("-ret", 0), w)
    return {f"SUMP_{w}": up, f"SUMN_{w}": down, f"SUMD_{w}": f"{up} - {down}"}


def volume_level(w):
    return {f"VMA_{w}": f"{sdiv('volume', avg('volume', w))} - 1", f"VSTD_{w}": sdiv(std("volume", w), avg("volume", w))}


def volume_direction(w):
    v = total("volume", w)
    up, down = sdiv(total(f"(volume * {flag('ret > 0')})", w), v), sdiv(total(f"(volume * {flag('ret < 0')})", w), v)
    return {f"VSUMP_{w}": up, f"VSUMN_{w}": down, f"VSUMD_{w}": f"{up} - {down}"}


FAMILIES = {f.__name__: f for f in (candle, momentum, dispersion, regression, price_place, time_place, price_volume, up_down_counts, up_down_sums, volume_level, volume_direction)}


def family(name: str) -> str:
    return select({k: x for w in WIDTHS for k, x in FAMILIES[name](w).items()}, "r", RETURNS, WIDTHS)


def core_panel(names) -> str:
    """The named price factors and the labels of complete rows of symbols with 90 bars or more."""
    made = {k: x for w in WIDTHS for f in FAMILIES.values() for k, x in f(w).items() if k in names}
    hs = (1, 3, 5, 10)
    columns = ", ".join([*(f"{x} AS {k}" for k, x in made.items()), *(f"(lead(close, {h}) OVER s / nullif(close, 0) - 1) * 100 AS future_return_{h}d" for h in hs), "count(*) OVER (PARTITION BY symbol) AS n_bars"])
    there = " AND ".join(f"{c} IS NOT NULL" for c in [*made, *(f"future_return_{h}d" for h in hs)])
    shown = ", ".join([*(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in ["close", *made, *(f"future_return_{h}d" for h in hs)]), *(f"CAST(future_return_{h}d > 0 AS INTEGER) AS future_up_{h}d" for h in hs)])
    return f"WITH {RETURNS.strip()}, p AS (SELECT symbol, date, close, {columns} FROM r {windows(*WIDTHS)}) SELECT symbol, date, {shown} FROM p WHERE n_bars >= 90 AND {there}"


def weighted_spread() -> str:
    vwap = ", ".join(f"{total('(close * volume)', w)} / nullif({total('volume', w)}, 0) AS vwap{w}" for w in WIDTHS)
    ctes = RETURNS + f", p AS (SELECT *, {vwap} FROM r {windows(*WIDTHS)})"
    return select({f"WVMA_{w}": f"sqrt({sdiv(total(f'((close - vwap{w}) * (close - vwap{w}) * volume)', w), total('volume', w))})" for w in WIDTHS}, "p", ctes, WIDTHS, 4)


def market_relative() -> str:
    both = lambda n, agg: f"(CASE WHEN count(CASE WHEN ret IS NOT NULL THEN r_SPY END) OVER w{n} = {n} THEN {agg} OVER w{n} END)"
    f = {f"RS_SPY_{w}": sdiv(total("ret", w), low(f"abs({total('r_SPY', w)})", 1e-6)) for w in (5, 20)}
    f |= {f"BETA_SPY_{w}": sdiv(both(w, "covar_samp(ret, r_SPY)"), low(full("r_SPY", w, "var_samp(r_SPY)"), 1e-10)) for w in (20, 60)}
    return select(f | {"CORR_SPY_20": corr("ret", "r_SPY", 20)}, "a", ALIGNED, (5, 20, 60))


def etf_relative() -> str:
    f = {}
    for t in TICKERS[1:]:
        e = total(f"r_{t}", 20)
        f |= {f"CORR_{t}_20": corr("ret", f"r_{t}", 20), f"RS_{t}_20": sdiv(f"{total('ret', 20)} - {e}", low(f"abs({e})", 1e-6))}
    return select(f, "a", ALIGNED, (20,))


def lead_signals() -> str:
    f = {"TLT_MOM_5": pct("px_TLT", 5), "TLT_MOM_20": pct("px_TLT", 20), "STOCK_BOND_DIVERGE": f"{total('ret', 5)} - {total('r_TLT', 5)}", "USD_MOM_5": pct("px_UUP", 5),
         "USD_MOM_20": pct("px_UUP", 20), "VIX_MOM_5": pct("px_VIXY", 5), "CREDIT_SPREAD_MOM": total("(r_HYG - r_IEF)", 5)}
    return select(f, "a", ALIGNED, (5,))


def aligned() -> str:
    cols = ", ".join(f"round(px_{t} + 1e-9, 6) + 0.0 AS px_{t}, round(r_{t} + 1e-9, 6) + 0.0 AS r_{t}" for t in TICKERS)
    return f"WITH {ALIGNED.strip()} SELECT symbol, date, {cols} FROM a"


def flow() -> str:
    ctes = RETURNS + """, t AS (
      SELECT *, (high + low + close) / 3.0 AS tp, (high + low + close) / 3.0 - lag((high + low + close) / 3.0) OVER s AS dtp,
             sum(volume * coalesce(sign(ret), 0)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv
      FROM r WINDOW s AS (PARTITION BY symbol ORDER BY date))"""
    up, down = total("(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END)", 14), total("(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END)", 14)
    obv = avg("obv", 20)
    cost = sdiv("abs(ret)", low("close * volume", 1.0))
    f = {"MFI_14": f"(100 - 100 / nullif(1 + {up} / nullif({down}, 0), 0)) / 100", "OBV_RATIO_20": sdiv(f"obv - {obv}", low(f"abs({obv})", 1e-6)), "AMIHUD_20": f"{avg(cost, 20)} * 1e6"}
    return select(f, "t", ctes, (14, 20))


def higher_moments() -> str:
    ctes = RETURNS + ", t AS (SELECT *, lag(ret, 5) OVER s AS ret5 FROM r WINDOW s AS (PARTITION BY symbol ORDER BY date))"
    ok = "CASE WHEN count(ret) OVER w20 = 20 AND stddev_pop(ret) OVER w20 > 0 THEN"
    f = {"SKEW_20": f"{ok} skewness(ret) OVER w20 END", "KURT_20": f"{ok} kurtosis(ret) OVER w20 END", "AUTOCORR_5": f"CASE WHEN count(ret) OVER w20 = 20 THEN {corr('ret', 'ret5', 15)} END"}
    return select(f, "t", ctes, (15, 20))


def volatility() -> str:
    rs = sdiv(avg(low("ret", 0), 14), low(avg(low("-ret", 0), 14), 1e-10))
    f = {"VOL_REGIME": sdiv(std("ret", 10), low(std("ret", 60), 1e-6)), "REALIZED_SKEW_20": sdiv(avg("(ret * ret * ret)", 20), low(f"pow({avg('(ret * ret)', 20)}, 1.5)", 1e-15)), "RSI_14": f"1 - 1 / (1 + {rs})"}
    return select(f, "r", RETURNS, (10, 14, 20, 60))


def relative_volume() -> str:
    rv = {w: sdiv("volume", low(avg("volume", w), 1.0)) for w in (5, 20)}
    f = {f"ROCP_{w}": pct("close", w) for w in (5, 20)} | {f"RVOL_{w}": rv[w] for w in (5, 20)} | {f"MOM_RVOL_{w}": f"{pct('close', w)} * {rv[w]}" for w in (5, 20)}
    return select(f | {"MOMENTUM_ACCEL": f"{pct('close', 5)} - {pct('close', 20)}"}, "r", RETURNS, (5, 20))


def gaps() -> str:
    gap = f"({sdiv('open - ' + back('close'), low(back('close'), 0.01))} * 100)"
    f = {"GAP_PCT": gap, "GAP_FOLLOWTHRU": f"{gap} * ret", "MEGA_GAP_UP": f"CAST({gap} > 3 AS DOUBLE)", "MEGA_GAP_DN": f"CAST({gap} < -3 AS DOUBLE)",
         "GAP_X_MOM5": f"{gap} * ({pct('close', 5)} * 100)", "GAP_ABS_LOG": f"ln(1 + abs({gap}))",
         "INTRADAY_RANGE": sdiv("high - low", low("close", 0.01)), "INTRADAY_DIR": sdiv("close - open", low("high - low", 0.01))}
    return select(f, "r", RETURNS, (5,))


def event_proxies() -> str:
    ctes = RETURNS + ", t AS (SELECT *, volume / nullif(lag(volume) OVER s, 0) - 1 AS dv FROM r WINDOW s AS (PARTITION BY symbol ORDER BY date))"
    f = {"ABNORMAL_VOLUME": sdiv(f"volume - {avg('volume', 20)}", low(std("volume", 20), 1)), "ABNORMAL_RETURN": sdiv("ret", low(std("ret", 20), 1e-6)), "VOLUME_PRICE_CORR": corr("ret", "dv", 5),
         "GAP_RATIO": sdiv(f"open - {back('close')}", low(avg("(high - low)", 14), 1e-4)), "INTRADAY_REVERSAL": f"(close - open) / {low('high - low', 1e-4)}"}
    return select(f, "t", ctes, (5, 14, 20))


MACRO = BARS + """,
macro AS (
  SELECT ['VIXCLS', 'T10Y2Y', 'FEDFUNDS', 'T10YIE', 'ICSA'][k] AS series_id, date, round(CASE WHEN k = 5 THEN v ELSE v / 10000 - 13 END + 1e-9, 6) AS value
  FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)),
calendar AS (SELECT DISTINCT date FROM bars),
days AS (SELECT c.date, """ + asof("macro", "series_id", ("VIXCLS", "T10Y2Y", "FEDFUNDS", "T10YIE", "ICSA"), "") + """ FROM calendar c),
features AS (
  SELECT date,
    CASE WHEN count(VIXCLS) OVER w252 >= 60 AND VIXCLS IS NOT NULL THEN
      (len(list_filter(list(VIXCLS) OVER w252, lambda x: x < VIXCLS)) + (len(list_filter(list(VIXCLS) OVER w252, lambda x: x = VIXCLS)) + 1) / 2) / count(VIXCLS) OVER w252 * 2 - 1 END AS VIX_PERCENTILE,
    """ + clip("VIXCLS / nullif(lag(VIXCLS, 5) OVER d, 0) - 1", -0.5, 0.5) + """ * 2 AS VIX_CHANGE_5D,
    """ + clip(clip("T10Y2Y", -1.5, 3.0) + " / 1.5", -1, 1) + """ AS YIELD_CURVE,
    """ + clip("T10Y2Y - lag(T10Y2Y, 20) OVER d", -1, 1) + """ AS YIELD_CURVE_CHG20,
    """ + clip("(FEDFUNDS - 3.0) / 3.0", -1, 1) + """ AS RATE_LEVEL,
    """ + clip("T10YIE - 2.0", -1, 1) + """ AS INFLATION_EXP,
    """ + clip(sdiv("ICSA - CASE WHEN count(ICSA) OVER w52 >= 20 THEN avg(ICSA) OVER w52 END", low("CASE WHEN count(ICSA) OVER w52 >= 20 THEN stddev_samp(ICSA) OVER w52 END", 1000)), -3, 3) + """ / 3 AS CLAIMS_ZSCORE
  FROM days WINDOW d AS (ORDER BY date), w252 AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), w52 AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"""

MACRO_NAMES = ("VIX_PERCENTILE", "VIX_CHANGE_5D", "YIELD_CURVE", "YIELD_CURVE_CHG20", "RATE_LEVEL", "INFLATION_EXP", "CLAIMS_ZSCORE")
_ROUNDED_MACRO = ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in MACRO_NAMES)


def macro() -> str:
    return f"WITH {MACRO.strip()} SELECT date, {_ROUNDED_MACRO} FROM features"


def macro_join() -> str:
    return f"WITH {MACRO.strip()} SELECT b.symbol, b.date, {_ROUNDED_MACRO} FROM bars b ASOF LEFT JOIN features f ON b.date >= f.date"


def labels() -> str:
    hs = (1, 3, 5, 10)
    ctes = BARS + ", y AS (SELECT *, " + ", ".join(f"(lead(close, {h}) OVER s / nullif(close, 0) - 1) * 100 AS f{h}" for h in hs) + " FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date))"
    cols = ", ".join(f"round(f{h} + 1e-9, 6) + 0.0 AS future_return_{h}d, coalesce(CAST(f{h} > 0 AS INTEGER), 0) AS future_up_{h}d" for h in hs)
    return f"WITH {ctes.strip()} SELECT symbol, date, {cols} FROM y"


#: Rows with a 20-week return as score and forward returns, complete.
SCORED = RETURNS + """,
y AS (SELECT symbol, date, close, nr, close / lag(close, 20) OVER s - 1 AS score, (lead(close, 1) OVER s / close - 1) * 100 AS future_return_1d,
             (lead(close, 5) OVER s / close - 1) * 100 AS future_return_5d FROM r WINDOW s AS (PARTITION BY symbol ORDER BY date)),
scored AS (SELECT symbol, date, close, score, future_return_1d, future_return_5d FROM y WHERE score IS NOT NULL AND future_return_1d IS NOT NULL AND future_return_5d IS NOT NULL)"""
