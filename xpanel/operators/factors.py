"""Factor families: each takes bars (or aligned bars) and adds its columns by windows over a symbol's rows.

All windows share one partition and order, so any number of families costs one shuffle and one sort by (symbol, date).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xpanel.functions.exprs import at_least, back, by_symbol, change, finite, ratio, rows, safe_div, total
from xpanel.functions.rolling import Rolling
from xpanel.sources.adapter import MARKET, NATIONS, SECTORS

WIDTHS = (5, 10, 20, 30, 60)
ETFS = SECTORS + NATIONS

Factors = dict[str, Column]


def _columns() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume", "ret"))


def with_returns(bars: DataFrame) -> DataFrame:
    """bars with ret (close over the previous close, less 1) and nr (row number within the symbol)."""
    return bars.withColumn("ret", change("close")).withColumn("nr", F.row_number().over(by_symbol()))


def with_factors(df: DataFrame, make: Callable[[Rolling], Factors]) -> DataFrame:
    """df with the factors that make() gives; what they have in common is made once."""
    r = Rolling()
    made = make(r)
    return r.add(df).withColumns(made).drop(*r.columns())


def candle(r: Rolling, w: int) -> Factors:
    O, _, _, C, _, _ = _columns()
    o, h, low, c = (r.mean(x, w) for x in ("open", "high", "low", "close"))
    top, bottom = r.mean("body_top", w, F.greatest(O, C)), r.mean("body_bottom", w, F.least(O, C))
    return {
        f"KMID_{w}": safe_div(c - o, o), f"KLEN_{w}": safe_div(h - low, o), f"KUP_{w}": safe_div(h - top, o),
        f"KLOW_{w}": safe_div(bottom - low, o), f"KSFT_{w}": safe_div(2 * c - h - low, o),
    }


def momentum(r: Rolling, w: int) -> Factors:
    _, _, _, C, _, _ = _columns()
    return {f"ROC_{w}": safe_div(C - back(C, w), back(C, w)), f"MA_{w}": safe_div(C, r.mean("close", w)) - 1.0}


def dispersion(r: Rolling, w: int) -> Factors:
    _, _, _, C, _, _ = _columns()
    return {f"STD_{w}": safe_div(r.std("close", w), C)}


def regression(r: Rolling, w: int) -> Factors:
    """Least squares of close / first close - 1 on 0..w-1: slope, R squared and last residual; null for a constant close."""
    _, _, _, C, _, _ = _columns()
    first, time = back(C, w - 1), w * (w * w - 1) / 12
    r.total("nr", w, F.col("nr").cast("double"))
    both, square = r.products("nr", "close", w), r.squares("close", w)
    slope, unit, moves = both / time, F.when(first == 0, F.lit(1.0)).otherwise(first), square > 0
    residual = (C - r.mean("close", w) - slope * ((w - 1) / 2)) / unit
    return {f"BETA_{w}": F.when(moves, slope / unit), f"RSQR_{w}": F.when(moves, both * both / (square * time)), f"RESI_{w}": F.when(moves, residual)}


def price_place(r: Rolling, w: int) -> Factors:
    """RSV, MAX, MIN by the highest and lowest close; QTLU and QTLD: the share of the other closes below and above."""
    _, _, _, C, _, _ = _columns()
    high, low = r.highest("close", w), r.lowest("close", w)
    smaller, larger = r.places("close", w)
    share = lambda n: F.when(high.isNotNull(), n / F.lit(w - 1))
    return {
        f"RSV_{w}": safe_div(C - low, high - low), f"MAX_{w}": safe_div(C, high) - 1.0, f"MIN_{w}": safe_div(C, low) - 1.0,
        f"QTLU_{w}": share(smaller), f"QTLD_{w}": share(larger),
    }


def time_place(r: Rolling, w: int) -> Factors:
    """Bars since the first highest and the first lowest close, as a share of w. IMXD is positive if the high is older."""
    _, _, _, C, _, _ = _columns()
    row = F.col("nr")
    top = r.highest("high_close", w, F.when(C.isNotNull(), F.struct(C.alias("c"), (-row).alias("r"))))
    bottom = r.lowest("low_close", w, F.when(C.isNotNull(), F.struct(C.alias("c"), row.alias("r"))))
    imax, imin = safe_div(row + top["r"], F.lit(w)), safe_div(row - bottom["r"], F.lit(w))
    return {f"IMAX_{w}": imax, f"IMIN_{w}": imin, f"IMXD_{w}": imax - imin}


def price_volume(r: Rolling, w: int) -> Factors:
    _, _, _, _, V, _ = _columns()
    return {f"CORR_{w}": r.correlation("close", "volume", w), f"CORD_{w}": r.correlation("close", "log_volume", w, xb=F.log1p(V))}


def _flag(test: Column) -> Column:
    return F.coalesce(test.cast("double"), F.lit(0.0))


def up_down_counts(r: Rolling, w: int) -> Factors:
    _, _, _, _, _, RET = _columns()
    up, down = r.mean("rises", w, _flag(RET > 0)), r.mean("falls", w, _flag(RET < 0))
    return {f"CNTP_{w}": up, f"CNTN_{w}": down, f"CNTD_{w}": up - down}


def up_down_sums(r: Rolling, w: int) -> Factors:
    _, _, _, _, _, RET = _columns()
    up, down = r.total("gain", w, at_least(RET, 0)), r.total("loss", w, at_least(-RET, 0))
    return {f"SUMP_{w}": up, f"SUMN_{w}": down, f"SUMD_{w}": up - down}


def volume_level(r: Rolling, w: int) -> Factors:
    _, _, _, _, V, _ = _columns()
    return {f"VMA_{w}": safe_div(V, r.mean("volume", w)) - 1.0, f"VSTD_{w}": safe_div(r.std("volume", w), r.mean("volume", w))}


def volume_direction(r: Rolling, w: int) -> Factors:
    _, _, _, _, V, RET = _columns()
    every = r.total("volume", w)
    up, down = safe_div(r.total("volume_up", w, V * _flag(RET > 0)), every), safe_div(r.total("volume_down", w, V * _flag(RET < 0)), every)
    return {f"VSUMP_{w}": up, f"VSUMN_{w}": down, f"VSUMD_{w}": up - down}


def weighted_spread(bars: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """WVMA: each row deviates from its own rolling weighted price, so the look-back is 2w - 1 rows (two chained windows)."""
    _, _, _, C, V, _ = _columns()
    spread = lambda w: (C - F.col(f"_vwap{w}")) * (C - F.col(f"_vwap{w}")) * V
    priced = with_factors(bars, lambda r: {f"_vwap{w}": ratio(r.total("money", w, C * V), r.total("volume", w)) for w in widths})
    out = with_factors(priced, lambda r: {f"WVMA_{w}": F.sqrt(safe_div(r.total(f"spread{w}", w, spread(w)), r.total("volume", w))) for w in widths})
    return out.drop(*[f"_vwap{w}" for w in widths])


#: family -> factors of one width; WVMA comes from weighted_spread
PRICE_FAMILIES = {
    "candle": candle, "momentum": momentum, "dispersion": dispersion, "regression": regression, "price_place": price_place, "time_place": time_place,
    "price_volume": price_volume, "up_down_counts": up_down_counts, "up_down_sums": up_down_sums, "volume_level": volume_level, "volume_direction": volume_direction,
}


def price_factors(r: Rolling, family: str, widths: tuple[int, ...] = WIDTHS) -> Factors:
    return {k: v for w in widths for k, v in PRICE_FAMILIES[family](r, w).items()}


def price_names(family: str, widths: tuple[int, ...] = WIDTHS) -> list[str]:
    return list(price_factors(Rolling(), family, widths))


def price_family(bars: DataFrame, family: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """bars (with_returns) and one family's columns for all widths."""
    return with_factors(bars, lambda r: price_factors(r, family, widths))


# --- benchmarks -------------------------------------------------------------------------------------------------------


def asof_wide(calendar: DataFrame, series: DataFrame, key: str, value: str, names: tuple[str, ...]) -> DataFrame:
    """date and a column per series: the latest value at or before each date of the calendar.

    calendar (date) and series (date, key, value) are as long as the history has days, whatever the number of symbols:
    that bounds both this table, which callers broadcast, and its one-partition window.
    """
    wide = series.groupBy("date").pivot(key, list(names)).agg(F.first(value))
    both = calendar.select("date").distinct().withColumn("_asked", F.lit(True)).join(wide, "date", "full")
    history = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("date", "_asked", *[F.last(n, ignorenulls=True).over(history).alias(n) for n in names]).filter("_asked").drop("_asked")


def asof_join(left: DataFrame, right: DataFrame, by: str | None, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right (by, date, values) at or before its date.

    For right sides of any size: both are stacked and the last known values carried forward within `by`. Without `by` the right
    side is one series: it is carried over the calendar of left's dates, and that is joined by date.
    """
    if by is None:
        dates = left.select("date").distinct().withColumn("_one", F.lit(0))
        known = asof_join(dates, right.select("date", *values, F.lit(0).alias("_one")), "_one", values).drop("_one")
        return left.join(known, "date", "left")
    empty = [F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values]
    carried = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (by, "date")]
    stacked = left.select("*", *empty, F.lit(1).alias("_left")).unionByName(right.select(by, "date", *carried, *values, F.lit(0).alias("_left")))
    known = Window.partitionBy(by).orderBy("date", "_left").rowsBetween(Window.unboundedPreceding, 0)
    return stacked.select(*left.columns, *[F.last(v, ignorenulls=True).over(known).alias(v) for v in values], "_left").filter("_left = 1").drop("_left")


def align_bench(bars: DataFrame, bench: DataFrame, tickers: tuple[str, ...] = (MARKET, *ETFS)) -> DataFrame:
    """bars with px_<ticker> (as of the date) and r_<ticker>, the return between the symbol's own dates."""
    wide = asof_wide(bars, bench, "ticker", "close", tickers)
    wide = wide.select("date", *[F.col(t).alias(f"px_{t}") for t in tickers])
    joined = bars.join(F.broadcast(wide), "date", "left")
    return joined.withColumns({f"r_{t}": change(f"px_{t}") for t in tickers})


def market_relative(r: Rolling) -> Factors:
    """Relative strength, beta and correlation against the market."""
    m = f"r_{MARKET}"
    for name in ("ret", m):
        r.total(name, 5)
    out = {f"RS_{MARKET}_{w}": safe_div(r.total("ret", w), at_least(F.abs(r.total(m, w)), 1e-6)) for w in (5, 20)}
    sample = lambda x, w: x / F.lit(float(w - 1))
    out |= {f"BETA_{MARKET}_{w}": safe_div(sample(r.products("ret", m, w), w), at_least(sample(r.squares(m, w), w), 1e-10)) for w in (20, 60)}
    return out | {f"CORR_{MARKET}_20": r.correlation("ret", m, 20)}


def etf_relative(r: Rolling, tickers: tuple[str, ...] = ETFS) -> Factors:
    out: Factors = {}
    for t in tickers:
        e = f"r_{t}"
        corr, own, other = r.correlation("ret", e, 20), r.total("ret", 20), r.total(e, 20)
        out |= {f"CORR_{t}_20": corr, f"RS_{t}_20": safe_div(own - other, at_least(F.abs(other), 1e-6))}
    return out


def lead_signals(r: Rolling) -> Factors:
    """Bonds, dollar, volatility and credit."""
    return {
        "TLT_MOM_5": change("px_TLT", 5), "TLT_MOM_20": change("px_TLT", 20), "STOCK_BOND_DIVERGE": r.total("ret", 5) - r.total("r_TLT", 5),
        "USD_MOM_5": change("px_UUP", 5), "USD_MOM_20": change("px_UUP", 20), "VIX_MOM_5": change("px_VIXY", 5),
        "CREDIT_SPREAD_MOM": r.total("credit", 5, F.col("r_HYG") - F.col("r_IEF")),
    }


# --- single-symbol extras ---------------------------------------------------------------------------------------------


def flow(bars: DataFrame) -> DataFrame:
    """Money flow index, on-balance volume against its mean, illiquidity."""
    _, H, L, C, V, RET = _columns()
    typical = (H + L + C) / 3.0
    staged = bars.withColumn("_tp", typical).withColumn("_dtp", F.col("_tp") - back("_tp"))
    signed = V * F.coalesce(F.sign(RET), F.lit(0.0))
    staged = staged.withColumn("_obv", F.sum(signed).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    money = F.col("_tp") * V
    up = F.when(F.col("_dtp") > 0, money).otherwise(0.0)
    down = F.when(F.col("_dtp") < 0, money).otherwise(0.0)
    cost = safe_div(F.abs(RET), at_least(C * V, 1.0))

    def made(r: Rolling) -> Factors:
        mfr = ratio(r.total("money_up", 14, up), r.total("money_down", 14, down))
        obv, obv_mean = F.col("_obv"), r.mean("_obv", 20)
        return {
            "MFI_14": (100.0 - ratio(F.lit(100.0), 1.0 + mfr)) / 100.0, "OBV_RATIO_20": safe_div(obv - obv_mean, at_least(F.abs(obv_mean), 1e-6)),
            "AMIHUD_20": r.mean("cost", 20, cost) * 1e6,
        }

    return with_factors(staged, made).drop("_tp", "_dtp", "_obv")


def higher_moments(r: Rolling) -> Factors:
    """Bias-corrected skewness and kurtosis, and the lag-5 autocorrelation within 20 returns."""
    _, _, _, _, _, RET = _columns()
    n = 20.0
    # the moments of a constant window are undefined
    square = r.squares("ret", 20)
    moves = square > 0
    g1, g2 = r.cubes("ret", 20) * F.lit(n**0.5) / F.pow(square, 1.5), r.fourths("ret", 20) * F.lit(n) / (square * square) - 3
    auto = F.when(r.total("ret", 20).isNotNull(), r.correlation("ret", "ret_before", 15, xb=back(RET, 5)))
    return {
        "SKEW_20": F.when(moves, g1 * ((n * (n - 1)) ** 0.5 / (n - 2))), "KURT_20": F.when(moves, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        "AUTOCORR_5": auto,
    }


def volatility(r: Rolling) -> Factors:
    _, _, _, _, _, RET = _columns()
    square, cube = r.mean("ret_2", 20, RET * RET), r.mean("ret_3", 20, RET * RET * RET)
    gain, loss = r.mean("gain", 14, at_least(RET, 0)), r.mean("loss", 14, at_least(-RET, 0))
    strength = safe_div(gain, at_least(loss, 1e-10))
    return {
        "VOL_REGIME": safe_div(r.std("ret", 10), at_least(r.std("ret", 60), 1e-6)), "REALIZED_SKEW_20": safe_div(cube, at_least(F.pow(square, 1.5), 1e-15)),
        "RSI_14": 1.0 - ratio(F.lit(1.0), 1.0 + strength),
    }


def relative_volume(r: Rolling) -> Factors:
    _, _, _, _, V, _ = _columns()
    rocp = {w: change("close", w) for w in (5, 20)}
    rvol = {w: safe_div(V, at_least(r.mean("volume", w), 1.0)) for w in (5, 20)}
    out = {f"ROCP_{w}": rocp[w] for w in rocp} | {f"RVOL_{w}": rvol[w] for w in rvol} | {f"MOM_RVOL_{w}": rocp[w] * rvol[w] for w in rocp}
    return out | {"MOMENTUM_ACCEL": rocp[5] - rocp[20]}


def gaps(_: Rolling) -> Factors:
    O, _, _, C, _, RET = _columns()
    gap = safe_div(O - back(C), at_least(back(C), 0.01)) * 100
    return {
        "GAP_PCT": gap, "GAP_FOLLOWTHRU": gap * RET, "MEGA_GAP_UP": (gap > 3.0).cast("double"), "MEGA_GAP_DN": (gap < -3.0).cast("double"),
        "GAP_X_MOM5": gap * (change("close", 5) * 100), "GAP_ABS_LOG": F.log1p(F.abs(gap)),
    }


def intraday(_: Rolling) -> Factors:
    O, H, L, C, _, _ = _columns()
    return {"INTRADAY_RANGE": safe_div(H - L, at_least(C, 0.01)), "INTRADAY_DIR": safe_div(C - O, at_least(H - L, 0.01))}


def event_proxies(bars: DataFrame) -> DataFrame:
    O, H, L, C, V, RET = _columns()
    made = lambda r: {
        "ABNORMAL_VOLUME": safe_div(V - r.mean("volume", 20), at_least(r.std("volume", 20), 1)), "ABNORMAL_RETURN": safe_div(RET, at_least(r.std("ret", 20), 1e-6)),
        "VOLUME_PRICE_CORR": r.correlation("ret", "_dv", 5), "GAP_RATIO": safe_div(O - back(C), at_least(r.mean("range", 14, H - L), 1e-4)),
        "INTRADAY_REVERSAL": finite((C - O) / at_least(H - L, 1e-4)),
    }
    return with_factors(bars.withColumn("_dv", change("volume")), made).drop("_dv")


FLOW = ("MFI_14", "OBV_RATIO_20", "AMIHUD_20")
EVENTS = ("ABNORMAL_VOLUME", "ABNORMAL_RETURN", "VOLUME_PRICE_CORR", "GAP_RATIO", "INTRADAY_REVERSAL")

# --- macro ------------------------------------------------------------------------------------------------------------

MACRO_SERIES = ("VIXCLS", "T10Y2Y", "FEDFUNDS", "T10YIE", "ICSA")


def macro_features(calendar: DataFrame, macro: DataFrame) -> DataFrame:
    """date and seven macro columns over the trading calendar; a null series gives a null column."""
    from xpanel.functions.exprs import clip

    days = asof_wide(calendar, macro, "series_id", "value", MACRO_SERIES)
    over = Window.orderBy("date")
    frame = lambda n: over.rowsBetween(-(n - 1), 0)
    lag = lambda c, n: F.lag(c, n).over(over)
    vix, yc, rate, infl, claims = (F.col(c) for c in MACRO_SERIES)
    past = F.collect_list(vix).over(frame(252))
    seen = F.count(vix).over(frame(252))
    mean_rank = F.size(F.filter(past, lambda x: x < vix)) + (F.size(F.filter(past, lambda x: x == vix)) + 1) / 2
    enough = F.count(claims).over(frame(52)) >= 20
    mid, spread = F.when(enough, F.avg(claims).over(frame(52))), F.when(enough, F.stddev_samp(claims).over(frame(52)))
    return days.select(
        "date",
        F.when((seen >= 60) & vix.isNotNull(), mean_rank / seen * 2 - 1).alias("VIX_PERCENTILE"),
        (clip(ratio(vix, lag(vix, 5)) - 1, -0.5, 0.5) * 2).alias("VIX_CHANGE_5D"),
        clip(clip(yc, -1.5, 3.0) / 1.5, -1, 1).alias("YIELD_CURVE"),
        clip(yc - lag(yc, 20), -1, 1).alias("YIELD_CURVE_CHG20"),
        clip((rate - 3.0) / 3.0, -1, 1).alias("RATE_LEVEL"),
        clip(infl - 2.0, -1, 1).alias("INFLATION_EXP"),
        (clip(safe_div(claims - mid, at_least(spread, 1000)), -3, 3) / 3).alias("CLAIMS_ZSCORE"),
    )


MACRO_FACTORS = ("VIX_PERCENTILE", "VIX_CHANGE_5D", "YIELD_CURVE", "YIELD_CURVE_CHG20", "RATE_LEVEL", "INFLATION_EXP", "CLAIMS_ZSCORE")


def join_macro(panel: DataFrame, features: DataFrame) -> DataFrame:
    """The macro columns as of each row's date, by day: features has a row per trading day at most, and each stands for the calendar
    days up to the next (the last for all later dates). That table is as long as the history has days, and broadcast."""
    names = [c for c in features.columns if c != "date"]
    until = F.coalesce(F.lead("date").over(Window.orderBy("date")), F.date_add("date", 1))
    days = features.withColumn("_until", until).select(F.explode(F.sequence("date", F.date_sub("_until", 1))).alias("_day"), *names)
    last = features.agg(F.max("date").alias("last")).scalar()
    return panel.withColumn("_as_of", F.least("date", last)).join(F.broadcast(days), F.col("_as_of") == F.col("_day"), "left").drop("_as_of", "_day")


# --- labels -----------------------------------------------------------------------------------------------------------

HORIZONS = (1, 3, 5, 10)


def forward_labels(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """future_return_<h>d in percent and future_up_<h>d (0 where the return is null)."""
    _, _, _, C, _, _ = _columns()
    ret = {h: (ratio(F.lead("close", h).over(by_symbol()), C) - 1) * 100 for h in horizons}
    out = bars.withColumns({f"future_return_{h}d": r for h, r in ret.items()})
    return out.withColumns({f"future_up_{h}d": F.coalesce((F.col(f"future_return_{h}d") > 0).cast("int"), F.lit(0)) for h in horizons})
