"""Walk-forward windows, factor selection, blending and score bookkeeping."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOWS = "window int, train_start date, train_end date, val_start date, val_end date, test_start date, test_end date"

#: Factors that selection always keeps, and which of them are macro.
FORCED = ("VIX_", "YIELD_", "RATE_", "INFLATION_", "CLAIMS_", "ROCP_", "RVOL_", "MOM_RVOL_", "MOMENTUM_ACCEL", "RS_SPY_", "GAP_", "MEGA_GAP_")
MACRO = ("VIX_", "YIELD_", "RATE_", "INFLATION_", "CLAIMS_")


def add_months(day: date, n: int) -> date:
    month = day.month - 1 + n
    year, month = day.year + month // 12, month % 12 + 1
    return date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def window_bounds(first: date, last: date, train: int = 12, val: int = 1, test: int = 1, step: int = 1, purge: int = 10, embargo: int = 5) -> list[tuple]:
    """Half-open date ranges of each window; steps add up, so a clamped day of month stays clamped.

    Purge and embargo are calendar days; they shorten training and validation, and do not move what follows.
    """
    out, start = [], first
    while True:
        train_end = add_months(start, train)
        val_start = train_end + timedelta(days=embargo)
        val_end = add_months(train_end, val)
        test_end = add_months(val_end, test)
        if test_end > last:
            return out
        out.append((len(out), start, train_end - timedelta(days=purge), val_start, val_end, val_end, test_end))
        start = add_months(start, step)


def walk_forward_windows(spark: SparkSession, panel: DataFrame, **steps: int) -> DataFrame:
    """The window table: tens of rows, from the panel's first and last date."""
    ends = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    rows = window_bounds(ends["a"], ends["b"], **steps) if ends["a"] else []
    return spark.createDataFrame(rows, WINDOWS)


def window_days(windows: DataFrame) -> DataFrame:
    """window, role, date: the calendar days of every window's ranges. windows is a bounded table, and so is this (windows times days)."""
    ranges = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("lo"), F.col(f"{r}_end").alias("hi")) for r in ("train", "val", "test")])
    spans = windows.select("window", F.explode(ranges).alias("s")).filter("s.lo < s.hi")
    return spans.select("window", "s.role", F.explode(F.sequence("s.lo", F.date_sub("s.hi", 1))).alias("date"))


def tag_windows(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """panel rows with window and role, once per window and role whose range holds the date: a join by day."""
    days = window_days(windows).select("window", "role", F.col("date").alias("_day"))
    return panel.join(F.broadcast(days), panel["date"] == F.col("_day")).drop("_day")


def usable_windows(tagged: DataFrame, train: int = 100, val: int = 20, test: int = 20) -> DataFrame:
    """window and its row counts, for windows with enough rows in each role."""
    n = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    counts = tagged.groupBy("window").agg(n("train"), n("val"), n("test"))
    return counts.filter((F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test))


def _starts(prefixes: tuple[str, ...]):
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith(F.col("feature"), F.lit(p))
    return test


def select_features(ics: DataFrame, min_ic: float = 0.02, top_k: int | None = 80, forced: tuple[str, ...] = FORCED, macro: tuple[str, ...] = MACRO, macro_cap: int = 5) -> DataFrame:
    """window, feature, ic, place: forced ones first (macro ones capped), then the best others up to top_k in all. |ic| counts to nine digits; ties go by name."""
    rows = ics.withColumn("forced", _starts(forced)).withColumn("macro", F.col("forced") & _starts(macro)).filter(F.col("forced") | (F.abs("ic") >= min_ic))
    best = [F.desc(F.round(F.abs("ic"), 9)), F.col("feature")]
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("window", "macro").orderBy(*best))).filter(~F.col("macro") | (F.col("_m") <= macro_cap))
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("forced"), *best))
    out = rows.withColumn("place", place)
    if top_k is not None:
        out = out.filter(F.col("forced") | (F.col("place") <= top_k))
    return out.select("window", "feature", "ic", "forced", "place")


def feature_frequency(selected: DataFrame, top: int = 30) -> DataFrame:
    return selected.groupBy("feature").agg(F.count("*").alias("windows")).orderBy(F.desc("windows"), "feature").limit(top)


def capped(weights: dict[str, float], cap: float = 0.40) -> dict[str, float]:
    """Weights summing to 1, none over the cap where that can be: up to five rounds hand the excess in equal parts to those below it, which stop at it.

    One model keeps 1; what no model may take is shared by the last scaling, so two models end at a half each.
    """
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()} if total else dict(weights)
    if len(w) < 2:
        return w
    for _ in range(5):
        excess = sum(max(v - cap, 0) for v in w.values())
        below = {k: v for k, v in w.items() if v < cap}
        if excess < 1e-6 or not below:
            break
        w = {k: min(v + excess / len(below), cap) if k in below else cap for k, v in w.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total else w


def raw_weights(ics: DataFrame, policy: str = "abs_ic") -> DataFrame:
    """window, model, weight before the cap: |ic| of every model, or the positive ics only."""
    rows = ics.filter("ic > 0") if policy == "positive_ic" else ics
    w = F.abs("ic") / F.sum(F.abs("ic")).over(Window.partitionBy("window"))
    return rows.select("window", "model", w.alias("weight"))


def ensemble_weights(spark: SparkSession, ics: DataFrame, policy: str = "abs_ic", cap: float = 0.40) -> DataFrame:
    """window, model, weight: a dozen rows a window, capped on the driver."""
    by_window: dict[int, dict[str, float]] = {}
    for r in raw_weights(ics, policy).orderBy("window", "model").collect():
        by_window.setdefault(r["window"], {})[r["model"]] = r["weight"]
    rows = [(w, m, float(v)) for w, ms in by_window.items() for m, v in capped(ms, cap).items()]
    return spark.createDataFrame(rows, "window int, model string, weight double")


def ensemble_score(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """window, date, symbol, score: the weighted sum of predictions. weights has a row per window and model (broadcast)."""
    return predictions.join(F.broadcast(weights), ["window", "model"]).groupBy("window", "date", "symbol").agg(F.sum(F.col("weight") * F.col("prediction")).alias("score"))


def dedupe_scores(scores: DataFrame) -> DataFrame:
    """One score per date and symbol: the latest window's."""
    rows = scores.dropna(subset=["date", "symbol"])
    last = F.row_number().over(Window.partitionBy("date", "symbol").orderBy(F.desc("window"), F.desc("score")))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last")


def common_dates(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both restricted to the dates that both have."""
    dates = a.select("date").intersect(b.select("date"))
    return a.join(dates, "date", "left_semi"), b.join(dates, "date", "left_semi")


def last_month(panel: DataFrame) -> DataFrame:
    """Adds holdout: whether a row is within the panel's last month."""
    ends = panel.agg(F.add_months(F.max("date"), -1).alias("_cut"))
    return panel.join(F.broadcast(ends)).withColumn("holdout", F.col("date") >= F.col("_cut")).drop("_cut")


def regime_filter(panel: DataFrame, factor: str, threshold: float = 0.0) -> DataFrame:
    return panel.filter(F.col(factor) > threshold)


def regime_summary(panel: DataFrame, factor: str, threshold: float = 0.0) -> DataFrame:
    """Rows and days in the regime, and its share of all rows."""
    inside = F.col(factor) > threshold
    return panel.agg(F.count_if(inside).alias("rows"), F.count_distinct(F.when(inside, F.col("date"))).alias("days"), (F.count_if(inside) / F.count("*")).alias("share"))
