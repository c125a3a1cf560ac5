"""Cross-sectional operators: per-date ranks, buckets, spreads and their summaries.

Everything is keyed by date (and by window or model where given), so one hash exchange by date serves ranking, gates and
aggregates. Ties are broken by symbol, since the order of equal scores is otherwise undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xpanel.functions.exprs import average_rank, clip, group_correlation, quantile_bucket
from xpanel.functions.places import medians, with_average_rank

ANNUAL = 252.0


def by_date(*keys: str) -> Window:
    return Window.partitionBy(*keys, "date")


def gate(df: DataFrame, least: int, *keys: str) -> DataFrame:
    """Rows of dates with at least so many names."""
    return df.withColumn("_names", F.count("*").over(by_date(*keys))).filter(F.col("_names") >= least).drop("_names")


def neutralize_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_neutral, the label less its date's mean; the raw label stays."""
    return df.withColumns({f"{c}_neutral": F.col(c) - F.avg(c).over(by_date()) for c in columns})


def tail_labels(df: DataFrame, label: str, q: float = 0.2) -> DataFrame:
    """0 / 1 / 2 for the bottom, middle and top of each date by average-rank percentile."""
    share = average_rank(label, "date") / F.count(label).over(by_date())
    return df.withColumn("tail", F.when(share <= q, 0).when(share >= 1 - q, 2).otherwise(1))


def date_edges(df: DataFrame, value: str, n: int) -> DataFrame:
    """date, edges: n + 1 exact quantiles of each date."""
    return df.groupBy("date").agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("edges"), F.count("*").alias("names"))


def relevance_grades(df: DataFrame, label: str, n_buckets: int = 5) -> DataFrame:
    """Quantile grade of each row within its date; dates with fewer names than buckets, or one value, get the middle."""
    edges = date_edges(df, label, n_buckets)
    grade = F.when(F.col("names") >= n_buckets, quantile_bucket(F.col(label), F.col("edges")))
    return df.join(edges, "date").withColumn("grade", F.coalesce(grade, F.lit(n_buckets // 2)).cast("int")).drop("edges", "names")


def daily_rank_ic(df: DataFrame, score: str, label: str, min_names: int, *keys: str) -> DataFrame:
    """keys, date, ic: Spearman correlation of each date with enough names; dates where a side is constant are left out."""
    ranked = gate(df, min_names, *keys).withColumn("_rs", average_rank(score, *keys, "date")).withColumn("_rl", average_rank(label, *keys, "date"))
    return ranked.groupBy(*keys, "date").agg(group_correlation("_rs", "_rl").alias("ic")).dropna(subset=["ic"])


def ic_summary(ics: DataFrame, *keys: str) -> DataFrame:
    """Mean IC, ICIR (1-day spread 1, no spread 0) and days."""
    spread = F.when(F.count("ic") == 1, 1.0).otherwise(F.stddev_pop("ic"))
    rows = ics.groupBy(*keys) if keys else ics.groupBy()
    out = rows.agg(F.avg("ic").alias("mean_ic"), spread.alias("_spread"), F.count("ic").alias("n_days"))
    return out.withColumn("icir", F.when(F.col("_spread") > 1e-9, F.try_divide("mean_ic", "_spread")).otherwise(0.0)).drop("_spread")


def pooled_rank_ic(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Spearman over all rows of each key (more than ten)."""
    ranked = with_average_rank(with_average_rank(df, score, "_rs", *keys), label, "_rl", *keys)
    out = ranked.groupBy(*keys).agg(group_correlation("_rs", "_rl").alias("ic"), F.count("*").alias("n_rows"))
    return out.filter("n_rows > 10")


def ranked_ends(df: DataFrame, score: str = "score", *keys: str) -> DataFrame:
    """Adds top_place and bottom_place (1 is the highest and the lowest score) and names, within each date."""
    w = by_date(*keys)
    return df.withColumn("top_place", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("names", F.count("*").over(w)).withColumn("bottom_place", F.col("names") - F.col("top_place") + 1)


def _mean_where(test: Column, value: str) -> Column:
    return F.avg(F.when(test, F.col(value)))


def daily_spreads(df: DataFrame, label: str, k: int, min_names: int, *keys: str) -> DataFrame:
    """keys, date, top, bottom, spread: means of the k best and the k worst."""
    ends = ranked_ends(df, "score", *keys).filter((F.col("names") >= min_names) & ((F.col("top_place") <= k) | (F.col("bottom_place") <= k)))
    daily = ends.groupBy(*keys, "date").agg(_mean_where(F.col("top_place") <= k, label).alias("top"), _mean_where(F.col("bottom_place") <= k, label).alias("bottom"))
    return daily.withColumn("spread", F.col("top") - F.col("bottom"))


def topk_return(df: DataFrame, label: str, k: int = 10, cost_bps: float = 10, *keys: str) -> DataFrame:
    """Means of the daily top and bottom returns, spread gross and net, Sharpe, and shares of positive days in percent."""
    cost = cost_bps * 2 / 10000 * 100
    daily = daily_spreads(df, label, k, 2 * k, *keys)
    spread = F.when(F.count("*") > 1, F.stddev_pop("spread")).otherwise(1.0)
    rows = daily.groupBy(*keys) if keys else daily.groupBy()
    out = rows.agg(
        F.avg("top").alias("top_k_return"), F.avg("bottom").alias("bottom_k_return"), F.avg("spread").alias("spread"), spread.alias("_sd"),
        (F.avg((F.col("spread") > 0).cast("double")) * 100).alias("pct_positive_spread"),
        (F.avg((F.col("spread") - cost > 0).cast("double")) * 100).alias("pct_positive_spread_net"), F.count("*").alias("n_days"),
    )
    net = F.col("spread") - cost
    sharpe = F.when(F.col("_sd") > 1e-9, F.try_divide(net, F.col("_sd")) * ANNUAL**0.5).otherwise(0.0)
    return out.withColumn("spread_net", net).withColumn("long_short_sharpe", sharpe).drop("_sd")


def bucket_returns(df: DataFrame, label: str, n_buckets: int = 5) -> DataFrame:
    """bucket (from 1), avg_return and std_return of its daily means, days, and for all: is_monotonic, spread_top_bottom.

    Needs ten rows a bucket in all (else no rows) and two names a bucket on a day.
    """
    edges = date_edges(df, "score", n_buckets).filter(F.col("names") >= 2 * n_buckets)
    placed = df.join(edges, "date").withColumn("bucket", quantile_bucket(F.col("score"), F.col("edges"))).dropna(subset=["bucket"])
    daily = placed.groupBy("date", "bucket").agg(F.avg(label).alias("r"))
    means = daily.groupBy("bucket").agg(F.avg("r").alias("avg_return"), F.when(F.count("*") > 1, F.stddev_pop("r")).alias("std_return"), F.count("*").alias("days"))
    enough = df.agg(F.count("*").alias("_n")).filter(F.col("_n") >= 10 * n_buckets)
    order, every = Window.orderBy("bucket"), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # n_buckets rows
    means = means.withColumn("_falls", (F.round("avg_return", 4) < F.lag(F.round("avg_return", 4)).over(order)).cast("int"))
    out = means.withColumn("is_monotonic", F.coalesce(F.max("_falls").over(every), F.lit(0)) == 0)
    out = out.withColumn("spread_top_bottom", F.last("avg_return").over(every) - F.first("avg_return").over(every))
    return out.join(F.broadcast(enough)).select((F.col("bucket") + 1).cast("int").alias("bucket"), "avg_return", "std_return", "days", "is_monotonic", "spread_top_bottom")


def directional_accuracy(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Share of rows where score and label have the same sign, and where score above its median goes with a positive label; RMSE."""
    rows = df.join(medians(df, score, "_median", *keys), list(keys))
    up = F.col(label) > 0
    return rows.groupBy(*keys).agg(
        F.avg(((F.col(score) > 0) == up).cast("double")).alias("dir_acc"), F.avg(((F.col(score) > F.col("_median")) == up).cast("double")).alias("dir_acc_median"),
        F.sqrt(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label)))).alias("rmse"),
    )


def group_sizes(df: DataFrame, weight: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("names")] + ([F.avg(weight).alias("mean_weight")] if weight else [])
    return df.groupBy("date").agg(*aggs)


def sentiment_cross_section(df: DataFrame) -> DataFrame:
    """Per snapshot: news_sent_cs, the clipped z score of sentiment over 3, and news_buzz_cs, the clipped excess of news over its mean."""
    w = by_date()
    z = (F.col("sentiment") - F.avg("sentiment").over(w)) / F.greatest(F.stddev_pop("sentiment").over(w), F.lit(0.01))
    buzz = F.col("news") / F.greatest(F.avg("news").over(w), F.lit(1.0)) - 1.0
    return df.select("date", "symbol", F.round(clip(z, -3, 3) / 3 + 1e-9, 4).alias("news_sent_cs"), F.round(clip(buzz, -1, 1) + 1e-9, 4).alias("news_buzz_cs"))
