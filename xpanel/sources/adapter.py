"""Bars, benchmarks, macro series and universe derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET = "SPY"
SECTORS = ("XLK", "XLF", "XLE", "XLV", "TLT")  #: by region key
NATIONS = ("UUP", "HYG", "IEF", "VIXY")  #: by nation key
SERIES = ("VIXCLS", "T10Y2Y", "FEDFUNDS", "T10YIE", "ICSA")  #: by order priority


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars: a supplier is a symbol, its line items of a week are trades, in the order of day, order, line, part and price.

    That order is one number of 35 digits, so first and last are kept in a hash aggregate's buffer; a struct would need two sorts.
    """
    items = _table(spark, sf_dir, "lineitem")
    order = F.weekday("l_shipdate").cast("decimal(1,0)")
    for part, digits in ((F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 11), (F.round(F.col("l_extendedprice") * 100), 9)):
        order = (order * F.lit(10**digits).cast(f"decimal({digits + 1},0)") + part.cast(f"decimal({digits},0)")).cast("decimal(38,0)")
    price = F.col("l_extendedprice").cast("double")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return items.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), week.alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(F.col("l_quantity").cast("double")).alias("volume"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    supplier = _table(spark, sf_dir, "supplier")
    joined = supplier.join(places, supplier["s_nationkey"] == places["n_nationkey"])
    return joined.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("sector"), "r_regionkey", "n_nationkey", F.col("s_suppkey").alias("ord"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select("ord", "symbol", "sector")


def bench(spark: SparkSession, sf_dir: str, prices: DataFrame) -> DataFrame:
    """date, ticker, close: the mean close of all suppliers, of each region, and of the first nations."""
    places = suppliers(spark, sf_dir).select("symbol", "r_regionkey", "n_nationkey")
    sector = F.element_at(F.array(*map(F.lit, SECTORS)), F.col("r_regionkey").cast("int") + 1)
    nation = F.when(F.col("n_nationkey") < len(NATIONS), F.element_at(F.array(*map(F.lit, NATIONS)), F.least(F.col("n_nationkey").cast("int") + 1, F.lit(len(NATIONS)))))
    tickers = F.array_compact(F.array(F.lit(MARKET), sector, nation))
    rows = prices.select("symbol", "date", "close").join(places, "symbol").select("date", "close", F.explode(tickers).alias("ticker"))
    return rows.groupBy("date", "ticker").agg(F.avg("close").alias("close"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations as text, a series per order priority, scaled to the size of rates (but for claims)."""
    orders = _table(spark, sf_dir, "orders")
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    month = F.date_trunc("month", "o_orderdate").cast("date")
    raw = orders.groupBy(number.alias("k"), month.alias("date")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("v"))
    series = F.element_at(F.array(*map(F.lit, SERIES)), F.col("k"))
    value = F.when(F.col("k") == len(SERIES), F.col("v")).otherwise(F.col("v") / 10000 - 13)
    return raw.select(series.alias("series_id"), F.col("date").cast("string").alias("date"), F.round(value + 1e-9, 6).cast("string").alias("value"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot (month) and user: the mean value and the count of events."""
    events = _table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("month", "ts").cast("date").alias("date"), F.col("user_id").cast("string").alias("symbol")).agg(F.avg("value").alias("sentiment"), F.count("*").cast("double").alias("news"))
