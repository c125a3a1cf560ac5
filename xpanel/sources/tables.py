"""Readers and writers of bars, macro observations, universes, panels, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
UNIVERSE = "symbol string, sector string, snapshot_date string"
MACRO = "series_id string, date string, value string"


def normalise_date(column) -> F.Column:
    """A date from a date, a time stamp with or without zone, or text; null where text is none."""
    return F.try_to_timestamp(column.cast("string")).cast("date")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of many symbols in one table; rows without a key are rejected."""
    return spark.read.schema(BARS).parquet(path).dropna(subset=["symbol", "date"])


def clean_macro(observations: DataFrame) -> DataFrame:
    """series_id, date, value: values that are no number ('.', '') and bad dates are dropped."""
    value = F.expr("try_cast(value AS double)")
    return observations.select("series_id", normalise_date(F.col("date")).alias("date"), value.alias("value")).dropna()


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    return clean_macro(spark.read.schema(MACRO).csv(path, header=True))


def clean_universe(universe: DataFrame, order: str = "ord") -> DataFrame:
    """Symbols trimmed with '.' written as '-', sectors trimmed, nulls dropped, the first row of each symbol kept."""
    symbol = F.regexp_replace(F.trim("symbol"), r"\.", "-")
    rows = universe.select(order, symbol.alias("symbol"), F.trim("sector").alias("sector")).dropna(subset=["symbol"])
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(order))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def stack(panels: list[DataFrame]) -> DataFrame:
    """Panels of different symbols under one another; a column that a panel lacks is null there."""
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_universe(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """A snapshot file in its order (small: one file), the first top_n rows if given."""
    rows = spark.read.schema(UNIVERSE).csv(path, header=True).withColumn("ord", F.monotonically_increasing_id())
    return clean_universe(rows if top_n is None else rows.orderBy("ord").limit(top_n))


def read_panel(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def _by_year(panel: DataFrame):
    """Partitioned by year, so that date ranges prune files. Rows are written where they are made, a file for each year and task: to
    exchange rows of all factors would take as much disk as the panel itself."""
    return panel.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year")


def write_panel(panel: DataFrame, path: str) -> None:
    _by_year(panel).parquet(path)


def merge_panel(rows: DataFrame, path: str) -> None:
    """New and corrected rows of a written panel, in place of those with their date and symbol: only the years that rows touch are
    written anew, each in one step when all of its files are there; other years' files stay as they are."""
    years = [r["year"] for r in rows.select(F.year("date").alias("year")).distinct().collect()]  # as many as the history has
    there = rows.sparkSession.read.parquet(path).filter(F.col("year").isin(years)).drop("year")
    untouched = there.join(rows.select("date", "symbol"), ["date", "symbol"], "left_anti")
    _by_year(untouched.unionByName(rows, allowMissingColumns=True)).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_bars(bars: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Bars as a table of the catalog, in buckets of symbols sorted by date: every later pass of windows over a symbol's rows, and
    every join by symbol with another such table, needs no exchange."""
    bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("date").option("path", path).saveAsTable(name)


def open_bars(spark: SparkSession, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The table written at path; a session whose catalog does not know it is told of its buckets."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (date) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A nested row per report as JSON; reports are a handful of rows."""
    report.coalesce(1).write.mode("overwrite").json(path)
