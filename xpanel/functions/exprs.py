"""Column expressions with the null, infinity and window rules of the factor definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL, DATE = "symbol", "date"


def by_symbol() -> Window:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def rows(n: int):
    """The last n rows of a symbol, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def back(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def full(x: Column, n: int, value: Column) -> Column:
    """value over the last n rows where all n values of x are there, else null."""
    return F.when(F.count(x).over(rows(n)) == n, value.over(rows(n)))


def mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x))


def total(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x))


def std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return finite(F.try_divide(a, b))


def safe_div(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a / b, and `fill` where that is null or infinite."""
    return F.coalesce(ratio(a, b), F.lit(fill))


def at_least(x: Column, low: float) -> Column:
    """Clip from below; null stays null (greatest() would take the bound)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def correlation(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation over n complete pairs; null where a side is constant (corr() throws there)."""
    pair = F.when(x.isNotNull() & y.isNotNull(), x)
    r = F.try_divide(F.covar_pop(x, y).over(rows(n)), F.stddev_pop(x).over(rows(n)) * F.stddev_pop(y).over(rows(n)))
    return F.when(F.count(pair).over(rows(n)) == n, r)


def change(x: str | Column, n: int = 1) -> Column:
    """x_t / x_(t-n) - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return ratio(x, F.lag(x, n).over(by_symbol())) - 1


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within the keys, ties share their mean rank."""
    within = Window.partitionBy(*keys)
    return F.rank().over(within.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def group_correlation(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quantile_bucket(x: Column, edges: Column) -> Column:
    """Bucket from 0 of right-closed quantile intervals, duplicate edges dropped; null where one edge is left."""
    distinct = F.array_distinct(edges)
    return F.when(F.size(distinct) > 1, F.greatest(F.size(F.filter(distinct, lambda e: e < x)) - 1, F.lit(0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, -0.0 as 0.0; moved a little first, as engines differ on which way an exact half goes."""
    return df.select(*[(F.round(F.col(c) + 1e-9, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
