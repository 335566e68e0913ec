"""Statistics: nearest-rank quantiles, series, inequality and intervals. All are plain columns or group-bys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95, Z_WILSON = 1.96, 1.959963984540054


#: Which measures a kind of description has, what it says of no rows, and whether its mean is rounded.
KINDS = {
    "full": ("count total minimum p25 median mean p75 p90 p95 p99 maximum zero", None, False),
    "plain": ("count minimum p25 median mean p75 p90 p95 p99 maximum", None, True),
    "integer": ("count minimum p25 median mean p75 p90 p95 p99 maximum", 0, False),
    "short": ("count minimum median mean p75 p90 p95 p99 maximum", 0, False),
    "profile": ("count p50 p90 p99", None, False),
}


def triple(ordered: Column) -> list[Column]:
    """Median (nearest rank), mean and maximum of a sorted array of numbers; nulls if it is empty."""
    n = F.size(ordered)
    middle = F.try_element_at(ordered, F.greatest(F.ceil(n / 2), F.lit(1)).cast("int"))
    mean = F.try_divide(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x), n)
    return [middle.alias("median"), mean.alias("mean"), F.array_max(ordered).alias("maximum")]


def weighted_histogram(df: DataFrame, value: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by, value, weight: how much weight each value has. Partial sums before the shuffle keep heavy values cheap."""
    return df.groupBy(*(by or []), F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("weight"))


def _stretch(value: Column) -> Column:
    """A number that grows with value and takes few values: the power of two and the next six bits."""
    v = value.cast("double")
    power = F.floor(F.log2(F.greatest(v, F.lit(1e-300))))
    return F.when(v > 0, power * 64 + F.floor((v / F.pow(F.lit(2.0), power) - 1) * 64)).otherwise(-(1 << 40)).cast("long")


def running(hist: DataFrame, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """hist with upto (the weight up to and including each value) and all (the whole weight), per by.

    Values are cut into stretches; a stretch's running sum starts at the sum of
    those before it. So no task sorts all distinct values, and only the few
    stretches are summed in one place.
    """
    by = by or []
    cut = hist.withColumn("_s", _stretch(F.col("value")))
    turn = F.desc if descending else F.asc
    sums = cut.groupBy(*by, "_s").agg(F.sum("weight").alias("_w"))
    w = Window.partitionBy(*by)
    before = sums.select(*by, "_s", F.coalesce(F.sum("_w").over(w.orderBy(turn("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_w").over(w).alias("all"))
    within = F.sum("weight").over(Window.partitionBy(*by, "_s").orderBy(turn("value")).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_within", within).join(before, [*by, "_s"]).withColumn("upto", F.col("_before") + F.col("_within")).drop("_s", "_before", "_within")


def weighted_quantiles(hist: DataFrame, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """Weighted nearest-rank quantiles of a histogram, one column q<percent> each: the first value at which the weight so far reaches ceil(p total)."""
    by = by or []
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("all"))), F.col("value"))).alias(f"q{round(p * 100)}") for p in ps]
    run = running(hist, by)
    return run.groupBy(*by).agg(*picks) if by else run.agg(*picks)


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """value, percent: the share of values up to each distinct value."""
    hist = weighted_histogram(df.filter(F.col(col).isNotNull()), col)
    return running(hist).select("value", (F.lit(100.0) * F.col("upto") / F.col("all")).alias("percent"))


def survival(df: DataFrame, col: str, rate: float) -> DataFrame:
    """minutes, percent: the share of values that take at least so long at rate a minute; zeros count in the whole only."""
    hist = weighted_histogram(df.filter(F.col(col).isNotNull()), col)
    out = running(hist, descending=True).filter("value > 0")
    return out.select((F.col("value") / F.lit(float(rate))).alias("minutes"), (F.lit(100.0) * F.col("upto") / F.col("all")).alias("percent"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), n: equal bins, the last closed."""
    k = F.least(F.floor((F.col(col) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(col).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def ticks(maximum: float, intervals: int) -> list[float]:
    """Evenly spaced ends of intervals from 0 to maximum."""
    return [maximum * k / intervals for k in range(intervals)] + [maximum]


def herfindahl(df: DataFrame, group: str, amount: str) -> DataFrame:
    """group, hhi, largest_share: from partial sums only, sum of squares over square of the sum."""
    per = df.groupBy(group).agg(F.sum(F.col(amount).cast("double") * F.col(amount)).alias("sq"), F.sum(amount).cast("double").alias("total"), F.max(amount).cast("double").alias("top"))
    return per.select(group, F.coalesce(F.try_divide("sq", F.col("total") * F.col("total")), F.lit(0.0)).alias("hhi"), F.coalesce(F.try_divide("top", "total"), F.lit(0.0)).alias("largest_share"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Odds ratio of the table [[a, b], [c, d]], null if b or c is empty, and its 95 % interval, null if any cell is."""
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    value = F.try_divide(a * d, b * c)
    error = F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + F.try_divide(F.lit(1.0), c) + F.try_divide(F.lit(1.0), d))
    return value, *(F.when(full, x) for x in (F.exp(F.log(value) - Z95 * error), F.exp(F.log(value) + Z95 * error)))


def wilson(hits: Column, n: Column, empty: float | None = None) -> tuple[Column, Column]:
    """Wilson's 95 % interval of hits among n; both ends are ``empty`` for n = 0."""
    p, z = hits.cast("double") / n, F.lit(Z_WILSON)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = F.lit(empty).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(none)


def wilson_value(hits: int, n: int, empty: float | None = None) -> tuple[float | None, float | None]:
    """The same for two numbers."""
    if n == 0:
        return empty, empty
    z, p = Z_WILSON, hits / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, middle - half), min(1.0, middle + half)
