"""Bands: counts and sizes put into named ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def banded(value: Column, edges: list[tuple[int, str]], last: str, unknown: str | None = "unknown") -> Column:
    """The name of the first edge that value doesn't exceed, or last; unknown for null."""
    out = F.when(value.isNull(), unknown) if unknown else F
    for edge, name in edges:
        out = out.when(value <= edge, name)
    return out.otherwise(last)


def size_band(size: Column) -> Column:
    return banded(size, [(50, "<=50"), (200, "51-200"), (1000, "201-1000"), (5000, "1001-5000")], ">5000")


def star_band(stars: Column) -> Column:
    return banded(stars, [(0, "0"), (9, "1-9"), (99, "10-99"), (999, "100-999")], ">=1000")


def multiplicity_band(n: Column) -> Column:
    return banded(n, [(2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20")], ">20", None)


#: Ranges of a file-count histogram.
COUNT_RANGES = [(k, k, str(k)) for k in range(1, 6)] + [(6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 100, "51-100"), (101, None, ">100")]


def range_histogram(spark: SparkSession, counts: DataFrame, col: str, ranges=None) -> DataFrame:
    """ordinal, label, n: rows of counts in each range, empty ranges included. The ranges are a short constant list."""
    ranges = ranges or COUNT_RANGES
    label = F.lit(None).cast("int")
    for k, (low, high, _) in reversed(list(enumerate(ranges))):
        inside = (F.col(col) >= low) & (F.col(col) <= high if high is not None else F.lit(True))
        label = F.when(inside, k).otherwise(label)
    found = counts.select(label.alias("ordinal")).groupBy("ordinal").count()
    bins = spark.createDataFrame([(k, name) for k, (_, _, name) in enumerate(ranges)], "ordinal int, label string")
    return bins.join(F.broadcast(found), "ordinal", "left").select("ordinal", "label", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
