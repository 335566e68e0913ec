"""Deterministic samples: smallest digests per stratum, and round robin over strata. Windows keep at most k rows a stratum before the sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(prefix: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), key), 256)


def smallest_digests(df: DataFrame, stratum: str, key: str, k: int, prefix: str) -> DataFrame:
    """The k rows of each stratum with the smallest SHA-256 of prefix and key, with columns digest and rank."""
    ranked = df.withColumn("digest", digest(prefix, F.col(key).cast("string")))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("digest", key))).filter(F.col("rank") <= k)


def with_capacities(df: DataFrame, capacities: DataFrame, stratum: str, key: str, prefix: str) -> DataFrame:
    """The same with a capacity for each stratum (columns: stratum, capacity; a short list)."""
    ranked = df.withColumn("digest", digest(prefix, F.col(key).cast("string"))).join(F.broadcast(capacities), stratum)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("digest", key))).filter(F.col("rank") <= F.col("capacity"))


def round_robin(df: DataFrame, category: str, band: str, bands: list[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each category, taken in turn from its bands in the given order, each band by SHA-256 of seed:key; column pick is the turn."""
    order = F.array_position(F.array(*map(F.lit, bands)), F.col(band))
    turned = df.withColumn("digest", digest(f"{seed}:", F.col(key).cast("string")))
    turned = turned.withColumn("turn", F.row_number().over(Window.partitionBy(category, band).orderBy("digest", key))).filter(F.col("turn") <= k)
    return turned.withColumn("pick", F.row_number().over(Window.partitionBy(category).orderBy("turn", order, "digest"))).filter(F.col("pick") <= k).drop("turn")
