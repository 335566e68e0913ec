"""Files that arrive in a folder, parsed as a stream into a Parquet table; late repeats are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import SCHEMAS, structure_fields


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of rows of the files table from Parquet files as they appear."""
    return spark.readStream.schema(SCHEMAS["files"]).parquet(folder)


def structured(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each content once within the delay, with its structure."""
    seen = files.withColumn("seen_at", F.coalesce(F.try_to_timestamp("fetched_at"), F.current_timestamp())).withWatermark("seen_at", delay)
    once = seen.dropDuplicatesWithinWatermark(["content_hash"])
    return once.select("id", "repo_full_name", "path", "content_hash", "seen_at", *[v.alias(k) for k, v in structure_fields(F.col("content")).items()])


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Run until all that is there has been taken in."""
    query = structured(arriving(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
