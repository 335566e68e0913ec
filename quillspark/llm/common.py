"""Small shared helpers of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import written as stored

__all__ = ["BROADCAST_IDS", "HELD_OUT", "plainly_named", "stored", "table", "with_free_names", "with_ids", "without"]

#: Rows with crc32(doc_id as text) % 4 equal to this never train a model.
HELD_OUT = 2
#: Ids (numbers) that a broadcast may carry: 16 MB of them.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted helper column, a name that df doesn't have (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        free = n
        while free.lower() in taken:
            free = "_" + free
        taken.add(free.lower())
        out[n] = free
    return out


def with_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and a column of it that numbers its rows: id_col if it does, else a new one, which is fixed by writing the rows."""
    if docs.schema[id_col].dataType.typeName() == "long" and docs.filter(F.col(id_col).isNull()).isEmpty() and docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return docs, id_col
    n = with_free_names(docs, "rid")["rid"]
    return stored(docs.withColumn(n, F.monotonically_increasing_id()), "numbered-rows"), n


def plainly_named(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., which no column that an operator adds is called; and the name of each of df's."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows without those whose number is in the stored table gone (one column, named key)."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")
