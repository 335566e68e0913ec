"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD_OUT

#: Characters of a training text at most, so that the sample is bounded; longer ones don't train (they are scored whole like any other).
TRAIN_CHARS = 1 << 20
#: Characters of all training texts at most, which bounds what comes to the driver.
ALL_CHARS = 64 << 20


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", train_chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most so many training documents of label 0 and of label 1, and the share of label 1 among all training labels.

    The sample is the rows whose id hashes lowest, as far as their texts have at most train_chars
    characters, and all of them together all_chars; ids may have any type, and are compared as texts where documents and labels differ in it. Of several labels of a document
    the mean counts, of several documents of an id the first by text; null ids and labels don't. Only ids of the sample, a
    bounded number, are broadcast.
    """
    same = docs.schema[id_col].dataType == labels.schema[id_col].dataType
    key = F.col(id_col) if same else F.col(id_col).cast("string")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = known.groupBy(key.alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    order = F.xxhash64("id", F.lit("sample"))
    chosen = [one.filter(F.col("label") == k).orderBy(order, "id").limit(n) for k, n in enumerate(per_class)]
    ids = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for part in chosen for r in part.collect()], one.schema)
    rows = docs.select(key.alias("id"), F.substring(text_col, 1, train_chars + 1).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.filter(F.length("text") <= train_chars).groupBy("id", "label").agg(F.min("text").alias("text"))
    # No more rows than the sample has ids are summed up here.
    upto = F.sum(F.length("text")).over(Window.orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= all_chars).select("id", "text", "label").collect()
    total = sum(counts.values())
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["id"], r["text"]))], counts.get(1, 0) / total if total else 0.0
