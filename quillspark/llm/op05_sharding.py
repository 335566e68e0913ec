"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Row p of the matrix says how many rows partition p sends to each cell, a cell
being a stretch of slots of one shard. The matrix is drawn by halving: at each
node of a binary tree over the partitions, the left half's share of every cell is
multivariate hypergeometric, with a generator seeded by the node; so each task
draws just its own row along its path, from the partitions' row counts alone.
It then permutes locally (which of its rows go to which cell), the cells are
exchanged, and each cell is permuted again by random keys. Every arrangement of
the rows is equally likely, and counts of shards differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import tidy
from .common import stored, table, with_free_names

SHARDS, SEED = 8, 20240607
#: Rows of a cell; a shard has as many cells as that takes, up to MAX_CELLS in all, each a task of the exchange. Beyond 2.6 x 10^9 rows cells grow
#: (at 10^11 rows to 380,000 rows, about 1 GB, whose sort spills), since each task holds two numbers for every cell.
CELL_ROWS, MAX_CELLS = 10_000, 1 << 18
#: numpy's hypergeometric generator takes fewer rows than the first; so many are drawn one by one.
_LARGE, _FEW = 1_000_000_000, 1000


def even_sizes(total: int, parts: int) -> np.ndarray:
    """Sizes of parts that differ by one at most, larger ones first."""
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def hypergeometric_split(sizes: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` rows drawn without replacement come from each of the cells; exact at any size.

    Beyond numpy's range each row is first taken with probability take / total, which is a binomial
    number for each cell. The rows by which their sum is wrong, about its square root, are then drawn back
    from those taken, or on from the others, by the same law; few rows are drawn one by one.
    """
    total = int(sizes.sum())
    take = min(take, total)
    if total < _LARGE:
        return rng.multivariate_hypergeometric(sizes, take, method="marginals")
    if take > total - take:
        return sizes - hypergeometric_split(sizes, total - take, rng)
    if take <= _FEW:
        rows = rng.choice(total, take, replace=False, shuffle=False)
        return np.bincount(np.searchsorted(np.cumsum(sizes), rows, "right"), minlength=len(sizes))
    taken = rng.binomial(sizes, take / total)
    wrong = int(taken.sum()) - take
    return taken - hypergeometric_split(taken, wrong, rng) if wrong >= 0 else taken + hypergeometric_split(sizes - taken, -wrong, rng)


def matrix_row(counts: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix for partitions of so many rows and cells of such sizes."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, own = 0, len(counts), cells
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = hypergeometric_split(own, int(ends[mid] - ends[lo]), np.random.default_rng([seed, lo, hi]))
        lo, hi, own = (lo, mid, left) if p < mid else (mid, hi, own - left)
    return own


def _is_scan(df: DataFrame) -> bool:
    """Whether df is files, projected and filtered: then its partitions are the same each time it runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with columns shard (int) and slot (long, gapless from 0 in each shard).

    Values don't matter: nulls, ties and repeated rows are placed as any row is,
    and an empty df stays empty. Columns of df that are named shard or slot are
    kept, as _shard or _slot. Input other than plain files is written to the
    shared folder first, so that its partitions keep their rows when tasks run again.
    """
    name = with_free_names(df, "shard", "slot", "cell", "order")
    for c in df.columns:
        if c.lower() in ("shard", "slot"):
            df = df.withColumnRenamed(c, name[c.lower()])
    if not _is_scan(df):
        df = stored(df, "sharding-input")
    n = df.rdd.getNumPartitions()
    counts = np.zeros(n, np.int64)
    for p, c in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect():
        counts[p] = c
    total = int(counts.sum())
    per_shard = even_sizes(total, shards)
    cuts = min(max(1, -(-int(per_shard.max()) // cell_rows)), max(1, MAX_CELLS // shards))
    sizes = np.concatenate([even_sizes(int(s), cuts) for s in per_shard])
    shared = df.sparkSession.sparkContext.broadcast((counts, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        counts, sizes = shared.value
        rng = np.random.default_rng([seed, len(counts), p])
        cells = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, p, seed))
        rng.shuffle(cells)
        done = 0
        for batch in batches:
            own = cells[done : done + len(batch)]
            done += len(batch)
            if len(own) < len(batch):
                raise RuntimeError(f"partition {p} has more rows than were counted")
            keys = rng.integers(-(1 << 63), (1 << 63) - 1, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(keys)], names=[*batch.schema.names, name["cell"], name["order"]])
        if done != len(cells):
            raise RuntimeError(f"partition {p} has fewer rows than were counted")

    schema = T.StructType([*df.schema.fields, T.StructField(name["cell"], T.IntegerType()), T.StructField(name["order"], T.LongType())])
    dealt = df.mapInArrow(tidy(run), schema)
    # A cell is a partition of its own, so no task gets several by chance.
    dealt = dealt.repartitionById(shards * cuts, F.col(name["cell"]))
    rank = F.row_number().over(Window.partitionBy(name["cell"]).orderBy(name["order"]))
    shard, place = F.floor(F.col(name["cell"]) / cuts), F.col(name["cell"]) % cuts
    rows = F.lit(total // shards) + (shard < total % shards).cast("long")  # of the shard, cut as even_sizes does
    start = place * F.floor(rows / cuts) + F.least(place.cast("long"), rows % cuts)
    placed = dealt.withColumn("slot", (start + rank - 1).cast("long")).withColumn("shard", shard.cast("int"))
    return placed.select(*df.columns, "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
