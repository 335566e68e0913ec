"""SimHash near-duplicates by similarity: shard trees over MinHash keys, exact confirmation.

Two texts link if the Jaccard similarity of their sets of five-word shingles
reaches the threshold. Equal sets are reduced to one node first. A node is in the shard
of each of its ``BANDS`` keys of ``ROWS`` minima; a pair at 0.8 shares no shard with probability
(1 - 0.8^6)^24 = 0.0007. A shard's BK-tree over the nodes' fingerprints gives,
for each node, the others within ``RADIUS`` bits; those of another component are compared
set by set until one links them, so a group of copies makes about as many
comparisons as it has members, never all of its pairs.

Shards beyond ``SHARD_ROWS`` nodes or ``SHARD_SHINGLES`` shingles are dealt to cells at random, each
key anew, which joins large groups of copies. What then still has several
components is compared in full: cells of one stretch of the nodes outside the shard's
largest component and one of all its nodes, for all pairs of stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import spread, tidy
from .common import BROADCAST_IDS, stored, with_ids, without
from .op08_simhash import SEED, BkTree, components, simhash

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
#: Fingerprints of texts at 0.8 differ by 9.7 bits on average, with a deviation of 3.
RADIUS = 22
#: Keys that are tried first, to join most copies before the others are looked at.
FIRST = 4
SHARD_ROWS, SHARD_SHINGLES = 256, 2_000_000
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: How a row of a cell takes part: held by the tree, sought in it, or both.
HELD, SOUGHT, BOTH = 0, 1, 2


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; of all its words if they are fewer, none without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    parts = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) > size else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= similarity * large and jaccard(a, b) >= similarity


def keys(own: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    import xxhash

    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for i in range(0, len(own), 512):
        np.minimum(least, (own[i : i + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def _marks(texts: DataFrame, size: int) -> DataFrame:
    """id, same (equal for equal sets of shingles), n (shingles of the set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(0, len(batch), 128):
                part, same, n, found = batch.slice(i, 128), [], [], []
                for text in part.column(1).to_pylist():
                    own = shingles(text, size)
                    same.append(xxhash.xxh3_128_digest(own.tobytes()))
                    n.append(len(own))
                    found.append(keys(own))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "same", "n", "keys"])

    return spread(texts).mapInArrow(tidy(run), T.StructType([texts.schema["id"]]).add("same", "binary").add("n", "long").add("keys", T.ArrayType(T.LongType())))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """node, fp, own: fingerprint and set (its hashes as bytes) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                own = [shingles(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([simhash(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "fp", "own"])

    return texts.mapInArrow(tidy(run), "node long, fp long, own binary")


def cell_links(members: list[tuple[int, int, int, int, np.ndarray]], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Confirmed links that join the components of a cell's members (side, node, root, fp, own), those that are held first."""
    tree, up, held, out = BkTree(radius), {}, [], []

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for side, node, root, fp, own in members:
        if side != HELD:
            for k in tree.find(fp):
                other, its_root, its_own = held[k]
                if top(its_root) != top(root) and reaches(own, its_own, similarity):
                    out.append((max(node, other), min(node, other)))
                    up[top(root)] = top(its_root)
        if side != SOUGHT:
            tree.insert(fp)
            held.append((node, root, own))
    return out


def _confirmed(cells: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """a, b: the links of all cells. cells: v, cell, side, node, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def out() -> pa.RecordBatch:
            found = cell_links(members, radius, similarity) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i in range(0, len(batch), 256):
                for v, cell, *row, own in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if (v, cell) != key:
                        if members:
                            yield out()
                        key, members = (v, cell), []
                    members.append((*row, np.frombuffer(own, np.uint64)))
        if members:
            yield out()

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = cells.join(sets, "node").select("v", "cell", "side", "node", "root", "fp", "own")
    return full.repartition(n, "v", "cell").sortWithinPartitions("v", "cell", "side", "node").mapInArrow(tidy(run), "a long, b long").distinct()


def _open(held: DataFrame, roots: DataFrame | None) -> DataFrame:
    """held with the root of each node, without the shards that have one root only."""
    if roots is None:
        return held.withColumn("root", F.col("node"))
    known = held.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = known.groupBy("v").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("v")
    return known.join(several, "v")


def _dealt(rows: DataFrame, wave: int) -> DataFrame:
    """Cells of a shard: its nodes dealt at random to as many as it needs."""
    cell = F.pmod(F.xxhash64("node", "v", F.lit(wave)), F.col("parts"))
    return rows.select("v", cell.alias("cell"), F.lit(BOTH).alias("side"), "node", "root")


def _crossed(rows: DataFrame) -> DataFrame:
    """Cells of a shard such that each node outside its largest component meets each other node in one."""
    per = rows.groupBy("v", "root").agg(F.count("*").alias("c"))
    large = per.groupBy("v").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("n")).select("v", F.col("m.root").alias("large"), "n", (F.col("n") - F.col("m.c")).alias("rest"))
    known = rows.join(large, "v").withColumn("few", F.ceil(F.col("rest") * F.col("parts") / F.col("n"))).withColumn("o", F.pmod(F.xxhash64("node", "v"), F.col("parts"))).withColumn("e", F.pmod(F.xxhash64("v", "node"), F.col("few")))
    every = known.select("v", "node", "root", "o", "parts", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("e"), F.lit(HELD).alias("side"))
    rest = known.filter("root <> large").select("v", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o"), "parts", "e", F.lit(SOUGHT).alias("side"))
    return every.unionByName(rest).select("v", (F.col("e") * F.col("parts") + F.col("o")).alias("cell"), "side", "node", "root")


def _roots(nodes: DataFrame, texts: DataFrame, size: int, similarity: float, radius: int, shard_rows: int) -> DataFrame | None:
    """a, b: the nodes that links join to a smaller one, and the smallest that they reach; None if there are none."""
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "v"))
    parts = F.greatest(F.ceil(F.count("*") / shard_rows), F.ceil(F.sum("n") / SHARD_SHINGLES))
    shared = keyed.groupBy("v").agg(F.count("*").alias("c"), parts.alias("parts")).filter("c > 1").select("v", "parts")
    held = stored(keyed.join(shared, "v").select("band", "v", "node", "parts"), "similar-held")
    if held.isEmpty():
        return None
    wanted = stored(held.select(F.col("node").alias("id")).distinct(), "similar-wanted")
    sets = stored(_sets(texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi"), size), "similar-sets")
    roots = None
    for wave in range(3):
        rows = stored(_open(held.filter(F.col("band") < FIRST) if wave == 0 else held if wave == 1 else held.filter("parts > 1"), roots), "similar-open")
        if rows.isEmpty():
            continue
        links = stored(_confirmed(_dealt(rows, wave) if wave < 2 else _crossed(rows), sets, radius, similarity), "similar-links")
        if not links.isEmpty():
            roots = components(links if roots is None else links.unionByName(roots))
    return roots


def _nodes(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The marks of all texts, and the node (smallest id) of each set."""
    marks = stored(_marks(texts, size), "similar-marks")
    return marks, stored(marks.groupBy("same").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")), "similar-nodes")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, component: per row of docs the smallest id that links reach; ids must be unique and not null."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks, nodes = _nodes(texts, size)
    roots = _roots(nodes, texts, size, similarity, radius, shard_rows)
    if roots is None:
        return marks.join(nodes.select("same", F.col("node").alias("component")), "same").select("id", "component")
    near = roots.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rooted = nodes.select("same", "node").join(near, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return marks.select("id", "same").join(rooted, "same").select("id", "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with one row of each component of similar texts, that of the smallest id; all columns stay.

    Null and wordless texts are copies of each other. If ids are null or
    repeat, or aren't numbers, the rows are numbered first, and the numbers serve as ids.
    An empty table stays empty; columns of docs may have any names.
    """
    rows, key = with_ids(docs, id_col)
    texts = rows.select(F.col(key).alias("id"), F.col(text_col).alias("text"))
    marks, nodes = _nodes(texts, size)
    roots = _roots(nodes, texts, size, similarity, radius, shard_rows)
    kept = nodes.select(F.col("node").alias("id"))
    if roots is not None:
        kept = kept.join(roots.select(F.col("a").alias("id")), "id", "left_anti")
    gone = stored(marks.select("id").join(kept, "id", "left_anti").withColumnRenamed("id", key), "similar-gone")
    return without(rows, key, gone).select(*docs.columns)
