"""SimHash near-duplicates: fingerprints, BK-tree links, connected components.

A fingerprint bit is set if it is set in over half of the shingles' XXH64
values. Two fingerprints link at ``radius`` or fewer differing bits. The links
are searched among distinct fingerprints only: cut into radius + 2 bit blocks,
two linked fingerprints agree in two blocks at least, so every pair of blocks
makes a key, and each key's fingerprints form a shard. A shard's BK-tree
(children keyed by the integer Hamming distance to their parent) is built and
searched in one go, following only the edges within the radius, and gives back
one star of links per connected part, never all pairs. Shards above
``shard_rows`` fingerprints are cut once more by blocks of the bits that their
key leaves free, which bounds any shard by the number of values of its free bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import stored, table, with_ids, without

SHINGLE, SEED, RADIUS, SHARD_ROWS = 3, 42, 2, 4096
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number, as Spark's long holds it; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    return simhash(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", n))


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, as a signed number; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp: one row per row of docs; null and wordless texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part, seen, out = batch.slice(i, 1024), {}, []
                for text in part.column(1).to_pylist():
                    if text not in seen:
                        seen[text] = fingerprint(text, shingle)
                    out.append(seen[text])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(tidy(run), slim.schema[0:1].add("fp", "long", False))


class BkTree:
    """A BK-tree of 64-bit codes: node k has code codes[k] and children[k], a dict from distance to node."""

    def __init__(self, radius: int):
        self.radius, self.codes, self.children = radius, [], []

    def find(self, code: int) -> list[int]:
        """The nodes within the radius."""
        codes, children, r, found = self.codes, self.children, self.radius, []
        todo = [0] if codes else []
        while todo:
            k = todo.pop()
            d = ((codes[k] ^ code) & _ALL).bit_count()
            if d <= r:
                found.append(k)
            for edge, child in children[k].items():
                if d - r <= edge <= d + r:
                    todo.append(child)
        return found

    def insert(self, code: int) -> None:
        codes, children = self.codes, self.children
        new, place = len(codes), 0
        codes.append(code)
        children.append({})
        while new:
            d = ((codes[place] ^ code) & _ALL).bit_count()
            if d not in children[place]:
                children[place][d] = new
                return
            place = children[place][d]

    def add(self, code: int) -> list[int]:
        """Insert a code; return the nodes within the radius that were there before."""
        found = self.find(code)
        self.insert(code)
        return found


def shard_links(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """(code, smallest code of its connected part in this shard) for codes that aren't their part's smallest."""
    tree, root = BkTree(radius), list(range(len(codes)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, code in enumerate(sorted(codes)):  # so a root is the smallest code of its part
        for other in tree.add(code):
            a, b = top(k), top(other)
            root[max(a, b)] = min(a, b)
    return [(code, tree.codes[top(k)]) for k, code in enumerate(tree.codes) if top(k) != k]


def _cuts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: a star of links for each connected part of each shard of the distinct fingerprints in column fp."""
    blocks = _cuts(list(range(64)), radius + 2)
    pairs = list(combinations(range(radius + 2), 2))
    masks = [_mask(blocks[i] + blocks[j]) for i, j in pairs]
    part = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(part).alias("p")).select("fp", F.col("p.k").alias("k"), F.col("p.v").alias("v"))
    large = stored(keyed.groupBy("k", "v").count().filter(F.col("count") > shard_rows).select("k", "v"), "simhash-large")
    if large.isEmpty():
        shards = keyed.withColumn("s", F.lit(0)).withColumn("w", F.lit(0).cast("long"))
    else:
        # Beyond the key's bits the others, cut into radius + 1 blocks, agree in one block at least.
        free = [_cuts([b for b in range(64) if b not in blocks[i] + blocks[j]], radius + 1) for i, j in pairs]
        sub = [[_mask(c) for c in cuts] for cuts in free]
        mask = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in sub]), F.col("k") + 1)
        fine = F.transform(mask, lambda m, s: F.struct((s + 1).alias("s"), F.col("fp").bitwiseAND(m).alias("w")))
        marked = keyed.join(large.withColumn("large", F.lit(True)), ["k", "v"], "left")
        whole = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("w")))
        shards = marked.select("fp", "k", "v", F.explode(F.when(F.col("large"), fine).otherwise(whole)).alias("p")).select("fp", "k", "v", "p.s", "p.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        key = None

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            fp = batch.column(0).to_numpy()
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(1, 5)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            sizes = np.diff(np.r_[starts, len(fp)])
            found = []
            last = len(starts) - 1
            # Groups of one row in the middle of a batch have no link.
            for g in sorted({0, last, *np.flatnonzero(sizes > 1).tolist()}):
                own, codes = tuple(keys[:, starts[g]].tolist()), fp[starts[g] : starts[g] + sizes[g]].tolist()
                if own == key:
                    held += codes
                else:
                    found += shard_links(held, radius) if len(held) > 1 else []
                    key, held = own, codes
                if g != last:
                    found += shard_links(held, radius) if len(held) > 1 else []
                    key, held = None, []
            if found:
                yield out(found)
        yield out(shard_links(held, radius) if len(held) > 1 else [])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.repartition(n, "k", "v", "s", "w").sortWithinPartitions("k", "v", "s", "w")
    return dealt.select("fp", "k", "v", "s", "w").mapInArrow(tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every linked node but its component's smallest, and that smallest node.

    Alternating large-star and small-star rounds; each is written to the shared
    folder, and only its count and a checksum come to the driver.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-edges")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a joins a's least neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: a and its smaller neighbours join the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a != b").distinct(), "simhash-edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, fp, component: per row of docs its fingerprint and the smallest id that links reach.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated
    rows stay repeated. Null ids stay null and are never a component's smallest
    id, unless all of its ids are null. An empty table gives an empty one.
    """
    marks = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-marks")
    distinct = stored(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    near = components(links(distinct.select("fp"), radius, shard_rows)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(near, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = stored(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component"), "simhash-classes")
    return marks.join(joined, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that of the smallest id; all columns stay.

    If ids are null or repeat, or aren't numbers, the rows are numbered first,
    and the numbers serve as ids.
    """
    rows, key = with_ids(docs, id_col)
    classes = near_duplicates(rows, key, text_col, **options)
    gone = stored(classes.filter("id != component").select(F.col("id").alias(key)), "simhash-gone")
    return without(rows, key, gone).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
