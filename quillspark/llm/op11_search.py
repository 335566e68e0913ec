"""Ranked lexical search as a blocked sparse matrix product.

The documents are a stored matrix of terms by documents, cut into blocks of whole documents; a
block keeps, for each of its terms, the documents that hold it and how often. The items are a
matrix of items by terms that every task has, in blocks of bounded size. For each pair of blocks the rows
of the product are merged after Gustavson: the block's rows of an item's terms, each
times its multiplicity, are added up. Only the best k of a row leave a block, a task and a group of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import stored, table
from .op01_decontamination import Terms, words

#: Results of an item.
TOP = 20
#: Words of a block of documents, unless a single document has more: rows of the matrix then take below 1 MB.
BLOCK_WORDS = 100_000
#: UTF-8 bytes of the items that are searched for at once; more items go in further rounds over the stored matrix.
ITEM_BYTES = 4 << 20
#: Summands of the product that are held at once, unless a single item has more in a block.
SUMMANDS = 1 << 19
#: Groups of tasks whose best results meet before those of all tasks.
LANES = 512


def build_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks: ids and numbers of words of the documents, the terms, the number of documents of each, and term by term their places in the block and counts.

    Terms hold no spaces, so that they are one value; numbers are little-endian 32-bit ones.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, terms, columns, total = [], [], Terms(), [], 0
        kind = None

        def out() -> pa.RecordBatch:
            n, all_terms = len(ids), np.concatenate(columns)
            of = np.repeat(np.arange(n), sizes)
            cell, count = np.unique(all_terms * n + of, return_counts=True)
            row = (pa.array([pa.array(ids, kind)], pa.list_(kind)), *[pa.array([x], pa.binary()) for x in (np.array(sizes, "<u4").tobytes(), b" ".join(terms), np.bincount(cell // n, minlength=len(terms)).astype("<u4").tobytes(), (cell % n).astype("<u4").tobytes(), count.astype("<u4").tobytes())])
            long = pa.array([sum(s > 0 for s in sizes)], pa.int64()), pa.array([total], pa.int64())
            return pa.RecordBatch.from_arrays([*row, *long], names=["ids", "sizes", "terms", "many", "places", "counts", "n_docs", "n_words"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = words(text)
                    ids.append(doc_id)
                    sizes.append(len(own))
                    columns.append(np.fromiter(map(terms.__getitem__, own), np.int64, len(own)))
                    total += len(own)
                    if total >= block_words or len(ids) >= block_words:
                        yield out()
                        ids, sizes, terms, columns, total = [], [], Terms(), [], 0
        if ids:
            yield out()

    from pyspark.sql import types as T

    rest = T._parse_datatype_string("sizes binary, terms binary, many binary, places binary, counts binary, n_docs long, n_words long").fields
    return spread(slim).mapInArrow(tidy(run), T.StructType([T.StructField("ids", T.ArrayType(slim.schema["id"].dataType)), *rest]))


@dataclass
class Items:
    """A block of items as a sparse matrix: of item k the terms term[first[k]:first[k + 1]], each so many times."""

    keys: list[bytes]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        numbers, term, times, first = Terms(), [], [], [0]
        for text in texts:
            own, count = np.unique(np.fromiter(map(numbers.__getitem__, words(text)), np.int64), return_counts=True)
            term.append(own)
            times.append(count)
            first.append(first[-1] + len(own))
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        return cls(list(numbers), np.array(first, np.int64), join(term), join(times))


def _numbers(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u4").astype(np.int64)


def document_counts(matrix: DataFrame, items: Items) -> np.ndarray:
    """For each term of the items the number of documents that hold it; as many rows as the items have terms come to the driver."""
    shared = matrix.sparkSession.sparkContext.broadcast(items.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        total = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                at = pc.index_in(pa.array(batch.column(0)[row].as_py().split(), pa.binary()), value_set=wanted).fill_null(-1).to_numpy()
                total[at] += _numbers(batch.column(1)[row])  # a block has each term once; the last place takes those not wanted
        held = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(len(items.keys), np.int64)
    for r in matrix.select("terms", "many").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(count: np.ndarray, size: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term gives to a document, in whole numbers."""
    if 25 * int(size.max(initial=0)) * n_docs < 1 << 63:
        long = 25 * size * n_docs // n_words
    else:
        long = np.array([25 * s * n_docs // n_words for s in size.tolist()], np.int64)
    return weight * (1_000_000_000 * count // (1000 * count + 12 * (75 + long)))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (size[k] numbers) for all k in a row."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - upto + size, size)


def product(items: Items, begin: np.ndarray, size: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, summands: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first item, rows of the product) for items by documents; begin, size: where the block has each term of the items.

    Row merging after Gustavson: an item's row is the sum of the block's rows of its terms, each times its multiplicity.
    """
    own = size[items.term]
    upto = np.concatenate([[0], np.cumsum(own)])[items.first]  # summands before each item
    k, last = 0, len(items.first) - 1
    while k < last:
        # As many items as summands and sums allow.
        end = max(k + 1, min(int(np.searchsorted(upto, upto[k] + summands, "right")) - 1, k + max(1, summands // n), last))
        some = slice(items.first[k], items.first[end])
        if upto[end] > upto[k]:
            cells = _ranges(begin[items.term[some]], own[some])
            row = np.repeat(np.arange(end - k), np.diff(upto[k : end + 1]))
            rows = np.zeros((end - k) * n, np.int64)
            np.add.at(rows, row * n + place[cells], value[cells] * np.repeat(items.times[some], own[some]))
            yield k, rows.reshape(end - k, n)
        k = end


class Best:
    """The best k results of each item so far: (negative score, id is null, id), in order."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def add(self, first: int, rows: np.ndarray, ids: list, order: np.ndarray) -> None:
        """order: of each document its place in the order of ids."""
        item, doc = np.nonzero(rows >= self.least[first : first + len(rows), None])
        if not len(item):
            return
        score = rows[item, doc]
        by = np.lexsort((order[doc], -score, item))
        item, doc, score = item[by], doc[by], score[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        item, doc, score = item[keep], doc[keep], score[keep]
        for i in np.unique(item).tolist():
            a, b = np.searchsorted(item, [i, i + 1])
            new = [(-s, ids[d] is None, ids[d]) for s, d in zip(score[a:b].tolist(), doc[a:b].tolist(), strict=True)]
            own = sorted(self.rows[first + i] + new, key=lambda r: r[:2] if r[1] else r)[: self.k]
            self.rows[first + i] = own
            if len(own) == self.k:
                self.least[first + i] = -own[-1][0]


def search(matrix: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_words: int, k: int, summands: int = SUMMANDS) -> DataFrame:
    """place (of the item in the block), lane, id, score: the best k of each task."""
    shared = matrix.sparkSession.sparkContext.broadcast((items, weight))
    kind = matrix.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, weight = shared.value
        wanted = pa.array(items.keys, pa.binary())
        best, id_kind = Best(len(items.first) - 1, k), pa.null()
        for batch in batches:
            id_kind = batch.schema.field(0).type.value_type
            for row in range(len(batch)):
                ids, size, terms, many, place, count = (batch.column(c)[row] for c in range(6))
                size, many, place, count = map(_numbers, (size, many, place, count))
                number = pc.index_in(pa.array(terms.as_py().split(), pa.binary()), value_set=wanted).fill_null(-1).to_numpy()
                held = np.flatnonzero(number >= 0)
                if not len(held):
                    continue
                # The block's rows of the items' terms only.
                cells = _ranges((np.cumsum(many) - many)[held], many[held])
                place, count = place[cells], count[cells]
                value = impacts(count, size[place], np.repeat(weight[number[held]], many[held]), n_docs, n_words)
                begin, length = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
                begin[number[held]], length[number[held]] = np.cumsum(many[held]) - many[held], many[held]
                ids = ids.values
                order = np.empty(len(ids), np.int64)
                order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                names = ids.to_pylist()
                for first, rows in product(items, begin, length, place, value, len(ids), summands):
                    best.add(first, rows, names, order)
        found = [(i, r[2], -r[0]) for i, own in enumerate(best.rows) for r in own]
        item, own, score = zip(*found, strict=True) if found else ((), (), ())
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([lane] * len(item), pa.int32()), pa.array(own, id_kind) if found else pa.array([], pa.int64()).cast(id_kind) if id_kind != pa.null() else pa.array([], pa.int64()), pa.array(score, pa.int64())], names=["place", "lane", "id", "score"])

    from pyspark.sql import types as T

    fields = [T.StructField("place", T.IntegerType()), T.StructField("lane", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())]
    return matrix.select("ids", "sizes", "terms", "many", "places", "counts").mapInArrow(tidy(run), T.StructType(fields))


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k rows of each key, with their rank; Spark cuts to k before the exchange, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP, item_bytes: int = ITEM_BYTES, block_words: int = BLOCK_WORDS, summands: int = SUMMANDS) -> DataFrame:
    """Item, rank (from 1), document and score: the k best documents of each item, highest score first, equal scores by ascending id (nulls last).

    The columns are item_col, rank, id_col and score (the document's column gets an underscore before its name where it clashes). Ids may have any type that orders.
    Each row of docs is a document: repeated rows are found each. Rows of items that are equal in id and text count
    once, other rows are items of their own, even of one id. Null, empty and wordless documents are found by no
    item and don't count; such items find nothing, and so do all in an empty table. Texts of any length are read whole.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    matrix = stored(build_matrix(docs, id_col, text_col, block_words), "term-matrix")
    sums = matrix.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l")).first()
    n_docs, n_words = sums["n"] or 0, sums["l"] or 0
    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // item_bytes) or 1
    name = id_col if id_col.lower() not in (item_col.lower(), "rank", "score") else f"_{id_col}"
    parts = []
    for b in range(n if n_words else 0):
        block = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)).collect()
        own = Items.of([r["text"] for r in block])
        found = search(matrix, own, weights(document_counts(matrix, own), n_docs), n_docs, n_words, k, summands)
        best = _top(_top(found, ["place", "lane"], k).drop("rank"), ["place"], k)
        names = F.broadcast(spark.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], "place int, item " + rows.schema["item"].dataType.simpleString()))
        parts.append(best.join(names, "place").select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(name), "score"))
    if not parts:
        from pyspark.sql import types as T

        fields = [(item_col, rows.schema["item"].dataType), ("rank", T.IntegerType()), (name, docs.schema[id_col].dataType), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Equal items count once here, too.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
q AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest(w) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, N),
m AS (SELECT r, doc_id, 75 + 25 * len(w) * N // L AS m FROM d, s WHERE len(w) > 0),
c AS (SELECT k, r, CAST(sum(times * f.w * (1000000000 * tf // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY k, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c JOIN m USING (r) JOIN b USING (k) WHERE score > 0) WHERE rank <= 20
"""
