"""Benchmark decontamination with a distributed positional inverted index.

The index holds every word of the documents and is stored. It is cut by documents: each row of it is a segment of whole documents
with, for each term, the sorted list of its positions. A phrase is found in a
segment by intersecting the position lists of its terms, each shifted by the
term's place in the phrase, from the rarest list to the most frequent; with a
tolerance on the shifts this gives proximity matches. Segments never need each
other, so a search has no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.storage import spread, tidy
from .common import stored, table, with_ids, without

#: Words of a window, and how far a word of a near window may be from its place.
WINDOW, SLOP = 10, 2
#: Words of a segment, unless a single document has more: rows of the index then take below 1 MB. Terms (which hold no spaces), counts and positions
#: are each one binary value, so that the JVM only hands bytes on.
SEGMENT_WORDS = 100_000
#: UTF-8 bytes of the test items that are searched at once (their windows take some 250 MB of the driver); more items go in further rounds.
BLOCK_BYTES = 2 << 20

#: A-Z to a-z; bytes other than 0-9, a-z and those of non-ASCII characters end a word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SEGMENT = "segment long, gap int, ids array<long>, n_words array<int>, terms binary, counts binary, positions binary"
REPORT = "segment long, place int, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits array<int>, n_near long, near array<long>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Terms(dict):
    """Numbers of words in the order in which they first come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Segment:
    """Position lists of one segment. Positions count on over the documents, with a gap of ``gap`` between two."""

    def __init__(self, gap: int):
        self.gap, self.ids, self.sizes, self.terms = gap, [], [], Terms()
        self.columns: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.at = 0

    def add(self, doc_id, own: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.columns.append(np.fromiter(map(self.terms.__getitem__, own), np.int32, len(own)))
        self.places.append(np.arange(self.at, self.at + len(own), dtype=np.uint32))
        self.at += len(own) + self.gap

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the terms' lists, and the lists in a row."""
        terms = np.concatenate(self.columns)
        counts = np.bincount(terms, minlength=len(self.terms))
        # numpy sorts 16-bit numbers by radix.
        order = np.argsort(terms.astype(np.uint16) if len(self.terms) <= 1 << 16 else terms, kind="stable")
        return counts, np.concatenate(self.places)[order]


class Phrases:
    """The distinct windows of ``size`` words of the items: an item with fewer, but not none, is one window."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import xxhash

        self.size, self.numbers = size, {}
        known, self.names, pairs, self.marks = {}, [], set(), []
        for name, text in items:
            own = words(text)
            if own:
                for i in range(max(1, len(own) - size + 1)):
                    part = tuple(own[i : i + size])
                    if part not in known:
                        known[part] = len(known)
                        self.marks.append(xxhash.xxh64_intdigest(b" ".join(part)) - (1 << 63))
                    pairs.add((known[part], len(self.names)))
                self.names.append(str(name))
        rows = [[self.numbers.setdefault(w, len(self.numbers)) for w in part] for part in known]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.term = np.array([r + [-1] * (size - len(r)) for r in rows], np.int64).reshape(len(rows), size)
        self.items = [[] for _ in rows]  # of each window
        for k, item in sorted(pairs):
            self.items[k].append(item)

    def starts(self, k: int, many: np.ndarray, lists: dict[int, np.ndarray], slop: int = 0) -> np.ndarray:
        """Where each word of window k is at most slop from its place, in order. many: positions of each of its words."""
        order = np.argsort(many, kind="stable")[: self.length[k]].tolist()
        starts = lists[self.term[k, order[0]]] - order[0]
        if slop:
            starts = np.unique(starts[:, None] + np.arange(-slop, slop + 1))
        for place in order[1:]:
            other = lists[self.term[k, place]]
            want = starts + place
            at = np.searchsorted(other, want - slop)
            starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= want + slop)]
            if not len(starts):
                break
        return starts

    def matches(self, lists: dict[int, np.ndarray], counts: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, exact starts, near starts) of the windows with any. counts: of each term's positions."""
        if not len(self.term):
            return
        many = np.where(self.term >= 0, counts[self.term], np.iinfo(np.int64).max)
        for k in np.flatnonzero(many.min(axis=1) > 0).tolist():
            near = self.starts(k, many[k], lists, slop)
            if len(near):  # an exact start is a near one
                yield k, self.starts(k, many[k], lists) if slop else near, near


def report(phrases: Phrases, ids: list, sizes: np.ndarray, gap: int, lists, counts: np.ndarray, slop: int | None) -> list[tuple]:
    """Per document: (place, id, words, hit words as sorted numbers, items, marks of the windows that are near but nowhere exact)."""
    n, m = len(ids), max(1, len(phrases.names))
    first = np.concatenate([[0], np.cumsum(sizes + gap)])
    change = np.zeros(int(first[-1]) + gap + 1, np.int32)
    held: list[np.ndarray] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for k, starts, near_starts in phrases.matches(lists, counts, slop or 0):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + phrases.length[k], -1)
        exact = np.unique(np.searchsorted(first, starts, "right") - 1)
        held += [exact * m + item for item in phrases.items[k]]
        if slop:
            # A start may lie before its document, whose first words are the window's last ones.
            of = np.unique(np.searchsorted(first, near_starts + slop + phrases.length[k] - 1, "right") - 1)
            for doc in np.setdiff1d(of, exact).tolist():
                near[doc].append(phrases.marks[k])
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    of = np.searchsorted(first, hit, "right") - 1
    pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    docs = pairs // m
    bounds, named = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(docs, np.arange(n + 1))
    out = []
    for i in range(n):
        names = {phrases.names[x % m] for x in pairs[named[i] : named[i + 1]].tolist()}
        out.append((i, ids[i], int(sizes[i]), (hit[bounds[i] : bounds[i + 1]] - first[i]).astype(np.int32), sorted(names), sorted(near[i])))
    return out


def _row(segment: int, place: int, doc_id, n_words: int, hits: np.ndarray, items: list[str], near: list[int]) -> tuple:
    return (segment, place, doc_id, n_words, len(hits), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(hits) > 0, items, hits, len(near), near)


def _typed(ddl: str, schema: pa.Schema, place: int, kind: T.DataType) -> tuple[T.StructType, pa.Schema]:
    """Both schemas with the type of the documents' ids at a place."""
    fields = T._parse_datatype_string(ddl).fields
    fields[place] = T.StructField(fields[place].name, kind)
    return T.StructType(fields), schema.set(place, pa.field(schema.field(place).name, to_arrow_type(kind)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_REPORT = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.int32())), ("n_near", pa.int64()), ("near", pa.list_(pa.int64()))])
_SEGMENT = pa.schema([("segment", pa.int64()), ("gap", pa.int32()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW + 2 * SLOP, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of all words of whole texts (see SEGMENT); gap: empty positions between two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment = TaskContext.get().partitionId() << 33, Segment(gap)

        def out() -> pa.RecordBatch:
            counts, places = segment.lists()
            return _batch([(number, gap, segment.ids, np.array(segment.sizes, np.int32), b" ".join(segment.terms), counts.astype("<u4").tobytes(), places.astype("<u4").tobytes())], arrow)

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    segment.add(doc_id, words(text))
                    if segment.at >= segment_words:
                        yield out()
                        number, segment = number + 1, Segment(gap)
        if segment.ids:
            yield out()

    schema, arrow = _typed(SEGMENT, _SEGMENT, 2, T.ArrayType(docs.schema[id_col].dataType))
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(tidy(run), schema)


def search(index: DataFrame, items: list[tuple], size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """One row per document of the index (see REPORT). items: (name, text), bounded by the caller.

    slop: also count in n_near the distinct windows that a document holds nowhere exactly, but
    somewhere such that each word is at most so far from its place. The index's
    gap must be size + 2 slop at least, so that no window spans two documents.
    """
    shared = index.sparkSession.sparkContext.broadcast(Phrases(items, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        wanted = pa.array(list(phrases.numbers), pa.binary())
        for batch in batches:
            for row in range(len(batch)):
                segment, gap, ids, sizes, terms, counts, positions = (batch.column(c)[row] for c in range(7))
                segment, gap, sizes = segment.as_py(), gap.as_py(), sizes.values.to_numpy().astype(np.int64)
                if gap < size + 2 * (slop or 0):
                    raise ValueError("the index's gap is too small for such windows")
                places = np.frombuffer(positions.as_buffer(), "<u4")
                sizes_of = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                ends = np.cumsum(sizes_of)
                number = pc.index_in(pa.array(terms.as_py().split(), pa.binary()), value_set=wanted).fill_null(-1).to_numpy()
                lists, many = {}, np.zeros(len(phrases.numbers) + 1, np.int64)
                for t in np.flatnonzero(number >= 0).tolist():
                    lists[int(number[t])] = places[ends[t] - sizes_of[t] : ends[t]].astype(np.int64)
                many[number[number >= 0]] = sizes_of[number >= 0]
                found = [_row(segment, *x) for x in report(phrases, ids.as_py(), sizes, gap, lists, many, slop)]
                for i in range(0, len(found), 5000):
                    yield _batch(found[i : i + 5000], arrow)

    schema, arrow = _typed(REPORT, _REPORT, 2, index.schema["ids"].dataType.elementType)
    return index.mapInArrow(tidy(run), schema)


def _merge(rows: pa.Table) -> pa.Table:
    """Several rounds' rows of one document as one."""
    first = rows.slice(0, 1).select(["segment", "place", "doc_id", "n_words"]).to_pylist()[0]
    every = {c: [x for some in rows[c].to_pylist() for x in some] for c in ("items", "hits", "near")}
    row = _row(*first.values(), np.unique(np.array(every["hits"], np.int32)), sorted(set(every["items"])), sorted(set(every["near"])))
    return pa.Table.from_batches([_batch([row], rows.schema)])


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The number of blocks of items of bounded size, and each as a list of (name, text); repeated items count once."""
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    size = named.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        yield n, [tuple(r) for r in (named if n == 1 else named.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int | None = SLOP, block_bytes: int = BLOCK_BYTES, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per row of docs (see REPORT): which of its words lie in windows of which items.

    Null and wordless texts have no words and no hits. Repeated rows stay
    repeated; ids may have any type, and a null id stays null. Very long texts are read whole, and fill a segment of their own. An empty table gives an empty one. Items with the same id count once, a null
    item id is named "null", items without words have no window. Other columns
    are ignored. The index is searched once per block of items of block_bytes.
    """
    index = stored(build_index(docs, id_col, text_col, size + 2 * (slop or 0), segment_words), "postings")
    found = None
    for n, block in _items(benchmark, item_col, item_text_col, block_bytes):
        part = search(index, block, size, slop)
        if n == 1:
            return part
        found = part if found is None else found.unionByName(part)
    return found.groupBy("segment", "place").applyInArrow(_merge, found.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold any window of any item; all columns stay.

    Null and wordless texts stay, repeated rows share their fate, an empty table
    or an empty benchmark changes nothing. If ids are null or repeat, or aren't
    long numbers, the rows are numbered first, and the numbers serve as ids.
    """
    rows, key = with_ids(docs, id_col)
    found = contamination(rows, benchmark, key, text_col, item_col, item_text_col, size, None, block_bytes)
    gone = stored(found.filter("contaminated").select(F.col("doc_id").alias(key)), "contaminated")
    return without(rows, key, gone).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


#: The windows of an item are joined with the windows of the documents at the positions of the window's first word.
#: Near windows are sought around the occurrences of the window's rarest word.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, w[i : i + n - 1] AS win, n FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, n, item_id, win FROM dw JOIN bw USING (win, n)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM m) GROUP BY r),
o AS (SELECT r, p, w[p] AS term FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
f AS (SELECT term, count(*) AS c FROM o GROUP BY term),
k AS (SELECT DISTINCT win, n FROM bw),
kt AS (SELECT win, n, k AS place, win[k] AS term FROM (SELECT win, n, unnest(range(1, n + 1)) AS k FROM k)),
anchor AS (SELECT win, n, place, term FROM kt JOIN f USING (term) QUALIFY row_number() OVER (PARTITION BY win ORDER BY c, place) = 1),
cand AS (SELECT DISTINCT r, win, n, p - place + 1 + e AS s FROM anchor JOIN o USING (term), (SELECT unnest(range(-2, 3)) AS e)),
near AS (
  SELECT DISTINCT r, win FROM cand JOIN d USING (r)
  WHERE len(list_filter(range(1, n + 1), lambda j: s + j + 1 >= 1 AND list_contains(w[greatest(s + j - 3, 1) : s + j + 1], win[j]))) = n),
e AS (SELECT r, count(*) AS n_near FROM near ANTI JOIN m USING (r, win) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN e USING (r)
"""
