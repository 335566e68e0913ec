"""CSV of unknown dialect, read in byte ranges: no task holds a file, and one long file keeps all tasks busy.

Whether a line end within a range ends a record depends on all quotes before it. A first pass says for each range what it
makes of every state that its first byte may be read in; these functions, composed in order, give the state each range
begins in. The second pass parses the records that begin after the record ends in its range, and reads on to the end of
the last one. The first pass also judges the encoding: a file is UTF-8 if all of it is, else Windows-1252.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import tidy, written
from .ordered_csv import filesystem

#: Bytes that one task parses at a time.
RANGE_BYTES = 16 << 20
#: Bytes of a file's beginning, where its first line is looked for.
HEAD_BYTES = 65_536
#: Bytes read at a time beyond a range.
_STEP = 1 << 16
_BOM = b"\xef\xbb\xbf"

# States of a reader: at the start of a field, within a plain one, within a quoted one, after a quote in a quoted one.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
#: What a quote, a separator or line end, and any other byte makes of the four states. A quote within a plain field is text.
_STEPS = [(_QUOTED, _PLAIN, _CLOSED, _QUOTED), (_START, _START, _QUOTED, _START), (_PLAIN, _PLAIN, _QUOTED, _PLAIN)]
_QUOTE, _END, _OTHER = (sum(to << 2 * at for at, to in enumerate(step)) for step in _STEPS)
#: A function of states is one byte, two bits for each; the identity leaves all as they are.
_SAME = sum(at << 2 * at for at in range(4))


def _composed() -> np.ndarray:
    """For any two functions, first and then, the one that does both."""
    codes = np.arange(256)
    to = (codes[:, None] >> (2 * np.arange(4))) & 3
    return ((to[:, to] << (2 * np.arange(4))).sum(2)).T.astype(np.uint8)


_THEN = _composed()


def _functions(data: bytes, sep: str) -> np.ndarray:
    """The function of each byte."""
    table = np.full(256, _OTHER, np.uint8)
    table[[ord(sep), 10, 13]] = _END
    table[ord('"')] = _QUOTE
    return table[np.frombuffer(data, np.uint8)]


def effect(data: bytes, sep: str) -> int:
    """What reading data makes of each state, as one function."""
    f = _functions(data, sep)
    while len(f) > 1:
        if len(f) % 2:
            f = np.append(f, np.uint8(_SAME))
        f = _THEN[f[::2], f[1::2]]
    return int(f[0]) if len(f) else _SAME


def _ends(data: bytes, sep: str, state: int) -> tuple[np.ndarray, int]:
    """Places of the line ends that end records, if data begins in a state, and the state after it."""
    width = 512
    f = _functions(data, sep)
    n = len(f)
    rows = np.full(-(-n // width) * width, _SAME, np.uint8)
    rows[:n] = f
    rows = rows.reshape(-1, width)
    before = np.full(rows.shape, _SAME, np.uint8)
    for j in range(1, width):
        before[:, j] = _THEN[before[:, j - 1], rows[:, j - 1]]
    starts = np.empty(len(rows), np.uint8)
    for i, whole in enumerate(_THEN[before[:, -1], rows[:, -1]].tolist()):
        starts[i] = state
        state = whole >> 2 * state & 3
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw == 10) | (raw == 13))
    found = before.reshape(-1)[at] >> 2 * starts[at // width] & 3
    return at[found != _QUOTED], state


def separator(head: bytes) -> str:
    """The one of comma, semicolon and tab that a file's first line has most; the first of them if none."""
    line = head.split(b"\n", 1)[0]
    return max(",;\t", key=lambda c: line.count(c.encode()))


def _follows(byte: int) -> bool:
    return 0x80 <= byte < 0xC0


def _utf8(data: bytes, first: bool, after: bytes) -> bool:
    """Whether the characters that begin in a range are UTF-8; those of its first bytes that go on from the range before are judged there."""
    begin = 0
    while not first and begin < len(data) and _follows(data[begin]):
        begin += 1
    if begin == len(data) and not first:
        return True
    more = 0
    while more < min(3, len(after)) and _follows(after[more]):
        more += 1
    try:
        (data[begin:] + after[:more]).decode()
    except UnicodeDecodeError:
        return False
    return True


def _open(path: str):
    files, at = filesystem(path)
    return files.open_input_file(at)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, k, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            with _open(path) as f:
                head = f.read_at(HEAD_BYTES, 0)
                data, after = f.read_at(stop - start, start), f.read_at(3, stop)
            sep = separator(head)
            fine = _utf8(data, start == 0, after)
            yield pa.RecordBatch.from_pydict({"path": [path], "k": pa.array([k], pa.int64()), "start": pa.array([start], pa.int64()), "stop": pa.array([stop], pa.int64()), "sep": [sep], "utf8": [fine], "effect": pa.array([effect(data[3:] if start == 0 and data.startswith(_BOM) else data, sep)], pa.int32())})


_SCANNED = "path string, k long, start long, stop long, sep string, utf8 boolean, effect int"


def _states(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state in which each range of a file begins; a row is some bytes, so a task has some MB for a file of many TB."""
    ranges = ranges.sort_values("k", ignore_index=True)
    state, found = _START, []
    for step in ranges["effect"].tolist():
        found.append(state)
        state = step >> 2 * state & 3
    ranges["state"] = found
    ranges["encoding"] = "UTF-8" if ranges["utf8"].all() else "windows-1252"
    return ranges[["path", "k", "start", "stop", "sep", "encoding", "state"]]


def _texts(path: str, start: int, stop: int, sep: str, state: int) -> bytes:
    """The records that begin in a range (after a record end in it, or at the file's beginning), with the end of the last one wherever it is."""
    with _open(path) as f:
        data = f.read_at(stop - start, start)
        if start == 0 and data.startswith(_BOM):
            data = data[3:]
        ends, state = _ends(data, sep, state)
        if start == 0:
            begin = 0
        elif not len(ends):
            return b""
        else:
            begin = int(ends[0]) + 1
        pieces, at = [data[begin:]], stop
        while more := f.read_at(_STEP, at):
            ends, state = _ends(more, sep, state)
            if len(ends):
                pieces.append(more[: int(ends[0]) + 1])
                break
            pieces.append(more)
            at += len(more)
    return b"".join(pieces)


def _records(data: bytes, sep: str, encoding: str) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    # The five bytes that Windows-1252 leaves open are the replacement character.
    text = data.decode() if encoding == "UTF-8" else data.decode("cp1252", "replace")
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r)


def _header(path: str, sep: str, encoding: str) -> list[str]:
    """Names of a file's columns: its first record that isn't empty."""
    # A short range with the record that begins in it, however long; empty lines before it make the range longer.
    stop = 4
    while True:
        with _open(path) as f:
            size = f.size()
        for names in _records(_texts(path, 0, min(stop, size), sep, _START), sep, encoding):
            return names
        if stop >= size:
            return []
        stop *= 64


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, sep, encoding in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield pa.RecordBatch.from_pydict({"path": [path], "names": pa.array([_header(path, sep, encoding)], pa.list_(pa.string()))})


def dialects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, k, start, stop, sep, encoding, state of each range of the files at a path (a file, a folder with all below it, or a glob), stored."""
    if range_bytes < 4:
        raise ValueError("a range has 4 bytes at least, so that the first one holds a byte order mark")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", F.posexplode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("k", "start"), "length")
    ranges = ranges.select("path", F.col("k").cast("long").alias("k"), "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))
    dealt = ranges.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "k")
    scanned = dealt.mapInArrow(tidy(_scan), _SCANNED)
    return written(scanned.groupBy("path").applyInPandas(_states, "path string, k long, start long, stop long, sep string, encoding string, state int"), "csv-ranges")


def read_csv(spark: SparkSession, path: str, required: list[str] = (), range_bytes: int = RANGE_BYTES, with_dialect: bool = False) -> DataFrame:
    """CSV files with headers, all columns as strings, each file in its own dialect.

    Encodings are judged from whole files, separators from first lines. Files may have different columns: the result has those of all
    files by name (in the order of the files' paths), null where a file has none or a record is short. Fields beyond a file's header are left out, and of columns of one name
    the last one counts, as in Python's csv. Empty lines and empty files give no rows. A required column that
    a file lacks is an error. Fields have any length: a task holds its range and the record that crosses its end.

    with_dialect: two more columns, _encoding and _separator.
    """
    ranges = dialects(spark, path, range_bytes)
    files = written(ranges.filter("k = 0").select("path", "sep", "encoding").mapInArrow(tidy(_headers), "path string, names array<string>"), "csv-headers")
    # Headers that differ are few; each is kept with the first file that has it.
    headers = [list(r["names"]) for r in files.groupBy("names").agg(F.min("path").alias("first")).orderBy("first").collect()]
    if missing := sorted({c for names in headers for c in required if c not in names} or ({*required} if not headers else set())):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    columns = list(dict.fromkeys(c for names in headers for c in names))
    out = columns + (["_encoding", "_separator"] if with_dialect else [])
    arrow = pa.schema([(c, pa.string()) for c in out])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, start, stop, sep, encoding, state, names in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                records = _records(_texts(at, start, stop, sep, state), sep, encoding)
                if start == 0:
                    next(records, None)
                place = {c: i for i, c in enumerate(names)}
                rows, size = [], 0

                def made(rows: list[list[str]]) -> pa.RecordBatch:
                    values = [pa.array([r[place[c]] if place[c] < len(r) else None for r in rows] if c in place else [None] * len(rows), pa.string()) for c in columns]
                    told = [pa.array([x] * len(rows), pa.string()) for x in (encoding, sep)] if with_dialect else []
                    return pa.RecordBatch.from_arrays(values + told, schema=arrow)

                for r in records:
                    rows.append(r)
                    size += sum(map(len, r))
                    if len(rows) == 1000 or size > 1 << 22:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    slim = ranges.join(files, "path").select("path", "start", "stop", "sep", "encoding", "state", "names")
    return slim.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start").mapInArrow(tidy(parse), ", ".join(f"`{c.replace('`', '``')}` string" for c in out))
