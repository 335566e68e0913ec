"""Periodic runs of words: maximal stretches that repeat themselves, found on a harmonic grid.

A run of period p and length at least 2 p (and at least 12) holds two words that lie p
apart such that the first stands on a grid whose step is what the run has
beyond one period. Over all periods these pairs are about n log n, a
harmonic sum. For all pairs at once, NumPy finds how far the words on both
sides agree (the longest common extension), by a binary search over prefix
hashes. A hash can only make an extension too long; so the words of each
run are compared at last, and what fails is measured word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import table, with_free_names

#: Words of a run at least.
LEAST = 12
#: Pairs that are looked at together.
PAIRS = 1 << 20
#: The hash: a polynomial in a fixed base, modulo a prime whose square fits into 63 bits.
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245

_powers = np.ones(1, np.int64)


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1; the table grows with the longest text so far."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (int(_powers[-1]) * _BASE % _PRIME) % _PRIME])
    return _powers[:n]


class Extensions:
    """Longest common extensions of places of a sequence of numbers."""

    def __init__(self, ids: np.ndarray):
        self.n, self.power = len(ids), powers(len(ids) + 1)
        self.sums = np.concatenate([[0], np.cumsum((ids + 1) * self.power[:-1] % _PRIME) % _PRIME])

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size numbers from a have the hash of those from b; a < b."""
        left = (self.sums[a + size] - self.sums[a]) % _PRIME * self.power[b - a] % _PRIME
        return left == (self.sums[b + size] - self.sums[b]) % _PRIME

    def _longest(self, most: np.ndarray, equal: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = equal(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._longest(self.n - b, lambda size: self._equal(a, b, size))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._longest(a.copy(), lambda size: self._equal(a - size, b - size, size))


def _grid(n: int, least: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid points, periods) of all pairs, in blocks by period."""
    period = np.arange(1, n // 2 + 1)
    step = np.maximum(least - period, period)
    many = -(-(n - period) // step)
    upto = np.cumsum(many)
    first = 0
    while first < len(period):
        base = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, base + pairs, "right")))
        own = slice(first, last)
        number = np.arange(int(upto[last - 1]) - base) - np.repeat(upto[own] - many[own] - base, many[own])
        yield number * np.repeat(step[own], many[own]), np.repeat(period[own], many[own])
        first = last


def _stretch(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The run around a pair, word by word."""
    a, b = at, at + period
    while a > 0 and ids[a - 1] == ids[a - 1 + period]:
        a -= 1
    while b < len(ids) and ids[b] == ids[b - period]:
        b += 1
    return a, b


def runs(ids: np.ndarray, least: int = LEAST, pairs: int = PAIRS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period."""
    n = len(ids)
    if n < least:
        return []
    ids = ids.astype(np.int64)
    # Two places beyond each end that are equal to nothing.
    wide = np.concatenate([[-1, -2], ids, [-3, -4]])
    known, found = None, {}
    for at, period in _grid(n, least, pairs):
        hit = np.flatnonzero(ids[at] == ids[at + period])
        at, period = at[hit], period[hit]
        # The words that agree around the pair are half of least, or more.
        a, b = at + 2, at + 2 + period
        near = ((wide[a + 1] == wide[b + 1]) & (wide[a + 2] == wide[b + 2])) | ((wide[a - 1] == wide[b - 1]) & (wide[a - 2] == wide[b - 2])) if least >= 8 else np.ones(len(at), bool)
        at, period = at[near], period[near]
        if not len(at):
            continue
        known = known or Extensions(ids)
        start = at - known.backward(at, at + period)
        end = at + period + known.forward(at, at + period)
        long = end - start >= np.maximum(least, 2 * period)
        order = np.lexsort((period[long], end[long], start[long]))
        start, end, period, at = (x[long][order] for x in (start, end, period, at))
        # Multiples of a period have the same run: the smallest one stays.
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        for s, e, p, i in zip(start[new].tolist(), end[new].tolist(), period[new].tolist(), at[new].tolist(), strict=True):
            if found.get((s, e), p + 1) <= p:
                continue
            if not np.array_equal(ids[s : e - p], ids[s + p : e]):
                # The hash was wrong, perhaps for other periods of this stretch, too.
                for i, p in {(int(i), int(p)) for i, p in zip(at[(start == s) & (end == e)], period[(start == s) & (end == e)], strict=True)}:  # noqa: B020
                    s2, e2 = _stretch(ids, i, p)
                    if e2 - s2 >= max(least, 2 * p):
                        found[s2, e2] = min(p, found.get((s2, e2), p))
                continue
            found[s, e] = p
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def words(text: str | None) -> list[bytes]:
    """Stretches without spaces and the characters U+0009 to U+000D."""
    return (text or "").encode().split()


def numbered(own: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own))


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FULL = REPORT + ", runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, edit: Callable | None = None, full: bool = False, pairs: int = PAIRS) -> DataFrame:
    """Per row of docs its id and REPORT: the number of runs, the longest one (ties: smallest start, then period), and digests; with full, also all runs and the collapsed text.

    The collapsed text lacks the words that a run contains after its first
    period, and has one space between words. edit(id, words) may replace the words first. Null, empty and
    wordless texts have no runs, nulls for the longest, and the digests of the
    empty string. Null ids and repeated rows stay, other columns are ignored, an empty table gives an
    empty one. Very long texts are read whole: their pairs are looked at in blocks. If the
    id is named like a column of FULL, that column gets an underscore before its name.
    """
    schema = FULL if full else REPORT
    slim = docs.select(id_col, F.col(text_col).alias("__text"))
    from pyspark.sql import types as T

    made = T._parse_datatype_string(schema).fields
    free = list(with_free_names(slim.select(id_col), *[f.name for f in made]).values())
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]

    def report(doc_id, text: str | None) -> tuple:
        own = words(text)
        if edit:
            own = edit(doc_id, own)
        found = runs(numbered(own), least, pairs)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        collapsed = b" ".join([own[k] for k in kept(len(own), found).tolist()] if found else own)
        row = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        return (*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], collapsed.decode()) if full else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                rows = [report(*x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]], names=[id_col, *free])

    return spread(slim).mapInArrow(tidy(run), T.StructType([slim.schema.fields[0], *[T.StructField(n, f.dataType) for n, f in zip(free, made, strict=True)]]))


def planted(doc_id, own: list[bytes]) -> list[bytes]:
    """The contract's rule: in a tenth of the documents (by id; a null id never), the words from some place on repeat the first few of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(own)
    if doc_id is None or h % 10 or not n:
        return own
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return own[:a] + [own[a + k % p] for k in range(n - a)]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit=planted)


#: Words that agree with those p places later are 6 or more in a row: so six words that come again p places later are found at each place of such a row,
#: and neighbouring places make up one run. crc32 is written out over a table of its steps.
ORACLE_SQL = r"""
WITH steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, steps),
e AS (SELECT r, doc_id, o, h, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a, h // 10 % 8 AS g FROM d),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN o[1 : a] || list_transform(range(0, n - a), lambda i: o[a + i % (1 + (n - a) // (3 + g)) + 1]) ELSE o END AS w FROM e),
pos AS MATERIALIZED (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM t),
six AS (SELECT r, n, i, string_agg(x, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS six FROM pos QUALIFY i + 6 <= n),
m AS (SELECT x.r, x.i, y.i - x.i AS p FROM six x JOIN six y ON x.r = y.r AND x.six = y.six AND x.i < y.i WHERE 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, p, min(i) AS s, max(i) + 6 + p AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM m) GROUP BY r, p, g),
u AS (SELECT r, s, e - s AS len, min(p) AS p FROM s WHERE e - s >= greatest(12, 2 * p) GROUP BY r, s, e),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY len DESC, s, p) = 1),
listed AS (SELECT r, count(*) AS k, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS l FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + len)) AS i FROM u),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM pos ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(k, 0) AS n_runs, s AS start, len AS length, p AS period, 1000 * len // p AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN left_over USING (r)
"""
