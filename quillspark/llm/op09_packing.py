"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each input partition is packed by the online sum-of-squares rule: a level array
counts, for every fill level h, the open windows that hold h ids, and an item of
length a goes to the level (or to a new window) that makes the sum of the squared
counts smallest. Documents longer than a window first fill whole windows; only
their rest is an item.

The items in windows that are still open at the end of a partition are written to the
shared folder and dealt to few tasks, of ``left_ids`` ids each, which pack them once more by the
same rule, long ones first. Only what is open there at the end is emptied, fullest first, and cut
freely into whole windows; the last rest is cut at powers of two, which need no padding.

Memory of a task: the open windows (at most ``max_open``; beyond, the fullest half goes on
to the second pass, or is emptied there), one Arrow batch, and a word cache of
bounded size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.storage import spread, tidy
from .common import stored, table

WINDOW = 2048
#: Open windows of a task at most (64 MB of ids); ids of a task of the second pass.
MAX_OPEN, LEFT_IDS = 8192, 8 << 20
#: The first window of the second pass: beyond the numbers of any partition of the first.
SECOND = 1 << 55
#: Longer words go to the tokenizer itself, whose merges take less than quadratic time.
LONG_WORD = 64
#: Bytes of text that are cut into words at a time, and of words that the tokenizer gets at a time.
TEXT_BYTES, CALL_BYTES, CACHE_BYTES = 8 << 20, 1 << 20, 96 << 20
END_ID = 1
#: A letter before a run of ASCII marks without an apostrophe: always a border between two pieces of the tokenizer.
_TAIL = re.compile(rb"(.*(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)", re.S)

#: Words of a-z and the letters of Latin-1 in UTF-8: one piece each, unchanged by composition.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SPAN = 1 << 20
_NEVER = np.iinfo(np.int32).max

_SPACE = re.compile(rb"[ \t-\r]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordBpe:
    """Byte-pair merges of many words at a time, by the merge list of a tokenizer file.

    Per round each word merges its leftmost pair of lowest rank, until no pair of
    any word is in the list: what the tokenizer does word by word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[x] * _SPAN + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, _NEVER).astype(np.int32)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        chars = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * _SPAN + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), 8192):
            some = order[i : i + 8192]
            for k, ids in zip(some, self._encode([words[j] for j in some]), strict=True):
                out[k] = ids
        return out

    def _encode(self, words: list[bytes]) -> list[bytes]:
        n, width = len(words), max(map(len, words))
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        columns = np.arange(width)
        sym = np.where(columns < sizes[:, None], self.inner[raw], -1)
        sym[np.arange(n), sizes - 1] = self.last[raw[np.arange(n), sizes - 1]]
        rank = np.full((n, width), _NEVER, np.int32)
        rank[:, :-1] = self._rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        live, done = np.arange(n), np.full((n, width), -1, np.int32)
        while len(live):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), j]
            ended = best == _NEVER
            if ended.any():
                done[live[ended], : sym.shape[1]] = sym[ended]
                keep = ~ended
                live, sym, rank, j, best = live[keep], sym[keep], rank[keep], j[keep], best[keep]
                if not len(live):
                    break
            rows, w = np.arange(len(live)), sym.shape[1]
            sym[rows, j] = self.merged[best]
            pull = np.minimum(np.arange(w) + (np.arange(w) > j[:, None]), w - 1)
            sym, rank = np.take_along_axis(sym, pull, 1), np.take_along_axis(rank, pull, 1)
            sym[:, -1], rank[:, -1] = -1, _NEVER
            rank[rows, j] = self._rank(sym[rows, j], sym[rows, np.minimum(j + 1, w - 1)])
            has_left = j > 0
            r, k = rows[has_left], j[has_left]
            rank[r, k - 1] = self._rank(sym[r, k - 1], sym[r, k])
        sizes = (done >= 0).sum(axis=1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = np.cumsum(sizes) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class CachedEncoder:
    """Ids of the tokenizer in a file, with a cache by white-space-free chunk.

    The tokenizer's pieces never span ASCII white space and are encoded one by
    one, so the ids of a text are those of its chunks in a row. A-Z may be
    lower-cased first (the tokenizer does so itself) unless combining marks,
    which compose with some letters of one case only, occur in the text. Words
    of Latin letters are one piece, which WordBpe encodes; anything else goes to
    the tokenizer itself. Arrow cuts the texts and numbers their distinct chunks, of which each is looked up
    once a batch. The cache is emptied beyond ``limit`` chunks or CACHE_BYTES of them.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bpe = WordBpe(path)
        self.limit, self.held = limit, 0
        self.cache: dict[bytes, bytes] = {b"": b""}

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that the cache lacks; it takes them in."""
        found, split, words, other = {}, [], {}, set()
        for c in chunks:
            if len(c) > LONG_WORD:
                other.add(c)
            elif c.isalpha():  # a-z and A-Z only
                words[c] = c.lower()
            elif m := _TAIL.fullmatch(c):
                a, b = m.groups()
                split.append((c, a, b))
                other.add(b)
                if a.isalpha():
                    words[a] = a.lower()
                elif _WORD.fullmatch(a):
                    words[a] = a.decode().lower().encode()
                else:
                    other.add(a)
            elif _WORD.fullmatch(c):
                words[c] = c.decode().lower().encode()
            else:
                other.add(c)
        cache = self.cache
        known = {c: ids for some in (words, other) for c in some if (ids := cache.get(c)) is not None}
        words = {c: w for c, w in words.items() if c not in known}
        found.update(zip(words, self.bpe.encode(list(words.values())), strict=True))
        rest = sorted(other.difference(known), key=len)
        while rest:
            some, size = [], 0
            while rest and (not some or size + len(rest[-1]) <= CALL_BYTES):
                size += len(rest[-1])
                some.append(rest.pop())
            for e, x in zip(self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), some, strict=True):
                found[x] = np.array(e.ids, "<u4").tobytes()
        known |= found
        for c, a, b in split:
            found[c] = known[a] + known[b]
        self.held += sum(map(len, found))
        if len(cache) + len(found) > self.limit or self.held > CACHE_BYTES:
            cache.clear()
            cache[b""], self.held = b"", sum(map(len, found))
        cache.update(found)
        return known | found

    def _encoded(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut and looked up together."""
        cut = pc.ascii_split_whitespace(pa.array(raws, pa.binary()).cast(pa.string()))
        numbered = cut.values.dictionary_encode()
        chunks = numbered.dictionary.cast(pa.binary()).to_pylist()
        codes = list(map(self.cache.get, chunks))
        if None in codes:
            learnt = self._learn([c for c, ids in zip(chunks, codes, strict=True) if ids is None])
            codes = [learnt[c] if ids is None else ids for c, ids in zip(chunks, codes, strict=True)]
        ids = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        which = numbered.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        # The place of each id of the texts in the ids of the distinct chunks.
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n)
        place += np.arange(len(place))
        out = ids[place].tobytes()
        borders = (4 * np.concatenate([[0], ends])[cut.offsets.to_numpy()]).tolist()
        return [out[a:b] for a, b in zip(borders, borders[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids and the closing id as little-endian unsigned 32-bit numbers."""
        end = np.array([END_ID], "<u4").tobytes()
        done: dict[str | None, list[bytes]] = {}
        wait: list[tuple[str | None, bytes]] = []
        waiting = 0

        def finish() -> None:
            nonlocal waiting
            for (text, _), ids in zip(wait, self._encoded([raw for _, raw in wait]), strict=True):
                done[text].append(ids)
            wait.clear()
            waiting = 0

        for text in texts:
            if text in done:
                continue
            done[text] = []
            raw = (text or "").encode()
            if b"\xcc" not in raw and b"\xcd" not in raw:
                raw = raw.lower()
            at = 0
            while at < len(raw):  # a long text in parts that end at white space
                border = _SPACE.search(raw, at + TEXT_BYTES) if len(raw) > at + TEXT_BYTES else None
                part = raw[at : border.start()] if border else raw[at:]
                at += len(part)
                if wait and waiting + len(part) > TEXT_BYTES:
                    finish()
                wait.append((text, part))
                waiting += len(part)
        if wait:
            finish()
        return [b"".join([*done[text], end]) for text in texts]


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One for each Python worker, whose cache stays from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


class Packer:
    """The sum-of-squares packer of one partition.

    add() takes one document, place() one piece below a window's length; emitted pieces gather in
    .out as tuples in the order of PIECES, with sequence ids counted from
    ``first``. hand_over: windows beyond max_open go to .left, as leave() puts
    them there, instead of being emptied.
    """

    def __init__(self, window: int = WINDOW, first: int = 0, max_open: int = MAX_OPEN, hand_over: bool = False):
        self.window, self.next, self.max_open, self.hand_over = window, first, max_open, hand_over
        self.left: list[tuple] = []
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, w, start = len(ids) // 4, self.window, 0
        while total - start >= w:
            self._emit([(doc, start, total, ids[4 * start : 4 * (start + w)])])
            start += w
        if a := total - start:
            self.place((doc, start, total, ids[4 * start :]), a)

    def place(self, piece: tuple, a: int) -> None:
        """Moving a window from level h to h + a changes the sum of squares by 2 (N(h+a) - N(h) + 1); a full one leaves no level."""
        w, n = self.window, self.levels
        cost = 2 * n[a:w] - 2 * n[: w - a] + 2  # to h + a < w, from h = 0, 1, ...
        cost[0] = 2 * n[a] + 1  # a new window
        cost[1:][n[1 : w - a] == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin())
        if n[w - a] and 1 - 2 * n[w - a] <= cost[best]:
            best = w - a
        if best:
            held = self.open[best].pop()
            n[best] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if best + a == w:
            self._emit(held)
        else:
            self.open[best + a].append(held)
            n[best + a] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                (self.leave if self.hand_over else self.drain)(self.max_open // 2)

    def leave(self, leave: int = 0) -> None:
        """Move the pieces of open windows to .left, fullest first, until ``leave`` remain."""
        for h in range(self.window - 1, 0, -1):
            while self.open[h] and self.n_open > leave:
                self.levels[h] -= 1
                self.n_open -= 1
                self.left += self.open[h].pop()

    def drain(self, leave: int = 0) -> None:
        """Empty open windows, fullest first, until ``leave`` remain; cut their pieces freely into whole windows."""
        w, row, filled = self.window, [], 0
        for h in range(w - 1, 0, -1):
            while self.open[h] and self.n_open > leave:
                self.levels[h] -= 1
                self.n_open -= 1
                for doc, start, total, ids in self.open[h].pop():
                    while ids:
                        take = min(w - filled, len(ids) // 4)
                        row.append((doc, start, total, ids[: 4 * take]))
                        ids, start, filled = ids[4 * take :], start + take, filled + take
                        if filled == w:
                            self._emit(row)
                            row, filled = [], 0
        while filled:  # the rest: parts whose lengths are powers of two
            size = 1 << (filled.bit_length() - 1)
            part, need, rest = [], size, []
            for doc, start, total, ids in row:
                take = min(need, len(ids) // 4)
                need -= take
                if take:
                    part.append((doc, start, total, ids[: 4 * take]))
                if ids[4 * take :]:
                    rest.append((doc, start + take, total, ids[4 * take :]))
            self._emit(part)
            row, filled = rest, filled - size


_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _batch(rows: list[tuple], left: list[tuple] | None, kind: pa.DataType) -> pa.RecordBatch:
    """Pieces as a batch; with a column of ids if left is given, null but for the pieces without a window."""
    rows = rows if left is None else [r + (None,) for r in rows] + [(doc, start, len(ids) // 4, None, total, None, None, ids) for doc, start, total, ids in left]
    columns = list(zip(*rows, strict=True)) or [()] * (7 + (left is not None))
    return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[*_NAMES, "ids"][: len(columns)])


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_open: int = MAX_OPEN, left_ids: int = LEFT_IDS) -> DataFrame:
    """Tokenise and pack whole texts; one row per piece (see PIECES).

    A null text is an empty one and has the closing id alone. Repeated rows are
    packed as often as they occur; ids may have any type, and a null id stays null. An empty table gives no
    pieces. Other columns are ignored, whatever their names. sequence_id is the partition number times
    2^33 plus the window's number in it, in the second pass beyond SECOND.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        codes, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 33, max_open, True)

        def flush() -> pa.RecordBatch:
            rows, left, packer.out, packer.left = packer.out, packer.left, [], []
            return _batch(rows, left, kind)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(batch), 1000):
                part = texts.slice(i, 1000).to_pylist()
                for doc, code in zip(ids.slice(i, 1000).to_pylist(), codes.encode(part), strict=True):
                    packer.add(doc, code)
            if packer.out or packer.left:
                yield flush()
        packer.leave()
        yield flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, SECOND + (TaskContext.get().partitionId() << 33), max_open)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                for doc, start, total, ids in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns), strict=True):
                    packer.place((doc, start, total, ids), len(ids) // 4)
                if packer.out:
                    yield _batch(packer.out, None, kind)
                    packer.out = []
        packer.drain()
        yield _batch(packer.out, None, kind)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = [slim.schema["doc_id"], *T._parse_datatype_string(PIECES + ", ids binary").fields[1:]]
    kind = to_arrow_type(made[0].dataType)
    pieces = stored(spread(slim).mapInArrow(tidy(first), T.StructType(made)), "pieces")
    left = pieces.filter("sequence_id IS NULL")
    # Long pieces first: fewer windows are open at the end.
    tasks = -(-(left.agg(F.sum("length")).first()[0] or 0) // left_ids) or 1
    dealt = left.select("doc_id", "start", "doc_tokens", "ids").repartition(tasks, F.xxhash64("doc_id", "start", "ids")).sortWithinPartitions(F.desc(F.octet_length("ids")), F.xxhash64("ids", "doc_id"), "doc_id", "start")
    return pieces.filter("sequence_id IS NOT NULL").select(*_NAMES).unionByName(dealt.mapInArrow(tidy(second), T.StructType(made[:-1])))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
