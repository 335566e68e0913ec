"""TIFF columns: read files into one row per page, and store bytes as TIFF.

The reader walks the chain of image directories in either byte order, takes
strips or tiles, decodes PackBits, LZW, deflate or raw data, undoes horizontal or
floating-point prediction and joins the parts to the page's samples. Samples may have 1, 4, 8, 16, 32 or
64 bits. The writer makes such files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import table, with_free_names

RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODECS = {RAW: "raw", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: The format's field types (code: bytes, struct letter) and tags.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325

#: A payload's rows are 64 samples; a page has up to this many rows.
ROW, PAGE_ROWS = 64, 16384
PAGE = "page int, width int, height int, samples int, bits int, codec string, predictor int, layout string, data binary, error string"


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[starts, len(a)])
    out, at = [], 0

    def literal(b: int) -> None:
        for i in range(at, b, 128):
            part = data[i : min(i + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for s, n in zip(starts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
        literal(s)
        value, at = data[s : s + 1], s + n
        while n:
            take = min(n, 128)
            out.append((bytes([257 - take]) if take > 1 else b"\0") + value)
            n -= take
    literal(len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        have += len(part)
    return b"".join(out)


CLEAR, END = 256, 257
#: Bits of the k-th code after a clear code, which is written when 258 + k codes are known, and the bits before it.
_BITS = 9 + sum((258 + np.arange(3839) >= n).astype(np.int64) for n in (512, 1024, 2048))
_BEFORE = np.cumsum(_BITS) - _BITS
_START = [bytes([b]) for b in range(256)] + [b"", b""]


def lzw_encode(data: bytes) -> bytes:
    """Codes from the highest bit on, one bit longer an entry early, as the format has it."""
    codes, places, known, n = [CLEAR], [0], {}, 0
    word = -1
    for b in data:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        longer = known.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        places.append(n)
        known[key] = 258 + n
        n += 1
        word = b
        if n == 3836:
            codes.append(CLEAR)
            places.append(n)
            known, n = {}, 0
    if word >= 0:
        codes.append(word)
        places.append(n)
        n += 1
        if n == 3836:
            codes.append(CLEAR)
            places.append(n)
            n = 0
    codes.append(END)
    places.append(n)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - _BITS[places][:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """All codes between two clear codes are cut out at once, since their widths are known."""
    raw, total = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(data)
    out: list[bytes] = []
    have, bit = 0, 0
    while have < size:
        offsets = bit + _BEFORE
        offsets = offsets[: np.searchsorted(offsets + _BITS, total, "right")]
        widths, at = _BITS[: len(offsets)], offsets >> 3
        codes = (raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]) >> (24 - (offsets & 7) - widths) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else len(codes)
        known, before = _START.copy(), b""
        for code in codes[:stop].tolist():
            if code < len(known):
                word = known[code]
            elif before and code == len(known):
                word = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            if before:
                known.append(before + word[:1])
            out.append(word)
            have += len(word)
            before = word
        if stop == len(codes) or codes[stop] == END:
            break
        bit = int(offsets[stop] + widths[stop])
    return b"".join(out)


def _predict(rows: np.ndarray) -> np.ndarray:
    """rows: (rows, columns, samples). Differences to the left neighbour."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def _predict_float(rows: np.ndarray) -> np.ndarray:
    """Each row's bytes, those of highest value of all samples first, as differences to the byte a pixel before."""
    h, w, s = rows.shape
    planes = rows.astype(rows.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * s, -1).transpose(0, 2, 1).reshape(h, -1, s)
    return _predict(planes)


def _undo_float(data: np.ndarray, height: int, width: int, samples: int, kind: np.dtype) -> np.ndarray:
    planes = np.cumsum(data.reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, kind.itemsize, width * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(height, width * samples).astype(kind)


def _encode(data: bytes, codec: int) -> bytes:
    if codec == PACKBITS:
        return packbits_encode(data)
    if codec == LZW:
        return lzw_encode(data)
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return data


def _decode(data: bytes, codec: int, size: int) -> bytes:
    if codec == PACKBITS:
        got = packbits_decode(data, size)
    elif codec == LZW:
        got = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    elif codec == RAW:
        got = data
    else:
        raise ValueError(f"compression {codec} is not supported")
    if len(got) < size:
        raise ValueError(f"a part holds {len(got)} of {size} bytes")
    return got[:size]


def write_tiff(pages: list[dict], order: str = "<") -> bytes:
    """A TIFF of pages of 8 to 64 bits, each a dict: width, height, samples (1), bits (8), data (rows of
    interleaved samples in the file's byte order), codec, predictor (1, 2 or 3), and rows_per_strip or tile (width, height)."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0"
    link = 4
    for page in pages:
        w, h, s, bits, codec, predictor = page["width"], page["height"], page.get("samples", 1), page.get("bits", 8), page.get("codec", RAW), page.get("predictor", 1)
        kind = np.dtype(f"{order}u{bits // 8}")
        image = np.frombuffer(page["data"], kind).reshape(h, w, s)
        parts = []
        if tile := page.get("tile"):
            tw, th = tile
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    part = np.zeros((th, tw, s), kind)
                    own = image[y : y + th, x : x + tw]
                    part[: own.shape[0], : own.shape[1]] = own
                    parts.append(part)
        else:
            step = page.get("rows_per_strip", h)
            parts = [image[y : y + step] for y in range(0, h, step)]
        offsets, sizes = [], []
        for part in parts:
            coded = _encode({2: _predict, 3: _predict_float}.get(predictor, np.asarray)(part).tobytes(), codec)
            offsets.append(len(out))
            sizes.append(len(coded))
            out += coded
            if len(out) % 2:
                out.append(0)
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [bits] * s, COMPRESSION: [codec], PHOTOMETRIC: [1 if s < 3 else 2], SAMPLES: [s], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[0]], TILE_HEIGHT: [tile[1]], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [page.get("rows_per_strip", h)], STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(tags.items()):
            kind_code, letter = (3, "H") if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else (4, "I")
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                field = struct.pack(f"{order}I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                field = raw.ljust(4, b"\0")
            entries.append(struct.pack(f"{order}HHI", tag, kind_code, len(values)) + field)
        out[link : link + 4] = struct.pack(f"{order}I", len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list], int]:
    """The tags of the image directory at an offset, and the next one's offset."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        size, letter = _TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + size * count > len(data):
            raise ValueError("a tag's values lie beyond the file")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, order: str, tags: dict[int, list]) -> dict:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    w, h, s, bits, codec, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if not w or not h:
        raise ValueError("width or height is missing")
    if s < 1:
        raise ValueError("a pixel has no samples")
    if bits not in (1, 4, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [bits])) or predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits < 16:
        raise ValueError("bits or predictor are not supported")
    tiled, planes = TILE_OFFSETS in tags, s if one(PLANAR, 1) == 2 else 1
    per = 1 if planes > 1 else s
    pw, ph = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    if not pw or not ph or len(offsets) != len(sizes):
        raise ValueError("the layout of strips or tiles is broken")
    across, down = -(-w // pw), -(-h // ph)
    if len(offsets) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    units = lambda n: (n * per * bits + 7) // 8 if bits < 8 else n * per
    row_units = units(pw)
    # Rows are joined per band of parts, so that the page is held once.
    bands: list[np.ndarray] = []
    for plane in range(planes):
        rows = []
        for y in range(down):
            height = ph if tiled else min(ph, h - y * ph)
            band = []
            for x in range(across):
                k = (plane * down + y) * across + x
                raw = _decode(data[offsets[k] : offsets[k] + sizes[k]], codec, height * row_units * kind.itemsize)
                part = _undo_float(np.frombuffer(raw, np.uint8), height, pw, per, kind) if predictor == 3 else np.frombuffer(raw, kind).reshape(height, row_units)
                if predictor == 2:
                    part = np.cumsum(part.reshape(height, pw, per), axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(height, row_units)
                band.append(part[: h - y * ph])
            rows.append(band[0] if across == 1 else np.concatenate(band, axis=1))
        image = rows[0] if down == 1 else np.concatenate(rows)
        bands.append(image[:, : units(w)])
    image = bands[0] if planes == 1 else np.stack(bands, axis=2).reshape(h, -1)
    return {"width": w, "height": h, "samples": s, "bits": bits, "codec": CODECS[codec], "predictor": predictor, "layout": "tiles" if tiled else "strips", "data": image.astype(kind).tobytes(), "error": None}


def read_tiff(data: bytes | None) -> Iterator[dict]:
    """The pages in the order of their directories. A broken page, or file, gives a dict with its error and no data."""
    blank = dict.fromkeys(("width", "height", "samples", "bits", "codec", "predictor", "layout", "data"))
    try:
        if not data or data[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("no TIFF header")
        order = "<" if data[:1] == b"I" else ">"
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            tags, at = _directory(data, order, at)
            try:
                yield _page(data, order, tags)
            except (ValueError, TypeError, zlib.error) as e:
                yield blank | {"error": str(e)}
    except (ValueError, struct.error) as e:
        yield blank | {"error": str(e)}


def tiff_pages(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per page: the file's id, page (from 0) and the columns of PAGE.

    A file that isn't readable (null and empty ones too) gives one row with an
    error and no data, a broken page likewise. Repeated files are read each, null ids stay, other columns
    are ignored. If the id is named like a column of PAGE, that column gets an underscore before its name.
    """
    names = [x.split()[0] for x in PAGE.split(", ")]
    slim = files.select(id_col, media_col)
    free = list(with_free_names(slim.select(id_col), *names).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(names, [pa.int32()] * 5 + [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()], strict=True))
        for batch in batches:
            for i in range(len(batch)):
                for n, page in enumerate(read_tiff(batch.column(1)[i].as_py())):
                    row = {"page": n} | page
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([row[c]], kinds[c]) for c in names]], names=[id_col, *free])

    from pyspark.sql import types as T

    made = T._parse_datatype_string(PAGE)
    return slim.mapInArrow(tidy(run), T.StructType([slim.schema[id_col], *[T.StructField(n, f.dataType) for n, f in zip(free, made.fields, strict=True)]]))


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, with bytes 0 up to a positive multiple of 64; and their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0"), len(raw)


def store(data: bytes) -> bytes:
    """A payload as TIFF pages of 64 samples a row. Each page's codec, layout and prediction follow from its checksum, so that all occur at all sizes."""
    pages = []
    for i in range(0, len(data), ROW * PAGE_ROWS):
        part = data[i : i + ROW * PAGE_ROWS]
        mark = zlib.crc32(part)
        codec = (LZW, PACKBITS, DEFLATE)[mark % 3]
        layout = {"tile": (ROW, 64)} if mark // 3 % 2 else {"rows_per_strip": 128}
        pages.append({"width": ROW, "height": len(part) // ROW, "data": part, "codec": codec, "predictor": 1 if codec == PACKBITS else 1 + mark // 6 % 2} | layout)
    return write_tiff(pages)


def features(pages: list[dict]) -> str:
    """Pages, rows, codecs, mean and standard deviation of the samples, and how many values occur."""
    counts = sum((np.bincount(np.frombuffer(p["data"], np.uint8), minlength=256) for p in pages), np.zeros(256, np.int64))
    n, values = int(counts.sum()), np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(((counts * (values - mean) ** 2).sum() / n) ** 0.5)
    return f"pages={len(pages)};rows={sum(p['height'] for p in pages)};codecs={'+'.join(sorted({p['codec'] for p in pages}))};mean={mean:.3f};deviation={deviation:.3f};values={int((counts > 0).sum())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Per row of docs its text as TIFF (column media, if kept) and what reading that back gives (see DIGEST).

    A null text is empty, and its payload 64 zero bytes. Equal texts have equal
    values. Ids may have any type; null ids and repeated rows stay, other columns are ignored. Very long texts have a page for each
    megabyte. An empty table gives an empty one.
    """

    def digest(text: str | None) -> tuple:
        data, n = payload(text)
        media = store(data)
        pages = list(read_tiff(media))
        if errors := [p["error"] for p in pages if p["error"]]:
            raise RuntimeError(errors[0])
        back = b"".join(p["data"] for p in pages)
        return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(pages), media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 8 if keep_media else 7]
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                rows = [digest(t)[: len(kinds)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    from pyspark.sql import types as T

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [slim.schema["doc_id"], *T._parse_datatype_string(DIGEST + ", media binary" * keep_media).fields[1:]]
    names = [f.name for f in fields]
    return spread(slim).mapInArrow(tidy(run), T.StructType(fields))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
