"""CSV read in byte ranges: equal to Python's csv wherever the ranges are cut."""

import csv
import io
import random

import pytest

from quillspark.sources import split_csv


def by_python(data: bytes, encoding: str, sep: str) -> list[dict]:
    return [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(data.decode(encoding), newline=""), delimiter=sep)]


def fields(rng: random.Random, letters: str) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9])))


def written_csv(rng: random.Random, names: list[str], sep: str, end: str, letters: str, n: int = 40) -> str:
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(names)
    for _ in range(n):
        w.writerow([fields(rng, letters) for _ in range(rng.choice([len(names)] * 5 + [1, len(names) + 1]))])
        if rng.random() < 0.1:
            out.write(end)
    return out.getvalue()


def records(path: str, size: int, step: int, sep: str, encoding: str) -> list[list[str]]:
    """All ranges of a file one after the other, by the reader's own steps."""
    data, state, out = open(path, "rb").read(), 0, []
    for start in range(0, size, step):
        stop = min(start + step, size)
        out += split_csv._records(split_csv._texts(path, start, stop, sep, state), sep, encoding)
        piece = data[start:stop]
        state = split_csv.effect(piece[3:] if start == 0 and piece.startswith(b"\xef\xbb\xbf") else piece, sep) >> 2 * state & 3
    return out


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_any_length_give_the_same_records(tmp_path, seed):
    rng = random.Random(seed)
    sep, end = rng.choice(",;\t"), rng.choice(["\n", "\r\n"])
    data = written_csv(rng, ["a", "b", "c"], sep, end, 'xé"\n\r,;\t ', 12).encode()
    # Quotes where no field begins are text; a field may go on after its closing quote, and the last line needs no end.
    data += rng.choice([b'a"b"' + sep.encode() + b'"x"y"z', b'"open' + end.encode() + b"to the end", b"last"])
    path = tmp_path / "x.csv"
    path.write_bytes(data)
    want = [r for r in csv.reader(io.StringIO(data.decode(), newline=""), delimiter=sep) if r]
    for step in (3, 4, 7, 16, 61, len(data)):
        assert records(str(path), len(data), step, sep, "UTF-8") == want, step


def test_encoding_is_judged_by_ranges():
    good, bad = "aé€😀z".encode() * 3, "aé€😀z".encode() + b"\xe9"
    for data in (good, bad, b"\x80", b"a\x80", "é".encode() + b"\x80\x80\x80\x80\x80", b"ab\xc3"):
        try:
            data.decode()
            want = True
        except UnicodeDecodeError:
            want = False
        for step in range(1, len(data) + 1):
            got = all(split_csv._utf8(data[i : i + step], i == 0, data[i + step : i + step + 3]) for i in range(0, len(data), step))
            assert got == want, (data, step)


def test_files_of_many_dialects(spark, tmp_path):
    rng, want = random.Random(7), []
    for k, (sep, encoding, end) in enumerate([(",", "utf-8-sig", "\n"), (";", "cp1252", "\r\n"), ("\t", "utf-8", "\n"), (";", "utf-8", "\n")]):
        names = [["id", "größe", "x"], ["größe", "id"], ["id", "größe", "y"], ["größe", "id", "x"]][k]
        data = written_csv(rng, names, sep, end, 'xö"\n,;\t ').encode(encoding)
        (tmp_path / f"{k}.csv").write_bytes(data)
        want += [tuple(r.get(c) for c in ("id", "größe", "x", "y")) for r in by_python(data, "cp1252" if encoding == "cp1252" else "utf-8-sig", sep)]
    (tmp_path / "none.csv").write_bytes(b"")
    for step in (5, 64, 1 << 20):
        df = split_csv.read_csv(spark, str(tmp_path), ["id", "größe"], step)
        assert df.columns == ["id", "größe", "x", "y"]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    told = split_csv.read_csv(spark, str(tmp_path), with_dialect=True).select("_encoding", "_separator").distinct().collect()
    assert {tuple(r) for r in told} == {("UTF-8", ","), ("windows-1252", ";"), ("UTF-8", "\t"), ("UTF-8", ";")}
    with pytest.raises(ValueError, match="missing: x"):
        split_csv.read_csv(spark, str(tmp_path), ["x"])


def test_long_fields_and_empty_input(spark, tmp_path):
    long = 'a"\n' * 300_000
    out = io.StringIO()
    csv.writer(out).writerows([["id", "t"], ["1", long], ["2", "é"]])
    (tmp_path / "long.csv").write_bytes(out.getvalue().encode("cp1252"))
    rows = split_csv.read_csv(spark, str(tmp_path / "long.csv"), ["t"], 1 << 14).collect()
    assert sorted((r.id, r.t) for r in rows) == [("1", long), ("2", "é")]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.csv").write_bytes(b"id,t\n")
    assert split_csv.read_csv(spark, str(empty)).collect() == []
    (empty / "a.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="missing: id"):
        split_csv.read_csv(spark, str(empty), ["id"])
