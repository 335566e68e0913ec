"""Ranked search, periodic runs and personal data against brute force, and what they make of odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op11_search, op12_runs, op13_pii

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return _WORD.findall((text or "").translate(_LOWER))


def _ranked(docs, items, k):
    """The contract's formula, document by document."""
    own = [(d, Counter(_terms(t)), len(_terms(t))) for d, t in docs]
    n_docs, n_words = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in sorted(set((i, t or "") for i, t in items)):
        scores = []
        for d, c, n in own:
            if n:
                m = 100 - 25 + 25 * n * n_docs // n_words
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in _terms(text) if c[w])
                if s > 0:
                    scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _some_docs():
    rnd = random.Random(5)
    vocabulary = ["Ab", "cd", "é", "x1", "Zz", "the", "of", "q"]
    docs = [(i, " ".join(rnd.choices(vocabulary, [1, 1, 1, 1, 1, 9, 9, 2], k=rnd.randint(0, 30)))) for i in range(60)]
    docs += [(100 + i, "the of Ab") for i in range(30)] + [(7, "the of Ab"), (7, "the of Ab"), (None, "q q q"), (200, None), (201, ""), (202, "--- !")]
    return docs


@pytest.mark.parametrize(("item_bytes", "block_words", "summands"), [(1 << 20, 100_000, 1 << 19), (40, 50, 100)])
def test_search_equals_brute_force(spark, item_bytes, block_words, summands):
    docs = _some_docs()
    items = [(1, "the ab"), (2, "AB ab q"), (3, "nothing like it"), (4, ""), (5, None), (1, "the ab"), (1, "é"), (6, "of of of x1, zz")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank int, score int")
    got = op11_search.ranked_search(df.repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=7, item_bytes=item_bytes, block_words=block_words, summands=summands)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items, 7)


def test_search_with_other_ids_and_empty_tables(spark):
    items = spark.createDataFrame([("i", "b a")], "doc_id string, text string")
    docs = spark.createDataFrame([("y", "a b"), ("x", "b a"), (None, "a b"), ("w", "a")], "doc_id string, text string")
    got = op11_search.ranked_search(docs, items, item_col="doc_id", k=3)
    assert got.columns == ["doc_id", "rank", "_doc_id", "score"]
    assert [r["_doc_id"] for r in got.orderBy("rank").collect()] == ["x", "y", None]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        out = op11_search.ranked_search(d, i, item_col="doc_id")
        assert out.columns == got.columns and out.count() == 0


def test_impacts_beyond_64_bits():
    huge = op11_search.impacts(np.array([1]), np.array([10**9]), np.array([5]), 10**11, 10**13)
    assert huge.tolist() == [5 * (10**9 // (1000 + 12 * (75 + 25 * 10**9 * 10**11 // 10**13)))]


def _runs(w, least=12):
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p) and not any((s, i + p - s, q) in out for q in range(1, p)):
                out.add((s, i + p - s, p))
            i += i == s
    return sorted(out)


@pytest.mark.parametrize("pairs", [1 << 20, 5])
def test_runs_equal_brute_force(pairs):
    rnd = random.Random(3)
    seen = 0
    for k in range(1500):
        w = [rnd.randint(0, rnd.choice([0, 1, 2, 5])) for _ in range(rnd.randint(0, 70))]
        if k % 3 == 0 and len(w) > 10:
            x, p = rnd.randrange(len(w)), rnd.randint(1, 9)
            w[x:] = [w[x + i % min(p, len(w) - x)] for i in range(len(w) - x)]
        for least in (12, 4, 1):
            want = _runs(w, least)
            seen += len(want)
            assert op12_runs.runs(np.array(w, np.int64), least, pairs) == want
    assert seen > 1000


def test_runs_don_t_depend_on_the_hash(monkeypatch):
    monkeypatch.setattr(op12_runs, "_PRIME", 7)
    monkeypatch.setattr(op12_runs, "_powers", np.ones(1, np.int64))
    rnd = random.Random(4)
    for _ in range(500):
        w = [rnd.randint(0, 1) for _ in range(rnd.randint(0, 60))]
        assert op12_runs.runs(np.array(w, np.int64)) == _runs(w)
    monkeypatch.undo()
    assert op12_runs.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_runs_of_odd_rows(spark):
    rows = [(None, "a b " * 10), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 11), (4, "x " * 11), (5, "p q r " * 4 + "p\x0bq\x0cz " + "y\u00a0y " * 12)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "start long, text string, n_runs int")
    got = op12_runs.periodic_runs(df, "start", full=True)
    assert got.columns[:4] == ["start", "n_runs", "_start", "length"]
    for r in got.collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", next(t for d, t in rows if d == r["start"]) or "")
        found = _runs(own)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        collapsed = " ".join(w for k, w in enumerate(own) if k not in gone)
        assert [tuple(x) for x in r["runs"]] == found and r["n_runs"] == len(found) and r["collapsed"] == collapsed
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["_start"], r["length"], r["period"]) == best
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed.encode()).hexdigest()
    assert got.count() == len(rows) and op12_runs.periodic_runs(df.limit(0), "start").count() == 0


def test_planted_runs():
    chosen = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    own = [b"%d" % i for i in range(200)]
    new = op12_runs.planted(chosen, own)
    g = zlib.crc32(str(chosen).encode()) // 10
    a = g % 200
    p = 1 + (200 - a) // (3 + g % 8)
    assert new == own[:a] + [own[a + (i - a) % p] for i in range(a, 200)]
    assert op12_runs.planted(None, own) == own and op12_runs.planted(chosen, []) == []


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text):
    """The patterns over the whole text."""
    out = []
    for k, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((k, m.start(), m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["12345670a.@+- (é:/", "1234 -", "12.", "a@.b-", "+1() .-2", "0"])
def test_base_spans_equal_the_patterns(letters):
    rnd = random.Random(letters)
    for _ in range(4000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 40)))
        assert [x for x in op13_pii.spans(text) if x[0] < op13_pii.BASE] == _base(text), text


def test_added_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00, not IBAN DE88 3704 0044 0532 0130 00; https://bob:pw@host.org/x, Account no 12345678, myaccount 12345678, SSN 123-45-6789, see http://host.org"
    found = [(op13_pii.KINDS[k], text[a:b]) for k, a, b in op13_pii.spans(text)]
    assert found == [("email", "pw@host.org"), ("address", "https://bob:pw@host.org"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("account", "123-45-6789")]
    assert op13_pii.redact("to https://bob:pw@host.org/x or a@b.cd") == "to [address]/x or [email]" and op13_pii.redact(None) is None


def test_very_long_texts_take_linear_time():
    for text in ("1 " * 300_000, "a@" * 300_000, "1." * 300_000, "a" * 600_000 + "@", "x://" * 150_000, "account " * 80_000, "+1" * 300_000):
        assert isinstance(op13_pii.spans(text), list)


def test_personal_data_of_odd_rows(spark):
    rows = [(None, "a@b.cd"), (1, None), (2, ""), (3, "clean"), (3, "clean"), (4, "é 10.0.0.1 +1 (555) 555-1234")]
    df = spark.createDataFrame([(t, d, "kept") for d, t in rows], "text string, N_Email long, spans string")
    got = op13_pii.personal_data(df)
    assert got.columns == ["text", "N_Email", "spans", "_n_email", "n_ip", "n_card", "n_phone", "base_sha256", "_spans"]
    for r in got.collect():
        found = op13_pii.spans(r["text"] or "")
        assert r["spans"] == "kept" and r["_spans"] == ",".join(f"{op13_pii.KINDS[k]}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(r["_spans"].encode()).hexdigest()
    assert got.count() == len(rows) and op13_pii.personal_data(df.limit(0)).count() == 0
    hidden = {r["N_Email"]: r["text"] for r in op13_pii.redacted(df).collect()}
    assert hidden == {None: "[email]", 1: None, 2: "", 3: "clean", 4: "é [ip] [phone]"}
