"""Decontamination, SimHash links, packing and sharding against brute force."""

import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op01_decontamination as decon
from quillspark.llm import op05_sharding as sharding
from quillspark.llm import op08_simhash as simhash
from quillspark.llm import op09_packing as packing
from quillspark.llm import similar
from quillspark.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, Shard string, slot int, fp long, score int, lang string"


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        own, hit, names = fold(text), set(), set()
        for name, item in items:
            w = fold(item)
            for i in range(max(1, len(w) - size + 1)) if w else []:
                part = w[i : i + size]
                for k in range(len(own) - len(part) + 1):
                    if own[k : k + len(part)] == part:
                        hit.update(range(k, k + len(part)))
                        names.add("null" if name is None else str(name))
        names = sorted(names)
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "été", "x1", "the", "of"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (2, text(14)), (None, "the of"), (7, ""), (8, None), (9, "The, OF the")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(3, items[0][1]), (3, items[0][1]), (None, "the of"), (50, None), (51, ""), (52, text(5000))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_is_brute_force(spark, phrases, block_bytes):
    docs, items = phrases
    d = spark.createDataFrame([(a, b, "s", 1, 2, 3, "en") for a, b in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decon.contamination(d, b, block_bytes=block_bytes, segment_words=500)
    assert rows_of(got, *CONTAMINATION) == brute_contamination(docs, items)
    kept = decon.drop_contaminated(d, b, block_bytes=block_bytes)
    clean = [x[0] for x in brute_contamination(docs, items) if not x[5]]
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, clean))


def test_contamination_of_nothing(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decon.contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows_of(decon.contamination(one, b), "doc_id", "n_words", "n_hit") == [(1, 2, 0)]


def test_near_matches_allow_gaps(spark):
    d = spark.createDataFrame([(1, "one two x three"), (2, "one two three"), (3, "three far away one two y z q"), (4, "two three four"), (5, "three"), (6, "three one")], "doc_id long, text string")
    index = decon.build_index(d, gap=12)
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decon.search(index, [("a", "one two three"), ("b", "One two three.")], slop=1).collect()}
    assert got == {1: (0, 1), 2: (3, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    with pytest.raises(Exception, match="gap"):
        decon.search(index, [("a", "b")], slop=2).collect()


def brute_near(docs, items, size=10, slop=2):
    windows = {tuple(w[i : i + size]) for _, t in items if (w := fold(t)) for i in range(max(1, len(w) - size + 1))}
    out = []
    for doc_id, text in docs:
        own, n = fold(text), 0
        for win in windows:
            exact = any(tuple(own[k : k + len(win)]) == win for k in range(len(own)))
            near = any(all(w in own[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, w in enumerate(win)) for s in range(-size - slop, len(own) + slop))
            n += near and not exact
        out.append((doc_id, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_near_windows_are_brute_force(spark, phrases, block_bytes):
    docs, items = phrases
    docs = docs[:45] + [(60, "alpha Beta x1 the of"), (61, " ".join(items[0][1].split()[3:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decon.contamination(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, segment_words=500)
    assert rows_of(got, "doc_id", "n_near") == brute_near(docs, items)


# -- SimHash


def brute_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius=2):
    n = len(marks)
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


def test_fingerprints_match_the_definition():
    for text in ["", None, "one", "one two", "A b C d é", "x\ty\nz w x y z", "a " * 3000, " lead trail "]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_links_reach_every_component(spark, shard_rows):
    rng = random.Random(5)
    marks = [0, 1, 3]
    for _ in range(25):
        x = rng.getrandbits(64)
        marks.append(x)
        for _ in range(rng.randint(0, 12)):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 0
            marks.append(x)
    marks = list(dict.fromkeys(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), shard_rows=shard_rows)
    found = {r.a: r.b for r in simhash.components(edges).collect()}
    groups = {}
    for m, g in zip(signed, brute_components(marks), strict=True):
        groups.setdefault(g, []).append(m)
    want = {m: min(own) for own in groups.values() for m in own if m != min(own)}
    assert found == want


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    marks = [brute_fingerprint(t) for _, t in rows]
    assert [got[i][0] & (1 << 64) - 1 for i, _ in rows] == marks
    assert [got[i][1] for i, _ in rows] == [rows[k][0] for k in brute_components(marks)]


def test_pipeline_drops_similar_texts(spark):
    import corpus_pipeline

    rng = random.Random(8)
    near, far = [f"w{rng.randrange(9999)}" for _ in range(200)], [f"v{rng.randrange(9999)}" for _ in range(200)]
    swapped = [*near[:60], "x", *near[61:140], "y", *near[141:]]  # 10 of 196 shingles differ: 0.9
    half = [*near[:120], *far[:80]]
    rows = [(1, near), (2, swapped), (3, half), (4, far), (5, near), (6, []), (7, [])]
    df = spark.createDataFrame([(a, " ".join(b), "s", 1, 2, 3, "en") for a, b in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3, 4, 6]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df.filter("doc_id < 3")).collect()) == [1, 2]
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_similar_components_are_brute_force(spark, sf_dir):
    rows = [(r.doc_id, similar.shingles(r.text)) for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root[i] != root[j] and similar.jaccard(a, b) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = {m: x if r == y else r for m, r in root.items()}
    assert {r.id: r.component for r in similar.similar(table(spark, sf_dir, "documents")).collect()} == root


@pytest.mark.parametrize("shard_rows", [8, 256])
def test_a_large_group_of_near_copies_is_one_component(spark, shard_rows):
    """Copies of one text with some words replaced, and of a related one, in shards that must be cut and crossed."""
    rng, base = random.Random(4), [f"w{k}" for k in range(120)]
    texts = []
    for i in range(90):
        own = list(base) if i % 3 else base[:70] + [f"v{k}" for k in range(50)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    sets = [similar.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component for r in similar.similar(df, shard_rows=shard_rows).collect()} == dict(enumerate(root))
    assert sorted(r.doc_id for r in similar.drop_similar(df, shard_rows=shard_rows).collect()) == sorted(set(root))


def test_dropping_similar_texts_of_odd_tables(spark):
    """Null and empty texts, repeated and null ids, clashing names, no rows."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, 0), (1, long, 1), (None, None, 2), (None, "", 3), (4, "a b", 4), (5, "a b", 5), (6, "A  b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "rid")
    kept = similar.drop_similar(df)
    assert kept.columns == df.columns and len(kept.collect()) == 3
    assert similar.drop_similar(df.limit(0)).count() == 0


def test_dropping_keeps_one_of_each(spark):
    text = "a b c d e f"
    rows = [(5, text), (3, text), (None, text), (9, "other words here now"), (9, "other words here now"), (7, None), (8, "")]
    df = spark.createDataFrame([(a, b, "s", 1, 2, 3, "en") for a, b in rows], DOCS)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 3
    plain = simhash.drop_near_duplicates(df.filter("doc_id IN (5, 3, 7, 8)"))
    assert sorted(r.doc_id for r in plain.collect()) == [3, 7]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    marks = {r.id: r.component for r in simhash.near_duplicates(df).collect()}
    assert marks == {5: 3, 3: 3, None: 3, 9: 9, 7: 7, 8: 7}


# -- packing


def check_packing(pieces, ids):
    """Every id of every document lies in one piece; windows are gapless and full, or powers of two."""
    by_doc, by_window = {}, {}
    for doc, start, length, crc, total, window, offset in pieces:
        assert 0 < length and start + length <= total
        by_doc.setdefault((doc, total), []).append((start, length, crc))
        by_window.setdefault(window, []).append((offset, length))
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc, code in ids:
        at = 0
        for start, length, crc in sorted(by_doc[doc, len(code) // 4]):
            assert start == at and zlib.crc32(code[4 * start : 4 * (start + length)]) == crc
            at += length
        assert at == len(code) // 4
    return by_window


def test_packer_round_trip():
    rng = np.random.default_rng(1)
    ids = [(k, rng.integers(0, 1000, int(n)).astype("<u4").tobytes()) for k, n in enumerate([*rng.integers(1, 3000, 300), 2048, 4096, 1, 2047])]
    for max_open in (4096, 20):
        packer = packing.Packer(max_open=max_open)
        for doc, code in ids:
            packer.add(doc, code)
        packer.drain()
        sizes = [sum(n for _, n in w) for w in check_packing(packer.out, ids).values()]
        padding = sum(packing.WINDOW - s for s in sizes if s & (s - 1))
        assert padding < 0.02 * sum(sizes)


def test_sum_of_squares_choice_is_best():
    """Each placement has the least sum of squares among all allowed ones."""
    rng, window = np.random.default_rng(2), 16
    packer = packing.Packer(window=window, max_open=10_000)
    for k in range(400):
        a = int(rng.integers(1, window))
        before = packer.levels.copy()
        costs = []
        for h in range(window - a + 1):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                n[h + a] += h + a < window
                costs.append(int((n[1:window] ** 2).sum()))
        packer.add(k, np.zeros(a, "<u4").tobytes())
        assert int((packer.levels[1:window] ** 2).sum()) == min(costs)


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return P.path("word_bpe_49k.json"), t


def test_encoder_equals_the_tokenizer(tokenizer, spark, sf_dir):
    path, t = tokenizer
    texts = [r.text for r in table(spark, sf_dir, "documents").limit(80).collect()]
    texts += ["", "It's DON'T we'll 'S", "a\x1cb c\u00a0d", "H\u0331 \u1e96 e\u0301", "<|endoftext|> x", "ΑΣ. ΣΑ, İi", "日本 語,, 12,3", "…word… word!?. ***x***", "ÉÈÀ ß ÷× é÷é", "\ud7ff 🙂🙂"]
    for limit in (1_000_000, 50):
        own = packing.CachedEncoder(path, limit)
        got = [np.frombuffer(c, "<u4").tolist() for c in own.encode([*texts, None])]
        assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in [*texts, ""]]


def test_packing_documents(spark, sf_dir, tokenizer):
    path, t = tokenizer
    docs = table(spark, sf_dir, "documents")
    pieces = [tuple(r) for r in packing.pack(docs.repartition(3)).collect()]
    ids = [(r.doc_id, np.array(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect()]
    check_packing(pieces, ids)
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(odd).collect()) == [("1", 1), ("1", 1), ("None", 2)]
    assert packing.pack(odd.limit(0)).count() == 0


def test_long_words_and_texts_cost_little(tokenizer, monkeypatch):
    """Words of a megabyte beside short ones, and texts that are cut at white space."""
    path, t = tokenizer
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghij", k=1 << 20))
    texts = [long, *(f"word{k} other" for k in range(9000)), long[:70], "e\u0301" * 500]
    code = f"""
import resource, sys
sys.path[:0] = {sys.path!r}
from quillspark.llm import op09_packing as packing
own = packing.CachedEncoder({path!r})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
own.encode([{long!r}, *(f"word{{k}} other" for k in range(9000))])
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
"""
    subprocess.run([sys.executable, "-c", "exec(__import__('sys').stdin.read())"], input=code, text=True, check=True, timeout=60)
    monkeypatch.setattr(packing, "TEXT_BYTES", 5000)
    texts.append(" ".join(f"Word{k}," for k in range(5000)))
    got = [np.frombuffer(c, "<u4").tolist() for c in packing.CachedEncoder(path).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_few_windows_are_cut_freely(spark, sf_dir, tokenizer):
    """What is open at the end of a partition is packed by the same rule once more."""
    path, t = tokenizer
    docs = table(spark, sf_dir, "documents")
    docs = docs.unionAll(docs).unionAll(docs).unionAll(docs)
    ids = [(r.doc_id, np.array(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect()]
    for max_open, left_ids in ((packing.MAX_OPEN, packing.LEFT_IDS), (20, 50_000)):
        pieces = [tuple(r) for r in packing.pack(docs.repartition(16), max_open=max_open, left_ids=left_ids).collect()]
        sizes = {}
        for _, _, n, _, _, window, offset in pieces:
            sizes.setdefault(window, []).append((offset, n))
        for own in sizes.values():
            total = 0
            for offset, n in sorted(own):
                assert offset == total
                total += n
            assert total & (total - 1) == 0
        assert sum(n for own in sizes.values() for _, n in own) == sum(len(c) // 4 for _, c in ids)
        starts = {}
        for doc, start, n, *_ in pieces:
            starts.setdefault(doc, []).append((start, n))
        assert all(sum(n for _, n in v) % 4 == 0 for v in starts.values())


# -- sharding


def test_matrix_rows_sum_to_cells():
    counts, cells = np.array([10, 0, 7, 200, 3]), sharding.even_sizes(220, 8)
    rows = np.array([sharding.matrix_row(counts, cells, p, 1) for p in range(len(counts))])
    assert rows.sum(axis=0).tolist() == cells.tolist() and rows.sum(axis=1).tolist() == counts.tolist() and rows.min() >= 0


def test_draws_are_uniform():
    """Over many seeds each partition's rows fall into each shard in proportion."""
    counts, cells, total = np.array([30, 70]), sharding.even_sizes(100, 4), np.zeros((2, 4))
    for seed in range(400):
        total += [sharding.matrix_row(counts, cells, p, seed) for p in (0, 1)]
    assert np.abs(total / 400 - np.outer(counts, cells) / 100).max() < 0.6


def test_large_draws_have_the_exact_law(monkeypatch):
    """The way beyond 10^9 rows, forced on small numbers, against numpy's generator; and its sums at 10^12."""
    sizes, n = np.array([40, 0, 100, 160]), 20_000
    for take in (90, 210):
        want = np.random.default_rng(1).multivariate_hypergeometric(sizes, take, n)
        with monkeypatch.context() as m:
            m.setattr(sharding, "_LARGE", 20)
            m.setattr(sharding, "_FEW", 3)
            rng = np.random.default_rng(2)
            got = np.array([sharding.hypergeometric_split(sizes, take, rng) for _ in range(n)])
        assert (got.sum(axis=1) == take).all() and (got <= sizes).all()
        assert np.abs(got.mean(axis=0) - want.mean(axis=0)).max() < 0.1 and np.abs(got.std(axis=0) - want.std(axis=0)).max() < 0.1
        for k in (0, 2, 3):
            a, b = (np.bincount(x[:, k], minlength=200) for x in (got, want))
            assert np.abs(a - b).max() < 6 * np.sqrt(max(a.max(), b.max()))
    counts, cells = np.full(1000, 10**9), sharding.even_sizes(10**12, 64)
    row = sharding.matrix_row(counts, cells, 123, 1)
    assert row.sum() == 10**9 and abs(row / (10**9 / 64) - 1).max() < 0.001


@pytest.mark.parametrize("cell_rows", [10_000, 7])
def test_shards_are_exact(spark, cell_rows, tmp_path):
    spark.range(0, 203, 1, 5).select(F.col("id").alias("doc_id"), F.lit("t").alias("Shard"), F.lit(1).alias("slot")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = sharding.shuffle_into_shards(df, cell_rows=cell_rows)
    assert out.columns == ["doc_id", "_shard", "_slot", "shard", "slot"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(203))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 8
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, cell_rows=cell_rows).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0
    assert sharding.shuffle_into_shards(df.groupBy("doc_id").count()).count() == 203  # not plain files


def test_sharding_query(spark, sf_dir):
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None and r.law == "rows" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3  # no trace of the order before


def test_sharding_of_odd_rows(spark):
    """Null and repeated rows, very long texts, names that clash in other letter cases, many cells."""
    rows = [(None, None, 1), (1, "x" * 1_000_000, 2), (1, "x" * 1_000_000, 2), *((k, "", k) for k in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, Cell string, __start int").withColumn("ORDER", F.lit(1))
    out = sharding.shuffle_into_shards(df, cell_rows=1)
    assert out.columns == [*df.columns, "shard", "slot"] and "Window" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 303 and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(38 if s < 7 else 37)]


def test_ids_of_any_type(spark):
    from quillspark.llm import op01_decontamination, op03_tiff, op09_packing

    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("a", text), (None, "nothing"), ("b", None)], "doc_id string, text string")
    items = spark.createDataFrame([("i", text), ("j", "two three")], "item_id string, text string")
    for block in (1 << 20, 30):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in op01_decontamination.contamination(docs, items, block_bytes=block).collect()}
        assert got == {"a": (11, 11, ["i", "j"]), None: (1, 0, []), "b": (0, 0, [])}
    assert [r["doc_id"] for r in op01_decontamination.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [None, "b"]
    assert {r["doc_id"]: r["n_bytes"] for r in op03_tiff.text_media(docs).collect()} == {"a": len(text), None: 7, "b": 0}
    assert {r["doc_id"]: r["doc_tokens"] for r in op09_packing.pack(docs).collect()}["b"] == 1


def test_training_sample_is_bounded(spark):
    from quillspark.llm.labelled import sample

    docs = spark.createDataFrame([(i, "x" * 10) for i in range(40)] + [(i, "w" * 10) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    every, share = sample(docs, labels, "y", (100, 100))
    assert 20 < len(every) < 40 and {t for t, _ in every} == {"w" * 10} and 0.3 < share < 0.7
    few, _ = sample(docs, labels, "y", (100, 100), all_chars=55)
    assert len(few) == 5 and not sample(docs, labels, "y", (100, 100), train_chars=9)[0]
    assert sorted(sample(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels, "y", (100, 100))[0]) == sorted(every)
