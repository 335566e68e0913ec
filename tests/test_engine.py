"""Expressions, statistics, joins, analyses on a small corpus, sources and sinks."""

import hashlib
import json
import posixpath
import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quillspark.functions import bands, paths, sampling, stats, text
from quillspark.operators import relational, selection
from quillspark.plans import analyses
from quillspark.plans.corpus import Corpus, fitted, parsed, structure_fields
from quillspark.plans.tables import Tables
from quillspark.sources import files as readers
from quillspark.sources import sinks, sqlite
from quillspark.streaming import ingest


def values(spark, column, rows, kind="string"):
    """A column expression of x over rows."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[1] for r in df.select("k", column).orderBy("k").collect()]


# -- text and paths against Python's own functions


def test_lines_and_words(spark):
    rng = random.Random(1)
    rows = ["", "\n", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x85f\u2028g\u2029h\n\n", "\r\n\r\n", "a\n\rb"] + ["".join(rng.choice("ab \t\n\r\x0b\x1c\u2028\u3000é_-'") for _ in range(30)) for _ in range(60)]
    assert values(spark, text.lines(F.col("x")), rows) == [r.splitlines() for r in rows]
    assert values(spark, text.word_count(F.col("x")), rows) == [len(r.split()) for r in rows]
    assert values(spark, text.word_count(F.col("x"), text.WORD), rows) == [len(re.findall(r"[\w]+(?:[-'][\w]+)*", r)) for r in rows]
    assert values(spark, text.word_count(F.col("x"), text.WORD_LETTERS), rows) == [len(re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", r)) for r in rows]


def test_paths_normalize_as_posix(spark):
    rng = random.Random(2)
    rows = ["", ".", "..", "a/..", "../a", "a/../..", "/..", "/a/../b", "./a//b/", "a/./b/../c", "/"] + ["/".join(rng.choice(["a", "b", "..", ".", ""]) for _ in range(6)) for _ in range(80)]
    rows = [r for r in rows if not r.startswith("//")]
    assert values(spark, paths.normalized(F.col("x")), rows) == [posixpath.normpath(r) for r in rows]


def test_paths(spark):
    rows = ["F.md", "a/F.md", "a/.claude/f.MD", ".claude/F.md", "x/readme.txt"]
    assert values(spark, paths.named(F.col("x"), "f.md"), rows) == [True, True, True, True, False]
    assert values(spark, paths.named_exactly(F.col("x"), "F.md"), rows) == [True, True, False, True, False]
    assert values(spark, paths.logical_scope(F.col("x")), rows) == ["", "a", "a", "", "x"]
    assert values(spark, paths.depth(F.col("x")), rows) == [0, 1, 2, 1, 1]
    assert values(spark, paths.relation(F.lit("a/b/F.md"), F.col("x")), ["a/b/x", "a/x", "a/b/c/x", "d/x", "../x", ".."]) == ["same_directory", "ancestor_directory", "descendant_directory", "other_directory", "outside_repository", "outside_repository"]
    assert values(spark, paths.import_kind(F.col("x")), ["https://a", "a*b", "$A/b", "~/a", "\\\\h\\a", "C:\\a", "/a", "a\\b", "a/b"]) == ["unsupported_uri", "unsupported_pattern", "unsupported_variable", "home_relative", "windows_unc_absolute", "windows_absolute", "posix_absolute", "platform_relative", "relative"]
    cat = lambda name, path: F.element_at(F.split("x", " "), 1), F.element_at(F.split("x", " "), 2)
    df = spark.createDataFrame([("AGENTS.md", "AGENTS.md"), ("x.md", "rules/x.md"), ("my-policy.md", "my-policy.md"), ("x.md", "a/Docs/x.md"), ("x.md", "skills/x.md"), ("README-de.md", "README-de.md"), ("x.md", "y/x.md")], "n string, p string")
    assert [r[0] for r in df.select(paths.target_category(F.col("n"), F.col("p"))).collect()] == ["agents_md", "rules_md", "instruction_guidance_md", "project_docs_md", "skills_md", "readme_md", "other_md"]
    assert values(spark, paths.url_is_markdown(F.col("x")), ["https://a.org/x.MD#y", "https://a.org/x%2Emd", "ftp://a/x.md", "https://[bad/x.md", "a/x.md"]) == [True, True, False, False, False]


def test_scripts_excerpts_codes(spark):
    assert values(spark, text.dominant_script(F.col("x")), ["plain", "", "Эти слова написаны", "Эт words of another kind", "12"]) == ["Latin/other", "none", "Cyrillic", "mixed", "none"]
    assert values(spark, text.language_code(F.col("x")), ["__label__nb", "zh_Hans", "EN"]) == ["no", "zh-hans", "en"]
    assert values(spark, text.truncated(F.col("x"), 7), ["one two three", "short", "unbroken-word"]) == ["one", "short", "unbroke"]
    assert values(spark, text.compact_excerpt(F.col("x"), 6), [" a \n b ", "abcdef g"]) == ["a b", "abcde…"]
    assert values(spark, text.fence_family(F.col("x")), [" TSX", "zig", "c#"]) == ["TypeScript", "zig", "C#"]
    assert values(spark, text.half_even(F.col("x"), 2), [0.125, 0.135, 2.5], "double") == [round(v, 2) for v in (0.125, 0.135, 2.5)]


def test_case_folding_is_full(spark):
    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["Straße ΑΣ ςΣ İi ﬁne", "PLAIN Text", "", None, *("".join(every[i : i + 500]) for i in range(0, len(every), 500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.casefold(F.col("t")).alias("t")).collect()
    # Letters that the running Java doesn't know yet have no lower case there.
    new = {c for c in every if c.casefold() != c and c not in text.foldings() and c > "\u1c7f"}
    for r in rows:
        want = texts[r.id] and texts[r.id].casefold()
        assert r.t == want or set(texts[r.id]) & new


def test_bands(spark):
    assert values(spark, bands.star_band(F.col("x")), [None, 0, 9, 10, 999, 1000], "int") == ["unknown", "0", "1-9", "10-99", "100-999", ">=1000"]
    counts = spark.createDataFrame([(1,), (1,), (7,), (500,)], "n int")
    found = {r.label: r.n for r in bands.range_histogram(spark, counts, "n").collect()}
    assert len(found) == 10 and found["1"] == 2 and found["6-10"] == 1 and found[">100"] == 1 and found["51-100"] == 0


# -- statistics


def test_described_equals_sorting(spark):
    import math
    import random

    rnd = random.Random(1)
    odd = [0.0, -5e-324, math.inf, -math.inf, 1e300, -2.0**-1030, 2.0**10, math.nextafter(2.0**10, 0), None]
    rows = [(rnd.choice(["a", None, "c"]), rnd.choice([rnd.gauss(0, 1e5), rnd.random(), float(rnd.randint(-3, 3)), rnd.choice(odd)]), rnd.choice([None, rnd.randint(-(2**62), 2**62), rnd.randint(0, 9)])) for _ in range(3000)]
    rows += [("hot", 1.0 + i * 2.0**-40, i % 7) for i in range(3000)] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(5)
    ranks = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    for cols, cast in ((["x"], "double"), (["n"], "decimal(38,0)")):
        for r in selection.described(df, cols, "full", cast, ["g"]).collect():
            own = sorted(v for v in (row[1 if cols == ["x"] else 2] for row in rows if row[0] == r["g"]) if v is not None)
            assert (r["measure"], r["count"], r["zero"]) == (cols[0], len(own), sum(v == 0 for v in own))
            assert [r[c] for c in ranks] == [own[max(1, math.ceil(p * len(own))) - 1] if own else None for p in ranks.values()]
            assert (r["minimum"], r["maximum"]) == ((own[0], own[-1]) if own else (None, None))
    one = selection.described(spark.createDataFrame([(10,), (0,), (3,), (4,)], "v long"), "v").first()
    assert (one["p25"], one["median"], one["p90"], one["total"], one["zero"], one["mean"]) == (0, 3, 10, 17, 1, 4.25)
    empty = selection.described(df.filter("false"), ["n", "x"], "integer").collect()
    assert [(r["measure"], r["count"], r["median"], r["mean"]) for r in empty] == [("n", 0, 0, 0.0), ("x", 0, 0, 0.0)]
    nan = selection.described(spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "v double"), "v", "short", "double").first()
    assert nan["median"] == math.inf and math.isnan(nan["p99"]) and math.isnan(nan["maximum"])


def test_described_sorts_no_whole_group(spark):
    plan = selection.described(spark.range(1000), "id")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_tables_make_what_is_asked_for(spark):
    asked = []
    both = Tables({"a": spark.range(1), "b": lambda: asked.append("b") or spark.range(2)}) | {"c": lambda: asked.append("c") or spark.range(3)}
    assert set(both) == {"a", "b", "c"} and not asked
    assert both["b"].count() == 2 and both["b"].count() == 2 and asked == ["b"]


def test_distinct_cube_and_strata(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(50)]), rnd.choice("xyz"), rnd.choice([None, 1, 2]), rnd.randint(0, 5)) for _ in range(2000)] + [(100_000 + i, "x", 1, 1) for i in range(40_000)]
    df = spark.createDataFrame(rows, "k int, a string, b int, n int").repartition(6)
    got = {(r["dimension"], r["value"]): (r["rows"], r["n"], r["keys"]) for r in relational.strata(df, ["a", "b"], {"rows": F.lit(1), "n": F.col("n")}, "k", "keys").collect()}
    for d, at in (("a", 1), ("b", 2)):
        for v in {r[at] for r in rows}:
            own = [r for r in rows if r[at] == v]
            assert got.pop((d, None if v is None else str(v))) == (len(own), sum(r[3] for r in own), len({r[0] for r in own} - {None}))
    assert not got
    flagged = df.withColumn("p", F.col("n") > 3).withColumn("q", F.when(F.col("n") > 2, F.col("a") == "x"))
    for r in relational.cohorts(flagged, ["p", "q"], {"ks": "k", "as": "a"}).collect():
        own = [x for x in rows if (x[3] > 3 if r["cohort"] == "p" else x[3] > 2 and x[1] == "x")]
        assert (r["files"], r["ks"], r["as"]) == (len(own), len({x[0] for x in own} - {None}), len({x[1] for x in own}))


def test_ranks_within_groups_of_any_size(spark):
    rows = spark.range(120_000).selectExpr("CASE WHEN id % 100 < 90 THEN 'hot' WHEN id % 100 < 99 THEN NULL ELSE 'g' || id END AS g", "xxhash64(id) AS v", "id").repartition(7)
    got = relational.ranked_within(rows, ["g"], [F.col("v"), F.col("id")])
    want = rows.selectExpr("*", "CAST(row_number() OVER (PARTITION BY g ORDER BY v, id) AS INT) AS rank")
    assert got.exceptAll(want).isEmpty() and got.count() == 120_000
    assert "PartitionBy" not in got._jdf.queryExecution().toString() and relational.ranked_within(rows.limit(0), ["g"], [F.col("v")]).isEmpty()


def test_shared_lines(spark):
    lines = {1: "a b c d", 2: "b c x", 3: "y", 4: "a b c d"}
    df = spark.createDataFrame([("r", f, w) for f, own in lines.items() for w in own.split()], "repo string, file long, line string")
    postings = relational.line_postings(df)
    pairs = spark.createDataFrame([(a, b) for a in lines for b in lines if a < b] + [(1, 2)], "a long, b long")
    got = {(r["a"], r["b"]): r["shared"] for r in relational.shared_lines(pairs, postings, "a", "b").collect()}
    assert got == {(1, 2): 2, (1, 4): 4, (2, 4): 2}


def test_series(spark):
    df = spark.createDataFrame([(4,), (1,), (2,), (2,)], "v long")
    assert sorted(map(tuple, stats.ecdf(df, "v").collect())) == [(1, 25.0), (2, 75.0), (4, 100.0)]
    times = spark.createDataFrame([(0,), (10,), (20,), (20,), (30,)], "v long")
    assert sorted(map(tuple, stats.survival(times, "v", 10).collect())) == [(1.0, 80.0), (2.0, 60.0), (3.0, 20.0)]
    assert sorted(map(tuple, stats.histogram(df, "v", 0, 4, 2).collect())) == [(0, 1), (1, 3)]
    assert len(stats.ticks(343_528, 16)) == 17 and stats.ticks(343_528, 16)[-1] == 343_528


def test_weighted_quantiles_equal_repeated_values(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(1, 9)) for _ in range(50)]
    got = stats.weighted_quantiles(stats.weighted_histogram(spark.createDataFrame(rows, "v int, w int"), "v", "w"), [0.01, 0.5, 0.99]).first()
    flat = sorted(v for v, w in rows for _ in range(w))
    assert tuple(got) == tuple(flat[max(1, -(-len(flat) * p // 100)) - 1] for p in (1, 50, 99))


def test_intervals():
    low, high = stats.wilson_value(10, 10)
    assert 0.7 < low < 0.73 and high == pytest.approx(1.0)
    assert stats.wilson_value(0, 0) == (None, None) and stats.wilson_value(0, 0, 0.0) == (0.0, 0.0)


def test_samples_are_the_smallest_digests(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("string").alias("key"))
    got = {(r.s, r.key) for r in sampling.smallest_digests(df, "s", "key", 4, "p\0").collect()}
    want = set()
    for s in range(3):
        own = sorted((hashlib.sha256(f"p\0{k}".encode()).hexdigest(), str(k)) for k in range(s, 60, 3))
        want |= {(str(s), k) for _, k in own[:4]}
    assert got == want
    caps = spark.createDataFrame([("0", 2), ("1", 0)], "s string, capacity int")
    assert sampling.with_capacities(df, caps, "s", "key", "p").count() == 2


# -- joins


def test_nearest_ancestors_and_chains(spark):
    names = ["F.md", "f.MD", "a/F.md", "a/b/c/F.md", "x/y/F.md"]
    files = spark.createDataFrame([(k, "r", p) for k, p in enumerate(names)] + [(9, "s", "q/F.md")], "id long, repo string, path string")
    edges = relational.nearest_ancestors(files, "repo", paths.directory(F.col("path")), ["path"])
    got = sorted((r.child_path, r.parent_path, r.child_depth, r.parent_depth) for r in edges.collect())
    assert got == [("a/F.md", "F.md", 1, 0), ("a/F.md", "f.MD", 1, 0), ("a/b/c/F.md", "a/F.md", 3, 1), ("x/y/F.md", "F.md", 2, 0), ("x/y/F.md", "f.MD", 2, 0)]
    chains = {(r.repo, r.dir): r.chain for r in relational.chain_lengths(files, "repo", paths.directory(F.col("path"))).collect()}
    assert chains == {("r", ""): 1, ("r", "a"): 2, ("r", "a/b/c"): 3, ("r", "x/y"): 2, ("s", "q"): 1}


def test_fifo_match_uses_each_row_once(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, a int")
    right = spark.createDataFrame([("k", 10), ("n", 11)], "key string, b int")
    for hot_rows in (10, 0):
        found = relational.fifo_match(left, right, ["key"], ["a"], ["b"], hot_rows)
        got = {(r.key, r.left_row and r.left_row.a, r.right_row and r.right_row.b) for r in found.collect()}
        assert got == {("k", 1, 10), ("k", 2, None), ("m", 3, None), ("n", None, 11)}
    many = spark.createDataFrame([(None if k % 7 == 0 else k % 3, k) for k in range(300)], "key int, a int")
    both = [{(r.key, r.left_row and r.left_row.a, r.right_row and r.right_row.a) for r in relational.fifo_match(many, many.filter("a > 50"), ["key"], ["a"], [-F.col("a")], n).collect()} for n in (1000, 1)]
    assert both[0] == both[1]


def test_bijection_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert relational.bijection(b, b, "k").count() == 1
    with pytest.raises(Exception, match="not matched once"):
        relational.bijection(a, b, "k").collect()


def test_overlap_kinds(spark):
    sets = {1: "abcdefgh", 2: "abcdefghi", 3: "abcdefghijklmnopq", 4: "hgfedcba", 5: "xyz", 6: "xyz"}
    rows = [("r", k, f"h{k}", c) for k, s in sets.items() for c in s]
    got = {(r.a, r.b): r.relation for r in relational.line_overlaps(spark.createDataFrame(rows, "repo string, file int, hash string, line string")).collect()}
    assert got == {(1, 2): "high_jaccard", (1, 3): "high_containment", (1, 4): "normalized_equivalent", (2, 3): "high_containment", (2, 4): "high_jaccard", (3, 4): "high_containment", (5, 6): "normalized_equivalent"}


# -- a small corpus


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


FILES = [
    ("a/one", "CLAUDE.md", "@AGENTS.md\n"),
    ("a/one", "sub/CLAUDE.md", "# Rules\n\n" + "Always run the whole test suite before you commit.\n" * 20),
    ("a/one", "sub/deep/claude.md", "See ../CLAUDE.md and [docs](https://x.org/y.md).\n```bash\nls\n```\n```\nx\n```\n"),
    ("a/one", "copy/CLAUDE.md", "@AGENTS.md\n"),
    ("b/two", "CLAUDE.md", "@AGENTS.md\n"),
    ("b/two", "notes.md", "plain"),
    ("b/two", ".claude/CLAUDE.md", "@AGENTS.md\n# Claude notes\nAlways use plan mode.\n"),
    ("c/three", "CLAUDE.md", ""),
]


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "corpus.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE repos (full_name TEXT PRIMARY KEY, stars INTEGER, language TEXT)")
    con.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, repo_full_name TEXT, path TEXT, content TEXT, content_hash TEXT, size_bytes INTEGER)")
    con.execute("CREATE TABLE analysis (file_id INTEGER, analyzer_id TEXT, result_json TEXT)")
    con.executemany("INSERT INTO repos VALUES (?, ?, ?)", [("a/one", 120, "Go"), ("b/two", None, None), ("c/three", 3, "")])
    con.executemany("INSERT INTO files VALUES (?, ?, ?, ?, ?, ?)", [(k + 1, r, p, c, sha(c), len(c)) for k, (r, p, c) in enumerate(FILES)])
    for k, (_, _, c) in enumerate(FILES):
        con.execute("INSERT INTO analysis VALUES (?, 'structure', ?)", (k + 1, json.dumps({"line_count": len(c.splitlines()), "word_count": len(c.split()), "char_count": len(c), "code_block_languages": {"bash": 1}})))
    con.commit()
    con.close()
    return path


@pytest.fixture(scope="module")
def corpus(spark, database):
    return sqlite.read_corpus(spark, database, 3)


def one(df):
    return df.first().asDict()


def test_populations(corpus):
    got = one(analyses.populations(corpus))
    assert (got["files"], got["exact_files"], got["strict_files"], got["other_files"], got["exact_repositories"]) == (8, 7, 6, 1, 3)
    assert {r.language: r.repositories for r in analyses.dataset(corpus)["languages"].collect()} == {"Go": 1, "(unknown)": 2}
    assert corpus.structures().agg(F.sum("word_count")).first()[0] == sum(len(c.split()) for *_, c in FILES)
    assert analyses.verify(corpus.session, corpus, {"files": 8, "repos": 3})["repos"] == (3, 3)
    with pytest.raises(analyses.VerificationError, match="repos is 3; expected 4\nnothing is None"):
        analyses.verify(corpus.session, corpus, {"files": 8, "repos": 4, "nothing": 1})


def test_duplicates(corpus):
    got = analyses.duplicates(corpus)
    (family,) = got["families"].collect()
    assert (family.copies, family.repositories, family.representative_repo, family.representative_path, family.rank) == (3, 2, "a/one", "CLAUDE.md", 1)
    assert one(got["summary"])["repeated_files"] == 2 and got["members"].count() == 3


def test_parsing_happens_once_per_content_and_task(spark, corpus):
    counter = spark.sparkContext.accumulator(0)

    def parser(content):
        counter.add(1)
        return len(content)

    rows = parsed(corpus.files.coalesce(1), parser, "int").select("id", "parsed").collect()
    assert {r.id: r.parsed for r in rows} == {k + 1: len(c) for k, (*_, c) in enumerate(FILES)}
    assert counter.value == len({c for *_, c in FILES})


def test_structure_expressions(corpus):
    own = structure_fields(F.col("content"))
    rows = {r.id: r for r in corpus.files.select("id", *[v.alias(k) for k, v in own.items()]).collect()}
    assert (rows[3].code_block_tags, rows[3].link_count, rows[2].header_count, rows[8].line_count, rows[8].max_header_depth) == (["bash", "(untagged)"], 1, 1, 0, 0)


def test_sections(corpus):
    got = analyses.sections(corpus)
    totals = one(got["totals"])
    assert (totals["files_full"], totals["files_unique"], totals["sections_full"], totals["sections_unique"]) == (7, 5, 2, 2)
    assert {r.name for r in got["headings"].collect()} == {"rules", "claude notes"}
    assert {r.style: r.sections_full for r in got["styles"].collect()} == {"prose_only": 2}


def test_references(corpus):
    got = analyses.reference_analysis(corpus)
    forms = {r.id: r.form for r in got["files"].collect()}
    assert forms[1] == "pointer_only" and forms[3] == "contextual_local_references_only" and forms[8] == "no_detected_markdown_reference"
    near = [r for r in got["occurrences"].collect() if r.id == 3]
    assert {(r.scope, r.resolved, r.relation) for r in near} == {("local", "sub/CLAUDE.md", "ancestor_directory"), ("external", "", "external")}
    assert got["strata"].filter("dimension = 'form'").agg(F.sum("files")).first()[0] == 7


def test_imports(corpus):
    earlier = analyses.reference_analysis(corpus)["occurrences"].filter("syntax = 'direct_include'").select("repo_full_name", "path", "line", "target", "place")
    got = analyses.import_analysis(corpus, earlier)
    assert {(r.decision, r.occurrences) for r in got["decisions"].groupBy("decision").agg(F.sum("occurrences").alias("occurrences")).collect()} == {("import_candidate", 4)}
    assert {(r.transition, r.n) for r in got["comparison"].collect()} == {("kept_import_candidate", 4)}
    assert one(got["targets"])["first_spelling"] == "AGENTS.md"


def test_repeated_content(corpus):
    got = analyses.repeated_content(corpus)
    (group,) = got["groups"].collect()
    assert (group.repo_full_name, group.files, group.category, group.target_category) == ("a/one", 2, "pointer_shim", "agents_md")
    assert got["summary"].count() == 6 and got["audit"].count() == 1


def test_overlays(corpus):
    got = analyses.overlay_analysis(corpus)
    assert {r.residual_class: r.files for r in got["partition"].collect()} == {"strict_import_only": 3, "short_residual": 1}
    assert one(got["sections"])["concrete"] == 1


def test_hierarchy_and_allocation(corpus):
    got = analyses.hierarchy(corpus)
    assert {(r.child_path, r.parent_path) for r in got["edges"].filter("repo_full_name = 'a/one'").collect()} == {("sub/CLAUDE.md", "CLAUDE.md"), ("copy/CLAUDE.md", "CLAUDE.md"), ("sub/deep/claude.md", "sub/CLAUDE.md")}
    assert one(got["pairs"])["hidden_path"] == ".claude/CLAUDE.md"
    logical = analyses.hierarchy(corpus, logical=True)["edges"].filter("repo_full_name = 'b/two'")
    assert logical.count() == 0
    per = analyses.allocation(corpus)
    edges = {(r.child_path, r.parent_path): r for r in per["edges"].collect()}
    assert edges["copy/CLAUDE.md", "CLAUDE.md"].jaccard == 1.0 and edges["copy/CLAUDE.md", "CLAUDE.md"].same_content_hash == 1
    assert edges["sub/deep/claude.md", "sub/CLAUDE.md"].child_refers_to_parent == 1
    assert {r.heading: r.files for r in per["headings"].collect()} == {"rules": 1, "claude notes": 1}
    assert one(per["comparison"])["equal"] == 1


def test_placement(corpus):
    got = analyses.placement(corpus)
    rows = {r.repo_full_name: (r.files, r.configuration, r.band, r.hidden_files) for r in got["repositories"].collect()}
    assert rows == {"a/one": (4, "root_and_nested", "4-5", 0), "b/two": (2, "root_and_nested", "2", 1), "c/three": (1, "root_only", "1", 0)}
    assert {r.repo_full_name: (r.groups, r.pairs) for r in analyses.exact_reuse(corpus).collect()} == {"a/one": (1, 1)}


def test_languages(corpus):
    class Always:
        name = "always"

        def predict(self, content):
            from quillspark.operators.prose import Prediction

            return Prediction("en", 0.99, 0.9)

    from quillspark.operators.prose import Config

    got = analyses.paragraph_languages(corpus, first=Always(), second=Always(), config=Config(min_words=5, min_letters=10, min_document_words=5))
    assert {(r.language, r.primary_files) for r in got["distribution"].collect()} == {("en", 1)}
    assert {r["class"] for r in got["documents"].collect()} == {"primary", "unknown"}


def test_exports_and_reports(corpus):
    wide = analyses.export(corpus, ["structure", "notation"])
    assert wide.count() == 8 and wide.filter("notation IS NULL").count() == 8 and {"stars", "structure"} <= set(wide.columns)
    assert {r.language: r.files for r in analyses.report(corpus)["languages"].collect()} == {"Go": 4, "(unknown)": 3, "": 1}


def test_star_comparison(spark, corpus):
    current = spark.createDataFrame([("a/renamed", "a/one", 5), ("B/two", None, 900)], "full_name string, stored_name string, stars int")
    got = analyses.star_comparison(corpus.repos, corpus.files, current, top=1)
    assert [r.full_name for r in got["entered"].collect()] == ["b/two"] and [r.full_name for r in got["left"].collect()] == ["a/one"]
    assert {r.full_name: r.change for r in got["comparison"].collect()} == {"a/one": -115, "b/two": 900, "c/three": None}


def test_audits(spark):
    rows = spark.createDataFrame([("__label__en", "TRUE"), ("en", "no"), ("de", " unsure"), ("de", "")], "language string, judgment string")
    got = {r.group: (r.reviewed, r.decisive, r.precision) for r in analyses.language_audit(rows).collect()}
    assert got == {"en": (2, 2, 0.5), "de": (1, 0, None), "(all)": (3, 2, 0.5)}
    with pytest.raises(Exception, match="unknown judgment"):
        analyses.language_audit(spark.createDataFrame([("en", "perhaps")], "language string, judgment string")).collect()
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    got = one(analyses.confusion(a, a.select("k", F.lit("x").alias("r")), "k", "a", "r")["precision"])
    assert (got["n"], got["right"], got["precision"]) == (2, 1, 0.5)


def test_folded_lines_use_composed_forms(spark):
    rows = [(1, "r", "ﬁne  Line\n\nStraße"), (2, "r", "fine line\nSTRASSE")]
    files = fitted(spark.createDataFrame(rows, "id long, repo_full_name string, content string").withColumn("content_hash", F.sha2("content", 256)), "files")
    lines = analyses.normalized_lines(files).groupBy("file").agg(F.sort_array(F.collect_set("line")).alias("l")).collect()
    assert lines[0].l == lines[1].l and unicodedata.normalize("NFKC", "ﬁ") == "fi"


# -- sources, sinks, streams


def test_sqlite_source(spark, database, tmp_path):
    assert sqlite.read_table(spark, database, "files", 3).count() == 8
    with pytest.raises(FileNotFoundError):
        sqlite.connect(str(tmp_path / "none.db"))
    empty = str(tmp_path / "e.db")
    con = sqlite3.connect(empty)
    con.execute("CREATE TABLE repos (full_name TEXT)")
    con.commit()
    con.close()
    assert sqlite.read_table(spark, empty, "repos").count() == 0
    with pytest.raises(ValueError, match="analysis, files"):
        sqlite.read_corpus(spark, empty)
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(database).execute("DELETE FROM repos")


def test_sqlite_takes_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "p.db")
    rows = [(k, random.choice(["a", "A", "b%", "é_", None, ""]), random.choice([None, k / 3, -1.5]), bytes([k % 256]), "2024") for k in [*range(0, 60), *range(10**12, 10**12 + 40)]]
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT COLLATE NOCASE, x REAL, b BLOB, d DATETIME)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()
    df = sqlite.read_table(spark, path, "t", 4)
    plain = spark.createDataFrame([(*r[:4], "2024") for r in rows], "id long, s string, x double, b binary, d string")
    x, t, n = ("x",), ("s",), ("id",)
    tests = {"s = 'a'": [ds.EqualTo(t, "a")], "s <=> NULL": [ds.IsNull(t)], "s IN ('A', 'é_')": [ds.In(t, ("A", "é_"))], "NOT (s = 'a')": [ds.Not(ds.EqualTo(t, "a"))], "s LIKE 'b%'": [ds.StringStartsWith(t, "b")], "contains(s, '%')": [ds.StringContains(t, "%")], "endswith(s, '_')": [ds.StringEndsWith(t, "_")]}
    tests |= {"id > 1000 AND x IS NOT NULL": [ds.GreaterThan(n, 1000), ds.IsNotNull(x)], "x >= 2.5": [ds.GreaterThanOrEqual(x, 2.5)], "id <= 7 AND NOT (x = -1.5)": [ds.LessThanOrEqual(n, 7), ds.Not(ds.EqualTo(x, -1.5))], "s > 'a'": [ds.GreaterThan(t, "a")], "x < 0": [ds.LessThan(x, 0)], "true": []}
    for test, filters in tests.items():
        want = sorted(map(str, plain.filter(test).collect()))
        assert sorted(map(str, df.filter(test).collect())) == want and sorted(map(str, sqlite.read_table(spark, path, "t", 4, where=filters).collect())) == want, test
    for odd in (ds.EqualTo(("d",), "2024"), ds.EqualTo(t, "a\0"), ds.EqualTo(n, 1.5), ds.In(t, ("a", None)), ds.EqualTo(("y",), 1)):
        with pytest.raises(Exception, match="can't judge"):
            sqlite.read_table(spark, path, "t", where=[odd]).collect()
    reader = sqlite.SqliteSource({"path": path, "table": "t", "partitions": "4"}).reader(df.schema)
    assert [sum(p.low <= r[0] <= p.high for r in rows) for p in reader.partitions()] == [25] * 4  # sparse ids, even parts
    assert sqlite.read_table(spark, path, "t", 4, ["x", "id"]).columns == ["x", "id"] and sqlite.read_table(spark, path, "t", 4, ["s"]).count() == 100
    with pytest.raises(ValueError, match="missing: y"):
        sqlite.read_table(spark, path, "t", 4, ["y"])


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Wörd\n1,ä\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_bytes("id;Wörd;x\n1;ä;\"a;b\"\n".encode("cp1252"))
    for name in ("a", "b"):
        df = readers.read_csv(spark, str(tmp_path / f"{name}.csv"), ["id", "Wörd"])
        assert [(r["id"], r["Wörd"]) for r in df.collect()] == [("1", "ä")]
        assert readers.read_lines_csv(str(tmp_path / f"{name}.csv"))[0]["Wörd"] == "ä"
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["other"])
    assert readers.dialect("a\tb\n".encode() + "é".encode()[:1]) == ("UTF-8", "\t")


def test_snapshots_and_catalogues(spark, tmp_path):
    doc = {"schema_version": 1, "search": [{"full_name": "a/b", "stars": 5}, {"full_name": "c/d", "stars": 3}], "lookups": {"old/name": {"full_name": "new/name", "stars": 7}, "gone/x": None}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    ranked, looked = readers.read_snapshot(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in ranked.collect()] == [(1, "a/b", 5), (2, "c/d", 3)] and [tuple(r) for r in looked.collect()] == [("old/name", "new/name", 7)]
    doc["search"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="order"):
        readers.read_snapshot(spark, str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="version"):
        readers.read_snapshot(spark, str(tmp_path / "s.json"), 2)
    (tmp_path / "c.yaml").write_text("notations:\n  - id: x\n    name: X\n    fence_languages: [xx]\n    untagged_heuristics: ['<<']\n")
    assert readers.read_catalogue(str(tmp_path / "c.yaml")) == [{"id": "x", "name": "X", "fence_languages": ["xx"], "untagged_heuristics": ["<<"]}]
    assert readers.digests(spark, str(tmp_path / "s.json")).first()["sha256"] == readers.file_sha256(str(tmp_path / "s.json"))


def test_sinks_are_deterministic(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", None), ("c", 1 / 3)], "k string, v double").repartition(3)
    ids = [(r.id, r.k) for r in sinks.numbered(df, "REF", ["k"]).orderBy("id").collect()]
    assert ids == [("REF-00000001", "a"), ("REF-00000002", "b"), ("REF-00000003", "c")]
    for n in ("x", "y"):
        assert sinks.write_csv(sinks.formatted(df), str(tmp_path / n), ["k"], bom=True) == 3
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes() == "\ufeffk,v\na,\nb,0.500000\nc,0.333333\n".encode()
    assert sinks.text_report({"t": df.orderBy("k")}, 2) == "t\n=\nk  v\na\nb  0.5\n...\n"
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), str(tmp_path / "z"), refuse_empty=True)
    sinks.write_summary({"t": df}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["t"][0] == {"k": "a", "v": None}


def test_analyses_parse_a_stored_content_once(spark, tmp_path, corpus, monkeypatch):
    kept = Corpus(corpus.repos, corpus.files, corpus.analysis, f"file://{tmp_path}/store")
    fresh = {n: sorted(map(str, analyses.sections(corpus)[n].collect())) for n in ("totals", "styles")}
    for _ in range(2):
        assert {n: sorted(map(str, analyses.sections(kept)[n].collect())) for n in fresh} == fresh
    epochs = list((tmp_path / "store" / "structures" / "1" / "manifests").glob("[!.]*"))
    assert len(epochs) == 1  # the second run had nothing to parse
    analyses.paragraph_languages(kept)["decisions"].collect()
    assert analyses.paragraph_languages(kept)["decisions"].collect() == analyses.paragraph_languages(corpus)["decisions"].collect()


def test_stream_takes_each_content_once(spark, tmp_path, corpus):
    (tmp_path / "in").mkdir()
    corpus.files.write.mode("overwrite").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len({c for *_, c in FILES})


def test_missing_columns_become_null(spark):
    assert fitted(spark.createDataFrame([(1, "r", "p")], "ID int, repo_full_name string, path string"), "files").dtypes[0] == ("id", "bigint")
    assert isinstance(Corpus(None, None), Corpus)


def test_fence_fold_equals_the_parser(spark):
    from quillspark.operators import markdown

    rng = random.Random(8)
    parts = ["```", "````", "~~~", "``` x", "``` a`b", "# h", "   ## h", "text", "", "    ```", "~~~~ ", "#no"]
    rows = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    got = values(spark, text.fence_fold(F.col("x")), rows)
    for r, s in zip(rows, got, strict=True):
        plain = [line for _, line in markdown.unfenced(r)]
        assert (s.blocks, s.outside, s.headings) == (markdown.fenced_blocks(r), len(plain), sum(bool(re.match(r" {0,3}#{1,6}([ \t]|$)", x)) for x in plain)), r


def test_stored_notations_and_replay(spark):
    from quillspark.operators import notations

    contents = ["```mermaid\npie x\n```\n```json\n{}\n```\n", "```\n+--+\n```\n", "none"]
    files = fitted(spark.createDataFrame(list(enumerate(contents)), "id long, content string"), "files")

    def stored(content, cap=30):
        found = notations.parse(content)["detections"]
        summary = {}
        for d in found:
            one = summary.setdefault(d["id"], {"count": 0, "confidences": [d["confidence"]], "subtypes": [d["subtype"]] if d["subtype"] else []})
            one["count"] += 1
        kept = [{"notation_id": d["id"], "confidence": d["confidence"], "detected_via": d["via"]} for d in found[:cap]]
        return json.dumps({"any_notation_detected": bool(found), "notation_count_total": len(found), "notations_summary": summary, "detections": kept})

    def corpus_of(cap):
        return Corpus(None, files, fitted(spark.createDataFrame([(k, "notation", stored(c, cap)) for k, c in enumerate(contents)], "file_id long, analyzer_id string, result_json string"), "analysis"))

    got = analyses.stored_notations(corpus_of(1))
    assert {(r.notation, r.occurrences, r.omitted) for r in got["notations"].collect()} == {("mermaid", 1, 0), ("json_schema", 1, 1), ("ascii_diagram", 1, 0)}
    assert tuple(got["caps"].first()) == (1, 1)
    assert analyses.replayed_notations(corpus_of(30)).count() == 3
    wrong = Corpus(None, files.filter("id > 0"), corpus_of(30).analysis)
    with pytest.raises(Exception, match="replay differs"):
        analyses.replayed_notations(wrong).collect()


def test_content_audit(spark):
    audit = spark.createDataFrame([(1, "h1", "pointer_shim"), (2, "h2", "short_ambiguous"), (3, "h3", "template_scaffold")], "audit_id int, content_hash string, auto_category string")
    labels = [(1, "h1", "pointer_shim", "accepted_correct"), (2, "h2", "pointer_shim", "accepted_incorrect"), (3, "h3", "template_scaffold", "classifier_abstention")]
    schema = "audit_id int, content_hash string, review_category string, review_disposition string"
    got = one(analyses.content_audit(audit, spark.createDataFrame(labels, schema))["total"])
    assert (got["audited"], got["accepted"], got["correct"], got["abstentions"], got["precision"]) == (3, 2, 1, 1, 0.5)
    for bad, message in (((1, "h9", "pointer_shim", "accepted_correct"), "hash mismatch"), ((1, "h1", "short_ambiguous", "accepted_correct"), "disagrees"), ((1, "h1", "pointer_shim", "maybe"), "disposition")):
        with pytest.raises(Exception, match=message):
            analyses.content_audit(audit, spark.createDataFrame([bad, *labels[1:]], schema))["total"].collect()


def test_hierarchy_candidates_parse_for_references_alone(spark, sf_dir, monkeypatch):
    from quillspark.plans.corpus import bind

    def refuse(*args, **kwargs):
        raise AssertionError("not needed")

    monkeypatch.setattr(analyses, "allocation", refuse)
    monkeypatch.setattr(relational, "strata", refuse)
    assert len(analyses.hierarchy_candidates(bind(spark, sf_dir)).collect()) == 1


def test_bitmaps_begin_where_their_cells_are(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).alias("d"))
    cube = relational.distinct_cube(df, "k", ["d"], {"n": F.lit(1)})
    lines = cube._jdf.queryExecution().executedPlan().toString().split("\n")
    begin = next(i for i, x in enumerate(lines) if "partial_bitmap_construct_agg" in x)
    assert not any("Exchange" in x for x in lines[:begin])  # no bitmap is exchanged
    assert sorted(map(tuple, relational.rolled_up(cube, ["d"], ["n"], "keys_").collect())) == [(0, 67, 67), (1, 67, 67), (2, 66, 66)]
