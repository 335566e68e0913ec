"""Every registered corpus analysis: its query over a folder of tables, and its SQL oracle where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands, paths, sampling, stats, text
from ..operators import language, relational
from ..operators.selection import described
from ..operators.storage import shared_folder, spread, written
from . import analyses, oracles, stored
from .corpus import _COPY_IDS, CORPUS_SQL, NOTES, Corpus, bind, corpus_sql, structure_fields

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(name: str, sql: str | None = None, corpus: bool = True):
    """Register a query; sql follows the corpus CTEs if corpus is set."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (CORPUS_SQL + sql) if corpus else sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _describe_sql(col: str, source: str, kind: str = "full", cast: str = "BIGINT", by: str = "") -> str:
    q = lambda p: f"CAST(quantile_disc({col}, {p}) AS {cast})"
    parts = {
        "count": f"count({col})",
        "total": f"CAST(sum({col}) AS {cast})",
        "minimum": f"CAST(min({col}) AS {cast})",
        "p25": q(0.25),
        "median": q(0.5),
        "p50": q(0.5),
        "mean": f"avg({col})",
        "p75": q(0.75),
        "p90": q(0.9),
        "p95": q(0.95),
        "p99": q(0.99),
        "maximum": f"CAST(max({col}) AS {cast})",
        "zero": f"count(*) FILTER (WHERE {col} = 0)",
    }
    names, _, rounded = stats.KINDS[kind]
    return "SELECT " + ", ".join(f"{f'round_even({parts[n]}, 6)' if rounded and n == 'mean' else parts[n]} AS {n}" for n in names.split()) + f"{by and ', ' + by} FROM {source}{by and ' GROUP BY ' + by}"


# -- duplicates: families of equal texts over the whole documents table ---------------------------------

_RAW = """
WITH f AS (SELECT doc_id AS id, source AS repo, 'docs/' || doc_id || '.md' AS path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content FROM documents),
fam AS (SELECT content_hash, count(*) AS copies, count(DISTINCT repo) AS repositories, min(size_bytes) AS min_size, max(size_bytes) AS max_size,
        min_by({'r': repo, 'p': path}, {'a': lower(repo), 'b': lower(path), 'c': repo, 'd': path, 'e': id}) AS first
        FROM f WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1)
"""


def _raw(spark: SparkSession, sf_dir: str):
    """Documents as Markdown files of their source, texts unchanged."""
    from .corpus import fitted

    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("repo_full_name"), F.format_string("docs/%d.md", "doc_id").alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))
    return Corpus(fitted(docs.select(F.col("source").alias("full_name")).distinct(), "repos"), fitted(files, "files"))


@query("d17_families", _RAW + "SELECT content_hash, copies, repositories, min_size, max_size, first.r AS representative_repo, first.p AS representative_path, CAST(row_number() OVER (ORDER BY copies DESC, repositories DESC, content_hash) AS INT) AS rank FROM fam", False)
def d17_families(spark, sf_dir):
    return analyses.duplicates(_raw(spark, sf_dir))["families"]


@query("d17_members", _RAW + "SELECT content_hash, id, repo AS repo_full_name, path, size_bytes FROM f SEMI JOIN fam USING (content_hash)", False)
def d17_members(spark, sf_dir):
    return analyses.duplicates(_raw(spark, sf_dir), rank=False)["members"]


@query("d17_summary", _RAW + "SELECT count(*) AS families, CAST(coalesce(sum(copies), 0) AS BIGINT) AS files, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS repeated_files, count(*) FILTER (WHERE repositories > 1) AS cross_repository_families, CAST(coalesce(max(copies), 0) AS BIGINT) AS largest_family FROM fam", False)
def d17_summary(spark, sf_dir):
    return analyses.duplicates(_raw(spark, sf_dir), rank=False)["summary"]


# -- scale, languages, sizes ------------------------------------------------------------------------------


@query(
    "a1_populations",
    """SELECT count(*) AS files, count(DISTINCT repo) AS repositories,
 count(*) FILTER (WHERE e) AS exact_files, count(DISTINCT repo) FILTER (WHERE e) AS exact_repositories,
 count(*) FILTER (WHERE s) AS strict_files, count(DISTINCT repo) FILTER (WHERE s) AS strict_repositories,
 count(*) FILTER (WHERE NOT e) AS other_files, count(DISTINCT repo) FILTER (WHERE NOT e) AS other_repositories
 FROM (SELECT *, lower(path) = 'claude.md' OR lower(path) LIKE '%/claude.md' AS e, path = 'CLAUDE.md' OR path LIKE '%/CLAUDE.md' AS s FROM files)""",
)
def a1_populations(spark, sf_dir):
    return analyses.populations(bind(spark, sf_dir))


@query("d1_languages", "SELECT language, repositories, 100.0::DOUBLE * repositories / sum(repositories) OVER () AS percent, CAST(row_number() OVER (ORDER BY repositories DESC, lower(language), language) AS INT) AS rank FROM (SELECT coalesce(nullif(language, ''), '(unknown)') AS language, count(*) AS repositories FROM repos GROUP BY 1)")
def d1_languages(spark, sf_dir):
    return analyses.dataset(bind(spark, sf_dir))["languages"]


@query("d1_top_repositories", "SELECT full_name, coalesce(stars, 0) AS stars, CAST(row_number() OVER (ORDER BY coalesce(stars, 0) DESC, lower(full_name), full_name) AS INT) AS rank FROM repos QUALIFY rank <= 15")
def d1_top_repositories(spark, sf_dir):
    return analyses.dataset(bind(spark, sf_dir))["top"]


@query("d1_stars", _describe_sql("s", "(SELECT coalesce(stars, 0) AS s FROM repos)"))
def d1_stars(spark, sf_dir):
    return analyses.dataset(bind(spark, sf_dir))["stars"]


@query("m2_describe_bytes", _describe_sql("size_bytes", "exact"))
def m2_describe_bytes(spark, sf_dir):
    return analyses.dataset(bind(spark, sf_dir))["describe_size_bytes"]


@query("m2_describe_tokens", _describe_sql("t", "(SELECT CAST(ceil(length(content) / 3.5::DOUBLE) AS BIGINT) AS t FROM exact)"))
def m2_describe_tokens(spark, sf_dir):
    return analyses.dataset(bind(spark, sf_dir))["describe_tokens"]


@query("m7_describe_prices", _describe_sql("l_extendedprice", "lineitem", "short", "DOUBLE").replace("avg(l_extendedprice)", "round(avg(l_extendedprice), 4)"), False)
def m7_describe_prices(spark, sf_dir):
    out = described(_table(spark, sf_dir, "lineitem"), "l_extendedprice", "short", "double")
    return out.withColumn("mean", F.round("mean", 4))


_LINE_GROUPS = "l_linenumber, l_returnflag"


@query("m1_line_prices", _describe_sql("l_extendedprice", "lineitem", "full", "DOUBLE", _LINE_GROUPS).replace("CAST(sum(l_extendedprice) AS DOUBLE)", "round(sum(l_extendedprice), 2)").replace("avg(l_extendedprice)", "round(avg(l_extendedprice), 4)"), False)
def m1_line_prices(spark, sf_dir):
    """Prices of line items by their place in the order and return flag."""
    out = described(_table(spark, sf_dir, "lineitem"), "l_extendedprice", "full", "double", _LINE_GROUPS.split(", "))
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("m1_order_prices", _describe_sql("o_totalprice", "orders", "plain", "DOUBLE", "o_orderpriority").replace("round_even(avg(o_totalprice), 6)", "round(avg(o_totalprice), 4)"), False)
def m1_order_prices(spark, sf_dir):
    out = described(_table(spark, sf_dir, "orders"), "o_totalprice", "plain", "double", ["o_orderpriority"])
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "m9_weighted_quantiles",
    """, fam AS (SELECT content_hash, count(*) AS w, min(length(content)) AS v FROM exact GROUP BY 1), h AS (SELECT v, sum(w) AS w FROM fam GROUP BY v),
 r AS (SELECT v, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS n FROM h)
 SELECT min(v) FILTER (WHERE upto >= greatest(1, ceil(0.25::DOUBLE * n))) AS q25, min(v) FILTER (WHERE upto >= greatest(1, ceil(0.5::DOUBLE * n))) AS q50,
 min(v) FILTER (WHERE upto >= greatest(1, ceil(0.9::DOUBLE * n))) AS q90, min(v) FILTER (WHERE upto >= greatest(1, ceil(0.99::DOUBLE * n))) AS q99 FROM r""",
)
def m9_weighted_quantiles(spark, sf_dir):
    own = analyses.families(bind(spark, sf_dir)).select(F.length("content").cast("long").alias("chars"), "copies")
    return stats.weighted_quantiles(stats.weighted_histogram(own, "chars", "copies"), [0.25, 0.5, 0.9, 0.99])


@query("m12_ecdf", "SELECT size_bytes AS value, 100.0::DOUBLE * sum(n) OVER (ORDER BY size_bytes) / sum(n) OVER () AS percent FROM (SELECT size_bytes, count(*) AS n FROM exact GROUP BY 1)")
def m12_ecdf(spark, sf_dir):
    return analyses.size_series(bind(spark, sf_dir))["ecdf_bytes"]


_WORDS = r"len(regexp_extract_all(content, '[^\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'))"


@query("m13_survival", f"SELECT w / 238.0::DOUBLE AS minutes, percent FROM (SELECT w, 100.0::DOUBLE * sum(n) OVER (ORDER BY w DESC) / sum(n) OVER () AS percent FROM (SELECT {_WORDS} AS w, count(*) AS n FROM exact GROUP BY 1)) WHERE w > 0")
def m13_survival(spark, sf_dir):
    return analyses.size_series(bind(spark, sf_dir))["survival_238"]


@query("m11_profile", _describe_sql("w", f"(SELECT {_WORDS} AS w FROM exact)", "profile"))
def m11_profile(spark, sf_dir):
    return analyses.size_series(bind(spark, sf_dir))["profile_words"]


@query("d19_histogram", "SELECT CAST(least(floor(size_bytes / 500.0::DOUBLE), 39) AS INT) AS bin, count(*) AS n FROM files WHERE lower(path) LIKE '%.md' AND tool_id = 'a' AND size_bytes BETWEEN 0 AND 20000 GROUP BY 1")
def d19_histogram(spark, sf_dir):
    return analyses.size_histogram(bind(spark, sf_dir), 20000, 40, tool="a")


@query(
    "d4_windows",
    """SELECT w.window, round_even(100.0::DOUBLE * baseline / w.size, 6) AS baseline_percent, round_even(100.0::DOUBLE * uplift / w.size, 6) AS uplift_percent
 FROM (SELECT max(CAST(ceil(length(content) / 3.5::DOUBLE) AS BIGINT)) AS baseline, max(CAST(ceil(length(content) / 3.5::DOUBLE * 1.3::DOUBLE) AS BIGINT)) AS uplift FROM exact),
 (VALUES ('200k', 200000), ('500k', 500000), ('1M', 1000000)) AS w("window", size)""",
)
def d4_windows(spark, sf_dir):
    return analyses.context_windows(bind(spark, sf_dir))["windows"]


_LINES = r"len(list_filter(regexp_split_to_array(regexp_replace(content, '(\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: content <> ''))"


@query("d4_lines", f"SELECT count(*) FILTER (WHERE n < 200) AS below, count(*) FILTER (WHERE n = 200) AS at, count(*) FILTER (WHERE n > 200) AS above, count(*) FILTER (WHERE n > 500) AS above_500, count(*) FILTER (WHERE n > 1000) AS above_1000, round_even(avg(CAST(n >= 200 AS DOUBLE)), 6) AS share_at_or_above FROM (SELECT {_LINES} AS n FROM exact)")
def d4_lines(spark, sf_dir):
    return analyses.context_windows(bind(spark, sf_dir))["lines"]


@query("d4_describe_chars", _describe_sql("c", "(SELECT length(content) AS c FROM exact)", "plain"))
def d4_describe_chars(spark, sf_dir):
    return analyses.context_windows(bind(spark, sf_dir))["describe_chars"]


@query("d20_languages", "SELECT coalesce(language, '(unknown)') AS language, count(*) AS files FROM files LEFT JOIN repos ON repo = full_name GROUP BY 1")
def d20_languages(spark, sf_dir):
    return analyses.report(bind(spark, sf_dir))["languages"]


@query("d20_tools", "SELECT tool_id, count(*) AS files, count(DISTINCT repo) AS repositories FROM files GROUP BY 1")
def d20_tools(spark, sf_dir):
    return analyses.report(bind(spark, sf_dir))["tools"]


@query("d20_largest", "SELECT id, path, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 15")
def d20_largest(spark, sf_dir):
    return analyses.report(bind(spark, sf_dir))["largest"]


@query(
    "d23_coverage",
    """, a AS (SELECT size_bytes // 200 AS interval, count(*) AS total FROM files GROUP BY 1), o AS (SELECT size_bytes // 200 AS interval, count(*) AS files FROM exact GROUP BY 1)
 SELECT interval, coalesce(files, 0) AS files, coalesce(total, 0) AS total, coalesce(files, 0)::DOUBLE / nullif(total, 0) AS share FROM a FULL JOIN o USING (interval)""",
)
def d23_coverage(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    available = corpus.files.groupBy(F.floor(F.col("size_bytes") / 200).alias("interval")).agg(F.count("*").alias("total"))
    return analyses.coverage(corpus, available)


@query("d21_export", "SELECT id, repo AS repo_full_name, path, tool_id, size_bytes, stars, language, length(content) AS characters FROM files LEFT JOIN repos ON repo = full_name")
def d21_export(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    results = corpus.files.select(F.col("id").alias("file_id"), F.lit("structure").alias("analyzer_id"), F.to_json(F.struct(F.length("content").alias("char_count"))).alias("result_json"))
    wide = analyses.export(Corpus(corpus.repos, corpus.files, results), ["structure"])
    return wide.select("id", "repo_full_name", "path", "tool_id", "size_bytes", "stars", "language", F.get_json_object("structure", "$.char_count").cast("long").alias("characters"))


# -- joins ---------------------------------------------------------------------------------------------------


@query("j1_documents_labels", "SELECT quality, toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL", False)
def j1_documents_labels(spark, sf_dir):
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("j3_customer_orders", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", False)
def j3_customer_orders(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("j4_multi_file_repositories", "SELECT id, repo AS repo_full_name, path FROM exact SEMI JOIN (SELECT repo FROM exact GROUP BY repo HAVING count(*) > 1) USING (repo)")
def j4_multi_file_repositories(spark, sf_dir):
    return relational.repeated(bind(spark, sf_dir).population("exact"), "repo_full_name").select("id", "repo_full_name", "path")


@query("j5_representatives", _RAW + "SELECT content_hash, min(id) AS id, count(*) AS copies FROM f WHERE content_hash IS NOT NULL GROUP BY 1", False)
def j5_representatives(spark, sf_dir):
    files = _raw(spark, sf_dir).files.select("id", "content_hash").filter("content_hash IS NOT NULL")
    return relational.representative(files, "content_hash", F.col("id")).select("content_hash", "id", "copies")


@query("j10_names_with_alias", "SELECT c.c_custkey, coalesce(a.n_name, b.n_name) AS n_name FROM customer c LEFT JOIN nation a ON lower('N' || c.c_custkey) = lower(a.n_name) LEFT JOIN nation b ON c.c_nationkey = b.n_nationkey", False)
def j10_names_with_alias(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    keyed = _table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("N"), "c_custkey")).join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("alias")), "c_nationkey", "left")
    return relational.first_matching(keyed, nation.select(F.col("n_name").alias("k"), "n_name"), "name", "alias", "k", "n_name").select("c_custkey", "n_name")


_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"


@query(
    "j7_hierarchy_edges",
    f""", e AS (SELECT id, repo, path, {_DIR} AS dir FROM exact), d AS (SELECT DISTINCT repo, dir FROM e),
 up AS (SELECT c.repo, c.dir, p.dir AS up FROM d c JOIN d p ON c.repo = p.repo AND c.dir <> p.dir AND (p.dir = '' OR starts_with(c.dir, p.dir || '/')) QUALIFY row_number() OVER (PARTITION BY c.repo, c.dir ORDER BY length(p.dir) DESC) = 1)
 SELECT c.repo AS repo_full_name, c.id AS child_id, c.path AS child_path, p.id AS parent_id, p.path AS parent_path,
 CAST(CASE WHEN c.dir = '' THEN 0 ELSE len(string_split(c.dir, '/')) END AS INT) AS child_depth, CAST(CASE WHEN up.up = '' THEN 0 ELSE len(string_split(up.up, '/')) END AS INT) AS parent_depth
 FROM e c JOIN up USING (repo, dir) JOIN e p ON p.repo = c.repo AND p.dir = up.up""",
)
def j7_hierarchy_edges(spark, sf_dir):
    return analyses.hierarchy(bind(spark, sf_dir))["edges"]


@query(
    "j15_chain_lengths",
    f""", d AS (SELECT DISTINCT repo, {_DIR} AS dir FROM exact)
 SELECT c.repo AS repo_full_name, c.dir, 1 + count(p.dir) AS chain FROM d c LEFT JOIN d p ON c.repo = p.repo AND c.dir <> p.dir AND (p.dir = '' OR starts_with(c.dir, p.dir || '/')) GROUP BY ALL""",
)
def j15_chain_lengths(spark, sf_dir):
    return analyses.hierarchy(bind(spark, sf_dir))["chains"]


@query(
    "j8_scope_pairs",
    f""", e AS (SELECT id, repo, path, content_hash, {_DIR} AS dir FROM exact),
 s AS (SELECT *, lower(dir) = '.claude' OR lower(dir) LIKE '%/.claude' AS hidden FROM e),
 l AS (SELECT *, CASE WHEN NOT hidden THEN dir WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE '' END AS scope FROM s)
 SELECT a.repo AS repo_full_name, a.scope, a.path AS direct_path, a.content_hash AS direct_hash, b.path AS hidden_path, b.content_hash AS hidden_hash, CAST(a.content_hash = b.content_hash AS INT) AS same_content
 FROM l a JOIN l b ON a.repo = b.repo AND a.scope = b.scope AND NOT a.hidden AND b.hidden""",
)
def j8_scope_pairs(spark, sf_dir):
    return analyses.hierarchy(bind(spark, sf_dir))["pairs"]


@query(
    "j6_line_overlaps",
    r""", several AS (SELECT * FROM exact SEMI JOIN (SELECT repo FROM exact GROUP BY repo HAVING count(*) > 1) USING (repo)),
 raw AS (SELECT repo, id, content_hash, unnest(regexp_split_to_array(content, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM several),
 l AS (SELECT DISTINCT repo, id, content_hash, lower(trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ')) AS line FROM raw), k AS (SELECT * FROM l WHERE line <> ''),
 n AS (SELECT repo, id, count(*) AS n FROM k GROUP BY ALL),
 s AS (SELECT a.repo, a.id AS a, b.id AS b, count(*) AS shared FROM k a JOIN k b ON a.repo = b.repo AND a.line = b.line AND a.id < b.id AND a.content_hash <> b.content_hash GROUP BY ALL),
 m AS (SELECT s.*, x.n AS na, y.n AS nb, shared::DOUBLE / (x.n + y.n - shared) AS jaccard, shared::DOUBLE / least(x.n, y.n) AS containment FROM s JOIN n x ON x.repo = s.repo AND x.id = s.a JOIN n y ON y.repo = s.repo AND y.id = s.b)
 SELECT * FROM (SELECT repo, a, b, na, nb, shared, jaccard, containment, CASE WHEN shared = na AND shared = nb THEN 'normalized_equivalent' WHEN shared >= 5 AND jaccard >= 0.8 THEN 'high_jaccard' WHEN shared >= 5 AND containment >= 0.9 THEN 'high_containment' END AS relation FROM m) WHERE relation IS NOT NULL""",
)
def j6_line_overlaps(spark, sf_dir):
    return analyses.line_overlaps(bind(spark, sf_dir), ascii_only=True)


@query(
    "j9_fifo_match",
    """WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
 r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = (SELECT max(event_type) FROM events))
 SELECT coalesce(l.user_id, r.user_id) AS user_id, l.event_id AS left_event, r.event_id AS right_event FROM l FULL JOIN r ON l.user_id = r.user_id AND l.n = r.n""",
    False,
)
def j9_fifo_match(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_type"), F.max("event_type")).first()
    one = lambda t: events.filter(F.col("event_type") == t).select("user_id", "event_id", "ts")
    return relational.fifo_match(one(low), one(high), ["user_id"], ["ts", "event_id"], ["ts", "event_id"]).select("user_id", F.col("left_row.event_id").alias("left_event"), F.col("right_row.event_id").alias("right_event"))


@query("j9_fifo_stream", _SQL["j9_fifo_match"], False)
def j9_fifo_stream(spark, sf_dir):
    """The same matches from a stream: events arrive in five stretches of time, each a batch, and the end of time settles what is left."""
    from ..streaming.matching import fifo_matches

    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    low, high, first, last = events.agg(F.min("event_type"), F.max("event_type"), F.min("ts"), F.max("ts")).first()
    chosen = events.filter(F.col("event_type").isin(low, high)).withColumn("part", F.least(F.floor((F.unix_millis("ts") - F.unix_millis(F.lit(first))) / F.greatest(F.lit(1), F.unix_millis(F.lit(last)) - F.unix_millis(F.lit(first)) + 1) * 5), F.lit(4)))
    at = f"{shared_folder(spark)}/fifo-{uuid.uuid4().hex}"
    # An event of nobody, long after all others, comes with the last ones: after that batch the watermark has passed them all.
    end = spark.range(1).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("INTERVAL 20 YEAR")).alias("ts"), F.lit(low).alias("event_type"))
    parts = [chosen.filter(F.col("part") == k).drop("part") for k in range(5)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in [*parts[:-1], parts[-1].unionByName(end)]:
            rows.write.mode("append").parquet(f"{at}/in")
            stream = fifo_matches(spark.readStream.schema(events.schema).parquet(f"{at}/in"), "user_id", "ts", "event_id", F.col("event_type") == low)
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    found = spark.read.schema(f"key {events.schema['user_id'].dataType.simpleString()}, left_event long, right_event long").parquet(f"{at}/out")
    return found.filter(F.coalesce(F.least("left_event", "right_event"), F.lit(0)) >= 0).withColumnRenamed("key", "user_id")


@query("k1_csv_parts", "SELECT * REPLACE (CAST(p_partkey AS VARCHAR) AS p_partkey) FROM (SELECT p_partkey, p_name, p_brand FROM part)", False)
def k1_csv_parts(spark, sf_dir):
    """Parts written as CSV by all tasks in the order of their names, and read back."""
    from ..sources.ordered_csv import write_parts

    at = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    write_parts(df, at, ["p_name", "p_partkey"])
    names = ", ".join(f"{c} string" for c in df.columns)
    return spark.read.schema(names).option("multiLine", True).csv(f"{at}/*.csv").filter("p_partkey <> 'p_partkey'")


@query("j11_label_bijection", "SELECT doc_id, quality, toxic FROM labels", False)
def j11_label_bijection(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return relational.bijection(labels.select("doc_id", "quality"), labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "l.quality", "r.toxic")


# -- aggregation, strata, samples ------------------------------------------------------------------------------


@query(
    "a10_strata",
    """, c AS (SELECT f.*, CASE WHEN size_bytes IS NULL THEN 'unknown' WHEN size_bytes <= 50 THEN '<=50' WHEN size_bytes <= 200 THEN '51-200' WHEN size_bytes <= 1000 THEN '201-1000' WHEN size_bytes <= 5000 THEN '1001-5000' ELSE '>5000' END AS size_band,
 CASE WHEN stars IS NULL THEN 'unknown' WHEN stars <= 0 THEN '0' WHEN stars <= 9 THEN '1-9' WHEN stars <= 99 THEN '10-99' WHEN stars <= 999 THEN '100-999' ELSE '>=1000' END AS star_band,
 coalesce(language, 'Unknown') AS language, CASE WHEN contains(path, '/') THEN 'nested' ELSE 'root' END AS location FROM exact f LEFT JOIN repos ON repo = full_name),
 u AS (SELECT unnest([{'d': 'size_band', 'v': size_band}, {'d': 'star_band', 'v': star_band}, {'d': 'language', 'v': language}, {'d': 'location', 'v': location}]) AS x, repo, size_bytes FROM c)
 SELECT x.d AS dimension, x.v AS value, count(*) AS files, count(DISTINCT repo) AS repositories, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM u GROUP BY ALL""",
)
def a10_strata(spark, sf_dir):
    files = analyses._context(bind(spark, sf_dir))
    return relational.strata(files, ["size_band", "star_band", "language", "location"], {"files": F.lit(1), "bytes": F.col("size_bytes")}, "repo_full_name", "repositories")


@query(
    "p12_bins",
    """, c AS (SELECT repo, count(*) AS n FROM exact GROUP BY repo),
 b(ordinal, label, lo, hi) AS (VALUES (0,'1',1,1),(1,'2',2,2),(2,'3',3,3),(3,'4',4,4),(4,'5',5,5),(5,'6-10',6,10),(6,'11-20',11,20),(7,'21-50',21,50),(8,'51-100',51,100),(9,'>100',101,1000000000))
 SELECT ordinal, label, count(c.n) AS n FROM b LEFT JOIN c ON c.n BETWEEN lo AND hi GROUP BY ALL""",
)
def p12_bins(spark, sf_dir):
    return analyses.placement(bind(spark, sf_dir))["bins"]


@query(
    "a28_placement",
    f""", e AS (SELECT repo, path, content_hash, {_DIR} AS dir FROM exact), g AS (SELECT *, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, lower(dir) = '.claude' OR lower(dir) LIKE '%/.claude' AS hidden FROM e),
 p AS (SELECT repo AS repo_full_name, count(*) AS files, count(*) FILTER (WHERE depth = 0) AS root_files, count(*) FILTER (WHERE depth > 0) AS nested_files, CAST(max(depth) AS INT) AS maximum_depth, count(DISTINCT content_hash) AS contents, count(*) FILTER (WHERE hidden) AS hidden_files FROM g GROUP BY repo)
 SELECT *, CASE WHEN nested_files = 0 THEN 'root_only' WHEN root_files = 0 THEN 'nested_only' ELSE 'root_and_nested' END AS configuration,
 CASE WHEN files = 1 THEN '1' WHEN files = 2 THEN '2' WHEN files = 3 THEN '3' WHEN files <= 5 THEN '4-5' WHEN files <= 10 THEN '6-10' WHEN files <= 20 THEN '11-20' ELSE '>20' END AS band FROM p""",
)
def a28_placement(spark, sf_dir):
    return analyses.placement(bind(spark, sf_dir))["repositories"]


@query(
    "a15_components",
    f""", e AS (SELECT id, repo, path, {_DIR} AS dir FROM exact WHERE contains(path, '/')), p AS (SELECT id, repo, path, string_split(dir, '/') AS parts FROM e),
 c AS (SELECT id, repo, path, 'first_directory' AS dimension, lower(parts[1]) AS component FROM p UNION ALL SELECT id, repo, path, 'parent_directory', lower(parts[-1]) FROM p UNION ALL SELECT id, repo, path, 'any_directory', lower(unnest(list_distinct(parts))) FROM p)
 SELECT dimension, component, count(*) AS files, count(DISTINCT repo) AS repositories, array_to_string(list(repo || '::' || path ORDER BY lower(repo), repo, lower(path), path)[1:3], '; ') AS examples, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, count(DISTINCT repo) DESC, component) AS INT) AS rank FROM c GROUP BY dimension, component""",
)
def a15_components(spark, sf_dir):
    return analyses.placement(bind(spark, sf_dir))["components"].withColumn("examples", F.array_join("examples", "; "))


@query("p14_anomalies", "SELECT CAST(sum(CAST(starts_with(path, '/') AS INT)) AS BIGINT) AS leading_slash, CAST(sum(CAST(contains(path, '//') AS INT)) AS BIGINT) AS double_slash, CAST(sum(CAST(contains(path, chr(92)) AS INT)) AS BIGINT) AS backslash, CAST(sum(CAST(list_has_any(string_split(path, '/'), ['.', '..']) AS INT)) AS BIGINT) AS dot_component FROM exact")
def p14_anomalies(spark, sf_dir):
    return analyses.placement(bind(spark, sf_dir))["anomalies"]


@query("a22_exact_reuse", "SELECT repo AS repo_full_name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS files, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT repo, content_hash, count(*) AS n FROM exact GROUP BY ALL HAVING count(*) > 1) GROUP BY repo")
def a22_exact_reuse(spark, sf_dir):
    return analyses.exact_reuse(bind(spark, sf_dir))


@query("m15_hhi", "SELECT o_custkey, round(sum(o_totalprice * o_totalprice) / (sum(o_totalprice) * sum(o_totalprice)), 9) AS hhi, round(max(o_totalprice) / sum(o_totalprice), 9) AS largest_share FROM orders GROUP BY 1", False)
def m15_hhi(spark, sf_dir):
    return stats.herfindahl(_table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").select("o_custkey", F.round("hhi", 9).alias("hhi"), F.round("largest_share", 9).alias("largest_share"))


_CELLS = "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS d FROM labels"


@query("m17_odds_ratio", f"SELECT round(r, 9) AS odds_ratio, round(exp(ln(nullif(r, 0)) - 1.96 * e), 9) AS low, round(exp(ln(nullif(r, 0)) + 1.96 * e), 9) AS high FROM (SELECT CASE WHEN b * c > 0 THEN a * d / (b * c) END AS r, CASE WHEN least(a, b, c, d) > 0 THEN sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS e FROM ({_CELLS}))", False)
def m17_odds_ratio(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    cells = _table(spark, sf_dir, "labels").agg(*[F.count_if((q == x) & (t == y)).alias(n) for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))])
    return cells.select(*[F.round(c, 9).alias(n) for n, c in zip(("odds_ratio", "low", "high"), stats.odds_ratio(*map(F.col, "abcd")), strict=True)])


@query("m18_wilson", "SELECT quality, n, k, round(greatest(0.0, m - h), 9) AS low, round(least(1.0, m + h), 9) AS high FROM (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM (SELECT quality, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS k, (count(*) FILTER (WHERE toxic = 0))::DOUBLE / count(*) AS p, 1.959963984540054::DOUBLE AS z FROM labels GROUP BY quality))", False)
def m18_wilson(spark, sf_dir):
    g = _table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("quality", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a20_confusion", "SELECT quality AS auto, toxic AS review, count(*) AS n FROM labels GROUP BY ALL", False)
def a20_confusion(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return analyses.confusion(labels.select("doc_id", "quality"), labels.select("doc_id", "toxic"), "doc_id", "quality", "toxic")["matrix"]


@query("o5_hash_sample", "SELECT lang, doc_id, digest, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, sha256('inspect' || chr(0) || doc_id) AS digest, row_number() OVER (PARTITION BY lang ORDER BY sha256('inspect' || chr(0) || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10", False)
def o5_hash_sample(spark, sf_dir):
    return sampling.smallest_digests(_table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 10, "inspect\0")


_BANDS = "CASE WHEN n_chars <= 200 THEN 'a' WHEN n_chars <= 1000 THEN 'b' ELSE 'c' END"


@query(
    "o7_round_robin",
    f"""WITH t AS (SELECT lang, doc_id, {_BANDS} AS band, sha256('7:' || doc_id) AS digest FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, band ORDER BY digest, doc_id) AS turn FROM t)
 SELECT lang, doc_id, band, digest, CAST(pick AS INT) AS pick FROM (SELECT lang, doc_id, band, digest, row_number() OVER (PARTITION BY lang ORDER BY turn, band, digest) AS pick FROM r) WHERE pick <= 7""",
    False,
)
def o7_round_robin(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.expr(_BANDS).alias("band"))
    return sampling.round_robin(docs, "lang", "band", ["a", "b", "c"], "doc_id", 7, 7)


_COHORTS = {"docs": "contains(content, '@docs')", "agents": "contains(content, '@AGENTS.md')", "large": "size_bytes > 2000"}


@query("a17_cohorts", " UNION ALL ".join(f"SELECT '{k}' AS cohort, count(*) FILTER (WHERE {p}) AS files, count(DISTINCT repo) FILTER (WHERE {p}) AS repositories, count(DISTINCT content_hash) FILTER (WHERE {p}) AS contents FROM exact" for k, p in _COHORTS.items()))
def a17_cohorts(spark, sf_dir):
    files = bind(spark, sf_dir).population("exact").select("repo_full_name", "content_hash", *[F.expr(p).alias(k) for k, p in _COHORTS.items()])
    return relational.cohorts(files, list(_COHORTS), {"repositories": "repo_full_name", "contents": "content_hash"})


_LINE_DIMENSIONS = ["l_returnflag", "l_linestatus", "l_linenumber", "o_orderstatus", "o_orderpriority", "discount"]


@query(
    "a10_customer_strata",
    f"""WITH c AS (SELECT *, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'middle' ELSE 'high' END AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 u AS (SELECT unnest([{", ".join(f"{{'d': '{d}', 'v': CAST({d} AS VARCHAR)}}" for d in _LINE_DIMENSIONS)}]) AS x, o_custkey, l_quantity FROM c)
 SELECT x.d AS dimension, x.v AS value, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(DISTINCT o_custkey) AS customers FROM u GROUP BY ALL""",
    False,
)
def a10_customer_strata(spark, sf_dir):
    """Line items and customers by six properties."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = F.col("l_discount")
    lines = lines.withColumn("discount", F.when(d < 0.03, "low").when(d < 0.07, "middle").otherwise("high"))
    return relational.strata(lines, _LINE_DIMENSIONS, {"lines": F.lit(1), "quantity": F.col("l_quantity").cast("long")}, "o_custkey", "customers")


@query(
    "a10_customer_pairs",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL
 UNION ALL SELECT o_orderstatus, NULL, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT o_custkey) FROM orders""",
    False,
)
def a10_customer_pairs(spark, sf_dir):
    """Distinct customers of pairs of properties, of one, and of all, from one cube."""
    cube = written(relational.distinct_cube(_table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], {"orders": F.lit(1)}), "cube")
    parts = [relational.rolled_up(cube, by, ["orders"], "customers") for by in (["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], [])]
    none = lambda c: F.lit(None).cast("string").alias(c)
    return parts[0].unionByName(parts[1].withColumn("o_orderpriority", none("p"))).unionByName(parts[2].withColumn("o_orderstatus", none("s")).withColumn("o_orderpriority", none("p")))


@query("u4_top_overlap", "WITH a AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100), b AS (SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) SELECT c_custkey, CASE WHEN b.c IS NULL THEN 'left' WHEN a.c IS NULL THEN 'entered' ELSE 'stayed' END AS state FROM (SELECT c_custkey, 1 AS c FROM a) a FULL JOIN (SELECT c_custkey, 1 AS c FROM b) b USING (c_custkey)", False)
def u4_top_overlap(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey")
    b = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count().orderBy(F.desc("count"), "c_custkey").limit(100).select("c_custkey")
    parts = ((a.intersect(b), "stayed"), (b.exceptAll(a), "entered"), (a.exceptAll(b), "left"))
    one, two, three = (df.withColumn("state", F.lit(s)) for df, s in parts)
    return one.unionByName(two).unionByName(three)


@query("s3_json_props", "SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || json_keys(props)[1])) AS first_values, CAST(max(len(json_keys(props))) AS INT) AS most_keys FROM events WHERE props IS NOT NULL GROUP BY 1", False)
def s3_json_props(spark, sf_dir):
    events = _table(spark, sf_dir, "events").filter("props IS NOT NULL")
    keys = F.json_object_keys("props")
    values = F.from_json("props", "map<string,string>")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.element_at(values, F.element_at(keys, 1))).alias("first_values"), F.max(F.size(keys)).alias("most_keys"))


@query(
    "k7_pivot_export",
    "SELECT d.doc_id, source, lang, max(quality) AS quality, max(toxic) AS toxic FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    False,
)
def k7_pivot_export(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    long = labels.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("quality", "toxic")])).alias("x")).select("doc_id", "x.name", "x.value")
    wide = long.groupBy("doc_id").pivot("name", ["quality", "toxic"]).agg(F.max("value"))
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(wide, "doc_id", "left")


# -- text and Markdown by expressions --------------------------------------------------------------------------


@query(
    "t1_structure",
    rf"""SELECT id, CAST({_LINES} AS INT) AS line_count, CAST({_WORDS} AS INT) AS word_count, CAST(length(content) AS INT) AS char_count,
 CAST(len(regexp_extract_all(content, '(?m)^(#{{1,6}})[\t-\r ]+([^\n]*)$')) AS INT) AS header_count,
 CAST(coalesce(list_max(list_transform(regexp_extract_all(content, '(?m)^(#{{1,6}})[\t-\r ]+([^\n]*)$', 1), lambda x: length(x))), 0) AS INT) AS max_header_depth,
 CAST(len(regexp_extract_all(content, '(?ms)^```([^\t-\r ]*)[\t-\r ]*\n(.*?)^```')) AS INT) AS code_block_count,
 CAST(len(regexp_extract_all(content, '(?m)^[\t-\r ]*[-*+][\t-\r ]+')) AS INT) AS bullet_count, CAST(len(regexp_extract_all(content, '\[[^\]]+\]\([^)]+\)')) AS INT) AS link_count FROM exact""",
)
def t1_structure(spark, sf_dir):
    own = structure_fields(F.col("content"))
    return bind(spark, sf_dir).population("exact").select("id", *[v.alias(k) for k, v in own.items() if k != "code_block_tags"])


_TAGS = r"unnest(regexp_extract_all(content, '(?ms)^```([^\t-\r ]*)[\t-\r ]*\n(.*?)^```', 1)) AS tag"
_LABELLED = f", b AS (SELECT id, CASE WHEN tag = '' THEN '(untagged)' ELSE lower(tag) END AS label FROM (SELECT id, {_TAGS} FROM files))"


@query("d7_fence_labels", _LABELLED + " SELECT label, count(*) AS blocks, count(DISTINCT id) AS files FROM b GROUP BY label")
def d7_fence_labels(spark, sf_dir):
    return analyses.fence_languages(bind(spark, sf_dir))["raw"]


@query("d7_fence_families", _LABELLED + " SELECT family, count(*) AS blocks, count(DISTINCT id) AS files FROM (SELECT id, CASE WHEN label = 'bash' THEN 'Shell' WHEN label = 'py' THEN 'Python' WHEN label = 'json' THEN 'JSON' WHEN label = 'ts' THEN 'TypeScript' WHEN label = 'mermaid' THEN 'Mermaid' ELSE label END AS family FROM b) GROUP BY family")
def d7_fence_families(spark, sf_dir):
    return analyses.fence_languages(bind(spark, sf_dir))["normalized"]


@query("d7_fence_summary", _LABELLED + " SELECT count(DISTINCT id) AS files_with_code, count(*) AS blocks, count(*) FILTER (WHERE label <> '(untagged)') AS tagged_blocks, count(DISTINCT label) AS labels FROM b")
def d7_fence_summary(spark, sf_dir):
    return analyses.fence_languages(bind(spark, sf_dir))["summary"]


@query(
    "fp_paths",
    f"""SELECT id, CAST(CASE WHEN contains(path, '/') THEN len(string_split(path, '/')) - 1 ELSE 0 END AS INT) AS depth, {_DIR} AS directory, regexp_extract(path, '([^/]*)$', 1) AS basename, CASE WHEN contains(path, '/') THEN 'nested' ELSE 'root' END AS location,
 CASE WHEN lower({_DIR}) = '.claude' OR lower({_DIR}) LIKE '%/.claude' THEN 'hidden' ELSE 'direct' END AS form FROM files""",
)
def fp_paths(spark, sf_dir):
    p = F.col("path")
    return bind(spark, sf_dir).files.select("id", paths.depth(p).alias("depth"), paths.directory(p).alias("directory"), paths.basename(p).alias("basename"), paths.location(p).alias("location"), paths.placement_form(p).alias("form"))


@query("fp_urls", r"SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, len(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/')) - 1 AS depth, CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^?#]*[.]html?([?#]|$)') THEN 1 ELSE 0 END AS html FROM pages", False)
def fp_urls(spark, sf_dir):
    path = F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([A-Za-z]+)://", 1).alias("scheme"), (F.size(F.split(path, "/")) - 1).cast("long").alias("depth"), path.rlike("[.]html?$").cast("int").alias("html"))


@query("f13_scripts_and_letters", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}')) AS INT) AS letters, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS INT) AS words, CASE WHEN regexp_matches(text, '\p{L}') THEN 'Latin/other' ELSE 'none' END AS script FROM documents", False)
def f13_scripts_and_letters(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.letters(t).alias("letters"), text.word_count(t, text.WORD).alias("words"), text.dominant_script(t).alias("script"))


@query("f12_excerpts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN replace(replace(text[:80], chr(13), '\\r'), chr(10), '\\n') || '…' ELSE replace(replace(text, chr(13), '\\r'), chr(10), '\\n') END AS excerpt FROM documents", False)
def f12_excerpts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.escaped_excerpt(F.col("text"), 80).alias("excerpt"))


_FOLD = """, f AS (SELECT id, content, list_reduce(string_split(content, chr(10)), lambda s, x: {'o': CASE WHEN s.o THEN NOT regexp_full_match(x, ' {0,3}```+[ \\t]*') ELSE regexp_matches(x, '^ {0,3}```') END,
 'b': s.b + CAST(NOT s.o AND regexp_matches(x, '^ {0,3}```') AS INT), 'u': s.u + CAST(NOT s.o AND NOT regexp_matches(x, '^ {0,3}```') AS INT),
 'h': s.h + CAST(NOT s.o AND regexp_matches(x, '^ {0,3}#{1,6}([ \\t]|$)') AS INT)}, {'o': false, 'b': 0, 'u': 0, 'h': 0}) AS s FROM exact)"""


@query("t3_fence_fold", _FOLD + " SELECT id, s.o AS open, CAST(s.b AS INT) AS blocks, CAST(s.u AS INT) - CAST(ends_with(content, chr(10)) AND NOT s.o OR content = '' AS INT) AS outside, CAST(s.h AS INT) AS headings FROM f")
def t3_fence_fold(spark, sf_dir):
    return bind(spark, sf_dir).population("exact").select("id", text.fence_fold(F.col("content")).alias("s")).select("id", "s.*")


@query("t5_heading_counts", _FOLD + " SELECT id, CAST(s.h AS INT) AS headings, CAST(s.b AS INT) AS fenced_blocks FROM f")
def t5_heading_counts(spark, sf_dir):
    """The document parser, in Python, against a fold in SQL."""
    from ..operators import markdown
    from .corpus import parsed

    files = bind(spark, sf_dir).population("exact")
    count = lambda c: {"headings": len(markdown.headings(c)), "fenced_blocks": markdown.fenced_blocks(c)}
    return parsed(files, count, "struct<headings:int,fenced_blocks:int>", "p", ["id", "content"]).select("id", "p.*")


_MINUTES = f"(SELECT id, {_WORDS} / 238.0::DOUBLE AS m FROM exact)"


@query("f16_durations", f"SELECT id, CASE WHEN m < 1 THEN printf('%.0f s', round_even(m * 60, 0)) WHEN m >= 60 THEN printf('%.1f h', m / 60) ELSE printf('%.1f min', m) END AS duration FROM {_MINUTES}")
def f16_durations(spark, sf_dir):
    return bind(spark, sf_dir).population("exact").select("id", text.duration(text.word_count(F.col("content")), 238).alias("duration"))


@query(
    "d2_star_comparison",
    """, n AS (SELECT full_name, coalesce(stars, 0) AS stars, (coalesce(stars, 0) * 7 + length(full_name) * 13) % 4000 AS current_stars FROM repos),
 o AS (SELECT full_name FROM n ORDER BY stars DESC, lower(full_name), full_name LIMIT 15), c AS (SELECT full_name FROM n ORDER BY current_stars DESC, lower(full_name), full_name LIMIT 15)
 SELECT full_name, CASE WHEN full_name IN (SELECT * FROM o) AND full_name IN (SELECT * FROM c) THEN 'stayed' WHEN full_name IN (SELECT * FROM c) THEN 'entered' ELSE 'left' END AS state, stars, CAST(current_stars AS BIGINT) AS current_stars
 FROM n WHERE full_name IN (SELECT * FROM o) OR full_name IN (SELECT * FROM c)""",
)
def d2_star_comparison(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    current = corpus.repos.select("full_name", F.lit(None).cast("string").alias("stored_name"), ((F.coalesce("stars", F.lit(0)) * 7 + F.length("full_name") * 13) % 4000).cast("long").alias("stars"))
    got = analyses.star_comparison(corpus.repos, corpus.files, current)
    states = [got[s].withColumn("state", F.lit(s)) for s in ("stayed", "entered", "left")]
    return states[0].unionByName(states[1]).unionByName(states[2]).join(got["comparison"].select("full_name", "stars", "current_stars"), "full_name")


@query("d18_partition", oracles.IMPORTS + r", f AS (SELECT id, len(regexp_extract_all(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN x = '@AGENTS.md' AND list_contains(outside, CAST(i AS INT)) THEN '' ELSE x END), lambda x: true), chr(10)), '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')) AS n, repo, content_hash, content FROM st WHERE id IN (SELECT id FROM imports WHERE decision = 'import_candidate' AND target = 'AGENTS.md')) SELECT CASE WHEN regexp_full_match(replace(content, '@AGENTS.md', ''), '[ \t\r\n]*') THEN 'strict_import_only' WHEN n = 0 THEN 'markup_or_punctuation_only_residual' WHEN n < 10 THEN 'short_residual' ELSE 'substantive_residual' END AS residual_class, count(*) AS files, count(DISTINCT repo) AS repositories, count(DISTINCT content_hash) AS contents FROM f GROUP BY 1")
def d18_partition(spark, sf_dir):
    return analyses.overlay_analysis(bind(spark, sf_dir))["partition"]


@query("d18_sections")
def d18_sections(spark, sf_dir):
    return analyses.overlay_analysis(bind(spark, sf_dir))["sections"]


# -- parsers and classifiers in Python, once per distinct content: no SQL says these; tests hold them to fixtures ---


@query("d6_section_totals", oracles.HEADINGS + " " + oracles.totals({"files": "1", "headed_files": "CAST(n > 0 AS INT)", "sections": "n", "empty_sections": "empties", "skipped_jumps": "jumps", "starts_below_h1": "CAST(below AS INT)", "multiple_h1": "CAST(h1 > 1 AS INT)"}))
def d6_section_totals(spark, sf_dir):
    return analyses.sections(bind(spark, sf_dir))["totals"]


@query("d6_styles", oracles.SECTIONS + " SELECT style, CAST(sum(w) AS BIGINT) AS sections_full, count(*) AS sections_unique, round(100.0::DOUBLE * sum(w) / (SELECT sum(w) FROM styled), 9) AS percent_full FROM styled GROUP BY style")
def d6_styles(spark, sf_dir):
    return analyses.sections(bind(spark, sf_dir))["styles"].withColumn("percent_full", F.round("percent_full", 9))


@query("d6_headings", oracles.HEADINGS + " SELECT name, CAST(sum(w) AS BIGINT) AS occurrences, CAST((SELECT sum(w) FROM (SELECT DISTINCT id, w FROM named_headings x WHERE x.name = h.name)) AS BIGINT) AS files, count(DISTINCT id) AS contents FROM named_headings h GROUP BY name ORDER BY files DESC, occurrences DESC, name LIMIT 1000")
def d6_headings(spark, sf_dir):
    return analyses.sections(bind(spark, sf_dir))["headings"]


@query("d6_quantiles", oracles.SECTIONS + ", long AS (SELECT w, unnest([{'k': 'line_count', 'v': line_count}, {'k': 'word_count', 'v': word_count}, {'k': 'list_items', 'v': list_items}, {'k': 'prose_blocks', 'v': prose_blocks}, {'k': 'list_lines', 'v': list_lines}, {'k': 'prose_lines', 'v': prose_lines}]) AS m FROM sect), flat AS (SELECT m.k AS measure, m.v AS value, w FROM long), q AS (SELECT * FROM (" + oracles.weighted("flat", "measure", [25, 50, 90, 99]).replace(", h AS", "WITH h AS", 1) + ")) SELECT measure, q25, q50, q90, q99 FROM q")
def d6_quantiles(spark, sf_dir):
    found = analyses.sections(bind(spark, sf_dir))["quantiles"]
    return found.select("measure", *[F.col(c).cast("long").alias(c) for c in ("q25", "q50", "q90", "q99")])


@query("d8_notations", oracles.NOTATIONS + " SELECT notation, confidence, count(*) AS occurrences, count(DISTINCT id) AS files FROM seen GROUP BY ALL")
def d8_notations(spark, sf_dir):
    return analyses.notation_candidates(bind(spark, sf_dir))["summary"]


@query(
    "d8_sample",
    r""", fenced AS (SELECT id, path, content_hash, unnest(regexp_extract_all(content, '(?ms)^```([^\s]*)[ \t]*\n(.*?)^```', 1)) AS label, unnest(regexp_extract_all(content, '(?ms)^```([^\s]*)[ \t]*\n(.*?)^```', 2)) AS body, unnest(range(len(regexp_extract_all(content, '(?ms)^```([^\s]*)[ \t]*\n(.*?)^```')))) AS nr FROM files),
 looks(turn, notation, pattern) AS (VALUES (1, 'mermaid', 'sequenceDiagram|classDiagram|stateDiagram|erDiagram'), (2, 'plantuml', '@startuml'), (3, 'graphviz', 'digraph |digraph\{|rankdir='), (4, 'ascii_diagram', '[┌┐└┘├┤┬┴┼─│]|\+[-]{2,}\+|<-{2,}>|-{2,}>|<-{2,}'), (5, 'bnf_ebnf', '::='), (6, 'json_schema', '"$schema"|"type": "object"|"properties":'), (7, 'yaml_schema', 'openapi:|swagger:|\$schema:')),
 told AS (SELECT id, path, content_hash, nr, 0 AS turn, CASE lower(label) WHEN 'mermaid' THEN 'mermaid' ELSE 'json_schema' END AS notation, 'high' AS confidence, 'fence_language' AS via, body FROM fenced WHERE lower(label) IN ('mermaid', 'json')
  UNION ALL SELECT id, path, content_hash, nr, turn, notation, 'medium', 'untagged_heuristic', body FROM fenced, looks WHERE lower(label) NOT IN ('mermaid', 'json') AND regexp_matches(body, pattern)),
 heads AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nr, turn) - 1 AS place, lower(array_to_string(string_split(regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10))[1:3], chr(10))) AS head FROM told),
 keyed AS (SELECT id, path, content_hash, CAST(place AS INT) AS place, notation, confidence, via, id || ':' || place AS key, sha256('notation-inspection-v1' || chr(0) || id || ':' || place) AS digest,
  coalesce(CASE WHEN notation = 'mermaid' THEN CASE WHEN contains(head, 'graph ') OR contains(head, 'graph;') OR contains(head, 'flowchart ') THEN 'flowchart' WHEN contains(head, 'sequencediagram') THEN 'sequence' WHEN contains(head, 'statediagram') THEN 'state' WHEN contains(head, 'classdiagram') THEN 'class'
   WHEN contains(head, 'erdiagram') THEN 'er' WHEN contains(head, 'gantt') THEN 'gantt' WHEN contains(head, 'journey') THEN 'journey' WHEN contains(head, 'pie ') THEN 'pie' END END, '(unclassified)') AS subtype FROM heads)
 SELECT *, CAST(row_number() OVER (PARTITION BY notation ORDER BY digest, key) AS INT) AS rank FROM keyed QUALIFY rank <= 10""",
)
def d8_sample(spark, sf_dir):
    return analyses.notation_candidates(bind(spark, sf_dir))["sample"]


_TRAINS = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) > '2'"


def _labelled(spark, sf_dir) -> DataFrame:
    """Documents with their language and whether they train, which three in sixteen (by id) don't."""
    return spread(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", (F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) > "2").alias("trains"))


def _language_models(spark, sf_dir) -> tuple:
    texts = _labelled(spark, sf_dir).filter("trains")
    counted = language.labelled_tokens(texts)
    return tuple(language.fit(texts, kind, counted=counted) for kind in language.KINDS)


_FEATURES = {
    "characters": r"flatten(list_transform(list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 1), lambda k: substr(' ' || w || ' ', k, 3))))",
    "words": r"list_transform(regexp_extract_all(text, '\p{L}+'), lambda w: lower(w))",
}
#: Counts of features by language, those that stay, and their scores.
_MODEL = "WITH " + ", ".join(
    f"""{k}_f AS (SELECT doc_id, lang, {_TRAINS} AS trains, unnest({f}) AS feature FROM documents WHERE text IS NOT NULL),
 {k}_c AS (SELECT feature, lang, count(*) AS n FROM {k}_f WHERE trains AND lang IS NOT NULL GROUP BY ALL),
 {k}_k AS (SELECT feature FROM {k}_c GROUP BY feature HAVING sum(n) >= 5 ORDER BY sum(n) DESC, feature LIMIT 50000),
 {k}_g AS (SELECT feature, l.lang, coalesce(c.n, 0) AS n FROM {k}_k CROSS JOIN (SELECT DISTINCT lang FROM {k}_c) l LEFT JOIN {k}_c c USING (feature, lang)),
 {k}_m AS (SELECT feature, lang, CAST(round(1000 * ln((n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY lang) + 0.5::DOUBLE * count(*) OVER (PARTITION BY lang)))) AS BIGINT) AS score FROM {k}_g),
 {k}_s AS (SELECT doc_id, m.lang, sum(score) AS s, count(*) AS n FROM {k}_f f JOIN {k}_m m USING (feature) WHERE NOT trains GROUP BY ALL),
 {k}_o AS (SELECT doc_id, lang, s, exp((s - max(s) OVER (PARTITION BY doc_id)) / 1000.0::DOUBLE / n * least(n, 12)) AS o FROM {k}_s),
 {k}_p AS (SELECT doc_id, min_by(lang, {{'a': -s, 'b': lang}}) AS predicted, 1 / sum(o) AS confidence FROM {k}_o GROUP BY doc_id)"""
    for k, f in _FEATURES.items()
)


@query("c9_language_model", f"{_MODEL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, feature, lang AS language, score FROM {k}_m" for k in _FEATURES), False)
def c9_language_model(spark, sf_dir):
    """The scores of all features of two models fitted on the documents' languages."""
    rows = []
    for m in _language_models(spark, sf_dir):
        each = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in m.languages]).alias("language"), F.col("scores").alias("score")))
        rows.append(m.table.select(F.lit(m.kind).alias("kind"), "feature", each.alias("x")).select("kind", "feature", F.col("x.language").alias("language"), F.col("x.score").alias("score")))
    return rows[0].unionByName(rows[1])


@query(
    "c9_language_accuracy",
    f"{_MODEL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, lang AS language, coalesce(predicted, 'und') AS predicted, count(*) AS documents, round(avg(coalesce(confidence, 0)), 6) AS confidence FROM documents LEFT JOIN {k}_p USING (doc_id) WHERE NOT {_TRAINS} GROUP BY ALL" for k in _FEATURES),
    False,
)
def c9_language_accuracy(spark, sf_dir):
    """What the models say of the documents that didn't train them."""
    held = _labelled(spark, sf_dir).filter("NOT trains")
    parts = []
    for m in _language_models(spark, sf_dir):
        found = held.select("doc_id", "lang").join(language.predict(held, ["doc_id"], m).withColumnRenamed("language", "predicted"), "doc_id")
        parts.append(found.groupBy(F.lit(m.kind).alias("kind"), F.col("lang").alias("language"), "predicted").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("confidence")))
    return parts[0].unionByName(parts[1])


@query("d9_decisions")
def d9_decisions(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["decisions"]


@query("d9_documents")
def d9_documents(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["documents"]


@query("d9_distribution")
def d9_distribution(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["distribution"]


@query("d11_line_overlaps", _SQL["j6_line_overlaps"].removeprefix(CORPUS_SQL))
def d11_line_overlaps(spark, sf_dir):
    return analyses.line_overlaps(bind(spark, sf_dir))


@query("d12_repositories", oracles.HIERARCHY + " SELECT repo AS repo_full_name, files, bytes, root_bytes, maximum_depth, round(hhi, 9) AS hhi, round(largest_share, 9) AS largest_share, (SELECT count(*) FROM edge WHERE edge.repo = per.repo) AS edges, round(root_share, 9) AS root_share, band FROM per")
def d12_repositories(spark, sf_dir):
    found = analyses.allocation(bind(spark, sf_dir))["repositories"]
    return found.select(*[F.round(c, 9).alias(c) if c in ("hhi", "largest_share", "root_share") else c for c in found.columns])


@query("d12_edges", oracles.FILE_HEADINGS + oracles.HIERARCHY + rf""", ln AS (SELECT DISTINCT id, line FROM (SELECT id, replace(lower(trim(regexp_replace(unnest(string_split(content, chr(10))), '\s+', ' ', 'g'), ' ')), 'ß', 'ss') AS line FROM several) WHERE line <> ''),
 n AS (SELECT id, count(*) AS n FROM ln GROUP BY id), nh AS (SELECT id, count(*) AS sections FROM named_headings GROUP BY id), hs AS (SELECT DISTINCT id, name FROM named_headings),
 f AS (SELECT s.id, path, content_hash, size_bytes, CAST({_LINES} AS INT) AS lines, CAST({_WORDS} AS INT) AS words, CAST(coalesce(sections, 0) AS INT) AS sections, coalesce(n, 0) AS n FROM several s LEFT JOIN nh USING (id) LEFT JOIN n USING (id)),
 sh AS (SELECT child, parent, count(*) AS shared FROM edge JOIN ln a ON a.id = child JOIN ln b ON b.id = parent AND a.line = b.line GROUP BY ALL),
 sn AS (SELECT child, parent, count(*) AS names FROM edge JOIN hs a ON a.id = child JOIN hs b ON b.id = parent AND a.name = b.name GROUP BY ALL)
 SELECT e.repo AS repo_full_name, p.path AS parent_path, c.path AS child_path, p.size_bytes AS parent_size_bytes, p.lines AS parent_lines, p.words AS parent_words, p.sections AS parent_sections, c.size_bytes AS child_size_bytes, c.lines AS child_lines, c.words AS child_words, c.sections AS child_sections,
 CAST(c.content_hash = p.content_hash AS INT) AS same_content_hash, CAST(coalesce(shared, 0) AS INT) AS shared_lines, coalesce(round(coalesce(shared, 0)::DOUBLE / nullif(c.n + p.n - coalesce(shared, 0), 0), 9), 0) AS jaccard, coalesce(round(coalesce(shared, 0)::DOUBLE / nullif(c.n, 0), 9), 0) AS child_coverage, coalesce(round(coalesce(shared, 0)::DOUBLE / nullif(p.n, 0), 9), 0) AS parent_coverage,
 0 AS parent_refers_to_child, 0 AS child_refers_to_parent, CAST(coalesce(names, 0) AS INT) AS shared_headings
 FROM edge e JOIN f c ON c.id = e.child JOIN f p ON p.id = e.parent LEFT JOIN sh USING (child, parent) LEFT JOIN sn USING (child, parent)""")
def d12_edges(spark, sf_dir):
    found = analyses.allocation(bind(spark, sf_dir))["edges"]
    return found.select(*[F.round(c, 9).alias(c) if c in ("jaccard", "child_coverage", "parent_coverage") else c for c in found.columns])


@query("d12_strata", oracles.HIERARCHY + " SELECT band, count(*) AS repositories, " + ", ".join(f"round({x}, 9) AS {n}" for c in ("hhi", "root_share") for n, x in ((f"{c}_minimum", f"min({c})"), (f"{c}_p25", f"quantile_disc({c}, 0.25)"), (f"{c}_median", f"quantile_disc({c}, 0.5)"), (f"{c}_mean", f"avg({c})"), (f"{c}_p90", f"quantile_disc({c}, 0.9)"), (f"{c}_maximum", f"max({c})"))) + " FROM per GROUP BY band")
def d12_strata(spark, sf_dir):
    found = analyses.allocation(bind(spark, sf_dir))["strata"]
    return found.select("band", "repositories", *[F.round(F.col(f"{c}.{m}"), 9).alias(f"{c}_{m}") for c in ("hhi", "root_share") for m in ("minimum", "p25", "median", "mean", "p90", "maximum")])


@query("d12_headings", oracles.FILE_HEADINGS + oracles.HIERARCHY + """, role AS (SELECT id, CASE WHEN id IN (SELECT parent FROM edge) AND id IN (SELECT child FROM edge) THEN 'middle' WHEN id IN (SELECT parent FROM edge) THEN 'parent' WHEN id IN (SELECT child FROM edge) THEN 'child' WHEN dir = '' THEN 'single_root' ELSE 'single_nested' END AS role FROM several),
 x AS (SELECT DISTINCT n.id, name, role FROM named_headings n JOIN role ON n.id = role.id)
 SELECT name AS heading, count(*) FILTER (WHERE role = 'parent') AS parent, count(*) FILTER (WHERE role = 'middle') AS middle, count(*) FILTER (WHERE role = 'child') AS child, count(*) FILTER (WHERE role = 'single_root') AS single_root, count(*) FILTER (WHERE role = 'single_nested') AS single_nested, count(*) AS files FROM x GROUP BY name ORDER BY files DESC, name LIMIT 1000""")
def d12_headings(spark, sf_dir):
    return analyses.allocation(bind(spark, sf_dir))["headings"]


@query("d13_occurrences", oracles.REFERENCES + " SELECT id, repo_full_name, path, line, syntax, 'local' AS scope, raw, target, name, source_line, context, resolved, relation, category, 0 AS is_self, rule, intent, CASE WHEN rule = 'no_explicit_instructional_cue_v1' THEN 'low' ELSE 'high' END AS confidence, high FROM ro")
def d13_occurrences(spark, sf_dir):
    found = analyses.reference_analysis(bind(spark, sf_dir))["occurrences"]
    return found.select("id", "repo_full_name", "path", "line", "syntax", "scope", "raw", "target", "name", "source_line", "context", "resolved", "relation", "category", "is_self", "rule", "intent", "confidence", "high")


@query("d13_files", oracles.REFERENCES + f" SELECT {oracles.FACT_COLUMNS}, residual_words, has_fence, local, local AS local_nonself, CAST(0 AS BIGINT) AS external, high, fan_out, distinct_targets, coalesce(target_categories, '') AS target_categories, form FROM forms")
def d13_files(spark, sf_dir):
    found = analyses.reference_analysis(bind(spark, sf_dir))["files"].withColumn("target_categories", F.coalesce("target_categories", F.lit("")))
    return found.select(*oracles.FACT_COLUMNS.split(", "), "residual_words", "has_fence", "local", "local_nonself", "external", "high", "fan_out", "distinct_targets", "target_categories", "form")


@query("d13_targets", oracles.REFERENCES + " SELECT 'local' AS scope, category, name, count(*) AS occurrences, count(DISTINCT id) AS files, count(DISTINCT repo_full_name) AS repositories, count(*) FILTER (WHERE high = 1) AS high_occurrences, count(DISTINCT id) FILTER (WHERE high = 1) AS high_files, count(*) FILTER (WHERE intent = 'direct_inclusion') AS direct_inclusion, count(*) FILTER (WHERE intent = 'instructional_delegation') AS instructional_delegation, count(*) FILTER (WHERE intent = 'contextual_documentation') AS contextual_documentation FROM ro GROUP BY category, name")
def d13_targets(spark, sf_dir):
    return analyses.reference_analysis(bind(spark, sf_dir))["targets"]


@query("d13_strata", oracles.REFERENCES + ", x AS (SELECT unnest([{'d': 'size_band', 'v': size_band}, {'d': 'star_band', 'v': star_band}, {'d': 'language', 'v': language}, {'d': 'location', 'v': location}, {'d': 'multiplicity', 'v': multiplicity}, {'d': 'duplication', 'v': duplication}, {'d': 'form', 'v': form}]) AS x, repo_full_name, high FROM forms) SELECT x.d AS dimension, x.v AS value, count(*) AS files, count(DISTINCT repo_full_name) AS repositories, count(*) FILTER (WHERE high > 0) AS files_with_high, CAST(sum(high) AS BIGINT) AS high_occurrences FROM x GROUP BY ALL")
def d13_strata(spark, sf_dir):
    return analyses.reference_analysis(bind(spark, sf_dir))["strata"]


@query("d14_tokens", oracles.IMPORTS + " SELECT id, repo_full_name, path, place, line, 1 AS \"column\", CAST(length(token) + 1 AS INT) AS end_column, token, target, context, decision, CASE WHEN context = 'plain_text' THEN 'documented_at_path_candidate_v1' ELSE 'fenced_code_exclusion_v1' END AS rule, 'whole_line' AS surface, 'relative' AS kind, replace(content[greatest(start - 180, 0) + 1 : start + length(token) + 180], chr(10), ' ') AS evidence, CAST(start AS INT) AS start, CAST(start + length(token) AS INT) AS \"end\", name, 'markdown' AS extension, 'markdown_file' AS shape, target AS normalized, resolved, relation FROM imports")
def d14_tokens(spark, sf_dir):
    found = analyses.import_analysis(bind(spark, sf_dir))["tokens"]
    return found.select("id", "repo_full_name", "path", F.col("place").cast("long").alias("place"), "line", "column", "end_column", "token", "target", "context", "decision", "rule", "surface", "kind", "evidence", "start", "end", "name", "extension", "shape", "normalized", "resolved", "relation")


@query("d14_targets", oracles.IMPORTS + " SELECT 'relative' AS kind, relation, 'markdown' AS extension, 'markdown_file' AS shape, lower(name) AS name, count(*) AS occurrences, count(DISTINCT id) AS files, count(DISTINCT repo_full_name) AS repositories, arg_min(name, {'a': repo_full_name, 'b': path, 'c': place}) AS first_spelling FROM imports WHERE decision = 'import_candidate' GROUP BY relation, lower(name)")
def d14_targets(spark, sf_dir):
    return analyses.import_analysis(bind(spark, sf_dir))["targets"]


@query("d14_comparison", oracles.IMPORTS + " SELECT CASE WHEN decision = 'import_candidate' THEN 'kept_import_candidate' ELSE 'new_excluded_fenced_code' END AS transition, 'markdown' AS extension, count(*) AS n FROM imports GROUP BY 1")
def d14_comparison(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    found = analyses.reference_analysis(corpus)["occurrences"].filter("syntax = 'direct_include'").select("repo_full_name", "path", "line", "target", "place")
    return analyses.import_analysis(corpus, found)["comparison"]


@query("d15_groups", oracles.REPEATED + " SELECT repo AS repo_full_name, content_hash, files, size_bytes, representative, '' AS tags, category, CAST(words AS INT) AS words, CAST(full_lines AS INT) AS nonempty_lines, CAST(n_refs AS INT) AS refs FROM formed")
def d15_groups(spark, sf_dir):
    return analyses.repeated_content(bind(spark, sf_dir))["groups"].select("repo_full_name", "content_hash", "files", "size_bytes", "representative", "tags", "category", "words", "nonempty_lines", "refs")


@query("d15_summary", oracles.REPEATED + """, k(ordinal, category) AS (VALUES (0, 'pointer_shim'), (1, 'empty_placeholder'), (2, 'generated_context'), (3, 'template_scaffold'), (4, 'substantive_repeated_document'), (5, 'short_ambiguous')),
 c AS (SELECT k.ordinal, k.category, count(f.id) AS groups, CAST(coalesce(sum(f.files), 0) AS BIGINT) AS files, count(DISTINCT f.repo) AS repositories, count(DISTINCT f.content_hash) AS contents FROM k LEFT JOIN formed f USING (category) GROUP BY ALL)
 SELECT *, groups::DOUBLE / sum(groups) OVER () AS groups_share, files::DOUBLE / sum(files) OVER () AS files_share, contents::DOUBLE / sum(contents) OVER () AS contents_share FROM c""")
def d15_summary(spark, sf_dir):
    return analyses.repeated_content(bind(spark, sf_dir))["summary"]


@query("d18_overlays")
def d18_overlays(spark, sf_dir):
    return analyses.overlay_analysis(bind(spark, sf_dir))["files"]


# -- placement by documented scope, analyzers, report ----------------------------------------------------------------


@query(
    "d11_placement",
    oracles.SCOPES
    + """, p AS (SELECT repo, count(*) AS files, count(*) FILTER (WHERE NOT hidden) AS d, count(*) FILTER (WHERE hidden) AS h, count(*) FILTER (WHERE scope = '') AS r, count(*) FILTER (WHERE scope = '' AND NOT hidden) AS rd, count(*) FILTER (WHERE scope = '' AND hidden) AS rh FROM sc GROUP BY repo)
 SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(d) AS BIGINT) AS direct_files, CAST(sum(h) AS BIGINT) AS hidden_files, CAST(sum(r) AS BIGINT) AS project_root_files, CAST(sum(files - r) AS BIGINT) AS nonroot_files, CAST(sum(rd) AS BIGINT) AS project_root_direct_files, CAST(sum(rh) AS BIGINT) AS project_root_hidden_files,
 count(*) FILTER (WHERE d > 0) AS direct_repositories, count(*) FILTER (WHERE h > 0) AS hidden_repositories, count(*) FILTER (WHERE rd > 0 AND rh > 0) AS project_root_both_repositories, count(*) FILTER (WHERE rh > 0 AND rd = 0) AS project_root_hidden_only_repositories, sum(h)::DOUBLE / sum(files) AS hidden_share FROM p""",
)
def d11_placement(spark, sf_dir):
    names = ["files", "direct_files", "hidden_files", "project_root_files", "nonroot_files", "project_root_direct_files", "project_root_hidden_files", "direct_repositories", "hidden_repositories", "project_root_both_repositories", "project_root_hidden_only_repositories", "hidden_share"]
    return analyses.scope_mapping(bind(spark, sf_dir))["placement"].select(*names)


@query(
    "d11_configurations",
    oracles.SCOPES
    + """, p AS (SELECT repo, count(*) AS files, bool_or(scope = '') AS r, bool_or(scope <> '') AS n FROM sc GROUP BY repo),
 c AS (SELECT CASE WHEN r AND n THEN 'project_root_and_nonroot' WHEN r THEN 'project_root_only' ELSE 'nonroot_only' END AS configuration, files FROM p),
 k(configuration) AS (VALUES ('project_root_only'), ('nonroot_only'), ('project_root_and_nonroot'))
 SELECT k.configuration, count(c.files) AS repositories, CAST(coalesce(sum(c.files), 0) AS BIGINT) AS files, count(c.files)::DOUBLE / (SELECT count(*) FROM c) AS repositories_share, coalesce(sum(c.files), 0)::DOUBLE / (SELECT sum(files) FROM c) AS files_share FROM k LEFT JOIN c USING (configuration) GROUP BY 1""",
)
def d11_configurations(spark, sf_dir):
    return analyses.scope_mapping(bind(spark, sf_dir))["configurations"]


@query(
    "d11_alternatives",
    oracles.SCOPES
    + """, g AS (SELECT repo, scope, count(*) FILTER (WHERE NOT hidden) AS d, count(*) FILTER (WHERE hidden) AS h FROM sc GROUP BY ALL HAVING d > 0 AND h > 0),
 q AS (SELECT a.content_hash = b.content_hash AS same FROM sc a JOIN sc b ON a.repo = b.repo AND a.scope = b.scope AND NOT a.hidden AND b.hidden)
 SELECT count(*) AS scope_groups, count(DISTINCT repo) AS repositories, count(*) FILTER (WHERE scope = '') AS project_root_groups, count(*) FILTER (WHERE scope <> '') AS nonroot_groups, (SELECT count(*) FROM q) AS file_pairs, (SELECT count(*) FROM q WHERE same) AS same_content_pairs, (SELECT count(*) FROM q WHERE NOT same) AS different_content_pairs FROM g""",
)
def d11_alternatives(spark, sf_dir):
    return analyses.scope_mapping(bind(spark, sf_dir))["alternatives"]


@query(
    "d11_topology",
    oracles.SCOPES
    + """, s AS (SELECT DISTINCT repo, scope FROM sc), c AS (SELECT a.repo, a.scope, 1 + count(b.scope) AS chain FROM s a LEFT JOIN s b ON a.repo = b.repo AND a.scope <> b.scope AND (b.scope = '' OR starts_with(a.scope, b.scope || '/')) GROUP BY ALL)
 SELECT count(*) AS scopes, count(*) FILTER (WHERE chain > 1) AS edges, count(DISTINCT repo) FILTER (WHERE chain > 1) AS repositories_with_edges, max(chain) AS longest_chain FROM c""",
)
def d11_topology(spark, sf_dir):
    return analyses.scope_mapping(bind(spark, sf_dir))["topology"]


@query("d11_nonroot_depths", oracles.SCOPES + " " + _describe_sql("d", "(SELECT len(string_split(scope, '/')) AS d FROM sc WHERE scope <> '')", "integer"))
def d11_nonroot_depths(spark, sf_dir):
    return analyses.scope_mapping(bind(spark, sf_dir))["nonroot_depths"]


def _analyzed(spark: SparkSession, sf_dir: str) -> Corpus:
    """The bound corpus with the stored results of all analyzers."""
    corpus = bind(spark, sf_dir)
    return Corpus(corpus.repos, corpus.files, written(analyses.analyze(corpus), "analysis"))


@query(
    "s11_stored_structure",
    rf"""SELECT id AS file_id, CAST({_LINES} AS INT) AS line_count, CAST({_WORDS} AS INT) AS word_count, CAST(length(content) AS INT) AS char_count, CAST(len(regexp_extract_all(content, '(?m)^(#{{1,6}})[\t-\r ]+([^\n]*)$')) AS INT) AS header_count,
 CAST(len(regexp_extract_all(content, '(?ms)^```([^\t-\r ]*)[\t-\r ]*\n(.*?)^```')) AS INT) AS code_block_count, CAST(len(regexp_extract_all(content, '\[[^\]]+\]\([^)]+\)')) AS INT) AS link_count FROM files""",
)
def s11_stored_structure(spark, sf_dir):
    """What the registered analyzer stores, read back."""
    return _analyzed(spark, sf_dir).structures().select("file_id", "line_count", "word_count", "char_count", "header_count", "code_block_count", "link_count")


@query("d20_top_languages", "SELECT language, count(*) AS n FROM files JOIN repos ON repo = full_name WHERE language <> '' GROUP BY language ORDER BY n DESC, min(id), language LIMIT 15")
def d20_top_languages(spark, sf_dir):
    return analyses.report(bind(spark, sf_dir))["top_languages"]


@query("d20_popular", "SELECT repo AS repo_full_name, max(coalesce(stars, 0)) AS stars FROM files JOIN repos ON repo = full_name GROUP BY repo ORDER BY stars DESC, min(id) LIMIT 15")
def d20_popular(spark, sf_dir):
    return analyses.report(bind(spark, sf_dir))["popular"]


@query("d20_structure_words", _describe_sql("w", f"(SELECT {_WORDS} AS w FROM files)", "short"))
def d20_structure_words(spark, sf_dir):
    return analyses.report(_analyzed(spark, sf_dir))["structure_word_count"]


@query("d20_fences", _LABELLED + " SELECT label, count(*) AS n FROM b GROUP BY label ORDER BY n DESC, min(id), label LIMIT 15")
def d20_fences(spark, sf_dir):
    return analyses.report(_analyzed(spark, sf_dir))["fences"]


@query("d20_notations_by_tool", oracles.NOTATIONS + " SELECT tool_id, notation, count(*) AS n FROM seen JOIN files USING (id) GROUP BY ALL")
def d20_notations_by_tool(spark, sf_dir):
    return analyses.report(_analyzed(spark, sf_dir))["notations_by_tool"]


#: Measures of a file that the populations add up.
_POPULATION = {
    "files": "1",
    "files_with_headings": "CAST(n > 0 AS INT)",
    "files_without_headings": "CAST(n = 0 AS INT)",
    "sections": "n",
    "files_with_skipped_jumps": "CAST(jumps > 0 AS INT)",
    "skipped_jumps": "jumps",
    "files_starting_below_h1": "CAST(below AS INT)",
    "files_without_h1": "CAST(h1 = 0 AS INT)",
    "headed_files_without_h1": "CAST(n > 0 AND h1 = 0 AS INT)",
    "files_with_multiple_h1": "CAST(h1 > 1 AS INT)",
    "files_with_empty_sections": "CAST(empties > 0 AS INT)",
    "empty_sections": "empties",
    "files_with_list_sections": "CAST(list_sections > 0 AS INT)",
    "files_with_prose_sections": "CAST(prose_sections > 0 AS INT)",
    "sections_with_list_items": "list_sections",
    "sections_with_prose": "prose_sections",
    "sections_with_other": "other_sections",
    "list_items": "list_items",
    "task_items": "task_items",
    "prose_blocks": "prose_blocks",
    "list_lines": "list_lines",
    "prose_lines": "prose_lines",
    "other_lines": "other_lines",
}


@query("d6_populations", oracles.SECTIONS + " SELECT population, " + ", ".join(f"CAST(sum(CASE WHEN one THEN 1 ELSE w END * ({x})) AS BIGINT) AS {n}" for n, x in _POPULATION.items()) + " FROM perfile, pop GROUP BY population")
def d6_populations(spark, sf_dir):
    return analyses.sections(bind(spark, sf_dir))["populations"].select("population", *_POPULATION)


@query("d6_distributions", oracles.SECTIONS + oracles.weighted("measured", "population, measure", [25, 50, 75, 90, 95, 99]))
def d6_distributions(spark, sf_dir):
    return analyses.sections(bind(spark, sf_dir))["distributions"].withColumn("mean", F.round("mean", 9))


@query("d9_populations")
def d9_populations(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["populations"]


@query("d9_language_table")
def d9_language_table(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["language_table"]


@query("d9_threshold_documents")
def d9_threshold_documents(spark, sf_dir):
    return analyses.paragraph_languages(bind(spark, sf_dir), models=_language_models(spark, sf_dir))["threshold_documents"]


# -- CSV of unknown dialects: the documents written in up to six, and read back ---------------------------


@query(
    "s5_csv_dialects",
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, sha256(coalesce(text, '')) AS text_sha256, CAST(n_chars AS VARCHAR) AS n_chars,
 CASE WHEN doc_id % 2 = 0 AND regexp_full_match(coalesce(text, ''), '[\x{00}-\x{7F}\x{A0}-\x{FF}]*') THEN 'windows-1252' ELSE 'UTF-8' END AS encoding,
 CASE doc_id % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS separator FROM documents""",
    False,
)
def s5_csv_dialects(spark, sf_dir):
    """Every document goes into a file of its dialect; line ends within texts stay. Ranges are short, so that texts cross their ends."""
    from ..sources.split_csv import read_csv

    docs = spread(_table(spark, sf_dir, "documents"))
    latin = (F.col("doc_id") % 2 == 0) & F.coalesce("text", F.lit("")).rlike(r"\A[\x00-\x7F\xA0-\xFF]*\z")
    dealt = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("größe"), "n_chars", latin.alias("_latin"), (F.col("doc_id") % 3).alias("_kind"))
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for one, encoding in ((True, "ISO-8859-1"), (False, "UTF-8")):
        for kind, sep in enumerate(",;\t"):
            # Numbers in another place in some files: columns are found by name.
            part = dealt.filter((F.col("_latin") == one) & (F.col("_kind") == kind)).select(*(["n_chars"] * (kind == 1)), "doc_id", "lang", "source", "größe", *(["n_chars"] * (kind != 1)))
            part.write.csv(f"{folder}/{encoding}-{kind}", header=True, sep=sep, encoding=encoding, escape='"', quoteAll=kind == 2, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_csv(spark, folder, ["doc_id", "größe"], 1 << 18, with_dialect=True)
    return rows.select("doc_id", "lang", "source", F.sha2("größe", 256).alias("text_sha256"), "n_chars", F.col("_encoding").alias("encoding"), F.col("_separator").alias("separator"))


# -- stored results as Variants: an order's lines as the detections of a file, stored as JSON, three records at most -----

_DETECTED = """WITH d AS (SELECT l_orderkey AS id, l_linenumber AS i, CASE l_suppkey % 7 WHEN 0 THEN 'mermaid' WHEN 1 THEN 'plantuml' WHEN 2 THEN 'graphviz' WHEN 3 THEN 'd2' WHEN 4 THEN 'ascii_diagram' WHEN 5 THEN 'bnf_ebnf' ELSE 'json_schema' END AS notation,
 CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'flow' WHEN 2 THEN 'state' ELSE 'class' END AS subtype, CASE l_linestatus WHEN 'O' THEN 'fence_label' ELSE 'pattern' END AS via
 FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_suppkey IS NOT NULL)"""


def _stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, analyzer_id, result_json of the detections of _DETECTED.

    An order's lines lie in several tasks, where lists of them save nothing: they are dealt by order once, as they are, and all that a result says is made of one list.
    """
    d = spark.sql(_DETECTED.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM d", lineitem=_table(spark, sf_dir, "lineitem"))
    line = F.struct("i", F.col("notation").alias("notation_id"), "subtype", "confidence", F.col("via").alias("detected_via"))
    lines = d.repartition("id").groupBy("id").agg(F.array_sort(F.collect_list(line)).alias("d"))
    own = F.transform(F.array_distinct("d.notation_id"), lambda n: F.struct(n.alias("notation"), F.filter("d", lambda x: x["notation_id"] == n).alias("d")))
    said = lambda e: F.struct(F.size(e["d"]).alias("count"), F.array_distinct(e["d"]["confidence"]).alias("confidences"), F.array_compact(F.array_distinct(e["d"]["subtype"])).alias("subtypes"))
    summary = F.map_from_entries(F.transform(own, lambda e: F.struct(e["notation"], said(e))))
    result = F.to_json(F.struct(F.lit(True).alias("any_notation_detected"), F.size("d").alias("notation_count_total"), summary.alias("notations_summary"), F.filter("d", lambda x: x["i"] <= 3).alias("detections")))
    # A struct's JSON is never null. Spark doesn't know that, and would make it once more for a filter of nulls.
    return lines.select(F.col("id").alias("file_id"), F.lit("notation").alias("analyzer_id"), F.coalesce(result, F.lit("{}")).alias("result_json"))


@query("a29_totals", _DETECTED + """, f AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE i <= 3) AS kept, bool_or(notation IN ('mermaid', 'plantuml', 'graphviz', 'd2') AND confidence = 'high') AS sure FROM d GROUP BY id)
 SELECT count(*) AS files, count(*) AS files_with_any, count(*) FILTER (WHERE sure) AS files_with_sure_diagram, count(*) FILTER (WHERE n > kept) AS capped_files, CAST(coalesce(sum(n - kept), 0) AS BIGINT) AS omitted FROM f""", False)
def a29_totals(spark, sf_dir):
    return stored.notation_rollup(_stored_lines(spark, sf_dir))["totals"]


@query("a29_notations", _DETECTED + " SELECT notation, count(*) AS occurrences, count(DISTINCT id) AS files, count(*) FILTER (WHERE i <= 3) AS kept, count(*) FILTER (WHERE i > 3) AS omitted FROM d GROUP BY notation", False)
def a29_notations(spark, sf_dir):
    return stored.notation_rollup(_stored_lines(spark, sf_dir))["notations"]


@query("a29_details", _DETECTED + " SELECT notation, what, value, count(DISTINCT id) AS files FROM (SELECT id, notation, 'confidence' AS what, confidence AS value FROM d UNION ALL SELECT id, notation, 'subtype', subtype FROM d WHERE subtype IS NOT NULL) GROUP BY ALL", False)
def a29_details(spark, sf_dir):
    return stored.notation_rollup(_stored_lines(spark, sf_dir))["details"]


@query("a29_kept", _DETECTED + " SELECT what, value, count(*) AS records FROM (SELECT 'confidence' AS what, confidence AS value FROM d WHERE i <= 3 UNION ALL SELECT 'via', via FROM d WHERE i <= 3) GROUP BY ALL", False)
def a29_kept(spark, sf_dir):
    return stored.notation_rollup(_stored_lines(spark, sf_dir))["kept"]


_PANELS = {"bytes": "size_bytes", "lines": _LINES, "words": _WORDS, "tokens": "CAST(ceil(length(content) / 3.5::DOUBLE) AS BIGINT)"}


@query(
    "d3_panels",
    ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS panel, CAST({x} AS BIGINT) AS value FROM exact" for n, x in _PANELS.items()) + ") SELECT panel, value, n AS files, 100.0::DOUBLE * sum(n) OVER (PARTITION BY panel ORDER BY value) / sum(n) OVER (PARTITION BY panel) AS percent FROM (SELECT panel, value, count(*) AS n FROM x GROUP BY ALL)",
)
def d3_panels(spark, sf_dir):
    corpus = _analyzed(spark, sf_dir)
    return stored.size_panels(stored.observations(corpus.population("exact"), corpus.analysis))


# -- hierarchy: parents and children compared, delegation by hierarchy; sections by list items --------------


_SIZED = oracles.HIERARCHY.split(",\n per AS")[0]


@query(
    "a19_edge_comparisons",
    oracles.FILE_HEADINGS + _SIZED + rf""", nh AS (SELECT id, count(*) AS sections FROM named_headings GROUP BY id),
 sized AS (SELECT s.id, size_bytes, CAST({_LINES} AS BIGINT) AS lines, CAST({_WORDS} AS BIGINT) AS words, CAST(coalesce(sections, 0) AS BIGINT) AS sections FROM several s LEFT JOIN nh USING (id)),
 sides AS (SELECT unnest([{{'k': 'size_bytes', 'c': c.size_bytes, 'p': p.size_bytes}}, {{'k': 'lines', 'c': c.lines, 'p': p.lines}}, {{'k': 'words', 'c': c.words, 'p': p.words}}, {{'k': 'sections', 'c': c.sections, 'p': p.sections}}]) AS m FROM edge e JOIN sized c ON c.id = e.child JOIN sized p ON p.id = e.parent)
 SELECT m.k AS measure, count(*) AS edges, """ + ", ".join(f"count(*) FILTER (WHERE m.c {op} m.p) AS child_{n}, count(*) FILTER (WHERE m.c {op} m.p)::DOUBLE / count(*) AS child_{n}_share" for n, op in (("lower", "<"), ("equal", "="), ("higher", ">"))) + " FROM sides GROUP BY m.k",
)
def a19_edge_comparisons(spark, sf_dir):
    return analyses.allocation(bind(spark, sf_dir))["comparisons"]


#: Repositories of some twenty files, so that some have no hierarchy and some no references.
_SMALL = 20


@query(
    "d12_candidates",
    CORPUS_SQL.replace("doc_id // 800", f"doc_id // {_SMALL}") + oracles.REFERENCES + _SIZED + """, r AS (SELECT s.repo, bool_or(s.id IN (SELECT child FROM edge)) AS nested, bool_or(high > 0) AS sure FROM several s JOIN rf ON rf.id = s.id GROUP BY s.repo),
 n AS (SELECT count(*) FILTER (WHERE nested AND sure) AS a, count(*) FILTER (WHERE nested AND NOT sure) AS b, count(*) FILTER (WHERE NOT nested AND sure) AS c, count(*) FILTER (WHERE NOT nested AND NOT sure) AS d FROM r),
 o AS (SELECT *, CASE WHEN b * c > 0 THEN a::DOUBLE * d / (b * c) END AS ratio, CASE WHEN least(a, b, c, d) > 0 THEN 1.96 * sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b + 1.0::DOUBLE / c + 1.0::DOUBLE / d) END AS e FROM n)
 SELECT a AS hierarchy_with, b AS hierarchy_without, c AS flat_with, d AS flat_without, round(coalesce(a::DOUBLE / nullif(a + b, 0), 0), 9) AS hierarchy_share, round(coalesce(c::DOUBLE / nullif(c + d, 0), 0), 9) AS flat_share,
  round(ratio, 9) AS odds_ratio, round(exp(ln(nullif(ratio, 0)) - e), 9) AS lower_95, round(exp(ln(nullif(ratio, 0)) + e), 9) AS upper_95 FROM o""",
    False,
)
def d12_candidates(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    own = F.concat(F.lit("/r"), F.floor(F.col("id") % _COPY_IDS / _SMALL).cast("string"))
    files = corpus.files.withColumn("repo_full_name", F.concat(F.regexp_extract("repo_full_name", "^(.*)/r[0-9]+$", 1), own))
    found = analyses.hierarchy_candidates(Corpus(corpus.repos, files))
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes])


@query(
    "u3_list_items",
    oracles.SECTIONS + """, n AS (SELECT list_items AS list_item_count, CAST(sum(w) AS BIGINT) AS f, count(*) AS u FROM sect GROUP BY 1)
 SELECT list_item_count, """ + ", ".join(f"{c} AS sections_{n}, round({c}::DOUBLE / sum({c}) OVER (), 9) AS share_all_sections_{n}, round(CASE WHEN list_item_count > 0 THEN {c}::DOUBLE / sum({c}) FILTER (WHERE list_item_count > 0) OVER () ELSE 0 END, 9) AS share_list_bearing_sections_{n}" for c, n in (("f", "full"), ("u", "unique"))) + " FROM n",
)
def u3_list_items(spark, sf_dir):
    found = analyses.list_item_distribution(analyses.sections(bind(spark, sf_dir))["list_item_histogram"])
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes])


@query(
    "m10_families",
    oracles.SECTIONS + """, ids AS (SELECT content_hash AS identity, fam.id, w FROM fam)
 SELECT identity, any_value(ids.w) AS copies, CAST(count(sect.id) AS INT) AS sections, quantile_disc(word_count, 0.5) AS median, round(avg(word_count), 9) AS mean, max(word_count) AS maximum FROM ids LEFT JOIN sect ON sect.id = ids.id GROUP BY identity""",
)
def m10_families(spark, sf_dir):
    found = analyses.sections(bind(spark, sf_dir))["families"]
    return found.select("identity", "copies", "sections", F.col("median").cast("long").alias("median"), F.round("mean", 9).alias("mean"), F.col("maximum").cast("long").alias("maximum"))


# -- references and imports of every kind, in files whose lines are written by the rule NOTES ----------------


@query("d13_syntaxes", corpus_sql(NOTES) + oracles.SAID + " SELECT scope, syntax, relation, CAST(scope = 'local' AND lower(resolved) = lower(path) AS INT) AS is_self, count(*) AS occurrences, count(DISTINCT id) AS files FROM referred GROUP BY ALL", False)
def d13_syntaxes(spark, sf_dir):
    found = analyses.reference_analysis(bind(spark, sf_dir, NOTES))["occurrences"]
    return found.groupBy("scope", "syntax", "relation", "is_self").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"))


@query("d14_contexts", corpus_sql(NOTES) + oracles.SAID + " SELECT CASE WHEN context = 'plain_text' THEN 'import_candidate' ELSE 'excluded_' || context END AS decision, context, surface, kind, relation, count(*) AS occurrences, count(DISTINCT id) AS files FROM imported GROUP BY ALL", False)
def d14_contexts(spark, sf_dir):
    found = analyses.import_analysis(bind(spark, sf_dir, NOTES))["tokens"]
    return found.groupBy("decision", "context", "surface", "kind", "relation").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"))


@query(
    "j13_edges",
    corpus_sql(NOTES) + oracles.SAID + _SIZED + """, reach AS (SELECT DISTINCT id, lower(resolved) AS resolved FROM referred WHERE scope = 'local'),
 e AS (SELECT c.repo, CAST((p.id, lower(c.path)) IN (SELECT (id, resolved) FROM reach) AS INT) AS parent_refers_to_child, CAST((c.id, lower(p.path)) IN (SELECT (id, resolved) FROM reach) AS INT) AS child_refers_to_parent FROM edge JOIN several c ON c.id = edge.child JOIN several p ON p.id = edge.parent)
 SELECT repo AS repo_full_name, parent_refers_to_child, child_refers_to_parent, count(*) AS edges FROM e GROUP BY ALL""",
    False,
)
def j13_edges(spark, sf_dir):
    edges = analyses.allocation(bind(spark, sf_dir, NOTES))["edges"]
    return edges.groupBy("repo_full_name", "parent_refers_to_child", "child_refers_to_parent").agg(F.count("*").alias("edges"))


@query("d13_forms", corpus_sql(NOTES) + oracles.SAID + """, n AS (SELECT id, count(*) FILTER (WHERE scope = 'local' AND lower(resolved) <> lower(path)) AS away, count(*) FILTER (WHERE scope = 'local') AS local, count(*) FILTER (WHERE scope = 'external') AS far FROM referred GROUP BY id)
 SELECT least(coalesce(local, 0), 9) AS local, least(coalesce(away, 0), 9) AS local_nonself, least(coalesce(far, 0), 3) AS external, count(*) AS files FROM exact LEFT JOIN n USING (id) GROUP BY ALL""", False)
def d13_forms(spark, sf_dir):
    """Files by their numbers of local references, of those to other files, and of external ones; the largest numbers in one class."""
    found = analyses.reference_analysis(bind(spark, sf_dir, NOTES))["files"]
    return found.groupBy(*[F.least(c, F.lit(n)).cast("long").alias(c) for c, n in (("local", 9), ("local_nonself", 9), ("external", 3))]).agg(F.count("*").alias("files"))
