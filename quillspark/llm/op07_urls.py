"""URL rules behind a blocked Bloom filter, in DataFrame operations only.

Listed are canonical keys: a host and the beginning of a path. A URL's possible
keys are the suffixes of its host at label borders, each with the beginnings of
its path that are as long as some listed path. The filter, one 256-bit block of
eight words for each few listed keys, lets through the listed ones and a few others;
an exact hash join with the list removes those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, with_free_names

#: The contract's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
KEYS_PER_BLOCK = 16
#: Blocks of the filter (some 150 bytes each) and bytes of listed keys or found verdicts up to which they are broadcast.
BROADCAST_BLOCKS, BROADCAST_BYTES = 400_000, 32 << 20
#: Pages without a host are dealt over so many keys of the last join.
_SALTS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the keys in column key."""
    rows = listed.select(_block("key", blocks), *[b.alias(f"w{k}") for k, b in enumerate(_bit_columns("key"))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)])


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _bit_columns(key: str) -> list[Column]:
    """One bit of each of the block's eight 32-bit words, from a second hash of the key."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {5 * k}) & 31 as int))") for k in range(8)]


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """host, path, rule, verdict for each distinct host and path of urls that a rule fits.

    rules: verdict, host, path. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest rule wins (of equal ones a block).
    rule is the winner's host and path. Null URLs and URLs without ://
    have an empty host and path. No rules, or no URLs, are fine. A URL of any length makes a key for each
    suffix of its host and each length of a listed path up to its own, so lists should have few lengths.
    Beyond BROADCAST_BLOCKS the filter would have to be joined by an exchange, which the exact join needs
    anyway; the keys then go to that directly.
    """
    listed = rules.select(
        F.concat_ws("\n", F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"),
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"),
        "verdict",
        F.length(F.coalesce("path", F.lit(""))).alias("n"),
    )
    listed = listed.groupBy("key", "rule", "n").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
    size, weight, lengths = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("rule") + 32), F.lit(0)), F.sort_array(F.collect_set("n"))).first()
    pairs = urls.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).distinct()
    blocks = max(1, -(-size // KEYS_PER_BLOCK))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat_ws("\n", s, F.substring(F.col("path"), F.lit(1), n)))))
    passed = pairs.select("host", "path", F.explode(F.array_distinct(keys)).alias("key"))
    if blocks <= BROADCAST_BLOCKS:
        passed = passed.select("host", "path", "key", _block("key", blocks)).join(F.broadcast(blocked_bloom(listed, blocks)), "block")
        for k, bit in enumerate(_bit_columns("key")):
            passed = passed.filter(F.col(f"w{k}").bitwiseAND(bit) != 0)
    hits = passed.select("host", "path", "key").join(F.broadcast(listed) if weight <= BROADCAST_BYTES else listed, "key")
    won = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "blocks", "rule")).alias("won"))
    return won.select("host", "path", F.col("won.rule").alias("rule"), F.when(F.col("won.blocks") == 1, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (see judge); columns of these names give way to them.

    Where no rule fits, rule is null and the verdict is ``default``. Rows stay as they are, repeated ones too.
    Pages without a host, often many, have a key of the join of their own, so that they don't meet in one task.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    names = with_free_names(pages, "host_key", "path_key")
    found = stored(judge(pages, rules, url_col), "url-verdicts")
    bare = found.filter("host = '' AND path = ''").first()  # one row at most
    weight = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    none = (host == "") & (path == "")
    salt = F.concat(F.lit("\n"), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("string"))
    placed = pages.select(*kept, host.alias("host"), path.alias("path"), host.alias(names["host_key"]), F.when(none, salt).otherwise(path).alias(names["path_key"]))
    keyed = found.select(F.col("host").alias(names["host_key"]), F.col("path").alias(names["path_key"]), "rule", "verdict")
    joined = placed.join(F.broadcast(keyed) if weight <= BROADCAST_BYTES else keyed, list(names.values()), "left").drop(*names.values())
    if bare:
        none = (F.col("host") == "") & (F.col("path") == "")
        joined = joined.withColumn("rule", F.when(none, F.lit(bare["rule"])).otherwise(F.col("rule"))).withColumn("verdict", F.when(none, F.lit(bare["verdict"])).otherwise(F.col("verdict")))
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS n
  FROM pages),
f AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""
