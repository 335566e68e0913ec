"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .storage import small, written


def repeated(df: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Rows whose key occurs at least so often: a semi-join with partly aggregated counts, not a window, so a hot key has no single task."""
    known = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return df.join(known.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys), list(keys), "left_semi")


def representative(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first by order, chosen by a partly aggregated minimum."""
    ranks = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*ranks))
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("_row"), F.count("*").alias("copies")).select("_row.*", "copies")


def folded_order() -> list[Column]:
    """The order of repository and path without, then with letter case, then the id."""
    return [F.lower("repo_full_name"), F.lower("path"), F.col("repo_full_name"), F.col("path"), F.col("id")]


def nearest_ancestors(files: DataFrame, repo: str, scope: Column, keep: list[str]) -> DataFrame:
    """Edges from each file to all files at the nearest strictly enclosing directory that has any.

    The strict beginnings of each distinct directory are joined with the
    directories that hold files; the longest one wins. Then its files join.
    """
    at = files.withColumn("_dir", scope)
    dirs = at.select(repo, "_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.when(F.col("_dir") == "", F.array().cast("array<struct<n:int,dir:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("dir"))))
    steps = dirs.select(repo, "_dir", F.explode(above).alias("a")).select(repo, "_dir", F.col("a.n").alias("_n"), F.col("a.dir").alias("_up"))
    held = dirs.select(F.col(repo), F.col("_dir").alias("_up"))
    nearest = steps.join(held, [repo, "_up"]).groupBy(repo, "_dir").agg(F.max_by("_up", "_n").alias("_up"), F.max("_n").alias("parent_depth"))
    child = at.select(F.col(repo), F.col("_dir"), *[F.col(c).alias(f"child_{c}") for c in keep])
    parent = at.select(F.col(repo), F.col("_dir").alias("_up"), *[F.col(c).alias(f"parent_{c}") for c in keep])
    return child.join(nearest, [repo, "_dir"]).join(parent, [repo, "_up"]).select(repo, *[f"child_{c}" for c in keep], *[f"parent_{c}" for c in keep], F.when(F.col("_dir") == "", 0).otherwise(F.size(F.split("_dir", "/"))).alias("child_depth"), "parent_depth")


def chain_lengths(files: DataFrame, repo: str, scope: Column) -> DataFrame:
    """repo, dir, chain: 1 plus the number of enclosing directories that hold files."""
    dirs = files.select(repo, scope.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    steps = dirs.select(repo, "dir", F.explode_outer(above).alias("up"))
    held = dirs.select(F.col(repo), F.col("dir").alias("up"), F.lit(1).alias("_one"))
    return steps.join(held, [repo, "up"], "left").groupBy(repo, "dir").agg((F.lit(1) + F.coalesce(F.sum("_one"), F.lit(0))).cast("long").alias("chain"))


def scope_pairs(files: DataFrame, repo: str, path: str, folder: str = ".claude") -> DataFrame:
    """Pairs of a direct and a hidden file that speak for the same directory."""
    at = files.select(repo, F.col(path).alias("_p"), "content_hash", paths.logical_scope(F.col(path), folder).alias("scope"), paths.placement_form(F.col(path), folder).alias("form"))
    direct = at.filter("form = 'direct'").select(repo, "scope", F.col("_p").alias("direct_path"), F.col("content_hash").alias("direct_hash"))
    other = at.filter("form = 'hidden'").select(repo, "scope", F.col("_p").alias("hidden_path"), F.col("content_hash").alias("hidden_hash"))
    return direct.join(other, [repo, "scope"]).withColumn("same_content", F.coalesce((F.col("direct_hash") == F.col("hidden_hash")).cast("int"), F.lit(0)))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with the place of each row (int, from 1) in a total order.

    A window without partitions would sort everything in one task. Here rows are
    dealt to ranges of the order, sorted there and written once; each range then
    starts after the rows of those before it, of which only counts are added up.
    """
    spark = df.sparkSession
    key = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = key.repartitionByRange(n, "_key").sortWithinPartitions("_key").withColumn("_m", F.monotonically_increasing_id()).drop("_key")
    placed = written(dealt, "ranked").withColumn("_p", F.shiftright("_m", 33))
    counts = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # one row a range
    before, starts = 0, []
    for p, c in counts:
        starts.append((p, before))
        before += c
    offsets = F.broadcast(spark.createDataFrame(starts, "_p long, _before long"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_p").withColumn(name, (F.col("_before") + within + 1).cast("int" if before < 2**31 else "long")).select(*df.columns, name)


def ranked_within(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with the place of each row (int, from 1) in a total order among the rows of its keys (nulls are a key), however many those are.

    As in ranked(), rows are dealt to ranges of keys and order. A range holds a stretch of each of its keys, which
    begins after the rows that the key has in the ranges before: a sum of one row a key and range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [c.alias(f"k{i}") for i, c in enumerate(order)]
    dealt = df.withColumn("_key", F.struct(*keys)).withColumn("_order", F.struct(*place)).repartitionByRange(n, "_key", "_order").sortWithinPartitions("_key", "_order")
    placed = written(dealt.withColumn("_m", F.monotonically_increasing_id()).drop("_order"), "ranked-within").withColumn("_p", F.shiftright("_m", 33))
    own = placed.groupBy("_p", "_key").agg(F.min("_m").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.select("_p", "_key", (before - F.col("_low") + 1).alias("_shift"))
    return placed.join(small(starts), ["_p", "_key"]).withColumn(name, (F.col("_m") + F.col("_shift")).cast("int")).select(*df.columns, name)


def line_postings(lines: DataFrame) -> DataFrame:
    """repo, file, line (a number from 1, rare lines first): rows repo, file, line (text), each once, with numbers for the texts.

    A line's text is exchanged to be counted and to meet its number; what comes after moves numbers only.
    """
    counted = written(lines.groupBy("line").agg(F.count("*").alias("n")), "lines")
    numbers = ranked(counted, [F.col("n"), F.col("line")], "number").select("line", "number")
    return written(lines.join(numbers, "line").select("repo", "file", F.col("number").alias("line")), "line-postings")


def shared_lines(pairs: DataFrame, postings: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and shared for the pairs (columns a and b, files) that have lines in common, counted from postings.

    Rows are numbers, and the second join is on file and line: a file with many partners is spread by its lines.
    """
    own = pairs.select(a, b).distinct().join(postings.select(F.col("file").alias(a), "line"), a)
    both = own.join(postings.select(F.col("file").alias(b), "line"), [b, "line"], "left_semi")
    return both.groupBy(a, b).agg(F.count("*").alias("shared"))


def line_overlaps(lines: DataFrame, minimum_shared: int = 5, jaccard: float = 0.80, containment: float = 0.90) -> DataFrame:
    """Pairs of files of a repository with much the same lines.

    lines: repo, file, hash, line with each line once a file; files of equal hash
    are skipped. A pair is normalized_equivalent if both line sets are equal, else
    high_jaccard, else high_containment; the last two need minimum_shared shared
    lines. Whatever the kind, the smaller set of n lines has at least a share t of
    them in common with the other, so one of its n - ceil(t n) + 1 rarest lines is
    common: only those look for partners, which keeps lines that a whole
    repository shares out of the join. Where such a line stands in both sets, sorted by rarity, bounds what they can share, and pairs
    below that are no candidates. Sets of fewer than minimum_shared lines can only be equal,
    and are joined whole. Candidates are counted from postings.
    """
    t = min(jaccard, containment)
    postings = line_postings(lines.select("repo", "file", "line"))
    sizes = lines.groupBy("repo", "file", "hash").agg(F.count("*").alias("n"))
    # A set's numbers, rarest first, each with its place.
    sets = postings.groupBy("repo", "file").agg(F.sort_array(F.collect_list("line")).alias("own")).withColumn("n", F.size("own").cast("long"))
    sets = written(sets, "line-sets")
    many = sets.filter(F.col("n") >= minimum_shared)
    at = lambda name, own: many.select("repo", F.col("file").alias(name), F.col("n").alias(f"n{name}"), F.posexplode(own).alias(f"p{name}", "line"))
    rare = at("x", F.slice("own", 1, (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int")))
    held = at("y", F.col("own"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    most = F.least("px", "py") + 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    pairs = rare.join(held, ["repo", "line"]).filter(smaller & (most >= F.ceil(F.col("nx") * t - 1e-9))).select("repo", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    few = sets.filter(F.col("n") < minimum_shared).select("repo", "file", "own")
    equal = few.withColumnRenamed("file", "a").join(few.withColumnRenamed("file", "b"), ["repo", "own"]).filter("a < b").select("repo", "a", "b")
    side = lambda k: sizes.select("repo", F.col("file").alias(k), F.col("hash").alias(f"h{k}"), F.col("n").alias(f"n{k}"))
    pairs = written(pairs.unionByName(equal).join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b"]).filter("ha <> hb").drop("ha", "hb"), "line-pairs")
    scored = pairs.join(shared_lines(pairs, postings, "a", "b"), ["a", "b"])
    scored = scored.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).withColumn("containment", F.col("shared") / F.least("na", "nb"))
    enough = F.col("shared") >= minimum_shared
    kind = F.when((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb")), "normalized_equivalent").when(enough & (F.col("jaccard") >= jaccard), "high_jaccard").when(enough & (F.col("containment") >= containment), "high_containment")
    return scored.withColumn("relation", kind).filter(F.col("relation").isNotNull()).select("repo", "a", "b", "na", "nb", "shared", "jaccard", "containment", "relation")


def _turns(df: DataFrame, keys: list[str], order: list, side: str, hot_rows: int) -> DataFrame:
    """keys, _n (the place among the rows of the key) and the row as a struct."""
    row = F.struct(*df.columns).alias(side)
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= hot_rows:
        return df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias("_n"), row)
    # A hot key's rows are ranked with all others, in ranges, and count from its first rank.
    placed = ranked(df, [F.struct(*keys), *[o if isinstance(o, Column) else F.col(o) for o in order]], "_r")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_r").alias("_first"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return placed.join(first, same).select(*keys, (F.col("_r") - F.col("_first") + 1).cast("long").alias("_n"), row)


def fifo_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list, hot_rows: int = 1_000_000) -> DataFrame:
    """Left and right rows of a key paired in order, each used once; unpaired rows have nulls on the other side (left_row, right_row).

    Orders are names or expressions, ascending. Keys of more than hot_rows rows are ranked without a window over the key.
    """
    l, r = _turns(left, keys, left_order, "left_row", hot_rows), _turns(right, keys, right_order, "right_row", hot_rows)  # noqa: E741
    return l.join(r, [*keys, "_n"], "full_outer").drop("_n")


def distinct_cube(df: DataFrame, key: str, dimensions: list[str], sums: dict[str, Column]) -> DataFrame:
    """dimensions, bucket, the sums and keys: for each combination of values and each bucket of 32,768 keys, which keys occur, as a bitmap of 4 kB.

    Keys get dense numbers first. Bitmaps of any rows of the cube can be united, so that one cube, stored, gives the distinct
    keys of every roll-up and every condition on the dimensions, and no row is read or repeated again. It takes an eighth
    of a byte for each key and combination, so dimensions should be such that combinations are few (bands, flags, kinds).
    """
    names = {d: f"_d{i}" for i, d in enumerate(dimensions)}
    values = df.select(F.col(key).alias("_of"), *[F.col(d).alias(n) for d, n in names.items()], *[c.alias(f"_s_{n}") for n, c in sums.items()])
    # What a frequent key has is added up before it meets its number.
    per = values.groupBy("_of", *names.values()).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    dense = ranked(values.select("_of").filter("_of IS NOT NULL").distinct(), [F.col("_of")], "_place")
    bit = (F.col("_place") - 1).cast("long")
    # Rows without a key have no bit, and a bucket (null) of their own.
    numbered = per.join(small(dense), "_of", "left")
    # Rows of numbers are dealt to their cells first: a task that begins bitmaps of all cells would hold, sort and send 4 kB for almost every row.
    dealt = numbered.withColumn("bucket", F.bitmap_bucket_number(bit)).repartition(*names.values(), "bucket")
    cells = dealt.groupBy(*names.values(), "bucket").agg(*[F.sum(f"_s_{n}").alias(n) for n in sums], F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("keys"))
    return cells.select(*[F.col(n).alias(d) for d, n in names.items()], "bucket", *sums, "keys")


def rolled_up(cube: DataFrame, by: list[str], sums: list[str], distinct: str) -> DataFrame:
    """by, the sums, and the number of distinct keys of each group of a cube."""
    buckets = cube.groupBy(*by, "bucket").agg(*[F.sum(n).alias(n) for n in sums], F.bitmap_or_agg("keys").alias("keys"))
    return buckets.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums], F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("keys"))), F.lit(0)).alias(distinct))


def strata(df: DataFrame, dimensions: list[str], sums: dict[str, Column], key: str | None = None, distinct: str = "distinct") -> DataFrame:
    """dimension, value, the sums and the number of distinct keys (if key is set): one group per value of each dimension.

    Rows are added up by their combination of values once, and stored; the dimensions are roll-ups of that.
    """
    if key is None:
        cube = df.groupBy(*dimensions).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        roll = lambda by: cube.groupBy(by).agg(*[F.sum(n).alias(n) for n in sums])
    else:
        cube = distinct_cube(df, key, dimensions, sums)
        roll = lambda by: rolled_up(cube, [by], list(sums), distinct)
    cube = written(cube, "cube")
    parts = [roll(d).select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), *sums, *([distinct] if key else [])) for d in dimensions]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cohorts(df: DataFrame, predicates: list[str], keys: dict[str, str]) -> DataFrame:
    """cohort, files and, under each name of keys, the distinct values of that column among the rows for which a predicate (a boolean column) holds.

    Each key's rows are first reduced to whether any of them fulfils each predicate: partial maxima, so nothing is expanded or repeated.
    """
    wide = df.agg(*[F.count_if(F.col(p)).alias(p) for p in predicates])
    out = [("files", wide)]
    for name, key in keys.items():
        any_of = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.coalesce(F.col(p), F.lit(False))).alias(p) for p in predicates])
        out.append((name, any_of.agg(*[F.count_if(F.col(p)).alias(p) for p in predicates])))
    long = [w.select(F.explode(F.array(*[F.struct(F.lit(p).alias("cohort"), F.col(p).alias("n")) for p in predicates])).alias("c"), F.lit(name).alias("of")) for name, w in out]
    both = reduce(lambda a, b: a.unionByName(b), long)
    return both.groupBy(F.col("c.cohort").alias("cohort")).agg(*[F.max(F.when(F.col("of") == name, F.col("c.n"))).alias(name) for name, _ in out])


def first_matching(left: DataFrame, right: DataFrame, key: str, alias: str, right_key: str, value: str) -> DataFrame:
    """left with value from right by lower-cased key, or by alias where that finds nothing."""
    known = right.select(F.lower(right_key).alias("_k"), F.col(value).alias("_v"))
    a, b = known.select(F.col("_k").alias("_ka"), F.col("_v").alias("_va")), known.select(F.col("_k").alias("_kb"), F.col("_v").alias("_vb"))
    joined = left.join(a, F.lower(key) == F.col("_ka"), "left").join(b, F.lower(alias) == F.col("_kb"), "left")
    return joined.withColumn(value, F.coalesce("_va", "_vb")).drop("_ka", "_va", "_kb", "_vb")


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The full outer join on key; a key that one side lacks, or that occurs twice, raises when the result is read."""
    a = left.groupBy(key).agg(F.count("*").alias("_a"), F.first(F.struct(*left.columns)).alias("l"))
    b = right.groupBy(key).agg(F.count("*").alias("_b"), F.first(F.struct(*right.columns)).alias("r"))
    joined = a.join(b, key, "full_outer")
    fine = (F.coalesce("_a", F.lit(0)) == 1) & (F.coalesce("_b", F.lit(0)) == 1)
    return joined.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not matched once: "), F.col(key).cast("string"))))).drop("_a", "_b")
