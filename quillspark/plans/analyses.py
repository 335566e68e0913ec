"""The composite analyses: each takes a corpus and returns its tables as DataFrames."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands, paths, sampling, stats, text
from ..operators import analyzers, forms, imports, language, markdown, notations, overlays, prose, references, relational
from ..operators.selection import described
from ..operators.storage import small, written
from . import populations as summaries
from . import stored
from .corpus import TARGET, Corpus, parsed, parsed_once
from .tables import Tables, descriptions

WINDOWS = {"200k": 200_000, "500k": 500_000, "1M": 1_000_000}
GUIDELINE = 200
READING_RATES = (175, 238, 300)


# -- scale, sizes, time ----------------------------------------------------------------------------


def populations(corpus: Corpus, target: str = TARGET) -> DataFrame:
    """One row of counts: files and repositories of each case rule. Repositories are aggregated first, so no distinct count expands rows."""
    exact, strict = paths.named(F.col("path"), target), paths.named_exactly(F.col("path"), target)
    kinds = {"exact": exact, "strict": strict, "other": ~exact}
    per = corpus.files.groupBy("repo_full_name").agg(F.count("*").alias("files"), *[F.count_if(p).alias(name) for name, p in kinds.items()])
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    cols = [total("files").alias("files"), F.count("repo_full_name").alias("repositories")]
    for name in kinds:
        cols += [total(name).alias(f"{name}_files"), F.count_if((F.col(name) > 0) & F.col("repo_full_name").isNotNull()).alias(f"{name}_repositories")]
    return per.agg(*cols)


def dataset(corpus: Corpus, per_token: float = 3.5, top: int = 15) -> dict[str, DataFrame]:
    """Scale, languages, stars and sizes of the corpus."""
    language = F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("(unknown)"))
    counted = corpus.repos.groupBy(language.alias("language")).agg(F.count("*").alias("repositories"))
    languages = counted.withColumn("percent", F.lit(100.0) * F.col("repositories") / F.sum("repositories").over(Window.partitionBy()))
    languages = languages.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("repositories"), F.lower("language"), "language")))
    stars = corpus.repos.select("full_name", F.coalesce("stars", F.lit(0)).alias("stars"))
    best = stars.orderBy(F.desc("stars"), F.lower("full_name"), "full_name").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("stars"), F.lower("full_name"), "full_name")))
    sizes = corpus.population("exact").select("size_bytes", F.length("content").alias("chars"), text.tokens(F.length("content"), per_token).alias("tokens"))
    out = {"populations": populations(corpus), "languages": languages, "top": best, "stars": lambda: described(stars, "stars")}
    return Tables(out | descriptions(sizes, ["size_bytes", "chars", "tokens"]))


def context_windows(corpus: Corpus, per_token: float = 3.5, uplift: float = 0.30, guideline: int = GUIDELINE) -> dict[str, DataFrame]:
    """How much of a model's context window files take, and how many lines they have."""
    files = corpus.population("exact").select("id", F.length("content").alias("chars"), F.size(text.lines(F.col("content"))).alias("lines"))
    files = files.withColumn("tokens", text.tokens(F.col("chars"), per_token)).withColumn("tokens_uplift", text.tokens(F.col("chars"), per_token, 1 + uplift))
    largest = files.agg(F.max("tokens").alias("baseline"), F.max("tokens_uplift").alias("uplift"))
    rows = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(n).alias("size")) for k, n in WINDOWS.items()])
    windows = largest.select("baseline", "uplift", F.explode(rows).alias("w")).select(F.col("w.window").alias("window"), *[text.half_even(F.lit(100.0) * F.col(c) / F.col("w.size")).alias(f"{c}_percent") for c in ("baseline", "uplift")])
    n = F.col("lines")
    line = files.agg(F.count_if(n < guideline).alias("below"), F.count_if(n == guideline).alias("at"), F.count_if(n > guideline).alias("above"), F.count_if(n > 500).alias("above_500"), F.count_if(n > 1000).alias("above_1000"), text.half_even(F.avg((n >= guideline).cast("double"))).alias("share_at_or_above"))
    return Tables({"windows": windows, "lines": line} | descriptions(files, ["chars", "tokens", "tokens_uplift", "lines"], "plain"))


def size_series(corpus: Corpus, rates: tuple[int, ...] = READING_RATES) -> dict[str, DataFrame]:
    """ECDF of sizes, reading-time survival, size histograms."""
    files = corpus.population("exact").select("size_bytes", text.word_count(F.col("content")).alias("words"), F.length("content").alias("chars"))
    out = {"ecdf_bytes": stats.ecdf(files, "size_bytes"), "profile_words": lambda: described(files, "words", "profile")}
    return Tables(out) | {f"survival_{r}": stats.survival(files, "words", r) for r in rates}


def size_histogram(corpus: Corpus, high: float, bins: int, tool: str | None = None, scope: str = "markdown") -> DataFrame:
    """Equal bins of valid sizes up to high."""
    return stats.histogram(corpus.population(scope, tool=tool).filter("size_bytes >= 0"), "size_bytes", 0, high, bins)


def coverage(corpus: Corpus, available: DataFrame, width: int = 200, scope: str = "exact") -> DataFrame:
    """Files of each size interval beside how many there are in all (available: interval, total), and the share that is here."""
    own = corpus.population(scope).filter("size_bytes >= 0").groupBy(F.floor(F.col("size_bytes") / width).alias("interval")).agg(F.count("*").alias("files"))
    both = own.join(available.select("interval", "total"), "interval", "full_outer").na.fill(0, ["files", "total"])
    return both.withColumn("share", text.ratio(F.col("files"), F.col("total")))


# -- duplicates --------------------------------------------------------------------------------------


def duplicates(corpus: Corpus, scope: str = "markdown", rank: bool = True) -> dict[str, DataFrame]:
    """Families of byte-equal files: two partly aggregated group-bys and one semi-join; rank: number the families (which reads them once at the call)."""
    files = corpus.population(scope)
    hashed = files.filter("content_hash IS NOT NULL AND content_hash <> ''")
    families = hashed.groupBy("content_hash").agg(
        F.count("*").alias("copies"),
        F.count_distinct("repo_full_name").alias("repositories"),
        F.min("size_bytes").alias("min_size"),
        F.max("size_bytes").alias("max_size"),
        F.min_by(F.struct("repo_full_name", "path"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(relational.folded_order())])).alias("first"),
    )
    families = families.filter("copies > 1").select("content_hash", "copies", "repositories", "min_size", "max_size", F.col("first.repo_full_name").alias("representative_repo"), F.col("first.path").alias("representative_path"))
    order = [-F.col("copies"), -F.col("repositories"), F.col("content_hash")]
    members = relational.repeated(hashed, "content_hash").select("content_hash", "id", "repo_full_name", "path", "size_bytes")
    summary = families.agg(F.count("*").alias("families"), F.coalesce(F.sum("copies"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_files"), F.count_if(F.col("repositories") > 1).alias("cross_repository_families"), F.coalesce(F.max("copies"), F.lit(0)).alias("largest_family"))
    return {"families": relational.ranked(families, order) if rank else families, "members": members, "summary": summary}


def families(corpus: Corpus, scope: str = "exact") -> DataFrame:
    """One row per distinct content with its number of copies, represented by its first file.

    The file is chosen among ids, names and hashes; its content stays where the scan has put it, unless there are
    too many families for a broadcast.
    """
    files = corpus.population(scope).filter("content IS NOT NULL").withColumn("identity", text.identity(F.col("content_hash"), F.col("id")))
    first = relational.representative(files.select("id", "repo_full_name", "path", "identity"), "identity", *relational.folded_order())
    return files.join(small(written(first.select("id", "copies"), "families")), "id")


# -- Markdown structure ------------------------------------------------------------------------------


def sections(corpus: Corpus, scope: str = "exact", heading_limit: int = 1000) -> dict[str, DataFrame]:
    """Headings and section bodies, parsed once per content and weighted by copies."""
    kind = f"struct<{markdown.STRUCTURE.replace(' array', ':array').replace(' int', ':int').replace(' boolean', ':boolean')}>"
    own = parsed_once(corpus, families(corpus, scope), markdown.structure, kind, "s", ["identity", "copies"], ("structures", "1"))
    own = written(own, "structures")  # several tables read it
    flat = own.select("identity", "copies", F.explode("s.sections").alias("b")).select("identity", "copies", "b.*")
    files = own.select("copies", F.size("s.headings").alias("headings"), "s.top_level_sections", "s.maximum_depth", "s.skipped_jumps", "s.starts_below_h1", "s.h1_count", "s.empty_sections")
    w = F.col("copies")
    both = lambda name, x: [F.sum(x * w).cast("long").alias(f"{name}_full"), F.sum(x).cast("long").alias(f"{name}_unique")]
    totals = files.agg(
        *both("files", F.lit(1)),
        *both("headed_files", (F.col("headings") > 0).cast("int")),
        *both("sections", F.col("headings")),
        *both("empty_sections", F.col("empty_sections")),
        *both("skipped_jumps", F.col("skipped_jumps")),
        *both("starts_below_h1", F.col("starts_below_h1").cast("int")),
        *both("multiple_h1", (F.col("h1_count") > 1).cast("int")),
    )
    styles = flat.groupBy("style").agg(*both("sections", F.lit(1)))
    styles = styles.withColumn("percent_full", F.lit(100.0) * F.col("sections_full") / F.sum("sections_full").over(Window.partitionBy()))
    measures = ["line_count", "word_count", "list_items", "prose_blocks", "list_lines", "prose_lines"]
    long = flat.select("copies", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])).alias("m")).select("copies", "m.measure", "m.value")
    quantiles = stats.weighted_quantiles(stats.weighted_histogram(long, "value", "copies", ["measure"]), [0.25, 0.5, 0.9, 0.99], ["measure"])
    names = own.select("identity", "copies", F.explode("s.headings.name").alias("name"))
    counted = names.groupBy("name").agg(F.sum("copies").alias("occurrences"))
    distinct = names.distinct().groupBy("name").agg(F.sum("copies").alias("files"), F.count("*").alias("contents"))
    top = counted.join(distinct, "name").orderBy(F.desc("files"), F.desc("occurrences"), "name").limit(heading_limit)
    out = {"totals": totals, "styles": styles, "quantiles": quantiles, "headings": top, "list_items": stats.weighted_histogram(flat, "list_items", "copies")}
    return out | summaries.section_populations(own)


def fence_languages(corpus: Corpus, scope: str = "all") -> dict[str, DataFrame]:
    """Labels of fenced blocks and their families, from the structure analysis."""
    files = corpus.population(scope).select("id", structure_tags(F.col("content")).alias("tags")).filter(F.size("tags") > 0)
    blocks = files.select("id", F.explode("tags").alias("label"))
    per = blocks.groupBy("id", "label").agg(F.count("*").alias("n"))
    raw = per.groupBy("label").agg(F.sum("n").alias("blocks"), F.count("*").alias("files"))
    family = per.withColumn("family", text.fence_family(F.col("label")))
    normal = family.groupBy("id", "family").agg(F.sum("n").alias("n")).groupBy("family").agg(F.sum("n").alias("blocks"), F.count("*").alias("files"))
    summary = per.agg(F.count_distinct("id").alias("files_with_code"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.coalesce(F.sum(F.when(F.col("label") != text.UNTAGGED, F.col("n"))), F.lit(0)).alias("tagged_blocks"), F.count_distinct("label").alias("labels"))
    return {"raw": raw, "normalized": normal, "summary": summary}


def list_item_distribution(items: DataFrame) -> DataFrame:
    """Sections by their number of list items, of all files and of distinct contents side by side: values that either has, with shares of all sections and of those with lists.

    items: population, value, sections (sections()["list_item_histogram"]). The windows run over distinct numbers of items.
    """
    wide = items.groupBy(F.col("value").alias("list_item_count")).pivot("population", ["full", "unique"]).agg(F.sum("sections")).na.fill(0)
    bearing, every, out = F.col("list_item_count") > 0, Window.partitionBy(), []
    for name in ("full", "unique"):
        n = F.col(name)
        out += [n.alias(f"sections_{name}"), text.share(n, F.sum(n).over(every)).alias(f"share_all_sections_{name}")]
        out.append(text.share(F.when(bearing, n).otherwise(0), F.sum(F.when(bearing, n)).over(every)).alias(f"share_list_bearing_sections_{name}"))
    return wide.select("list_item_count", *out)


def structure_tags(content: Column) -> Column:
    from .corpus import structure_fields

    return structure_fields(content)["code_block_tags"]


def notation_candidates(corpus: Corpus, scope: str = "all", per_category: int = 10) -> dict[str, DataFrame]:
    """Notations by confidence and subtype, and a digest-ordered sample of each."""
    found = parsed(corpus.population(scope), notations.parse, notations.DETECTED, "n", ["id", "path", "content_hash"])
    rows = found.select("id", "path", "content_hash", F.posexplode("n.detections").alias("place", "d")).select("id", "path", "content_hash", "place", F.col("d.id").alias("notation"), "d.subtype", "d.confidence", "d.via", "d.snippet", "d.shape")
    rows = rows.withColumn("subtype", F.coalesce("subtype", F.lit("(unclassified)")))
    summary = rows.groupBy("notation", "confidence").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"))
    subtypes = rows.groupBy("notation", "subtype").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"))
    keyed = rows.withColumn("key", F.concat_ws(":", "id", "place"))
    return {"summary": summary, "subtypes": subtypes, "sample": sampling.smallest_digests(keyed, "notation", "key", per_category, "notation-inspection-v1\0").drop("snippet", "shape")}


def stored_notations(corpus: Corpus) -> Tables:
    """The stored notation results added up (stored.notation_rollup), and what their caps left out."""
    found = stored.notation_rollup(corpus.analysis)
    return found | {"caps": lambda: found["totals"].select("capped_files", "omitted")}


def replayed_notations(corpus: Corpus, without: tuple[str, ...] = ("plantuml",)) -> DataFrame:
    """Notations found again in the files' texts beside the stored counts; a difference raises when the row is read.

    Notations with boundary marks outside fences are left out of the comparison.
    """
    found = parsed(corpus.files, notations.parse, notations.DETECTED, "n", ["id"])
    again = found.select(F.explode("n.detections").alias("d")).groupBy(F.col("d.id").alias("notation")).agg(F.count("*").alias("replayed"))
    both = again.join(stored_notations(corpus)["notations"].select("notation", "occurrences"), "notation", "full_outer").na.fill(0).filter(~F.col("notation").isin(*without))
    fine = F.col("replayed") == F.col("occurrences")
    return both.withColumn("notation", F.when(fine, F.col("notation")).otherwise(F.raise_error(F.concat(F.lit("replay differs from the stored results: "), F.col("notation")))))


def _judged_by_models(docs: DataFrame, models: tuple[language.LanguageModel, language.LanguageModel], config: prose.Config) -> DataFrame:
    """identity, copies, index, words, d of eligible paragraphs (see prose.DECISION), by expressions over the predictions of two models.

    A paragraph is scored where it is stored, by both models in one pass.
    """
    rows = docs.select("identity", "copies", F.explode("p").alias("q")).select("identity", "copies", "q.*").filter("eligible")
    # A second look at the words alone: a language that letter case or marks decide isn't stable.
    rows = rows.select("identity", "copies", "index", "words", "text", language.bare(F.col("text")).alias("plain"), text.dominant_script(F.col("text")).alias("script"))
    own = language.predictions(rows, ["identity", "copies", "index", "words", "script"], {"first": ("text", models[0]), "second": ("text", models[1]), "plain": ("plain", models[0])})
    a, b = F.col("first"), F.col("second")
    stable = F.col("plain.language") == a["language"]
    checks = [
        ("detector_disagreement", a["language"] == b["language"]),
        ("fasttext_low_confidence", a["confidence"] >= config.min_confidence),
        ("fasttext_low_margin", a["margin"] >= config.min_margin),
        ("lingua_low_confidence", b["confidence"] >= config.min_confidence),
        ("lingua_low_margin", b["margin"] >= config.min_margin),
        ("script_mismatch", text.script_fits(a["language"], F.col("script"))),
        ("normalization_instability", stable),
    ]
    decision = F.coalesce(*[F.when(~fine, F.lit(name)) for name, fine in checks], F.lit("accepted"))
    found = own.withColumn("decision", decision).withColumn("stable", stable).withColumn("language", F.when(F.col("decision") == "accepted", a["language"]))
    return written(found.select("identity", "copies", "index", "words", F.struct("language", "decision", "script", "stable", "first", "second").alias("d")), "paragraph-decisions")


def paragraph_languages(corpus: Corpus, scope: str = "exact", first: prose.LanguageDetector | None = None, second: prose.LanguageDetector | None = None, config: prose.Config = prose.Config(), audit: int = 20, models: tuple[language.LanguageModel, language.LanguageModel] | None = None) -> dict[str, DataFrame]:
    """Languages of prose paragraphs by two that agree, and of documents by their paragraphs; weighted by copies.

    models: two fitted ones (operators.language), which Spark applies; else two detectors, which run beside the parser.
    """
    one, two = first or prose.StopWordDetector("stop words"), second or prose.TrigramDetector()
    able = lambda p: p["words"] >= config.min_words and p["letters"] >= config.min_letters

    def judged(content: str) -> list[dict]:
        return [{"index": p["index"], "words": p["words"], "eligible": able(p), "d": prose.decide(p["text"], one, two, config) if able(p) else None} for p in prose.paragraphs(content)]

    def told(content: str) -> list[dict]:
        return [{"index": p["index"], "words": p["words"], "eligible": able(p), "text": prose.cut(p["text"], config.max_characters) if able(p) else None} for p in prose.paragraphs(content)]

    parse, field = (told, "text:string") if models else (judged, f"d:{prose.DECISION}")
    # Limits and detectors are part of what a stored result depends on.
    version = hashlib.md5(repr((config, None if models else (one.name, two.name))).encode()).hexdigest()[:12]
    docs = parsed_once(corpus, families(corpus, scope), parse, f"array<struct<index:int,words:int,eligible:boolean,{field}>>", "p", ["identity", "copies"], ("paragraphs", f"1-{version}"))
    docs = written(docs, "paragraphs")  # several tables read it
    rows = _judged_by_models(docs, models, config) if models else docs.select("identity", "copies", F.explode("p").alias("q")).select("identity", "copies", "q.*").filter("eligible")
    decisions = rows.groupBy(F.col("d.decision").alias("decision")).agg(F.count("*").alias("paragraphs"), F.sum("words").alias("words"))
    agreed = rows.filter("d.decision = 'accepted'").select("identity", "copies", "index", "words", F.col("d.language").alias("language"))
    eligible = docs.select("identity", "copies", F.aggregate(F.filter("p", lambda x: x["eligible"]), F.lit(0), lambda a, x: a + x["words"]).alias("eligible_words"))
    joined = eligible.join(summaries.ranked_languages(agreed, ["identity"]), "identity", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    documents = summaries.document_classes(joined, F.col("eligible_words"), config).select("identity", "copies", "eligible_words", "accepted", "reason", "language", "class")
    documents = written(documents, "language-documents")
    distribution = agreed.groupBy("language").agg(F.sum(F.col("words") * F.col("copies")).alias("words_full"), F.sum("words").alias("words_unique"), F.sum("copies").alias("paragraphs_full"), F.count("*").alias("paragraphs_unique"), F.count_distinct("identity").alias("contents"))
    primaries = documents.filter("class = 'primary'").groupBy("language").agg(F.sum("copies").alias("primary_files"))
    distribution = distribution.join(primaries, "language", "full_outer").na.fill(0).withColumn("share_full", text.share(F.col("words_full"), F.sum("words_full").over(Window.partitionBy())))
    levels = F.array(*[F.lit(t) for t in config.thresholds])
    sure = (F.col("d.first.language") == F.col("d.second.language")) & (F.least("d.first.confidence", "d.second.confidence") >= F.col("threshold")) & (F.least("d.first.margin", "d.second.margin") >= config.min_margin) & text.script_fits(F.col("d.first.language"), F.col("d.script")) & F.col("d.stable")
    sure = rows.withColumn("threshold", F.explode(levels)).filter(sure).select("identity", "copies", "threshold", F.col("d.first.language").alias("language"), "words", "index")
    sensitivity = sure.groupBy("threshold", "language").agg(F.sum("words").alias("words"), F.count("*").alias("paragraphs"))
    keyed = rows.select(F.col("d.decision").alias("decision"), F.concat_ws(":", "identity", "index").alias("key"), "words")
    more = summaries.language_populations(docs, rows, agreed, sure, documents, config)
    return more | {"decisions": decisions, "documents": documents, "distribution": distribution, "sensitivity": sensitivity, "audit": sampling.smallest_digests(keyed, "decision", "key", audit, "language-audit-v1\0")}


# -- placement and hierarchy ---------------------------------------------------------------------------


def placement(corpus: Corpus) -> dict[str, DataFrame]:
    """Where files lie: per repository and scope, components of their paths, odd paths."""
    files = corpus.population("exact").withColumn("depth", paths.depth(F.col("path")))
    root = F.col("depth") == 0
    per = files.groupBy("repo_full_name").agg(F.count("*").alias("files"), F.count_if(root).alias("root_files"), F.count_if(~root).alias("nested_files"), F.max("depth").alias("maximum_depth"), F.count_distinct("content_hash").alias("contents"), F.count_if(paths.hidden(F.col("path"))).alias("hidden_files"))
    per = per.withColumn("configuration", F.when(F.col("nested_files") == 0, "root_only").when(F.col("root_files") == 0, "nested_only").otherwise("root_and_nested")).withColumn("band", F.when(F.col("files") > 1, bands.multiplicity_band(F.col("files"))).otherwise("1"))
    parts = paths.directory_parts(F.col("path"))
    kinds = F.array(
        F.struct(F.lit("first_directory").alias("dimension"), F.try_element_at(parts, F.lit(1)).alias("component")),
        F.struct(F.lit("parent_directory").alias("dimension"), F.try_element_at(parts, F.lit(-1)).alias("component")),
    )
    every = F.concat(kinds, F.transform(F.array_distinct(parts), lambda x: F.struct(F.lit("any_directory").alias("dimension"), x.alias("component"))))
    component = files.select("id", "repo_full_name", "path", F.explode(every).alias("c")).select("id", "repo_full_name", "path", "c.dimension", text.casefold(F.col("c.component")).alias("component")).filter("component IS NOT NULL")

    def components() -> DataFrame:
        keys = ["dimension", "component"]
        own = written(component, "components")
        counted = own.groupBy(*keys, "repo_full_name").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("files"), F.count("repo_full_name").alias("repositories"))
        # The first three paths of each; a task keeps three of each before the exchange.
        scan = Window.partitionBy(*keys).orderBy(F.lower("repo_full_name"), "repo_full_name", F.lower("path"), "path")
        firsts = own.withColumn("_n", F.row_number().over(scan)).filter("_n <= 3")
        examples = firsts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.concat_ws("::", "repo_full_name", "path").alias("x")))), lambda s: s["x"]).alias("examples"))
        return relational.ranked_within(counted.join(examples, keys), ["dimension"], [-F.col("files"), -F.col("repositories"), F.col("component")])

    flags = files.agg(*[F.sum(v).alias(k) for k, v in paths.anomalies(F.col("path")).items()])
    return Tables({"repositories": per, "components": components, "anomalies": flags, "bins": lambda: bands.range_histogram(corpus.session, per, "files")})


def scope_mapping(corpus: Corpus) -> dict[str, DataFrame]:
    """Placement forms, scope configurations, alternative placements and topology by the scope that files speak for."""
    return summaries.scope_mapping(corpus)


def hierarchy(corpus: Corpus, logical: bool = False) -> dict[str, DataFrame]:
    """Edges to nearest enclosing files, and how long their chains are; by physical directory or by the scope that files speak for."""
    files = corpus.population("exact")
    scope = paths.logical_scope(F.col("path")) if logical else paths.directory(F.col("path"))
    edges = relational.nearest_ancestors(files, "repo_full_name", scope, ["id", "path"])
    return {"edges": edges, "chains": relational.chain_lengths(files, "repo_full_name", scope), "pairs": relational.scope_pairs(files, "repo_full_name", "path")}


def normalized_lines(files: DataFrame, ascii_only: bool = False) -> DataFrame:
    """repo, file, hash, line: distinct non-blank lines of files, white space made single, letter case folded (composed forms in the full version)."""

    def fold(content: str) -> list[str]:
        import unicodedata

        return sorted({x for x in (" ".join(unicodedata.normalize("NFKC", line).split()).casefold() for line in content.splitlines()) if x})

    if ascii_only:
        cleaned = F.transform(text.lines(F.col("content")), lambda x: F.lower(F.trim(F.regexp_replace(x, "[ \t]+", " "))))
        rows = files.withColumn("line", F.explode(F.array_distinct(F.filter(cleaned, lambda x: x != ""))))
    else:
        rows = parsed(files, fold, "array<string>", "l", ["repo_full_name", "id", "content_hash"]).withColumn("line", F.explode("l"))
    return rows.select(F.col("repo_full_name").alias("repo"), F.col("id").alias("file"), F.col("content_hash").alias("hash"), "line")


def line_overlaps(corpus: Corpus, minimum_shared: int = 5, jaccard: float = 0.80, containment: float = 0.90, ascii_only: bool = False) -> DataFrame:
    """Pairs of files of a repository with much the same lines."""
    several = relational.repeated(corpus.population("exact"), "repo_full_name")
    return relational.line_overlaps(normalized_lines(several, ascii_only), minimum_shared, jaccard, containment)


def exact_reuse(corpus: Corpus) -> DataFrame:
    """Per repository: groups of equal files, their files, repeats and pairs."""
    groups = corpus.population("exact").filter("content_hash IS NOT NULL").groupBy("repo_full_name", "content_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.groupBy("repo_full_name").agg(F.count("*").alias("groups"), F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("repeated"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def allocation(corpus: Corpus, heading_limit: int = 1000) -> dict[str, DataFrame]:
    """How a hierarchy's files share their content: sizes, line overlap, references between parent and child, headings by role."""
    files = relational.repeated(corpus.population("exact"), "repo_full_name").withColumn("depth", paths.depth(F.col("path")))

    def measure(content: str) -> dict:
        import unicodedata

        own = markdown.structure(content)
        return {
            "lines": len(content.splitlines()),
            "words": len(content.split()),
            "sections": len(own["headings"]),
            "fences": markdown.fenced_blocks(content),
            "names": sorted({h["name"] for h in own["headings"]}),
            "line_set": sorted({x for x in (" ".join(unicodedata.normalize("NFKC", line).split()).casefold() for line in content.splitlines()) if x}),
            "targets": sorted({r["target"] for r in references.local_references(content)}),
        }

    kind = "struct<lines:int,words:int,sections:int,fences:int,names:array<string>,line_set:array<string>,targets:array<string>>"
    known = parsed(files, measure, kind, "m", ["id", "repo_full_name", "path", "content_hash", "size_bytes", "depth"])
    known = written(known.withColumn("reached", F.transform("m.targets", lambda t: F.lower(paths.resolved(F.col("path"), t)))), "measures")
    edges = relational.nearest_ancestors(files, "repo_full_name", paths.directory(F.col("path")), ["id"]).select("repo_full_name", "child_id", "parent_id")
    side = lambda name: known.select(F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in ("path", "content_hash", "size_bytes", "reached")], *[F.col(f"m.{c}").alias(f"{name}_{c}") for c in ("lines", "words", "sections", "names")], F.size("m.line_set").alias(f"{name}_distinct"))
    joined = edges.join(side("child"), "child_id").join(side("parent"), "parent_id")

    def compare() -> DataFrame:
        postings = relational.line_postings(known.select(F.col("repo_full_name").alias("repo"), F.col("id").alias("file"), F.explode("m.line_set").alias("line")))
        counts = relational.shared_lines(edges.select("child_id", "parent_id"), postings, "child_id", "parent_id")
        return compared(joined.join(counts, ["child_id", "parent_id"], "left").na.fill(0, ["shared"]))

    union = F.col("child_distinct") + F.col("parent_distinct") - F.col("shared")
    compared = lambda rows: rows.select(
        "repo_full_name",
        "parent_path",
        "child_path",
        *[F.col(f"{s}_{c}") for s in ("parent", "child") for c in ("size_bytes", "lines", "words", "sections")],
        (F.col("child_content_hash") == F.col("parent_content_hash")).cast("int").alias("same_content_hash"),
        F.col("shared").cast("int").alias("shared_lines"),
        text.share(F.col("shared"), union).alias("jaccard"),
        text.share(F.col("shared"), F.col("child_distinct")).alias("child_coverage"),
        text.share(F.col("shared"), F.col("parent_distinct")).alias("parent_coverage"),
        F.array_contains("parent_reached", F.lower("child_path")).cast("int").alias("parent_refers_to_child"),
        F.array_contains("child_reached", F.lower("parent_path")).cast("int").alias("child_refers_to_parent"),
        F.size(F.array_intersect("child_names", "parent_names")).alias("shared_headings"),
    )
    hhi = stats.herfindahl(known, "repo_full_name", "size_bytes")
    per = known.groupBy("repo_full_name").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum(F.when(F.col("depth") == 0, F.col("size_bytes")).otherwise(0)).alias("root_bytes"), F.max("depth").alias("maximum_depth"))
    per = per.join(hhi, "repo_full_name").join(edges.groupBy("repo_full_name").agg(F.count("*").alias("edges")), "repo_full_name", "left").na.fill(0, ["edges"])
    per = per.withColumn("root_share", text.share(F.col("root_bytes"), F.col("bytes"))).withColumn("band", bands.multiplicity_band(F.col("files")))

    def grouped() -> DataFrame:
        each = described(per, ["hhi", "root_share"], "integer", "double", ["band"])
        own = F.struct(*[c for c in each.columns if c not in ("band", "measure")])
        return each.groupBy("band").agg(F.max("count").alias("repositories"), *[F.max(F.when(F.col("measure") == m, own)).alias(m) for m in ("hhi", "root_share")])

    is_parent = edges.select(F.col("parent_id").alias("id")).distinct().withColumn("p", F.lit(1))
    is_child = edges.select(F.col("child_id").alias("id")).distinct().withColumn("c", F.lit(1))
    roles = known.join(is_parent, "id", "left").join(is_child, "id", "left")
    role = F.when(F.col("p").isNotNull() & F.col("c").isNotNull(), "middle").when(F.col("p").isNotNull(), "parent").when(F.col("c").isNotNull(), "child").when(F.col("depth") == 0, "single_root").otherwise("single_nested")
    headings = roles.select(role.alias("role"), F.explode("m.names").alias("heading")).groupBy("heading").pivot("role", ["parent", "middle", "child", "single_root", "single_nested"]).count().na.fill(0)
    headings = headings.withColumn("files", sum((F.col(c) for c in ("parent", "middle", "child", "single_root", "single_nested")), F.lit(0))).orderBy(F.desc("files"), "heading").limit(heading_limit)
    smaller = joined.agg(F.count_if(F.col("child_size_bytes") < F.col("parent_size_bytes")).alias("child_smaller"), F.count_if(F.col("child_size_bytes") == F.col("parent_size_bytes")).alias("equal"), F.count_if(F.col("child_size_bytes") > F.col("parent_size_bytes")).alias("child_larger"))
    return Tables({"repositories": per, "edges": compare, "strata": grouped, "headings": headings, "comparison": smaller, "comparisons": compared_sizes(joined, ["size_bytes", "lines", "words", "sections"])})


def compared_sizes(edges: DataFrame, measures: list[str]) -> DataFrame:
    """measure, edges and how many children have less, as much or more of it than their parents, with shares: one aggregate of all measures, then a row for each."""
    count = lambda m: F.struct(F.lit(m).alias("measure"), *[F.count_if(f(F.col(f"child_{m}"), F.col(f"parent_{m}"))).alias(name) for name, f in (("child_lower", lambda c, p: c < p), ("child_equal", lambda c, p: c == p), ("child_higher", lambda c, p: c > p))])
    rows = edges.agg(F.count("*").alias("edges"), *[count(m).alias(f"_{m}") for m in measures]).select("edges", F.explode(F.array(*[f"_{m}" for m in measures])).alias("x")).select("edges", "x.*")
    return rows.select("measure", "edges", *[c for name in ("child_lower", "child_equal", "child_higher") for c in (F.col(name), text.share(F.col(name), F.col("edges")).alias(f"{name}_share"))])


def hierarchy_candidates(corpus: Corpus) -> DataFrame:
    """Whether repositories with a hierarchy of files delegate more often: those with a file that surely refers to another local one, beside the rest, and the odds ratio.

    Both sides are flags of repositories, made by partial aggregates; one row remains.
    """
    files = relational.repeated(corpus.population("exact").select("repo_full_name", "id", "path"), "repo_full_name")
    files = written(files, "hierarchy-files")  # names only; contents are parsed for their references alone
    edges = relational.nearest_ancestors(files, "repo_full_name", paths.directory(F.col("path")), ["id"])
    nested = files.groupBy("repo_full_name").agg(F.lit(1).alias("_one")).join(edges.select("repo_full_name", F.lit(True).alias("_nested")).distinct(), "repo_full_name", "left")
    nested = nested.select("repo_full_name", F.coalesce("_nested", F.lit(False)).alias("nested"))
    sure = reference_analysis(corpus)["files"].groupBy("repo_full_name").agg((F.max("high") > 0).alias("sure"))
    both = nested.join(sure, "repo_full_name", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    cells = both.agg(*[F.count_if(side & said).alias(name) for name, side, said in (("hierarchy_with", F.col("nested"), F.col("sure")), ("hierarchy_without", F.col("nested"), ~F.col("sure")), ("flat_with", ~F.col("nested"), F.col("sure")), ("flat_without", ~F.col("nested"), ~F.col("sure")))])
    names = cells.columns
    shares = [text.share(F.col(f"{side}_with"), F.col(f"{side}_with") + F.col(f"{side}_without")).alias(f"{side}_share") for side in ("hierarchy", "flat")]
    return cells.select(*names, *shares, *[c.alias(n) for n, c in zip(("odds_ratio", "lower_95", "upper_95"), stats.odds_ratio(*map(F.col, names)), strict=True)])


# -- references and imports -----------------------------------------------------------------------------


def _context(corpus: Corpus) -> DataFrame:
    """Facts of the files of the exact population, of their repositories and of their copies in the corpus and the repository; no contents."""
    files = corpus.population("exact").filter("content IS NOT NULL").select("id", "repo_full_name", "path", text.identity(F.col("content_hash"), F.col("id")).alias("identity"), "size_bytes")
    files = written(files, "exact-files")  # read three times here
    repos = corpus.repos.select(F.col("full_name").alias("repo_full_name"), "stars", F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("Unknown")).alias("language"))
    sets = written(files.groupBy("repo_full_name", "identity").agg(F.count("*").alias("repo_copies")), "content-sets")
    sizes = sets.groupBy("repo_full_name").agg(F.sum("repo_copies").alias("repo_files"))
    copies = sets.groupBy("identity").agg(F.sum("repo_copies").alias("copies"))
    # What there is one row of for each repository and content, joined with the files once.
    known = sets.join(sizes, "repo_full_name").join(copies, "identity").join(repos, "repo_full_name", "left")
    joined = files.join(known, ["repo_full_name", "identity"])
    return joined.select(
        "id",
        "repo_full_name",
        "path",
        "identity",
        "size_bytes",
        F.coalesce("language", F.lit("Unknown")).alias("language"),
        bands.size_band(F.col("size_bytes")).alias("size_band"),
        bands.star_band(F.col("stars")).alias("star_band"),
        paths.location(F.col("path")).alias("location"),
        paths.plain_depth(F.col("path")).alias("depth"),
        F.when(F.col("repo_files") > 1, "multiple").otherwise("single").alias("multiplicity"),
        F.when(F.col("copies") > 1, "duplicate").otherwise("unique").alias("duplication"),
        "copies",
        "repo_copies",
    )


def _parsed_facts(corpus: Corpus, parser, kind: str, name: str, table: str) -> DataFrame:
    """The facts of the exact population's files and what a parser makes of their contents, joined by id and written once."""
    own = parsed(corpus.population("exact").filter("content IS NOT NULL"), parser, kind, name, ["id"])
    return written(own.join(_context(corpus), "id").select(*_FACTS, name), table)


_FACTS = ["id", "repo_full_name", "path", "identity", "size_bytes", "language", "size_band", "star_band", "location", "depth", "multiplicity", "duplication", "copies", "repo_copies"]


def reference_analysis(corpus: Corpus) -> dict[str, DataFrame]:
    """References to Markdown files: occurrences, files, targets and strata."""
    docs = _parsed_facts(corpus, references.parse, references.PARSED, "p", "references")
    flat = docs.select(*_FACTS, F.posexplode("p.refs").alias("place", "r")).select(*_FACTS, "place", "r.*")
    local = flat.filter("scope = 'local'").withColumn("resolved", paths.resolved(F.col("path"), F.col("target")))
    local = local.withColumn("relation", paths.relation(F.col("path"), F.col("resolved"))).withColumn("category", paths.target_category(F.col("name"), F.col("resolved"))).withColumn("is_self", (F.lower("resolved") == F.lower("path")).cast("int"))
    instruction = F.col("acts") & F.col("category").isin(*references.ACTION_CATEGORIES)
    local = local.withColumn("rule", F.coalesce("rule", F.when(instruction, references.ACTION), F.lit("no_explicit_instructional_cue_v1")))
    plain = F.col("rule") == "no_explicit_instructional_cue_v1"
    local = local.withColumn("intent", F.when(F.col("rule").isin(*references.INCLUDE_RULES), "direct_inclusion").when(plain, "contextual_documentation").otherwise("instructional_delegation")).withColumn("confidence", F.when(plain, "low").otherwise("high"))
    local = local.withColumn("high", F.when(plain | (F.col("is_self") == 1) | (F.col("relation") == "outside_repository"), 0).otherwise(1)).drop("acts")
    far = flat.filter("scope = 'external'").select(*_FACTS, "place", *[c for c in flat.columns if c not in (*_FACTS, "place", "rule", "acts")], F.lit("").alias("resolved"), F.lit("external").alias("relation"), paths.target_category(F.col("name"), F.col("raw")).alias("category"), F.lit(0).alias("is_self"), F.lit("external_reference").alias("intent"), F.lit("high").alias("confidence"), F.lit("external_markdown_url_v1").alias("rule"), F.lit(0).alias("high"))
    occurrences = local.unionByName(far)
    other = (F.col("scope") == "local") & (F.col("is_self") == 0)
    per = occurrences.groupBy("id").agg(
        F.count_if(F.col("scope") == "local").alias("local"),
        F.count_if(other).alias("local_nonself"),
        F.count_if(F.col("scope") == "external").alias("external"),
        F.sum(F.when(other, F.col("high")).otherwise(0)).alias("high"),
        F.count_distinct(F.when(other & (F.col("high") == 1), F.col("resolved"))).alias("fan_out"),
        F.count_distinct(F.when(other & (F.col("relation") != "outside_repository"), F.col("resolved"))).alias("distinct_targets"),
        F.array_join(F.sort_array(F.collect_set(F.when(other, F.col("category")))), ";").alias("target_categories"),
    )
    files = docs.select(*_FACTS, F.col("p.residual_words").alias("residual_words"), F.col("p.has_fence").alias("has_fence")).join(per, "id", "left").na.fill(0, ["local", "local_nonself", "external", "high", "fan_out", "distinct_targets"])
    form = (
        F.when((F.col("local") == 0) & (F.col("external") == 0), "no_detected_markdown_reference")
        .when((F.col("high") > 0) & ~F.col("has_fence") & (F.col("residual_words") <= 50), "pointer_only")
        .when(F.col("high") > 0, "instructions_plus_delegation")
        .when(F.col("local_nonself") > 0, "contextual_local_references_only")
        .when(F.col("external") > 0, "external_references_only")
        .otherwise("self_references_only")
    )
    files = files.withColumn("form", form)
    hi = F.col("high") == 1
    targets = occurrences.groupBy("scope", "category", "name").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"), F.count_distinct("repo_full_name").alias("repositories"), F.count_if(hi).alias("high_occurrences"), F.count_distinct(F.when(hi, F.col("id"))).alias("high_files"), *[F.count_if(F.col("intent") == x).alias(x) for x in ("direct_inclusion", "instructional_delegation", "contextual_documentation")])
    strata = lambda: relational.strata(files, ["size_band", "star_band", "language", "location", "multiplicity", "duplication", "form"], {"files": F.lit(1), "files_with_high": (F.col("high") > 0).cast("int"), "high_occurrences": F.col("high")}, "repo_full_name", "repositories")
    return Tables({"occurrences": occurrences, "files": files, "targets": targets, "strata": strata})


def import_analysis(corpus: Corpus, earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """@path imports: tokens, files, targets, strata, and how they meet the direct references found before (columns repo_full_name, path, line, target, in order of place)."""
    docs = _parsed_facts(corpus, imports.import_tokens, imports.IMPORTS, "t", "imports")
    flat = docs.select(*_FACTS, F.posexplode("t").alias("place", "r")).select(*_FACTS, "place", "r.*")
    name = paths.basename(F.col("target"), True)
    plain_kind = F.col("kind") == "relative"
    normal = F.when(plain_kind, paths.normalized(F.col("target"))).otherwise(F.col("target"))
    tokens = flat.withColumn("name", name).withColumn("extension", paths.extension_class(F.col("name"))).withColumn("shape", paths.target_shape(F.col("target"), F.col("extension"))).withColumn("normalized", normal)
    tokens = tokens.withColumn("resolved", F.when(plain_kind, paths.resolved(F.col("path"), F.col("normalized"))).otherwise(""))
    tokens = tokens.withColumn("relation", F.when(plain_kind, paths.relation(F.col("path"), F.col("resolved"))).when(F.col("kind") == "platform_relative", "platform_dependent").when(F.col("kind") == "home_relative", "external_home").when(F.col("kind").endswith("absolute"), "external_absolute").otherwise(F.col("kind")))
    active = F.col("decision") == imports.CANDIDATE
    files = tokens.groupBy("id").agg(F.count("*").alias("tokens"), F.count_if(active).alias("candidates"), F.count_if(active & (F.col("shape") != "bare_extensionless")).alias("explicit"), F.count_distinct(F.when(active & (F.col("resolved") != ""), F.col("resolved"))).alias("fan_out"))
    files = docs.select(*_FACTS).join(files, "id", "left").na.fill(0, ["tokens", "candidates", "explicit", "fan_out"])
    targets = tokens.filter(active).groupBy("kind", "relation", "extension", "shape", F.lower("name").alias("name")).agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"), F.count_distinct("repo_full_name").alias("repositories"), F.min_by("name", F.struct("repo_full_name", "path", "place")).alias("first_spelling"))
    decisions = tokens.groupBy("decision", "context", "surface").agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("files"))
    strata = lambda: relational.strata(files, ["size_band", "star_band", "language", "location", "multiplicity", "duplication"], {"files": F.lit(1), "files_with_imports": (F.col("candidates") > 0).cast("int"), "candidates": F.col("candidates")})
    out = {"tokens": tokens, "files": files, "targets": targets, "decisions": decisions, "strata": strata}
    if earlier is not None:
        keys = ["repo_full_name", "path", "line", "key"]
        left = tokens.select("repo_full_name", "path", "line", F.col("normalized").alias("key"), "place", "decision", "extension")
        right = earlier.select("repo_full_name", "path", "line", F.col("target").alias("key"), "place")
        matched = relational.fifo_match(left, right, keys, ["place"], ["place"])
        state = F.when(F.col("left_row").isNull(), "earlier_only").when(F.col("right_row").isNull(), F.concat(F.lit("new_"), F.col("left_row.decision"))).otherwise(F.concat(F.lit("kept_"), F.col("left_row.decision")))
        out["comparison"] = matched.groupBy(state.alias("transition"), F.coalesce("left_row.extension", F.lit("none")).alias("extension")).agg(F.count("*").alias("n"))
    return Tables(out)


def repeated_content(corpus: Corpus, limits: forms.Thresholds = forms.Thresholds(), per_category: int = 10, seed: int = 20260727) -> dict[str, DataFrame]:
    """Files that repeat within a repository, by the form of their content."""
    files = relational.repeated(corpus.population("exact"), "repo_full_name", "content_hash")

    def classified(content: str) -> dict:
        return forms.classify(content, len(content.encode()), limits)

    known = parsed(files, classified, forms.FORM, "f", ["id", "repo_full_name", "path", "content_hash", "size_bytes"])
    groups = known.groupBy("repo_full_name", "content_hash").agg(F.count("*").alias("files"), F.first("f").alias("f"), F.first("size_bytes").alias("size_bytes"), F.min("path").alias("representative"), F.array_distinct(F.flatten(F.collect_set(F.transform(paths.directory_parts(F.col("path")), F.lower)))).alias("parts"))
    groups = groups.withColumn("tags", paths.context_tags(F.col("parts"))).select("repo_full_name", "content_hash", "files", "size_bytes", "representative", "tags", "f.*")
    contents = groups.groupBy("content_hash").agg(F.count("*").alias("repositories"), F.sum("files").alias("files"), F.first("category").alias("category"), F.first("subtype").alias("subtype"), F.first("size_bytes").alias("size_bytes"))
    names = corpus.session.createDataFrame([(k, c) for k, c in enumerate(forms.CATEGORIES)], "ordinal int, category string")
    per = groups.groupBy("category").agg(F.count("*").alias("groups"), F.sum("files").alias("files"), F.count_distinct("repo_full_name").alias("repositories"), F.count_distinct("content_hash").alias("contents"))
    summary = names.join(F.broadcast(per), "category", "left").na.fill(0)
    for c in ("groups", "files", "contents"):
        summary = summary.withColumn(f"{c}_share", text.share(F.col(c), F.sum(c).over(Window.partitionBy())))
    audit = sampling.round_robin(contents.withColumn("band", bands.size_band(F.col("size_bytes"))), "category", "band", ["<=50", "51-200", "201-1000", "1001-5000", ">5000", "unknown"], "content_hash", per_category, seed)
    return {"groups": groups, "contents": contents, "summary": summary, "audit": audit}


def overlay_analysis(corpus: Corpus, substantive: int = 10, minimum_words: int = 3, limit: int = 500) -> dict[str, DataFrame]:
    """Files that import shared instructions: what they add. The prefilter drops only files that can't have such an import."""
    files = corpus.population("exact").filter(F.col("content").contains("@") & F.lower("content").contains(overlays.TARGET))
    found = parsed(files, lambda content: overlays.analyze(content, minimum_words, limit), overlays.OVERLAY, "o", ["id", "repo_full_name", "path", "content_hash"]).filter("o IS NOT NULL")
    residual = F.when(F.col("o.strict") == 1, "strict_import_only").when(F.col("o.comments_only") == 1, "imports_plus_html_comments_only").when(F.col("o.residual_words") == 0, "markup_or_punctuation_only_residual").when(F.col("o.residual_words") < substantive, "short_residual").otherwise("substantive_residual")
    rows = found.select("id", "repo_full_name", "path", "content_hash", residual.alias("residual_class"), "o.*")
    parts = rows.select("id", "repo_full_name", "content_hash", F.explode("sections").alias("s")).select("id", "repo_full_name", "content_hash", "s.*")
    partition = rows.groupBy("residual_class").agg(F.count("*").alias("files"), F.count_distinct("repo_full_name").alias("repositories"), F.count_distinct("content_hash").alias("contents"))
    themes = parts.select("id", F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("sections"), F.count_distinct("id").alias("files"))
    return Tables({"files": rows.drop("sections"), "sections": parts, "partition": partition, "themes": themes, "words": lambda: described(rows, "residual_words", "plain")})


# -- audits, snapshots, reports ----------------------------------------------------------------------


def confusion(audit: DataFrame, labels: DataFrame, key: str, auto: str, review: str) -> dict[str, DataFrame]:
    """Automatic against reviewed labels, each audited once: the matrix, and precision with its interval."""
    joined = relational.bijection(audit, labels, key).select(key, F.col(f"l.{auto}").alias("auto"), F.col(f"r.{review}").alias("review"))
    right, n = F.count_if(F.col("auto") == F.col("review")), F.count("*")
    low, high = stats.wilson(right, n, 0.0)
    return {"matrix": joined.groupBy("auto", "review").agg(F.count("*").alias("n")), "precision": joined.agg(n.alias("n"), right.alias("right"), F.try_divide(right, n).alias("precision"), low.alias("low"), high.alias("high"))}


def content_audit(audit: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Reviewed forms of repeated contents: audit (audit_id, content_hash, auto_category) and labels (audit_id, content_hash, review_category, review_disposition).

    Each id occurs once on either side, with the same hash; a disposition must
    agree with its categories. Anything else raises. Precision counts accepted rows only.
    """
    joined = relational.bijection(audit.select("audit_id", "content_hash", "auto_category"), labels.select("audit_id", "content_hash", "review_category", "review_disposition"), "audit_id")
    rows = joined.select("audit_id", F.col("l.content_hash").alias("hash"), F.col("r.content_hash").alias("other"), F.col("l.auto_category").alias("auto"), F.col("r.review_category").alias("review"), F.col("r.review_disposition").alias("disposition"))
    wrong = (
        F.when(~F.col("hash").eqNullSafe(F.col("other")), "content hash mismatch")
        .when(~F.col("disposition").isin("accepted_correct", "accepted_incorrect", "classifier_abstention"), "unsupported disposition")
        .when(~F.col("review").isin(*forms.CATEGORIES), "unsupported review category")
        .when((F.col("disposition") == "accepted_correct") & (F.col("auto") != F.col("review")), "correct label disagrees with the automatic category")
        .when((F.col("disposition") == "accepted_incorrect") & (F.col("auto") == F.col("review")), "incorrect label equals the automatic category")
    )
    sound = rows.withColumn("auto", F.when(wrong.isNull(), F.col("auto")).otherwise(F.raise_error(F.concat(wrong, F.lit(": "), F.col("audit_id").cast("string")))))
    accepted, right = F.count_if(F.col("disposition").startswith("accepted_")), F.count_if(F.col("disposition") == "accepted_correct")
    low, high = stats.wilson(right, accepted, 0.0)
    measures = [F.count("*").alias("n"), accepted.alias("accepted"), right.alias("correct"), F.count_if(F.col("disposition") == "classifier_abstention").alias("abstentions"), F.try_divide(right, accepted).alias("precision"), low.alias("low"), high.alias("high")]
    return {"matrix": sound.groupBy("auto", "review").agg(F.count("*").alias("n")), "categories": sound.groupBy("auto").agg(*measures), "total": sound.agg(F.count("auto").alias("audited"), *measures)}


#: Spellings of an audit's judgments.
JUDGMENTS = {"correct": "correct", "yes": "correct", "y": "correct", "true": "correct", "1": "correct", "incorrect": "incorrect", "no": "incorrect", "n": "incorrect", "false": "incorrect", "0": "incorrect", "uncertain": "uncertain", "unsure": "uncertain", "?": "uncertain"}


def judgment(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in JUDGMENTS.items() for x in pair])
    clean = F.lower(F.trim(value))
    return F.when(clean.isNull() | (clean == ""), F.lit(None)).otherwise(F.coalesce(F.element_at(known, clean), F.raise_error(F.concat(F.lit("unknown judgment: "), value))))


def language_audit(rows: DataFrame, group: str = "language", value: str = "judgment") -> DataFrame:
    """Precision of the decisive judgments in each group and in all, with Wilson's interval."""
    judged = rows.select(text.language_code(F.col(group)).alias("group"), judgment(F.col(value)).alias("j")).filter("j IS NOT NULL")
    both = judged.select(F.explode(F.array(F.col("group"), F.lit("(all)"))).alias("group"), "j")
    right, n = F.count_if(F.col("j") == "correct"), F.count_if(F.col("j") != "uncertain")
    low, high = stats.wilson(right, n)
    return both.groupBy("group").agg(F.count("*").alias("reviewed"), n.alias("decisive"), right.alias("correct"), F.try_divide(right, n).alias("precision"), low.alias("low"), high.alias("high"))


def star_comparison(repos: DataFrame, files: DataFrame, current: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """Stored against current stars (full_name, stored_name, stars): ranks, who stayed, entered and left the top."""
    counts = files.groupBy("repo_full_name").agg(F.count("*").alias("files"))
    stored = repos.select("full_name", F.coalesce("stars", F.lit(0)).alias("stars")).join(counts, F.col("full_name") == F.col("repo_full_name"), "left").select("full_name", "stars", F.coalesce("files", F.lit(0)).alias("files"))
    now = current.select(F.lower(F.coalesce("stored_name", "full_name")).alias("k"), F.col("full_name").alias("current_name"), F.col("stars").alias("current_stars"))
    joined = stored.join(now, F.lower("full_name") == F.col("k"), "left").drop("k").withColumn("change", F.col("current_stars") - F.col("stars"))
    old = stored.orderBy(F.desc("stars"), F.lower("full_name"), "full_name").limit(top).select("full_name")
    new = joined.filter("current_stars IS NOT NULL").orderBy(F.desc("current_stars"), F.lower("full_name"), "full_name").limit(top).select("full_name")
    return {"comparison": joined, "stayed": old.intersect(new), "entered": new.exceptAll(old), "left": old.exceptAll(new)}


def report(corpus: Corpus, top: int = 15) -> dict[str, DataFrame]:
    """Overview, languages weighted by files, structure, notations and notable files; the last parts need stored results. Ties keep the files' order."""
    joined = corpus.files.join(corpus.repos.select("full_name", "language", "stars"), F.col("repo_full_name") == F.col("full_name"), "left")
    languages = joined.groupBy(F.coalesce("language", F.lit("(unknown)")).alias("language")).agg(F.count("*").alias("files"))
    tools = corpus.files.groupBy("tool_id").agg(F.count("*").alias("files"), F.count_distinct("repo_full_name").alias("repositories"))
    popular = joined.groupBy("repo_full_name").agg(F.max(F.coalesce("stars", F.lit(0))).alias("stars"), F.min("id").alias("first")).orderBy(F.desc("stars"), "first").limit(top).drop("first")
    largest = corpus.files.orderBy(F.desc(F.coalesce("size_bytes", F.lit(0))), "id").limit(top).select("id", "path", "size_bytes")
    named = joined.filter("language <> ''")
    out = {"languages": languages, "tools": tools, "popular": popular, "largest": largest, "top_languages": most_common(named, "language", top)}
    if corpus.analysis is None:
        return out
    own = corpus.files.select(F.col("id").alias("file_id"), "tool_id", "repo_full_name", "path").join(written(corpus.structures(), "report-structures"), "file_id")
    code = F.count_if(F.col("code_block_count") > 0)
    out |= descriptions(own, ["word_count", "line_count", "header_count"], "short", "structure_")
    out["structure_code"] = own.agg(F.count("*").alias("files"), code.alias("files_with_code"), (F.lit(100.0) * F.try_divide(code, F.count("*"))).alias("percent"))
    labels = own.select("file_id", F.explode("code_block_languages").alias("label", "n"))
    out["fences"] = most_common(labels, "label", top, F.sum("n"), "file_id")
    found = written(corpus.notations(), "report-notations")
    out["notation_files"] = found.agg(F.count("*").alias("files"), F.count_if("any_notation_detected").alias("files_with_any"))
    each = corpus.files.select(F.col("id").alias("file_id"), "tool_id").join(found.select("file_id", F.explode("notations_summary").alias("notation", "s")), "file_id")
    out["notations"] = most_common(each.withColumn("n", F.col("s.count")), "notation", None, F.sum("n"), "file_id")
    out["notations_by_tool"] = each.groupBy("tool_id", "notation").agg(F.sum("s.count").alias("n"))
    out["subtypes"] = each.select("notation", F.explode("s.subtypes").alias("subtype")).groupBy("notation", "subtype").agg(F.count("*").alias("files"))
    out["confidences"] = each.select(F.explode("s.confidences").alias("confidence")).groupBy("confidence").agg(F.count("*").alias("n"))
    most = found.filter("notation_count_total > 0").orderBy(F.desc("notation_count_total"), "file_id").limit(10)
    out["most_notations"] = most.select("file_id", F.col("notation_count_total").alias("n"), F.array_join(F.map_keys("notations_summary"), ", ").alias("notations"))
    return Tables(out)


def most_common(df: DataFrame, value: str, top: int | None, count: Column | None = None, order: str = "id") -> DataFrame:
    """value, n of the most frequent values; of equal ones that first which the lowest number in column order has."""
    counted = df.groupBy(value).agg((count if count is not None else F.count("*")).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first", value)
    return (counted.limit(top) if top else counted).select(value, "n")


def analyze(corpus: Corpus, names: list[str] | None = None) -> DataFrame:
    """file_id, analyzer_id, result_json of registered analyzers, as Corpus.analysis holds them."""
    names = names or analyzers.names()
    found = parsed(corpus.files.filter("content IS NOT NULL"), lambda content: [{"analyzer_id": n, "result_json": analyzers.analyze(n, content)} for n in names], "array<struct<analyzer_id:string,result_json:string>>", "r", ["id"])
    return found.select(F.col("id").alias("file_id"), F.explode("r").alias("r")).select("file_id", "r.analyzer_id", "r.result_json")


def export(corpus: Corpus, analyzers: list[str], content: bool = False) -> DataFrame:
    """One row per file with its repository's facts and a column of each analyzer's result."""
    wide = corpus.analysis.groupBy("file_id").pivot("analyzer_id", analyzers).agg(F.first("result_json"))
    cols = ["id", "repo_full_name", "path", "tool_id", "html_url", "size_bytes", "fetched_at", *(["content"] if content else [])]
    facts = corpus.repos.select(F.col("full_name").alias("repo_full_name"), "stars", "language")
    return corpus.files.select(*cols).join(facts, "repo_full_name", "left").join(wide.withColumnRenamed("file_id", "id"), "id", "left")


class VerificationError(ValueError):
    """What differs from the frozen data, one line each."""


def verify(spark: SparkSession, corpus: Corpus, expected: dict[str, int], database: str | None = None, size: int | None = None, sha256: str | None = None) -> dict[str, tuple[int, int | None]]:
    """Counts of the corpus against expected ones, by name; a missing expectation is None.

    database: a SQLite file whose tables, size and digest are checked too. Anything that differs raises, all of it at once.
    """
    from ..sources import files as readers
    from ..sources.sqlite import table_names

    failures = []
    if database is not None:
        if missing := {"repos", "files", "analysis"} - set(table_names(database)):
            failures.append(f"missing tables: {', '.join(sorted(missing))}")
        own = readers.file_facts(database)
        failures += [f"{what} is {got}; expected {want}" for what, got, want in (("size", own[0], size), ("SHA-256", own[1], sha256)) if want is not None and got != want]
    row = populations(corpus).first().asDict() | {"repos": corpus.repos.count(), "analysis": corpus.analysis.count() if corpus.analysis is not None else 0}
    failures += [f"{k} is {row.get(k)}; expected {n}" for k, n in expected.items() if row.get(k) != n]
    if failures:
        raise VerificationError("\n".join(failures))
    return {k: (int(v), expected.get(k)) for k, v in row.items()}
