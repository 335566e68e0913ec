"""Summaries of whole populations: placement by documented scope, Markdown sections, paragraph languages.

Every file counts by its copies in the population "full" and every distinct content
once in "unique"; both come from one pass over the contents, each row taken with its two weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, stats, text
from ..operators import relational
from ..operators.selection import described
from ..operators.storage import written
from .corpus import Corpus
from .tables import Tables


def in_both(df: DataFrame, copies: str = "copies") -> DataFrame:
    """df twice, with population and w: full, where a row counts as often as it has copies, and unique."""
    pair = F.array(F.struct(F.lit("full").alias("population"), F.col(copies).cast("long").alias("w")), F.struct(F.lit("unique").alias("population"), F.lit(1).cast("long").alias("w")))
    return df.withColumn("_p", F.explode(pair)).select("*", "_p.population", "_p.w").drop("_p")


def _total(value: Column | int, name: str) -> Column:
    return F.sum(F.col("w") * value).cast("long").alias(name)


def _files(predicate: Column, name: str) -> Column:
    return F.sum(F.when(predicate, F.col("w")).otherwise(0)).cast("long").alias(name)


# -- placement by documented scope -----------------------------------------------------------------------


def scope_mapping(corpus: Corpus, folder: str = ".claude") -> dict[str, DataFrame]:
    """How files lie if a hidden folder speaks for the directory that holds it.

    Repositories and scopes are aggregated first, so that no pair of files is made: the pairs of direct and
    hidden files of a scope are products of counts.
    """
    path = F.col("path")
    form, scope, parts = paths.placement_form(path, folder), paths.logical_scope(path, folder), paths.directory_parts(path)
    files = corpus.population("exact").select("repo_full_name", "content_hash", scope.alias("scope"), form.alias("form"), (F.try_element_at(parts, F.lit(-1)) == folder).alias("exact_case"))
    files = written(files, "scopes")  # read several times here
    direct, hidden, root = F.col("form") == "direct", F.col("form") == "hidden", F.col("scope") == ""
    kinds = {
        "direct_files": direct,
        "hidden_files": hidden,
        "hidden_exact_case_files": hidden & F.col("exact_case"),
        "hidden_case_variant_files": hidden & ~F.col("exact_case"),
        "project_root_files": root,
        "nonroot_files": ~root,
        "project_root_direct_files": root & direct,
        "project_root_hidden_files": root & hidden,
        "project_root_hidden_exact_case_files": root & hidden & F.col("exact_case"),
        "project_root_hidden_case_variant_files": root & hidden & ~F.col("exact_case"),
    }
    per = files.groupBy("repo_full_name").agg(F.count("*").alias("files"), *[F.count_if(p).alias(name) for name, p in kinds.items()])
    has = lambda name: F.col(name) > 0
    repositories = {
        "direct_repositories": has("direct_files"),
        "hidden_repositories": has("hidden_files"),
        "project_root_direct_repositories": has("project_root_direct_files"),
        "project_root_hidden_repositories": has("project_root_hidden_files"),
        "project_root_either_repositories": has("project_root_files"),
        "project_root_both_repositories": has("project_root_direct_files") & has("project_root_hidden_files"),
        "project_root_hidden_only_repositories": has("project_root_hidden_files") & ~has("project_root_direct_files"),
    }
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    placement = per.agg(total("files").alias("files"), *[total(name).alias(name) for name in kinds], *[F.count_if(p).alias(name) for name, p in repositories.items()])
    for name in ("hidden", "project_root", "nonroot"):
        placement = placement.withColumn(f"{name}_share", text.share(F.col(f"{name}_files"), F.col("files")))
    named = F.when(has("project_root_files") & has("nonroot_files"), "project_root_and_nonroot").when(has("project_root_files"), "project_root_only").otherwise("nonroot_only")
    found = per.groupBy(named.alias("configuration")).agg(F.count("*").alias("repositories"), F.sum("files").alias("files"))
    configurations = corpus.session.createDataFrame([("project_root_only",), ("nonroot_only",), ("project_root_and_nonroot",)], "configuration string").join(F.broadcast(found), "configuration", "left").na.fill(0)
    every = Window.partitionBy()
    for name in ("repositories", "files"):
        configurations = configurations.withColumn(f"{name}_share", text.share(F.col(name), F.sum(name).over(every)))
    counted = lambda keys: files.groupBy(*keys).agg(F.count_if(direct).alias("d"), F.count_if(hidden).alias("h")).filter("d > 0 AND h > 0")
    groups, same = counted(["repo_full_name", "scope"]), counted(["repo_full_name", "scope", "content_hash"]).filter("content_hash IS NOT NULL")
    pairs = groups.agg(F.count("*").alias("scope_groups"), F.count_distinct("repo_full_name").alias("repositories"), F.count_if(root).alias("project_root_groups"), F.count_if(~root).alias("nonroot_groups"), F.coalesce(F.sum(F.col("d") * F.col("h")), F.lit(0)).alias("file_pairs"))
    equal = same.agg(F.coalesce(F.sum(F.col("d") * F.col("h")), F.lit(0)).alias("same_content_pairs"))
    # Both are one row.
    alternatives = pairs.withColumn("_k", F.lit(0)).join(F.broadcast(equal.withColumn("_k", F.lit(0))), "_k").drop("_k").withColumn("different_content_pairs", F.col("file_pairs") - F.col("same_content_pairs"))
    chains = relational.chain_lengths(files, "repo_full_name", F.col("scope"))
    nested = F.col("chain") > 1
    topology = chains.agg(F.count("*").alias("scopes"), F.count_if(nested).alias("edges"), F.count_distinct(F.when(nested, F.col("repo_full_name"))).alias("repositories_with_edges"), F.coalesce(F.max("chain"), F.lit(0)).alias("longest_chain"))
    depths = files.filter(~root).select(F.size(F.split("scope", "/")).alias("depth"))
    return Tables({"placement": placement, "configurations": configurations, "alternatives": alternatives, "topology": topology, "nonroot_depths": lambda: described(depths, "depth", "integer")})


# -- sections ------------------------------------------------------------------------------------------------

STYLES = ("empty", "list_only", "prose_only", "other_only", "list_and_prose", "list_and_other", "prose_and_other", "list_prose_and_other")
_DISTRIBUTION = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def distributions(long: DataFrame, by: list[str]) -> DataFrame:
    """by, count, total, minimum, q25 to q99, mean and maximum of rows value, w: weighted histograms, nearest rank."""
    histogram = stats.weighted_histogram(long, "value", "w", by)
    plain = histogram.groupBy(*by).agg(F.sum("weight").alias("count"), F.sum(F.col("value") * F.col("weight")).alias("total"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    return plain.withColumn("mean", F.col("total") / F.col("count")).join(stats.weighted_quantiles(histogram, _DISTRIBUTION, by), by)


def section_populations(own: DataFrame) -> dict[str, DataFrame]:
    """Totals with shares, styles, distributions and list items of sections. own: identity, copies, s (parsed structure)."""
    sections = F.col("s.sections")
    having = lambda test: F.size(F.filter(sections, test))
    summed = lambda c: F.aggregate(sections, F.lit(0).cast("long"), lambda a, b: a + b[c]).alias(c)
    files = own.select(
        "copies",
        F.size("s.headings").alias("sections"),
        F.col("s.top_level_sections").alias("top_level"),
        F.col("s.maximum_depth").alias("depth"),
        F.col("s.skipped_jumps").alias("jumps"),
        F.col("s.starts_below_h1").alias("below_h1"),
        F.col("s.h1_count").alias("h1"),
        F.col("s.empty_sections").alias("empty"),
        having(lambda b: b["list_items"] > 0).alias("list_sections"),
        having(lambda b: b["prose_blocks"] > 0).alias("prose_sections"),
        having(lambda b: b["other_lines"] > 0).alias("other_sections"),
        *[summed(c) for c in ("list_items", "unordered_items", "ordered_items", "task_items", "prose_blocks", "list_lines", "prose_lines", "other_lines")],
    )
    rows = in_both(files)
    headed = F.col("sections") > 0
    totals = rows.groupBy("population").agg(
        _total(1, "files"),
        _files(headed, "files_with_headings"),
        _files(~headed, "files_without_headings"),
        _total(F.col("sections"), "sections"),
        _files(F.col("jumps") > 0, "files_with_skipped_jumps"),
        _total(F.col("jumps"), "skipped_jumps"),
        _files(F.col("below_h1"), "files_starting_below_h1"),
        _files(F.col("h1") == 0, "files_without_h1"),
        _files(headed & (F.col("h1") == 0), "headed_files_without_h1"),
        _files(F.col("h1") > 1, "files_with_multiple_h1"),
        _files(F.col("empty") > 0, "files_with_empty_sections"),
        _total(F.col("empty"), "empty_sections"),
        _files(F.col("list_sections") > 0, "files_with_list_sections"),
        _files(F.col("prose_sections") > 0, "files_with_prose_sections"),
        _total(F.col("list_sections"), "sections_with_list_items"),
        _total(F.col("prose_sections"), "sections_with_prose"),
        _total(F.col("other_sections"), "sections_with_other"),
        *[_total(F.col(c), c) for c in ("list_items", "unordered_items", "ordered_items", "task_items", "prose_blocks", "list_lines", "prose_lines", "other_lines")],
    )
    totals = totals.withColumn("headed_share", text.ratio(F.col("files_with_headings"), F.col("files")))
    for name in ("files_with_skipped_jumps", "files_starting_below_h1", "headed_files_without_h1", "files_with_multiple_h1", "files_with_empty_sections", "files_with_list_sections", "files_with_prose_sections"):
        totals = totals.withColumn(f"{name}_share", text.ratio(F.col(name), F.col("files_with_headings")))
    for name in ("sections_with_list_items", "sections_with_prose", "sections_with_other"):
        totals = totals.withColumn(f"{name}_share", text.ratio(F.col(name), F.col("sections")))
    classified = F.col("list_lines") + F.col("prose_lines") + F.col("other_lines")
    for name in ("list", "prose", "other"):
        totals = totals.withColumn(f"{name}_line_share", text.ratio(F.col(f"{name}_lines"), classified))
    flat = in_both(own.select("copies", F.explode(sections).alias("b")).select("copies", "b.*"))
    names = own.sparkSession.createDataFrame([(p, s) for p in ("full", "unique") for s in STYLES], "population string, style string")
    styles = names.join(F.broadcast(flat.groupBy("population", "style").agg(F.sum("w").alias("sections"))), ["population", "style"], "left").na.fill(0)
    styles = styles.withColumn("share", text.ratio(F.col("sections"), F.sum("sections").over(Window.partitionBy("population"))))
    measure = lambda name, value, when=None: F.struct(F.lit(name).alias("measure"), (value if when is None else F.when(when, value)).cast("long").alias("value"))
    of_files = F.array(
        measure("sections_per_file", F.col("sections")),
        measure("sections_per_headed_file", F.col("sections"), headed),
        measure("top_level_sections_per_file", F.col("top_level")),
        measure("top_level_sections_per_headed_file", F.col("top_level"), headed),
        measure("maximum_depth_per_file", F.col("depth")),
        measure("maximum_depth_per_headed_file", F.col("depth"), headed),
        measure("skipped_jumps_per_file", F.col("jumps")),
    )
    of_sections = F.array(
        measure("section_lines", F.col("line_count")),
        measure("section_words", F.col("word_count")),
        measure("list_items_per_section", F.col("list_items")),
        measure("list_items_per_list_section", F.col("list_items"), F.col("list_items") > 0),
        measure("prose_blocks_per_section", F.col("prose_blocks")),
    )
    long = lambda df, values: df.select("population", "w", F.explode(values).alias("m")).select("population", "w", "m.measure", "m.value").filter("value IS NOT NULL")
    spread = distributions(long(rows, of_files).unionByName(long(flat, of_sections)), ["population", "measure"])
    items = flat.groupBy("population", F.col("list_items").alias("value")).agg(F.sum("w").alias("sections"))
    words = F.sort_array(F.transform(sections, lambda b: b["word_count"]))
    families = own.select("identity", "copies", F.size(words).alias("sections"), *stats.triple(words))
    return {"populations": totals, "population_styles": styles, "distributions": spread, "list_item_histogram": items, "families": families}


# -- paragraph languages ----------------------------------------------------------------------------------


def document_classes(joined: DataFrame, eligible: Column, config) -> DataFrame:
    """joined with reason, language and class of each document. joined: accepted (words), ranked (languages by words, first place)."""
    share = F.try_divide(-F.try_element_at("ranked", F.lit(1))["o"], F.col("accepted"))
    second = -F.try_element_at("ranked", F.lit(2))["o"]
    reason = (
        F.when(eligible == 0, "no_eligible_prose")
        .when(F.col("accepted") < config.min_document_words, "insufficient_accepted_words")
        .when(F.col("accepted") / eligible < config.min_coverage, "low_accepted_word_coverage")
        .when(share >= config.dominant_share, "dominant_language")
        .when((second / F.col("accepted") >= config.secondary_share) & (second >= config.secondary_words), "multiple_substantial_languages")
        .otherwise("no_dominant_or_substantial_secondary_language")
    )
    out = joined.withColumn("reason", reason).withColumn("language", F.when(F.col("reason") == "dominant_language", F.try_element_at("ranked", F.lit(1))["language"]))
    return out.withColumn("class", F.when(F.col("reason") == "dominant_language", "primary").when(F.col("reason") == "multiple_substantial_languages", "multilingual").otherwise("unknown"))


def ranked_languages(agreed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accepted, ranked: words of accepted paragraphs (rows language, words, index) and the languages by them."""
    by = agreed.groupBy(*keys, "language").agg(F.sum("words").alias("w"), F.min("index").alias("at"))
    return by.groupBy(*keys).agg(F.sum("w").alias("accepted"), F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "at", "language"))).alias("ranked"))


def language_populations(docs: DataFrame, rows: DataFrame, agreed: DataFrame, sure: DataFrame, documents: DataFrame, config) -> dict[str, DataFrame]:
    """Counts and shares of paragraphs, documents and languages for both populations, and at each threshold.

    docs: identity, copies, p (all paragraphs); rows: eligible paragraphs with their decision d; agreed: accepted
    ones with language; sure: identity, copies, threshold, language, words, index of those accepted at a threshold;
    documents: identity, copies, eligible_words, reason, language, class.
    """
    extracted = docs.select("copies", F.size("p").alias("extracted"), F.size(F.filter("p", lambda x: x["eligible"])).alias("eligible"), F.aggregate(F.filter("p", lambda x: x["eligible"]), F.lit(0), lambda a, x: a + x["words"]).alias("eligible_words"))
    files = in_both(extracted).groupBy("population").agg(_total(1, "files"), _total(F.col("extracted"), "extracted"), _total(F.col("eligible"), "eligible"), _total(F.col("eligible_words"), "eligible_words"), _files(F.col("eligible") > 0, "documents_with_eligible_prose"))
    agreeing, stable, accepted = F.col("d.first.language") == F.col("d.second.language"), F.col("d.stable"), F.col("d.decision") == "accepted"
    paragraphs = in_both(rows).groupBy("population").agg(_files(agreeing, "agreements"), _files(agreeing & stable, "stable_agreements"), _files(accepted, "accepted"), F.sum(F.when(accepted, F.col("w") * F.col("words")).otherwise(0)).cast("long").alias("accepted_words"))
    totals = files.join(F.broadcast(paragraphs), "population", "left").na.fill(0)
    for name, part, whole in (
        ("documents_with_eligible_prose_share", "documents_with_eligible_prose", "files"),
        ("eligible_share", "eligible", "extracted"),
        ("agreement_share", "agreements", "eligible"),
        ("stable_agreement_share", "stable_agreements", "eligible"),
        ("accepted_share", "accepted", "eligible"),
        ("accepted_word_coverage", "accepted_words", "eligible_words"),
    ):
        totals = totals.withColumn(name, text.ratio(F.col(part), F.col(whole)))
    count = lambda df, what, key: in_both(df).groupBy("population", F.lit(what).alias("what"), F.col(key).alias("key")).agg(F.sum("w").alias("n"))
    kinds = [
        count(rows.select("copies", F.col("d.decision").alias("k")), "paragraph_decision", "k"),
        count(documents.select("copies", F.col("class").alias("k")), "document_class", "k"),
        count(documents.select("copies", F.col("reason").alias("k")), "document_decision", "k"),
        count(documents.filter("language IS NOT NULL").select("copies", F.col("language").alias("k")), "primary_language", "k"),
        count(agreed.select("copies", F.col("language").alias("k")), "accepted_paragraphs", "k"),
        count(agreed.select("identity", "copies", F.col("language").alias("k")).distinct(), "documents_with_language", "k"),
        in_both(agreed).groupBy("population", F.lit("accepted_words").alias("what"), F.col("language").alias("key")).agg(_total(F.col("words"), "n")),
    ]
    counts = kinds[0]
    for more in kinds[1:]:
        counts = counts.unionByName(more)
    counts = written(counts, "language-counts")
    counts = counts.withColumn("share", text.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("population", "what"))))
    levels = F.array(*[F.lit(t) for t in config.thresholds])
    at = in_both(sure).groupBy("population", "threshold", "language").agg(F.sum("w").alias("paragraphs"), _total(F.col("words"), "words"))
    at = at.withColumn("word_share", text.ratio(F.col("words"), F.sum("words").over(Window.partitionBy("population", "threshold"))))
    every = documents.select("identity", "copies", "eligible_words", F.explode(levels).alias("threshold"))
    joined = every.join(ranked_languages(sure, ["identity", "threshold"]), ["identity", "threshold"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    classed = document_classes(joined, F.col("eligible_words"), config)
    classes = in_both(classed).groupBy("population", "threshold", "class", "reason", "language").agg(F.sum("w").alias("documents"))
    classes = classes.withColumn("share", text.ratio(F.col("documents"), F.sum("documents").over(Window.partitionBy("population", "threshold"))))
    wide = counts.filter(F.col("what").isin("accepted_words", "accepted_paragraphs", "documents_with_language", "primary_language")).withColumn("column", F.concat_ws("_", "what", "population"))
    names = [f"{w}_{p}" for p in ("full", "unique") for w in ("accepted_words", "accepted_paragraphs", "documents_with_language", "primary_language")]
    table = wide.groupBy(F.col("key").alias("language")).pivot("column", names).agg(F.sum("n")).na.fill(0).filter("accepted_words_full > 0 OR accepted_words_unique > 0")
    for name in names:
        if not name.startswith("documents"):
            table = table.withColumn(f"{name}_share", text.ratio(F.col(name), F.sum(name).over(Window.partitionBy())))
    table = table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accepted_words_full"), F.desc("primary_language_full"), "language")))
    return {"populations": totals, "counts": counts, "thresholds": at, "threshold_documents": classes, "language_table": table}
