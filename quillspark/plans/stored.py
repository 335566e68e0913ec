"""Stored analysis results as Variants: parsed once whatever they hold, fields taken by path, and what is missing told by file.

A result that isn't JSON, or lacks a field that is demanded, raises when its row is read, and names the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from .tables import Tables

#: Notations that are diagrams by their own mark.
DIAGRAMS = ("mermaid", "plantuml", "graphviz", "d2")
#: The sizes of a file that its structure result has.
SIZES = ("line_count", "word_count", "char_count")
#: What is read of a notation's summary and of a record; a member of another kind is null, as one that is missing.
_MEMBER = "struct<count:bigint,confidences:array<string>,subtypes:array<string>>"
_RECORD = "struct<notation_id:string,confidence:string,detected_via:string>"


def _refused(what: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit("file "), F.col("file_id").cast("string"), F.lit(f" {what}"))).cast(kind)


def variants(analysis: DataFrame, analyzer: str) -> DataFrame:
    """file_id, v of the stored results of an analyzer; a null result is left out."""
    rows = analysis.filter((F.col("analyzer_id") == analyzer) & F.col("result_json").isNotNull())
    return rows.select("file_id", F.coalesce(F.try_parse_json("result_json"), _refused("has a result that is no JSON", "variant")).alias("v"))


def field(v: Column, path: str, kind: str, otherwise) -> Column:
    """A member of a Variant, or else a value, if it is missing, null or of another kind."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", kind), F.lit(otherwise).cast(kind))


def _several(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def demanded(v: Column, path: str, kind: str) -> Column:
    """A member of a result that must be there."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", kind), _refused(f"lacks {path}", kind))


def observations(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """file_id, path, size_bytes and SIZES of files (id, path, size_bytes) with a structure result; one that is missing or below zero raises."""
    found = variants(analysis, "structure").select("file_id", *[demanded(F.col("v"), c, "bigint").alias(c) for c in SIZES])
    rows = files.select(F.col("id").alias("file_id"), "path", "size_bytes").join(found, "file_id")
    whole = rows.withColumn("size_bytes", F.coalesce(F.col("size_bytes").cast("bigint"), _refused("lacks size_bytes", "bigint")))
    return whole.withColumn("size_bytes", F.when(F.least("size_bytes", *SIZES) >= 0, F.col("size_bytes")).otherwise(_refused("has a size below zero", "bigint")))


def size_panels(observed: DataFrame, per_token: float = 3.5, multiplier: float = 1.0) -> DataFrame:
    """panel, value, files, percent: the distribution functions of bytes, lines, words and estimated tokens, by one pass over the files.

    Files are counted by value before the exchange; what is added up in order are the distinct values of each panel.
    """
    panels = {"bytes": F.col("size_bytes"), "lines": F.col("line_count"), "words": F.col("word_count"), "tokens": text.tokens(F.col("char_count"), per_token, multiplier)}
    each = F.array(*[F.struct(F.lit(n).alias("panel"), x.cast("bigint").alias("value")) for n, x in panels.items()])
    counted = stats.weighted_histogram(observed.select(F.explode(each).alias("p")).select("p.*"), "value", by=["panel"])
    summed = stats.running(counted, ["panel"])
    return summed.select("panel", "value", F.col("weight").alias("files"), (F.lit(100.0) * F.col("upto") / F.col("all")).alias("percent"))


def notation_rollup(analysis: DataFrame) -> Tables:
    """Stored notation results added up, whatever notations they name.

    totals: files, those with any notation, with a diagram of high confidence, with more detections than are kept, and how many records that leaves out.
    notations: occurrences, files, records kept and left out of each. details: files by notation and confidence or subtype.
    kept: kept records by confidence and by how they were detected; what a record lacks is "?".
    Missing members are empty, and missing counts zero. A member of a result stays beside its records, so nothing is joined, and
    a file has each notation once, so its files are counted without a distinct.
    """
    rows, v, d = variants(analysis, "notation"), F.col("v"), F.col("d")
    members = F.coalesce(F.try_variant_get(v, "$.notations_summary", f"map<string,{_MEMBER}>"), F.create_map().cast(f"map<string,{_MEMBER}>"))
    member = lambda key, x: F.struct(key.alias("notation"), F.coalesce(x["count"], F.lit(0)).alias("n"), *[F.coalesce(x[c], F.array().cast("array<string>")).alias(c) for c in ("confidences", "subtypes")])
    record = lambda x: F.struct(*[F.coalesce(x[path], F.lit("?")).alias(name) for path, name in (("notation_id", "notation"), ("confidence", "confidence"), ("detected_via", "via"))])
    one = rows.select(
        field(v, "any_notation_detected", "boolean", False).alias("any"),
        field(v, "notation_count_total", "bigint", 0).alias("total"),
        F.transform(F.map_entries(members), lambda e: member(e["key"], e["value"])).alias("m"),
        F.transform(_several(v, "detections", _RECORD), record).alias("d"),
    )
    # Spark would infer a filter on the size of what an inner explode takes, and parse again for it.
    each = one.select("d", F.explode_outer("m").alias("m")).filter("m IS NOT NULL").select("m.*", F.size(F.filter(d, lambda x: x["notation"] == F.col("m.notation"))).alias("kept"))
    sure = F.exists("m", lambda m: m["notation"].isin(*DIAGRAMS) & F.array_contains(m["confidences"], "high"))
    over = F.greatest(F.col("total") - F.size(d), F.lit(0))
    marked = lambda what, values: F.transform(values, lambda x: F.struct(F.lit(what).alias("what"), x.alias("value")))
    told = F.concat(marked("confidence", "confidences"), marked("subtype", "subtypes"))
    # Files say much the same of a notation: they are counted by all that they say before it is taken apart.
    alike = each.groupBy("notation", "confidences", "subtypes").agg(F.count("*").alias("files"))
    facts = F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"d.{c}").alias("value")) for c in ("confidence", "via")])
    return Tables(
        {
            "totals": one.agg(F.count("*").alias("files"), F.count_if("any").alias("files_with_any"), F.count_if(sure).alias("files_with_sure_diagram"), F.count_if(over > 0).alias("capped_files"), F.coalesce(F.sum(over), F.lit(0)).alias("omitted")),
            "notations": each.groupBy("notation").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"), F.sum("kept").alias("kept"), F.sum(F.greatest(F.col("n") - F.col("kept"), F.lit(0))).alias("omitted")),
            "details": alike.select("notation", "files", F.explode(told).alias("x")).groupBy("notation", "x.what", "x.value").agg(F.sum("files").alias("files")),
            "kept": one.select(F.explode_outer("d").alias("d")).filter("d IS NOT NULL").select(F.explode(facts).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("records")),
        }
    )
