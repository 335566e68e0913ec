"""A corpus-cleaning pipeline: each stage works on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever columns docs has. Any stage takes an empty table, null and repeated ids,
and null, empty and very long texts; what each makes of them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op01_decontamination, op06_toxicity, op09_packing, op10_quality, similar
from quillspark.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Each row is judged by its own text, so repeated rows share their fate; null and wordless texts stay.
    Without labels nothing goes.
    """
    return op06_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Each row is judged by its own text; null and wordless ones are one passage without features, and share
    their fate. Without labels nothing goes.
    """
    return op10_quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word similarity of 0.8 or more, that of the smallest id.

    Null and wordless texts are copies of each other, and texts of fewer than five words of equal ones. If ids
    are null or repeat, the rows are numbered, and the first row stays.
    """
    return similar.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of any benchmark item. Null and wordless texts stay; repeated rows share their fate; no items drop nothing."""
    return op01_decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null text is an empty one and has the closing id alone; null ids stay null; no rows give no pieces."""
    return op09_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained classifiers and a byte-pair tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}-{name}")
    return docs
