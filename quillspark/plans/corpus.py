"""The corpus: repositories, files and per-file analysis results, and how it is bound to data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import paths, text
from ..operators.storage import spread, tidy

SCHEMAS = {
    "repos": "full_name string, stars int, language string, fetched_at string",
    "files": "id long, repo_full_name string, path string, tool_id string, html_url string, content string, content_hash string, size_bytes long, fetched_at string",
    "analysis": "file_id long, analyzer_id string, result_json string",
}
#: Fixed value: the name of the studied files.
TARGET = "CLAUDE.md"
STRUCTURE_JSON = "line_count int, word_count int, char_count int, header_count int, max_header_depth int, headers array<string>, code_block_count int, code_block_languages map<string,int>, bullet_count int, link_count int"
NOTATION_JSON = "any_notation_detected boolean, notation_count_total int, notations_summary map<string,struct<count:int,confidences:array<string>,subtypes:array<string>>>, detections array<struct<notation_id:string,notation_name:string,subtype:string,confidence:string,detected_via:string,snippet:string>>"


def fitted(df: DataFrame, name: str) -> DataFrame:
    """df with all columns of a base table: missing ones are null."""
    have = {c.lower(): c for c in df.columns}
    want = T._parse_datatype_string(SCHEMAS[name])
    return df.select(*[(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


@dataclass(frozen=True)
class Corpus:
    repos: DataFrame
    files: DataFrame
    analysis: DataFrame | None = None
    #: A folder where parser results are kept from run to run (see sources.results).
    store: str | None = None

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Corpus:
        """A corpus of Parquet tables repos, files and analysis in a folder."""
        return cls(*[fitted(spark.read.parquet(f"{folder}/{n}"), n) for n in SCHEMAS])

    @property
    def session(self) -> SparkSession:
        return self.files.sparkSession

    def population(self, scope: str = "exact", target: str = TARGET, tool: str | None = None) -> DataFrame:
        """Files of a named population: exact, strict, other, markdown or all."""
        path = F.col("path")
        chosen: dict[str, Column] = {"exact": paths.named(path, target), "strict": paths.named_exactly(path, target), "other": ~paths.named(path, target), "markdown": paths.has_suffix(path), "all": F.lit(True)}
        files = self.files.filter(chosen[scope])
        return files.filter(F.col("tool_id") == tool) if tool else files

    def structures(self) -> DataFrame:
        """file_id and the fields of the stored structure results; a result that doesn't parse raises."""
        rows = self.analysis.filter(F.col("analyzer_id") == "structure")
        return rows.select("file_id", F.from_json("result_json", STRUCTURE_JSON, {"mode": "FAILFAST"}).alias("s")).select("file_id", "s.*")

    def notations(self) -> DataFrame:
        rows = self.analysis.filter(F.col("analyzer_id") == "notation")
        return rows.select("file_id", F.from_json("result_json", NOTATION_JSON, {"mode": "FAILFAST"}).alias("s")).select("file_id", "s.*")


def structure_fields(content: Column) -> dict[str, Column]:
    """The structure analysis as plain columns, by patterns alone."""
    heads = F.regexp_extract_all(content, F.lit("(?md)^(#{1,6})\\s+(.*)$"), F.lit(1))
    tags = F.transform(F.regexp_extract_all(content, F.lit("(?md)^```(\\S*)\\s*\\n(?s:.*?)^```"), F.lit(1)), lambda x: F.when(x == "", text.UNTAGGED).otherwise(F.lower(x)))
    return {
        "line_count": F.size(text.lines(content)),
        "word_count": text.word_count(content),
        "char_count": F.length(content),
        "header_count": F.size(heads),
        "max_header_depth": F.coalesce(F.array_max(F.transform(heads, F.length)), F.lit(0)),
        "code_block_count": F.size(tags),
        "code_block_tags": tags,
        "bullet_count": F.regexp_count(content, F.lit("(?md)^\\s*[-*+]\\s+")),
        "link_count": F.regexp_count(content, F.lit("\\[[^\\]]+\\]\\([^)]+\\)")),
    }


#: Characters of contents and of their results (stored as bytes) that a task keeps, and characters of contents whose results are open at a time.
_KNOWN_CHARS, _OPEN_CHARS = 4 << 20, 1 << 20


class _Known:
    """Results of the last contents, stored as bytes: as objects, the facts of a content take many times its size."""

    def __init__(self, parser: Callable[[str], object], limit: int):
        self.parser, self.limit, self.size, self.rows = parser, limit, 0, {}

    def __call__(self, content: str | None) -> object:
        if content is None:
            return None
        stored = self.rows.get(content)
        if stored is not None:
            return pickle.loads(stored)
        result = self.parser(content)
        stored = pickle.dumps(result, pickle.HIGHEST_PROTOCOL)
        own = len(content) + len(stored)
        if self.size + own > self.limit:
            self.rows, self.size = {}, 0
        if own <= self.limit:
            self.rows[content] = stored
            self.size += own
        return result


def _stretches(contents: pa.Array, limit: int, most: int = 200) -> Iterator[tuple[int, int]]:
    """Beginnings and lengths of stretches of contents of at most limit bytes and most rows, one at least."""
    sizes, begin, size = pc.fill_null(pc.binary_length(contents), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (size + n > limit or i - begin == most):
            yield begin, i - begin
            begin, size = i, 0
        size += n
    if sizes:
        yield begin, len(sizes) - begin


def parsed(files: DataFrame, parser: Callable[[str], object], kind: str, name: str = "parsed", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of files (all by default) with a column of parser(content); null for rows without content.

    kind: the column's type as DDL. Contents are parsed where the scan has put them, and no exchange carries
    them. A task parses a content once, as long as it is among the last ones of some MB (with its result), so many copies cost
    little. Results leave the task by stretches of some MB of contents.
    """
    keep = keep or files.columns
    slim = files.select(*keep, F.col("content").alias("_content"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(parser, _KNOWN_CHARS)
        for batch in batches:
            for i, n in _stretches(batch.column(len(keep)), _OPEN_CHARS):
                part = batch.slice(i, n)
                values = [known(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values, arrow.field(name).type)], schema=arrow)

    return slim.mapInArrow(tidy(run), schema)


def parsed_once(corpus: Corpus, contents: DataFrame, parser: Callable[[str], object], kind: str, name: str, keep: list[str], store: tuple[str, str], key: str = "identity") -> DataFrame:
    """As parsed(), but through the corpus's store, if it has one: what the parser of that name and version knows isn't parsed again."""
    if corpus.store is None:
        return parsed(contents, parser, kind, name, keep)
    from ..sources.results import ResultStore

    known = ResultStore(corpus.session, corpus.store, *store, kind)
    known.fill(contents.select(key, "content"), lambda new: parsed(new, parser, kind, "result", [key]), key)
    return contents.select(*keep).join(known.rows().select(F.col("key").alias(key), F.col("result").alias(name)), key, "left")


# The driver's tables carry no markup or paths; this binding adds both by rule, in Spark and in SQL alike.

_TREE = "CASE WHEN k = 0 THEN '' WHEN k <= 3 THEN 'p' || k || '/' WHEN k <= 12 THEN 'p' || ((k - 1) {div} 3) || '/p' || k || '/' ELSE 'p' || (((k - 1) {div} 3 - 1) {div} 3) || '/p' || ((k - 1) {div} 3) || '/p' || k || '/' END"
_NAME = "CASE id % 13 WHEN 4 THEN 'claude.MD' WHEN 7 THEN 'README.md' WHEN 9 THEN 'notes.txt' ELSE 'CLAUDE.md' END"
#: Some slots lie one directory deeper, so that ancestors are missing; some, and all copies, in the hidden folder.
_FOLDER = "CASE WHEN k % 7 = 5 THEN 'aside/' ELSE '' END || CASE WHEN k % 11 = 3 OR c = 1 THEN '.claude/' ELSE '' END"
#: A tenth of the documents have a second file, with the same content or one more line.
_COPIES = "CASE WHEN id % 10 = 6 THEN [0, 1] ELSE [0] END"
_MORE = "CASE WHEN c = 1 AND id % 20 = 6 THEN text || chr(10) || 'one more line' ELSE text END"
#: Copies' ids follow after so many.
_COPY_IDS = 10_000_000_000
_LINE = """CASE (i + id) % 8
 WHEN 0 THEN repeat('#', CAST(1 + ((i + id) {div} 8) % 4 AS INT)) || ' ' || CASE WHEN id % 6 = 1 THEN 'Claude-specific notes' ELSE l END
 WHEN 1 THEN '- ' || l
 WHEN 2 THEN '- [ ] ' || l
 WHEN 3 THEN '```' || CASE ((i + id) {div} 8) % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'py' WHEN 2 THEN 'json' WHEN 3 THEN '' WHEN 4 THEN 'ts' ELSE 'mermaid' END
 WHEN 5 THEN '```'
 WHEN 6 THEN CASE WHEN id % 4 = 0 THEN 'Always read [guide](../docs/g' ELSE '[guide](docs/g' END || (id % 7) || '.md) ' || l
 WHEN 7 THEN CASE WHEN id % 3 = 1 THEN '@AGENTS.md' ELSE '@docs/setup' || (id % 5) || '.md' END
 ELSE l END"""


#: Another way to write a document's lines, with what the first one leaves out: bare paths, addresses, comments, code spans, links to the
#: file itself and to files above and below, imports in running text and of the home folder. A tilde fence hides what follows until the next one.
NOTES = """CASE (i + id) % 16
 WHEN 0 THEN '# ' || l
 WHEN 1 THEN 'Read docs/x' || (id % 9) || '.md first'
 WHEN 2 THEN 'see [site](https://example.org/p' || (id % 9) || '.md) now'
 WHEN 3 THEN '<!-- @hidden' || (id % 9) || '.md -->'
 WHEN 4 THEN '[me](CLAUDE.md) here'
 WHEN 5 THEN 'use `@span' || (id % 9) || '.md` now'
 WHEN 6 THEN '~~~'
 WHEN 7 THEN '@fenced' || (id % 9) || '.md'
 WHEN 8 THEN 'docs/fenced' || (id % 9) || '.md'
 WHEN 9 THEN '~~~'
 WHEN 10 THEN '@docs/a' || (id % 9) || '.md'
 WHEN 11 THEN 'https://example.org/bare' || (id % 9) || '.md'
 WHEN 12 THEN '[up](../CLAUDE.md)'
 WHEN 13 THEN '[down](.claude/CLAUDE.md) and more'
 WHEN 14 THEN '- see @docs/li' || (id % 9) || '.md and go'
 ELSE CASE WHEN id % 2 = 1 THEN '@~/home' || (id % 9) || '.md' ELSE l END END"""


def bind(spark: SparkSession, sf_dir: str, lines: str = _LINE) -> Corpus:
    """The corpus of a folder of test tables: documents as Markdown files of synthetic repositories, one per source and 40 slots.

    Every document is a file, and some are two. lines: how a line l (number i, from 0) of a document is written.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = docs.selectExpr("doc_id AS id", "source || '/r' || (doc_id div 800) AS repo_full_name", "(doc_id div 20) % 40 AS k", "text", "lang")
    repos = base.groupBy("repo_full_name").agg(F.min("id").alias("m"), F.max("lang").alias("lang"))
    repos = repos.selectExpr("repo_full_name AS full_name", "CASE WHEN m % 7 = 3 THEN NULL ELSE CAST((m * 37) % 5000 AS INT) END AS stars", "CASE WHEN m % 11 = 5 THEN NULL ELSE lang END AS language")
    tree, line = _TREE.format(div="div"), lines.format(div="div")
    files = base.selectExpr("*", f"explode({_COPIES.replace('[', 'array(').replace(']', ')')}) AS c").selectExpr(
        f"id + c * {_COPY_IDS} AS id",
        "repo_full_name",
        f"({tree}) || {_FOLDER} || ({_NAME}) AS path",
        "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS tool_id",
        f"array_join(transform(split({_MORE}, '\\n', -1), (l, i) -> {line}), '\\n') AS content",
        "lang",
    )
    files = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content").cast("long"))
    return Corpus(fitted(repos, "repos"), fitted(files, "files"))


def corpus_sql(lines: str = _LINE) -> str:
    """The same in SQL: repos, files, and exact, those of the exact population."""
    return f"""
WITH base AS (SELECT doc_id AS id, source || '/r' || (doc_id // 800) AS repo, (doc_id // 20) % 40 AS k, text, lang FROM documents),
repos AS (SELECT repo AS full_name, CASE WHEN min(id) % 7 = 3 THEN NULL ELSE CAST((min(id) * 37) % 5000 AS INT) END AS stars, CASE WHEN min(id) % 11 = 5 THEN NULL ELSE max(lang) END AS language FROM base GROUP BY repo),
copied AS (SELECT *, unnest({_COPIES}) AS c FROM base),
named AS (SELECT id, c, repo, ({_TREE.format(div="//")}) || {_FOLDER} || ({_NAME}) AS path, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS tool_id, {_MORE} AS text FROM copied),
marked AS (SELECT id + c * {_COPY_IDS} AS id, repo, path, tool_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, j: {lines.format(div="//").replace("(i + id)", "(j - 1 + id)")}), chr(10)) AS content FROM named),
files AS (SELECT *, sha256(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS size_bytes FROM marked),
exact AS (SELECT * FROM files WHERE lower(path) = 'claude.md' OR lower(path) LIKE '%/claude.md')
"""


CORPUS_SQL = corpus_sql()
