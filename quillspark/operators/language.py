"""Language models that Spark fits on labelled texts and applies where the texts are.

Features are sequences of three characters of words with their letter case and marks ("characters"), or words in
lower case ("words"). Fitting counts features by language, keeps the most frequent ones and
gives each a whole number per language, a thousand times its logarithm. A text's numbers are added
up, so its scores don't depend on the order of the sum. No feature reaches beyond a run of characters without space
("token"): tokens are counted and scored once each, not wherever they stand. The table of a model is of bounded size
and is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .storage import tidy, written

#: Features of a model at most, and the least number of times that a feature occurs in training.
FEATURES, LEAST = 50_000, 5
#: Labels at most; more are an error.
LANGUAGES = 200
#: Features that make a prediction sharper; more of them say the same again.
EVIDENCE = 12
KINDS = ("characters", "words")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SPACE = "[\\x09-\\x0D\\x20]+"


def features(text: Column, kind: str) -> Column:
    """The features of a text, repeats included; work grows with its length."""
    if kind == "words":
        return F.transform(F.regexp_extract_all(text, F.lit("\\p{L}+"), F.lit(0)), F.lower)
    if kind != "characters":
        raise ValueError(f"no such features: {kind}")
    bordered = F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(bordered, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, 3))))


@dataclass(frozen=True)
class LanguageModel:
    """table: feature and scores (array of whole numbers in the order of languages); at most FEATURES rows."""

    kind: str
    languages: list[str]
    table: DataFrame


def labelled_tokens(texts: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """label, token, n: how often each run of characters without space occurs in texts of each label; rows with a null text or label don't count."""
    known = texts.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    each = known.select(F.col(label_col).alias("label"), F.explode(F.split(text_col, _SPACE)).alias("token"))
    return written(each.groupBy("label", "token").agg(F.count("*").alias("n")), "language-tokens")


def fit(texts: DataFrame, kind: str, text_col: str = "text", label_col: str = "lang", limit: int = FEATURES, least: int = LEAST, counted: DataFrame | None = None) -> LanguageModel:
    """A model of labelled texts: rows with a null text or label don't count.

    Features are counted by partial aggregates; only counts are exchanged. The most frequent ones stay (of equal ones the first by text),
    if they occur often enough. Unseen pairs count as half an occurrence. counted: labelled_tokens() of the texts, for several kinds.
    """
    tokens = labelled_tokens(texts, text_col, label_col) if counted is None else counted
    counts = tokens.select("label", "n", F.explode(features(F.col("token"), kind)).alias("feature")).groupBy("feature", "label").agg(F.sum("n").alias("n"))
    counts = written(counts, f"language-{kind}")
    languages = sorted(r["label"] for r in counts.select("label").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    by = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)], F.sum("n").alias("n"))
    kept = written(by.filter(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(limit), f"language-kept-{kind}")
    total = kept.agg(F.count("*").alias("kinds"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(languages))]).first()
    score = lambda i: F.round(1000 * F.log((F.col(f"n{i}") + F.lit(0.5)) / F.lit(total[f"t{i}"] + 0.5 * total["kinds"]))).cast("long")
    scores = F.array(*[score(i) for i in range(len(languages))]) if languages else F.array().cast("array<bigint>")
    return LanguageModel(kind, languages, written(kept.select("feature", scores.alias("scores")), f"language-model-{kind}"))


class _TokenScores:
    """Of texts, the number of known features and the sums of their scores. Each distinct token of some texts is scored once."""

    def __init__(self, kind: str, languages: int, table: dict[str, list[int]]):
        self.kind, self.width = kind, languages + 1
        # The last row is that of a feature that isn't known.
        known = sorted(table, key=self._code) if kind == "characters" else list(table)
        self.values = np.array([[1, *table[f]] for f in known] + [[0] * self.width], np.int64).T.copy()
        self.codes = np.array([*map(self._code, known), 1 << 62], np.int64) if kind == "characters" else None
        self.rows = {f: i for i, f in enumerate(known)}

    @staticmethod
    def _code(three: str) -> int:
        return (ord(three[0]) << 42) | (ord(three[1]) << 21) | ord(three[2])

    @staticmethod
    def _summed(values: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each row of values, the sums of what stands at the numbers between the ends."""
        upto, out = np.zeros(len(at) + 1, np.int64), np.empty((len(values), len(ends) - 1), np.int64)
        for k, own in enumerate(values):
            np.cumsum(own[at], out=upto[1:])
            out[k] = np.diff(upto[ends])
        return out

    def _of_characters(self, tokens: list[str]) -> np.ndarray:
        """Sequences of three characters of all tokens at once, as one number each; those that reach from one token into the next are unknown."""
        at = np.frombuffer(f" {' '.join(tokens)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        three = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
        three[ends[:-1] - 1] = -1
        found = np.searchsorted(self.codes, three)
        found[self.codes[found] != three] = len(self.codes) - 1
        ends[-1] -= 1
        return self._summed(self.values, found, np.concatenate([[0], ends]))

    def _of_words(self, tokens: list[str]) -> np.ndarray:
        none, owners, found = len(self.rows), [], []
        for i, t in enumerate(tokens):
            for w in (t,) if t.isalpha() else _NO_LETTERS.split(t):
                # Numbers other than digits are no letters either.
                for x in (w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split():
                    if (row := self.rows.get(x.lower(), none)) != none:
                        owners.append(i)
                        found.append(row)
        return self._summed(self.values, np.array(found, np.int64), np.searchsorted(owners, np.arange(len(tokens) + 1)))

    def sums(self, texts: pa.Array) -> pa.Array:
        parts = pc.ascii_split_whitespace(texts)
        ends, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        tokens = coded.dictionary.to_pylist()
        each = np.zeros((self.width, 0), np.int64) if not tokens else self._of_characters(tokens) if self.kind == "characters" else self._of_words(tokens)
        own = self._summed(each, coded.indices.to_numpy(), ends).T
        return pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * self.width, own.ravel())


def predictions(rows: DataFrame, keep: list[str], asked: dict[str, tuple[str, LanguageModel]], evidence: int = EVIDENCE) -> DataFrame:
    """keep and, under each name asked for, language, confidence, margin of a text column by a model: und with 0 for a text without known features, or null.

    A text is scored where it is, in one pass for all that is asked; nothing is exchanged. Tables of models (at most FEATURES rows) pass through the driver to be broadcast.
    Confidence is the best language's share of the likelihood, taken to the mean of at most so many features; margin is
    what it has beyond the second one. Of equal scores the first language by name counts.
    """
    models = {id(m): m for _, m in asked.values()}
    tables = {k: (m.kind, len(m.languages), {r["feature"]: list(r["scores"]) for r in m.table.collect()}) for k, m in models.items()}
    sent = rows.sparkSession.sparkContext.broadcast(tables)
    which = [id(m) for _, m in asked.values()]
    slim = rows.select(*keep, *[F.col(c).alias(f"_t{i}") for i, (c, _) in enumerate(asked.values())])
    schema = T.StructType([*slim.schema.fields[: len(keep)], *[T.StructField(f"_t{i}", T.ArrayType(T.LongType(), False)) for i in range(len(asked))]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = {k: _TokenScores(*table) for k, table in sent.value.items()}
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                own = [scores[k].sums(part.column(len(keep) + j)) for j, k in enumerate(which)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[x.cast(arrow.field(f"_t{j}").type) for j, x in enumerate(own)]], schema=arrow)

    found = slim.mapInArrow(tidy(run), schema)
    return found.select(*keep, *[_told(F.col(f"_t{i}"), m.languages, evidence).alias(name) for i, (name, (_, m)) in enumerate(asked.items())])


def _told(sums: Column, languages: list[str], evidence: int) -> Column:
    """language, confidence, margin from the number of a text's known features and their sums by language."""
    n = len(languages)
    if not n:
        return F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("margin"))
    count, own = sums[0], [sums[i + 1] for i in range(n)]
    best = F.greatest(*own) if n > 1 else own[0]
    odds = F.array(*[F.exp((x - best) / 1000.0 / count * F.least(count, F.lit(evidence))) for x in own])
    whole = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    first = F.coalesce(*[F.when(x == best, F.lit(name)) for x, name in zip(own, languages, strict=True)])
    second = F.element_at(F.sort_array(odds, asc=False), 2) if n > 1 else F.lit(0.0)
    told = count > 0
    said = {"language": (first, "und"), "confidence": (F.lit(1.0) / whole, 0.0), "margin": ((F.lit(1.0) - second) / whole, 0.0)}
    return F.struct(*[F.when(told, x).otherwise(F.lit(none)).alias(name) for name, (x, none) in said.items()])


def predict(rows: DataFrame, keys: list[str], model: LanguageModel, text_col: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """keys, language, confidence, margin for each row, by one model (see predictions)."""
    return predictions(rows, keys, {"_said": (text_col, model)}, evidence).select(*keys, "_said.*")


def bare(text: Column) -> Column:
    """A text's words in lower case, without marks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+(?:['’\\-][\\p{L}]+)*"), F.lit(0)), " ")
