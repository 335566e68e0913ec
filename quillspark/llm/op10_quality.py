"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (shares of
byte classes, word lengths, repetition, capitals) and passed through a hidden
layer; gated attention, learned from document labels alone, weighs the passages,
and the weighted mean representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import spread, tidy
from .common import plainly_named, table
from .labelled import ALL_CHARS, TRAIN_CHARS, held_out, sample

#: Training documents of label 0 and 1 at most; all of their passages train.
PER_CLASS = (1500, 3000)
PASSAGE_WORDS, HIDDEN, ATTENTION = 64, 16, 8
THRESHOLD = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes: 0 space, 1 line end, 2 a-z, 3 A-Z, 4 digit, 5 sentence mark, 6 ! and ?, 7 bar and table marks, 8 other ASCII marks, 9 non-ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[_SPACE] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 9
_CLASS[[ord(c) for c in ".,;:'-()\""]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in "|\t"]] = 7
_CLASSES = 10
_MIX = np.random.default_rng(11).integers(1, 1 << 62, 256, np.int64)
_MIX[_SPACE] = 0
FEATURES = _CLASSES + 7


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts, and the number of passages of each text (0 without words)."""
    raws = [(t or "").encode() for t in texts]
    buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])[:-1]
    space = _SPACE[buffer]
    word = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(word):
        return np.zeros((0, FEATURES), np.float32), np.zeros(len(texts), np.int64)
    first = np.searchsorted(word, starts)
    of = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, len(word)]))
    opens = (np.arange(len(word)) - first[of]) % PASSAGE_WORDS == 0
    passage = np.cumsum(opens) - 1
    head = np.flatnonzero(opens)
    n = len(head)
    counts = np.bincount(of[head], minlength=len(texts))
    edges = np.r_[word[head], len(buffer)]
    last = np.r_[edges[1:-1], len(buffer)]
    # A passage's bytes end where its text ends.
    ends = np.minimum(last, (starts + np.array([len(r) for r in raws]))[of[head]])
    size = np.maximum(1, ends - edges[:-1])
    at = np.repeat(np.arange(n, dtype=np.int64) * _CLASSES, np.diff(edges))
    classes = np.bincount(at + _CLASS[buffer[edges[0] :]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    n_words = np.diff(np.r_[head, len(word)])
    mixed = np.add.reduceat(_MIX[buffer], word)
    same1 = np.r_[False, (mixed[1:] == mixed[:-1]) & (passage[1:] == passage[:-1])]
    same2 = np.zeros(len(word), bool)
    same2[2:] = (mixed[2:] == mixed[:-2]) & (passage[2:] == passage[:-2])
    initial = _CLASS[buffer[word]]
    total = lambda x: np.bincount(passage, x, n)
    letters = classes[:, 2] + classes[:, 3] + classes[:, 9]
    rows = np.empty((n, FEATURES), np.float32)
    rows[:, :_CLASSES] = classes / size[:, None]
    k = _CLASSES
    rows[:, k] = (size - classes[:, 0]) / n_words / 10
    rows[:, k + 1] = total(same1) / n_words
    rows[:, k + 2] = total(same2) / n_words
    rows[:, k + 3] = total(initial == 3) / n_words
    rows[:, k + 4] = total((initial >= 5) & (initial <= 8)) / n_words
    rows[:, k + 5] = np.log1p(n_words) / 4
    rows[:, k + 6] = letters / size
    return rows, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Standardised features x, h = tanh(Wx + b), attention a = softmax(w (tanh(Vh) * sigmoid(Uh))), score = sigmoid(c sum(a h) + d)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def score(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One score per text; a text without passages counts as one passage without features."""
        p, none = self.p, counts == 0
        if none.any():
            at = np.cumsum(counts)[none]
            rows = np.insert(rows, at, 0, axis=0) if len(rows) else np.zeros((int(none.sum()), len(self.mean)), np.float32)
            counts = np.where(none, 1, counts)
        if not len(counts):
            return np.zeros(0)
        h = np.tanh(self.scaled(rows) @ p["W"] + p["b"])
        a = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
        starts = np.cumsum(counts) - counts
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        z = np.add.reduceat(h * a[:, None], starts) / np.add.reduceat(a, starts)[:, None]
        return _sigmoid(z @ p["c"] + p["d"])

    def step(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for documents of so many passages each, whose features x are in a row, by back-propagation."""
        p, n, starts = self.p, len(counts), np.cumsum(counts) - counts
        of = np.repeat(np.arange(n), counts)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        miss = (_sigmoid(z @ p["c"] + p["d"]) - y) * weight / n
        dz = (miss[:, None] * p["c"])[of]
        da = (h * dz).sum(axis=1)
        de = (a * (da - np.add.reduceat(a * da, starts)[of]))[:, None]
        dt, dg = de * p["w"] * g * (1 - t * t), de * p["w"] * t * g * (1 - g)
        ds = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ ds, "b": ds.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g * de).sum(axis=0), "c": z.T @ miss, "d": np.array([miss.sum()])}


def fit(texts: list[tuple[str, int]], share: float, steps: int = 600, batch: int = 128) -> Model:
    """A model from (text, label) pairs by Adam steps; share: of label 1 in the population, to which labels are weighted."""
    rng = np.random.default_rng(5)
    # A few hundred texts at a time: encoding takes some ten times their bytes.
    parts = [encode([t for t, _ in texts[i : i + 256]]) for i in range(0, len(texts), 256)] or [encode([])]
    rows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    mean = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    scale = rows.std(axis=0) + 0.01 if len(rows) else np.ones(FEATURES)
    model = Model(mean, scale, rng)
    y = np.array([label for _, label in texts], float)
    if not len(y) or not 0 < y.mean() < 1:
        share = share if len(y) else 1.0
        model.p["c"][:] = 0
        model.p["d"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    none = counts == 0
    if none.any():  # a text without passages is one passage without features, as in score()
        rows, counts = np.insert(rows, np.cumsum(counts)[none], 0, axis=0), np.where(none, 1, counts)
    starts, scaled = np.cumsum(counts) - counts, model.scaled(rows)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        k = rng.choice(len(y), min(batch, len(y)), replace=False)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        own = np.repeat(starts[k] - np.cumsum(counts[k]) + counts[k], counts[k]) + np.arange(counts[k].sum())
        for name, grad in model.step(scaled[own], counts[k], y[k], weight[k]).items():
            m, v = moments[name]
            grad = grad + 1e-4 * model.p[name]
            m[:], v[:] = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            model.p[name] = model.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: tuple[int, int] = PER_CLASS, text_col: str = "text", train_chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out (see labelled.sample)."""
    return fit(*sample(docs, labels, label_col, per_class, text_col=text_col, train_chars=train_chars, all_chars=all_chars))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with score.

    Null and wordless texts are scored as one passage without features. Rows
    stay as they are. A column named score gives way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                scores = model.score(*encode(part.column(len(kept)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    slim = docs.select(*kept, F.col(text_col).alias("__text"))
    return spread(slim).mapInArrow(tidy(run), T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def drop_poor(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score stays below the threshold; all columns stay with their values, whatever their names.

    Rows are judged each by its own text: null and wordless ones as one passage
    without features, repeated rows alike. With labels of one kind every
    row has the share of label 1 as its score, and without labels nothing goes. An empty table stays empty.
    """
    rows, names = plainly_named(docs)
    scored = score_texts(rows, train(docs, labels, text_col=text_col), names[text_col])
    return scored.filter(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
