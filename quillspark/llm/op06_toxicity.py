"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) over a document's words. Training tokens are labelled
from document labels: a word of a toxic document is toxic if one of its features
(the word itself and its beginnings) is significantly tied to toxic documents.
The CRF is fitted to stretches of such tokens by gradient steps on its exact
likelihood. Scoring runs forward and backward over whole texts; words without
any weighted feature share one transfer matrix, so a stretch of them is a matrix
power and only the others cost a step. A document's score is the probability that
any weighted word is toxic, scaled to the share of toxic documents seen in training.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import plainly_named, table
from .labelled import ALL_CHARS, TRAIN_CHARS, held_out, sample
from .op01_decontamination import words

#: Training documents of label 0 and 1 at most; words of a training stretch.
PER_CLASS = (3000, 1000)
STRETCH = 24
THRESHOLD, SPAN_PROBABILITY = 0.3, 0.5
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Powers of the transfer matrix that are kept; of higher ones only those of two.
_POWERS = 256


def word_features(word: bytes) -> list[bytes]:
    """The word and its beginnings of four to ten bytes."""
    return [word, *(word[:n] + b"*" for n in range(4, 11) if len(word) > n)]


def one_of_each(docs: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """One document of each group of copies, exact or near ones: those that share their lowest-hashed pair of words in a row, and their label."""
    found = {}
    for own, label in docs:
        key = min((zlib.crc32(a + b" " + b), a, b) for a, b in zip(own, own[1:], strict=False)) if len(own) > 1 else tuple(own)
        found.setdefault((key, label), own)
    return [(own, label) for (_, label), own in found.items()]


def informative(docs: list[tuple[list[bytes], int]]) -> list[bytes]:
    """Features more frequent in toxic documents than chance allows, among as many as were looked at."""
    toxic = Counter(f for own, label in docs if label for f in {f for w in set(own) for f in word_features(w)})
    known = {f for f, n in toxic.items() if n >= 3}
    all_of = Counter({f: toxic[f] for f in known})
    for own, label in docs:
        if not label:
            # A word with a known beginning has that beginning's first four bytes known too.
            some = [w for w in set(own) if w in known or w[:4] + b"*" in known]
            all_of.update({f for w in some for f in word_features(w)} & known)
    q = sum(label for _, label in docs) / max(1, len(docs))
    if not 0 < q < 1:
        return []
    tried = [f for f in known if all_of[f] >= 4]
    bar, scored = math.log(max(1, len(tried))) + 1, []
    for f in tried:
        n, share = all_of[f], toxic[f] / all_of[f]
        if share <= q or share < 0.7:
            continue
        gain = n * (share * math.log(share / q) + ((1 - share) * math.log((1 - share) / (1 - q)) if share < 1 else 0))
        if gain > bar:
            scored.append((-gain, f))
    return [f for _, f in sorted(scored)]


class Crf:
    """weights: by feature; bias: of the toxic state; move[a, b]: from state a to b; start[b]."""

    def __init__(self, weights: dict[bytes, float], bias: float, move: np.ndarray, start: np.ndarray):
        self.weights, self.bias, self.move, self.start = weights, bias, move, start
        self.low, self.high = 0.0, 1.0
        self.prepare()

    def prepare(self) -> None:
        step = np.exp(self.move + np.array([0.0, self.bias]))
        powers = [np.eye(2)]
        for _ in range(_POWERS):
            p = powers[-1] @ step
            powers.append(p / p.sum())
        self.powers = [p.tolist() for p in powers]
        p = powers[-1]
        self.doubled = [p.tolist()]  # the 256th power, the 512th, ...
        for _ in range(54):
            p = p @ p
            p /= p.sum()
            self.doubled.append(p.tolist())
        self.seen: dict[bytes, float] = {}
        self.heads = {f[:4] for f in self.weights}  # every feature of a word begins as the word does

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def over(self, gap: int) -> list[list[float]]:
        """The transfer matrix over so many ordinary words, up to a factor."""
        if gap <= _POWERS:
            return self.powers[gap]
        out, rest = np.array(self.powers[gap % _POWERS]), gap // _POWERS
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                out = out @ np.array(self.doubled[k])
                out /= out.sum()
        return out.tolist()

    def evidence(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words with weighted features, and the sums of their weights."""
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        try:
            values = np.fromiter(map(seen.__getitem__, own), np.float64, len(own))
        except KeyError:
            get = self.weights.get
            for w in set(own).difference(seen):
                seen[w] = sum(get(f, 0.0) for f in word_features(w)) if w[:4] in self.heads else 0.0
            values = np.fromiter(map(seen.__getitem__, own), np.float64, len(own))
        places = np.flatnonzero(values)
        return places, values[places]

    def marginals(self, n: int, places: np.ndarray, values: np.ndarray) -> list[float]:
        """The toxic state's probability at each of the places, in a text of n words, by forward and backward sums."""
        m00, m01, m10, m11 = np.exp(self.move).ravel().tolist()
        s0, s1 = np.exp(self.start).tolist()
        e = np.exp(np.clip(values + self.bias, -30, 30)).tolist()
        at, over = places.tolist(), self.over
        base = math.exp(self.bias)
        forward, f0, f1, last = [], 0.0, 0.0, -1
        for k, p in enumerate(at):
            gap = p - last - 1
            if last < 0:
                f0, f1 = s0, s1
                if gap:  # the first word is an ordinary one
                    f1 *= base
                    (a, b), (c, d) = over(gap - 1)
                    f0, f1 = f0 * a + f1 * c, f0 * b + f1 * d
                    f0, f1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
            else:
                if gap:
                    (a, b), (c, d) = over(gap)
                    f0, f1 = f0 * a + f1 * c, f0 * b + f1 * d
                f0, f1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
            f1 *= e[k]
            total = f0 + f1
            f0, f1, last = f0 / total, f1 / total, p
            forward.append((f0, f1))
        out, b0, b1, following = [0.0] * len(at), 1.0, 1.0, n
        for k in range(len(at) - 1, -1, -1):
            gap = following - at[k] - 1
            if following < n:
                c0, c1 = b0, b1 * e[k + 1]
                b0, b1 = m00 * c0 + m01 * c1, m10 * c0 + m11 * c1
            if gap:
                (a, b), (c, d) = over(gap)
                b0, b1 = a * b0 + b * b1, c * b0 + d * b1
            total = b0 + b1
            b0, b1, following = b0 / total, b1 / total, at[k]
            x0, x1 = forward[k][0] * b0, forward[k][1] * b1
            out[k] = x1 / (x0 + x1)
        return out

    def score(self, own: list[bytes]) -> tuple[float, np.ndarray, list[float]]:
        """Document score, places of weighted words, their marginals."""
        places, values = self.evidence(own)
        if not len(places):
            return self.low, places, []
        p = self.marginals(len(own), places, values)
        clean = 1.0
        for x in p:
            clean *= 1 - x
        return self.low + (self.high - self.low) * (1 - clean), places, p


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def fit(texts: list[tuple[str, int]], share: float, steps: int = 60) -> Crf:
    """A CRF from (text, label) pairs; share: of label 1 in the population."""
    docs = one_of_each([(words(t), label) for t, label in texts])
    features = informative(docs)
    number = {f: k for k, f in enumerate(features)}
    heads, none = {f[:4] for f in features}, []
    rng = np.random.default_rng(7)
    rows, targets = [], []
    pool = []
    for own, label in docs:
        marks = [[number[f] for f in word_features(w) if f in number] if w[:4] in heads else none for w in own]
        wanted = {k // STRETCH for k, m in enumerate(marks) if m}
        if own:
            pool.append((marks, int(rng.integers(0, (len(own) - 1) // STRETCH + 1))))
        for s in sorted(wanted):
            part = marks[s * STRETCH : (s + 1) * STRETCH]
            rows.append(part)
            targets.append([int(bool(m) and label == 1) for m in part])
    for k in rng.permutation(len(pool)).tolist():  # a stretch at a random place of each document
        marks, s = pool[k]
        part = marks[s * STRETCH : (s + 1) * STRETCH]
        if not any(part):
            rows.append(part)
            targets.append([0] * len(part))
    n, t, d = len(rows), STRETCH, len(features)
    weights, bias, move, start = np.full(d, 1.0), -3.0, np.zeros((2, 2)), np.zeros(2)
    if n and d:
        size = np.array([len(r) for r in rows])
        y = np.zeros((n, t), np.int64)
        for k, x in enumerate(targets):
            y[k, : len(x)] = x
        live = np.arange(t) < size[:, None]
        cell = np.array([k * t + i for k, r in enumerate(rows) for i, m in enumerate(r) for _ in m], np.int64)
        feature = np.array([f for r in rows for m in r for f in m], np.int64)
        params = np.concatenate([weights, [bias], move.ravel(), start])
        first, second = np.zeros_like(params), np.zeros_like(params)
        pair_seen = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                pair_seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum()
        start_seen = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()])
        for step in range(1, steps + 1):
            weights, bias, move, start = params[:d], params[d], params[d + 1 : d + 5].reshape(2, 2), params[d + 5 :]
            toxic = (np.bincount(cell, weights[feature], n * t) + bias).reshape(n, t)
            forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            forward[:, 0] = start
            forward[:, 0, 1] += toxic[:, 0]
            for i in range(1, t):
                new = np.stack([_log_sum(forward[:, i - 1] + move[:, b]) for b in (0, 1)], axis=1)
                new[:, 1] += toxic[:, i]
                forward[:, i] = np.where(live[:, i, None], new, forward[:, i - 1])
            for i in range(t - 2, -1, -1):
                ahead = backward[:, i + 1].copy()
                ahead[:, 1] += toxic[:, i + 1]
                new = np.stack([_log_sum(ahead + move[a]) for a in (0, 1)], axis=1)
                backward[:, i] = np.where(live[:, i + 1, None], new, 0.0)
            total = _log_sum(forward[:, -1])
            p = np.where(live, np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]), 0.0)
            miss = p - y * live
            grad = np.zeros_like(params)
            grad[:d] = np.bincount(feature, miss.ravel()[cell], d) + 0.5 * weights
            grad[d] = miss.sum()
            for a in (0, 1):
                for b in (0, 1):
                    pair = forward[:, :-1, a] + move[a, b] + (toxic[:, 1:] if b else 0.0) + backward[:, 1:, b] - total[:, None]
                    grad[d + 1 + 2 * a + b] = np.exp(pair)[live[:, 1:]].sum() - pair_seen[a, b] + 0.1 * move[a, b]
            q = np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(axis=0)
            grad[d + 5 :] = q - start_seen + 0.1 * start
            grad /= n
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            params = params - 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias, move, start = params[:d], float(params[d]), params[d + 1 : d + 5].reshape(2, 2), params[d + 5 :]
    crf = Crf(dict(zip(features, weights.tolist(), strict=True)), bias, move, start)
    # What scores near 0 and near 1 are worth, each label weighted by its share in the population.
    raw = [(crf.score(own)[0], label) for own, label in docs]
    n1 = sum(label for _, label in raw)
    if 0 < n1 < len(raw) and 0 < share < 1:
        weight = {1: share / n1, 0: (1 - share) / (len(raw) - n1)}

        def rate(rows: list) -> float:
            a, b = sum(weight[1] for _, label in rows if label), sum(weight[0] for _, label in rows if not label)
            return (a + 0.5 * weight[1] * share) / (a + b + 0.5 * weight[1])

        low, high = rate([r for r in raw if r[0] < 0.5]), rate([r for r in raw if r[0] >= 0.5])
        crf.low, crf.high = min(low, high), max(low, high)
    else:
        crf.low = crf.high = share
    return crf


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS, text_col: str = "text", train_chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> Crf:
    """A model from a bounded sample of the labelled rows that aren't held out (see labelled.sample)."""
    return fit(*sample(docs, labels, label_col, per_class, text_col=text_col, train_chars=train_chars, all_chars=all_chars))


SCORED = "score double, spans array<struct<start:int,end:int,probability:double>>"


def score_texts(docs: DataFrame, model: Crf, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with score and spans (characters of words whose marginal is 0.5 or more).

    Null and wordless texts have the score of texts without toxic words, and no
    spans. Rows stay as they are. Columns named score or spans give way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                scores, spans = [], []
                for text in part.column(len(kept)).to_pylist():
                    value, places, p = crf.score(words(text))
                    scores.append(value)
                    found = {k: x for k, x in zip(places.tolist(), p, strict=True) if x >= SPAN_PROBABILITY}
                    spans.append([{"start": m.start(), "end": m.end(), "probability": found[k]} for k, m in enumerate(_WORD.finditer(text)) if k in found] if found else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, span_type)], names=[*kept, "score", "spans"])

    slim = docs.select(*kept, F.col(text_col).alias("__text"))
    from pyspark.sql import types as T

    return spread(slim).mapInArrow(tidy(run), T.StructType([*slim.schema.fields[:-1], *T._parse_datatype_string(SCORED).fields]))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay with their values, whatever their names.

    Rows are judged each by its own text: null and wordless ones stay, repeated
    rows share their fate, and no labels at all drop nothing (or, if all training
    labels are toxic, everything). An empty table stays empty.
    """
    rows, names = plainly_named(docs)
    scored = score_texts(rows, train(docs, labels, text_col=text_col), names[text_col])
    return scored.filter(F.col("score") < threshold).select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
