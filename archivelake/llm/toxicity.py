"""Toxic spans and document scores with a linear-chain conditional random field.

Words carry a tag, 0 or 1. A word's features are itself and its beginnings; their
weights and four transition weights give every tagging of a text a probability.
Documents carry labels and words do not, so the words are labelled first: a word of
a toxic document is labelled 1 if one of its features is much more frequent in toxic
documents than in others. The field learns from those, so a feature that also occurs
in clean documents ends up weak.

Forward and backward messages give every word's marginal probability of tag 1.
Words without a known feature all behave alike, so a run of k of them is one step
with the k-th power of the transition matrix: exact, and as cheap as the known words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivelake.llm.base import WordMemory, fold, released, unit_hash
from archivelake.session import durable

SEED = 23
#: Expected number of documents of each label that the model is learned from.
LEARN_DOCS = 5000
#: Most features, training windows and words of a window.
MAX_FEATURES, MAX_WINDOWS, WINDOW = 4000, 30_000, 16
#: A feature is kept from this many toxic training documents on, and labels words from
#: this many times its frequency in clean ones on.
MIN_DOCS, MIN_RATIO = 4, 8.0
PREFIXES = range(3, 9)
THRESHOLD = 0.7
ROUNDS, RATE, DECAY = 150, 0.5, 1e-5

_EDGE = '.,;:!?#*$%&|<>()[]{}"\'`~_+=/\\-…»«“”„’‘'
_MEMORY = 150_000


def word_features(word: str) -> list[str]:
    """The lowered word without punctuation at its ends, and its proper beginnings."""
    core = word.strip(_EDGE).lower()
    if not core:
        return []
    return [core + "$", *("^" + core[:k] for k in PREFIXES if k < len(core))]


@dataclass
class Model:
    """Feature weights, tag weights and the map from marginals to document scores.

    `start` holds the weights of the first tag, `move[i, j]` of tag j after i, `bias` of
    tag 1 at any word.
    """

    weights: dict[str, float]
    bias: float
    start: np.ndarray
    move: np.ndarray
    scale: np.ndarray

    def emissions(self, words: list[str]) -> dict[str, float]:
        """Weight of tag 1 that a word's known features add; 0.0 without any."""
        get = self.weights.get
        return {w: sum(v for f in word_features(w) if (v := get(f))) or 0.0 for w in words}

    def marginals(self, at: np.ndarray, emission: np.ndarray, n: int) -> np.ndarray:
        """Probability of tag 1 at the words `at` (ascending) of a text of n words.

        `emission` belongs to `at`; all other words have emission 0.
        """
        plain = np.exp(self.move + np.array([0.0, self.bias]))
        root, left = np.linalg.eig(plain)
        right = np.linalg.inv(left)
        root = root / root[0] if root[0] >= root[1] else root / root[1]

        def run(k: int) -> np.ndarray:
            """Transition over k plain words, up to a factor."""
            return (left * root**k) @ right

        matrices = [np.exp(self.move + np.array([0.0, self.bias + min(e, 50.0)])) for e in emission]
        forward = []
        before = np.exp(self.start)
        place = 0
        for i, m in zip(at.tolist(), matrices, strict=True):
            if i == 0:
                before = np.exp(self.start + np.array([0.0, self.bias + min(float(emission[0]), 50.0)]))
            else:
                if place == 0:
                    before = np.exp(self.start + np.array([0.0, self.bias]))
                    place = 1
                before = before @ run(i - place) @ m
            before = before / before.sum()
            forward.append(before)
            place = i + 1
        out = np.empty(len(forward))
        after = np.ones(2)
        place = n
        for k in range(len(forward) - 1, -1, -1):
            after = run(place - int(at[k]) - 1) @ after
            both = forward[k] * after
            out[k] = both[1] / both.sum()
            after = matrices[k] @ (after / after.sum())
            place = int(at[k])
        return out

    def document_score(self, marginals: np.ndarray) -> float:
        """Probability that the document is labelled toxic, from its words' marginals."""
        return float(1 / (1 + np.exp(-np.clip(summary(marginals) @ self.scale, -30, 30))))


def summary(marginals: np.ndarray) -> np.ndarray:
    """One, the log odds that any word has tag 1, and the log of how many have."""
    none = np.log1p(-np.minimum(marginals, 1 - 1e-9)).sum()
    odds = math.log(max(-math.expm1(none), 1e-9)) - none
    return np.array([1.0, min(max(odds, -10.0), 10.0), math.log1p(marginals.sum())])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows the model is not learned from."""
    return fold(F.col(doc_id) if isinstance(doc_id, str) else doc_id, 3) == 1


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of a sample of labelled documents, stored; and the sampling rates.

    A document labelled twice counts as toxic if one label says so. Copies count once.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, per_label / n) for y, n in sizes.items()}
    rate = F.lit(0.0)
    for y, r in rates.items():
        rate = F.when(F.col("y") == y, F.lit(r)).otherwise(rate)
    # About `per_label` ids of each label, however many documents there are.
    chosen = F.broadcast(known.where(unit_hash("doc_id", seed=SEED) < rate))
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
    return durable(texts.dropDuplicates(["text"]).select("text", "y").repartition(16)), rates


def _count_features(sample: DataFrame) -> DataFrame:
    """(feature, y, n): in how many sample documents of a label each feature occurs."""

    def rows(counts: Counter) -> pa.RecordBatch:
        names, ys = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(ys, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["feature", "y", "n"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, y in zip(*[batch.column(c).to_pylist() for c in ("text", "y")], strict=True):
                found = {f for w in set(text.split()) for f in word_features(w)}
                counts.update((f, y) for f in found)
                if len(counts) > 200_000:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    counted = sample.mapInArrow(released(task), "feature string, y int, n long")
    return counted.groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )


def _windows(sample: DataFrame, number: dict[str, int], marking: frozenset[str]) -> DataFrame:
    """(features, tags, n): distinct windows of the sample and how often each occurs.

    `features` holds for each word the numbers of its known features; a window is
    WINDOW words, the last one of a text may be shorter.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learn(words: list[str]) -> dict[str, tuple]:
            out = {}
            for w in words:
                found = word_features(w)
                out[w] = (tuple(number[f] for f in found if f in number), any(f in marking for f in found))
            return out

        memory = WordMemory(learn, _MEMORY)
        for batch in batches:
            counts: Counter = Counter()
            ys = batch.column("y").to_pylist()
            split = [t.split() for t in batch.column("text").to_pylist()]
            for y, values in zip(ys, memory.values(split), strict=True):
                for low in range(0, len(values), WINDOW):
                    part = values[low:low + WINDOW]
                    counts[tuple(v[0] for v in part), tuple(int(y == 1 and v[1]) for v in part)] += 1
            if counts:
                features, tags = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32())),
                     pa.array(list(counts.values()), pa.int64())], names=["features", "tags", "n"],
                )

    schema = "features array<array<int>>, tags array<int>, n long"
    return sample.mapInArrow(released(task), schema).groupBy("features", "tags").agg(F.sum("n").alias("n"))


def fit_chain(
    windows: list[tuple[list[list[int]], list[int], int]], n_features: int
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights of features 1 to n, bias, start and move: most likely given tagged windows.

    Gradients are observed less expected counts, by forward-backward over all windows
    of a length at once; steps follow Adam with weight decay.
    """
    groups = {}
    for length in sorted({len(tags) for _, tags, _ in windows}):
        own = [w for w in windows if len(w[1]) == length]
        wide = max(1, max(len(f) for features, _, _ in own for f in features))
        grid = np.zeros((len(own), length, wide), np.int32)
        for r, (features, _, _) in enumerate(own):
            for t, f in enumerate(features):
                grid[r, t, :len(f)] = f
        groups[length] = (grid, np.array([w[1] for w in own]), np.array([w[2] for w in own], float))
    total = sum(n for _, _, n in windows)
    theta = np.zeros(n_features + 1 + 7)  # slot 0 stands for no feature
    theta[n_features + 1] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, bias = theta[:n_features + 1], theta[n_features + 1]
        start, move = theta[n_features + 2:n_features + 4], theta[n_features + 4:].reshape(2, 2)
        slope = np.zeros_like(theta)
        for length, (grid, tags, n) in groups.items():
            emission = weights[grid].sum(axis=2) + bias
            factor = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -50, 50))], axis=2)
            moves = np.exp(move)
            alpha = np.empty_like(factor)
            beta = np.ones_like(factor)
            now = np.exp(start) * factor[:, 0]
            alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
            for t in range(1, length):
                now = alpha[:, t - 1] @ moves * factor[:, t]
                alpha[:, t] = now / now.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                now = (beta[:, t + 1] * factor[:, t + 1]) @ moves.T
                beta[:, t] = now / now.sum(axis=1, keepdims=True)
            both = alpha * beta
            marginal = both[:, :, 1] / both.sum(axis=2)
            miss = (tags - marginal) * n[:, None]
            slope[:n_features + 1] += np.bincount(
                grid.ravel(), np.repeat(miss.ravel(), grid.shape[2]), minlength=n_features + 1
            )
            slope[n_features + 1] += miss.sum()
            slope[n_features + 2] -= miss[:, 0].sum()
            slope[n_features + 3] += miss[:, 0].sum()
            for t in range(1, length):
                pair = alpha[:, t - 1, :, None] * moves * (factor[:, t] * beta[:, t])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                seen = np.zeros((2, 2))
                np.add.at(seen, (tags[:, t - 1], tags[:, t]), n)
                slope[n_features + 4:] += (seen - np.tensordot(n, pair, 1)).ravel()
        slope = slope / total - DECAY * theta
        slope[0] = 0.0
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return (theta[:n_features + 1], float(theta[n_features + 1]), theta[n_features + 2:n_features + 4],
            theta[n_features + 4:].reshape(2, 2))


def fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of document summaries, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, per_label: int = LEARN_DOCS) -> Model:
    """A model from a bounded sample of documents (doc_id, text) with a `toxic` label.

    What comes to the driver is bounded by the parameters above: features, distinct
    windows and a summary per sample document. Without a toxic or a clean label every
    document gets the share of toxic labels, 0 without labels, as its score.
    """
    sample, rates = _sample(docs, labels, per_label)
    flat = Model({}, -20.0, np.zeros(2), np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0]))
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return flat if not toxic else Model({}, -20.0, np.zeros(2), np.zeros((2, 2)), np.array([30.0, 0.0, 0.0]))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    best = (
        _count_features(sample).where(F.col("toxic") >= MIN_DOCS).withColumn("ratio", ratio)
        .where("ratio > 2").orderBy((F.log("ratio") * F.sqrt("toxic")).desc(), "feature").limit(MAX_FEATURES).collect()
    )
    names = sorted(r.feature for r in best)
    number = {f: i + 1 for i, f in enumerate(names)}
    marking = frozenset(r.feature for r in best if r.ratio >= MIN_RATIO)
    ordered = _windows(sample, number, marking).orderBy(F.col("n").desc(), F.xxhash64("features", "tags"))
    windows = [(r.features, r.tags, r.n) for r in ordered.limit(MAX_WINDOWS).collect()]
    weights, bias, start, move = fit_chain(windows, len(names))
    model = Model({f: float(weights[i]) for f, i in number.items()}, bias, start, move, np.array([0.0, 0.0, 0.0]))

    seen = np.array([tuple(r) for r in _tagged(sample, model, ["y"], "toxic").select(
        "y", "toxic_any", "toxic_many"
    ).collect()], float)
    # Each row stands for as many documents as the sample left out.
    weight = np.array([1 / rates[int(y)] for y in seen[:, 0]])
    model.scale = fit_scale(np.column_stack([np.ones(len(seen)), seen[:, 1:]]), seen[:, 0], weight / weight.mean())
    return model


_ADDED = (
    "{0}_any double, {0}_many double, {0}_score double, "
    "{0}_spans array<struct<start:int,length:int,probability:double>>"
)


def _tagged(docs: DataFrame, model: Model, keep: list[str], out: str) -> DataFrame:
    """`keep` and the columns of _ADDED of every row with a `text`."""
    schema = docs.select(*keep).schema
    for column in StructType.fromDDL(_ADDED.format(out)).fields:
        schema = schema.add(column)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordMemory(model.emissions, _MEMORY)
        nothing = summary(np.empty(0))
        base = model.document_score(np.empty(0))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for text, values in zip(texts, memory.values([t.split() for t in texts]), strict=True):
                emission = np.array(values)
                at = np.flatnonzero(emission)
                if not len(at):
                    rows.append((nothing[1], nothing[2], base, []))
                    continue
                p = model.marginals(at, emission[at], len(emission))
                spans = []
                if (p >= 0.5).any():
                    marked = dict(zip(at[p >= 0.5].tolist(), p[p >= 0.5].tolist(), strict=True))
                    for i, m in enumerate(re.finditer(r"\S+", text)):
                        if i in marked:
                            spans.append({"start": m.start(), "length": m.end() - m.start(), "probability": marked[i]})
                rows.append((*summary(p)[1:], model.document_score(p), spans))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            arrays = [batch.column(c) for c in keep] + [pa.array(c, pa.float64()) for c in columns[:3]]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(columns[3], span_type)], names=schema.names
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(released(task), schema)


def score(
    docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD, out: str = "toxic"
) -> DataFrame:
    """`keep`, toxic_score (0 to 1), toxic (0/1) and toxic_spans of every row.

    A null or empty text has no spans and the score of a text without known words.
    Spans are character offsets of words whose marginal is at least one half. `out` is
    the beginning of the new columns' names; no kept column may begin with it.
    """
    toxic = (F.col(f"{out}_score") >= threshold).cast("int").alias(out)
    return _tagged(docs, model, keep, out).select(*keep, f"{out}_score", toxic, f"{out}_spans")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document."""
    model = learn(docs, labels)
    told = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return told.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"),
        F.col("toxic_spans").alias("spans"),
    )
