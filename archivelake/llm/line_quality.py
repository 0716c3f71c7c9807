"""Document quality from lines, with a linear-chain conditional random field.

Every line carries a tag, good or bad. A line is described by the classes its counts
fall in (share of letters, capitals, symbols and digits, repeated words, length, whether
the text had the line before) and by those of the lines around it. Weights of these
classes and four transition weights give every tagging of a text a probability; forward
and backward messages give each line's marginal probability of being bad. Their mean,
weighted by the lines' lengths, is mapped to the document's score.

Documents carry labels and lines do not. All lines of a bad document start out as bad;
after a fit, those the model finds good are tagged good, and it is fitted again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from archivelake.llm.base import fold, released, unit_hash
from archivelake.llm.wordhash import CHUNK, byte_values, mix, parts, span_hashes, word_spans
from archivelake.session import durable

SEED = 31
#: Expected number of documents of each label that the model is learned from.
LEARN_DOCS = 3000
#: Lines of a training window, and the expected number of windows that are fitted. Windows
#: are drawn by hash, each stands for as many as were left out.
WINDOW, FIT_WINDOWS = 32, 20_000
#: Fits, steps of each, their length and decay; a bad document's line stays bad from
#: this marginal on.
FITS, ROUNDS, RATE, DECAY, STAYS_BAD = 3, 80, 0.3, 1e-4, 0.3
THRESHOLD = 0.5

COUNTS = ("chars", "letters", "capitals", "symbols", "marks", "digits", "words", "distinct", "repeats")

_CAPITAL, _LETTER, _SYMBOL, _MARK, _DIGIT, _INNER = (np.zeros(256, bool) for _ in range(6))
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # the first byte of any other letter
_SYMBOL[list(b"#*$%&|<>^~=_+{}[]\\@")] = True
_MARK[list(b"!?")] = True
_DIGIT[48:58] = True
_INNER[0x80:0xC0] = True  # later bytes of a character
_VALUES = byte_values(SEED)


def line_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, document of each line, whether the document had the line before).

    Lines are what line feeds part, so an empty text has one. Texts are read in parts of
    about a megabyte; a word that stands in two parts of a line counts as distinct in
    each.
    """
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
    total = int(per_text.sum())
    counts = np.zeros((total, len(COUNTS)), np.int64)
    line_hash = np.zeros(total, np.uint64)
    base = 0
    for part in parts(data):
        raw = np.frombuffer(part, np.uint8)
        breaks = np.flatnonzero(raw == 10)
        lows, highs = np.append(0, breaks + 1), np.append(breaks, len(raw))
        rows = slice(base, base + len(lows))

        def per_line(mask: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(mask, dtype=np.int32))
            return sums[highs] - sums[lows]

        follows = np.append(0, raw[:-1])
        latin_capital = (follows == 0xC3) & (raw >= 0x80) & (raw < 0x9F)
        masks = (~_INNER[raw] & (raw != 10), _LETTER[raw], _CAPITAL[raw] | latin_capital, _SYMBOL[raw], _MARK[raw], _DIGIT[raw])
        for k, mask in enumerate(masks):
            counts[rows, k] += per_line(mask)
        starts, ends = word_spans(raw)
        if len(starts):
            if len(raw) <= CHUNK:
                hashes = span_hashes(raw, starts, ends, _VALUES)
            else:  # one word longer than a part
                hashes = np.array([zlib.crc32(part[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64)
            line = np.searchsorted(lows, starts, "right") - 1
            n = len(lows)
            counts[rows, 6] += np.bincount(line, minlength=n)
            order = np.lexsort((hashes, line))
            new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))
            counts[rows, 7] += np.bincount(line[order][new], minlength=n)
            again = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
            counts[rows, 8] += np.bincount(line[1:][again], minlength=n)
            # A sum of the words' hashes; lines of the same words in another order count as equal.
            np.add.at(line_hash, base + line, mix(hashes))
        base += len(breaks)
    doc = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((np.arange(total), line_hash, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    seen = np.zeros(total, bool)
    seen[order[1:][same]] = True
    return counts, doc, seen & (counts[:, 6] > 0)


#: (numerator, denominator, limits): a line's class is how many limits its ratio exceeds.
_RATIOS = (
    ("letters", "chars", (0.3, 0.5, 0.65, 0.75)), ("capitals", "letters", (0.0, 0.05, 0.15, 0.3, 0.6)),
    ("symbols", "chars", (0.0, 0.01, 0.03, 0.1)), ("marks", "words", (0.0, 0.1, 0.3, 0.6)),
    ("digits", "chars", (0.0, 0.05, 0.15)), ("repeats", "words", (0.0, 0.05, 0.15, 0.4)),
    ("words", None, (0, 1, 3, 7, 15, 31, 63, 127)), ("chars", "words", (2, 4, 5, 6, 8, 11, 16)),
)
#: Distinct words of short, middle and long lines.
_DISTINCT = (0.2, 0.4, 0.6, 0.8, 0.95)
#: The first so many ratios also describe the lines before and after.
_AROUND = 6


def line_features(counts: np.ndarray, doc: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """(numbers of the classes each line is in, how many classes there are)."""
    column = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    found, sizes = [], []
    for over, under, limits in _RATIOS:
        ratio = column[over] if under is None else column[over] / np.maximum(column[under], 1)
        found.append(np.searchsorted(np.array(limits, float), ratio, "left"))
        sizes.append(len(limits) + 1)
    length = np.searchsorted(np.array([15.0, 63.0]), column["words"], "left")
    share = np.searchsorted(np.array(_DISTINCT), column["distinct"] / np.maximum(column["words"], 1), "left")
    found += [length * (len(_DISTINCT) + 1) + share, seen.astype(int)]
    sizes += [3 * (len(_DISTINCT) + 1), 2]
    edge = np.append(doc[1:] != doc[:-1], True)
    for k in range(_AROUND):
        # One more class for the first and the last line, which have no neighbour.
        before = np.where(np.append(True, edge[:-1]), sizes[k], np.append(0, found[k][:-1]))
        after = np.where(edge, sizes[k], np.append(found[k][1:], 0))
        found += [before, after]
        sizes += [sizes[k] + 1] * 2
    offsets = np.append(0, np.cumsum(sizes))
    return (np.stack(found, axis=1) + offsets[:-1]).astype(np.int16), int(offsets[-1])


#: Number of classes of a line.
N_FEATURES = line_features(np.zeros((1, len(COUNTS)), np.int64), np.zeros(1, int), np.zeros(1, bool))[1]


def marginals(emission: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple:
    """(marginal of tag 1, forward, backward) of rows of lines, padded to one width.

    `emission` (rows by lines) is what tag 1 weighs more than tag 0 at each line, `start`
    and `move` the weights of the first tag and of a tag after another.
    """
    rows, width = emission.shape
    factor = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -50, 50))], axis=2)
    moves = np.exp(move)
    forward, backward = np.zeros((rows, width, 2)), np.ones((rows, width, 2))
    now = np.exp(start) * factor[:, 0]
    forward[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, width):
        now = forward[:, t - 1] @ moves * factor[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        now = (backward[:, t + 1] * factor[:, t + 1]) @ moves.T
        now /= now.sum(axis=1, keepdims=True)
        backward[:, t] = np.where((t + 1 < length)[:, None], now, 1.0)
    both = forward * backward
    return both[:, :, 1] / both.sum(axis=2), forward, backward


@dataclass
class Model:
    """Class weights, tag weights and the map from the weighted mean to scores."""

    weights: np.ndarray
    bias: float
    start: np.ndarray
    move: np.ndarray
    scale: np.ndarray

    def line_marginals(self, features: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Probability of every line to be bad."""
        emission = self.weights[features].sum(axis=1) + self.bias
        length = np.bincount(doc, minlength=n_docs)
        first = np.append(0, np.cumsum(length))[:-1]
        out = np.empty(len(emission))
        # Documents of about the same number of lines go together, so little is padded.
        size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for s in np.unique(size[length > 0]):
            rows = np.flatnonzero((size == s) & (length > 0))
            width = int(length[rows].max())
            at = first[rows][:, None] + np.arange(width)
            real = np.arange(width) < length[rows][:, None]
            grid = np.where(real, emission[np.minimum(at, len(emission) - 1)], 0.0)
            p = marginals(grid, length[rows], self.start, self.move)[0]
            out[at[real]] = p[real]
        return out

    def scores(self, mean: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the weighted mean of the lines' marginals."""
        return 1 / (1 + np.exp(np.clip(summary(mean) @ self.scale, -30, 30)))


def summary(mean: np.ndarray) -> np.ndarray:
    """One and the log odds of the weighted mean."""
    inside = np.clip(mean, 0.002, 0.998)
    return np.column_stack([np.ones(len(mean)), np.log(inside / (1 - inside))])


def weighted_means(p: np.ndarray, chars: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Mean of the lines' marginals by length; the plain mean of texts of empty lines."""
    weight = chars.astype(float)
    empty = np.bincount(doc, weight, n_docs) == 0
    weight[empty[doc]] = 1.0
    return np.bincount(doc, p * weight, n_docs) / np.maximum(np.bincount(doc, weight, n_docs), 1.0)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows the model is not learned from."""
    return fold(F.col(doc_id) if isinstance(doc_id, str) else doc_id, 3) == 1


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of a sample of labelled documents, stored; and the sampling rates.

    y is 1 for a bad document. One labelled twice is bad if a label says so, and equal
    texts count once.
    """
    known = (
        labels.where("quality is not null and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max((F.col("quality") != 1).cast("int")).alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, per_label / n) for y, n in sizes.items()}
    rate = F.lit(0.0)
    for y, r in rates.items():
        rate = F.when(F.col("y") == y, F.lit(r)).otherwise(rate)
    # About `per_label` ids of each label, however many documents there are.
    chosen = F.broadcast(known.where(unit_hash("doc_id", seed=SEED) < rate))
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
    once = texts.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    return durable(once.select("text", "y").repartition(16)), rates


def _windows(sample: DataFrame) -> DataFrame:
    """(y, features, length): runs of at most WINDOW lines of the sample's texts.

    `features` holds the lines' class numbers one after the other, as little-endian
    16-bit integers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = batch.column("text").to_pylist(), batch.column("y").to_pylist()
            if not texts:
                continue
            counts, doc, seen = line_counts(texts)
            features, _ = line_features(counts, doc, seen)
            bounds = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))))
            rows = [
                (y, features[k:min(k + WINDOW, high)].astype("<i2").tobytes(), min(WINDOW, high - k))
                for y, low, high in zip(ys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                for k in range(low, high, WINDOW)
            ]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32())],
                names=["y", "features", "length"],
            )

    return sample.mapInArrow(released(task), "y int, features binary, length int")


def fit_chain(
    features: np.ndarray, length: np.ndarray, tags: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Class weights, bias, start and move that make the tags of the windows most likely.

    `features` is windows by lines by classes, `tags` windows by lines, both padded.
    Gradients are observed less expected counts; steps follow Adam with weight decay.
    """
    rows, width, kinds = features.shape
    real = np.arange(width) < length[:, None]
    flat = features[real].ravel()
    total = float((weight * length).sum())
    theta = np.zeros(N_FEATURES + 7)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, bias = theta[:N_FEATURES], theta[N_FEATURES]
        start, move = theta[N_FEATURES + 1:N_FEATURES + 3], theta[N_FEATURES + 3:].reshape(2, 2)
        emission = np.where(real, weights[features].sum(axis=2) + bias, 0.0)
        p, forward, backward = marginals(emission, length, start, move)
        miss = np.where(real, (tags - p) * weight[:, None], 0.0)
        slope = np.zeros_like(theta)
        slope[:N_FEATURES] = np.bincount(flat, np.repeat(miss[real], kinds), N_FEATURES)
        slope[N_FEATURES] = miss.sum()
        slope[N_FEATURES + 1:N_FEATURES + 3] = -miss[:, 0].sum(), miss[:, 0].sum()
        factor = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -50, 50))], axis=2)
        moves = np.exp(move)
        for t in range(1, width):
            on = np.flatnonzero(length > t)
            if not len(on):
                break
            pair = forward[on, t - 1, :, None] * moves * (factor[on, t] * backward[on, t])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (tags[on, t - 1], tags[on, t]), weight[on])
            slope[N_FEATURES + 3:] += (seen - np.tensordot(weight[on], pair, 1)).ravel()
        slope = slope / total - DECAY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return (theta[:N_FEATURES], float(theta[N_FEATURES]), theta[N_FEATURES + 1:N_FEATURES + 3],
            theta[N_FEATURES + 3:].reshape(2, 2))


def fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of document summaries, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, per_label: int = LEARN_DOCS) -> Model:
    """A model from a bounded sample of documents (doc_id, text) with a `quality` label.

    What comes to the driver is bounded by the parameters above: windows of class
    numbers, and a mean per sample document. With labels of one kind only, every
    document gets that label's score; without labels, one half.
    """
    sample, rates = _sample(docs, labels, per_label)
    windows = durable(_windows(sample))
    sizes = {r.y: r.n for r in windows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        sure = {(): 0.0, (0,): -30.0, (1,): 30.0}[tuple(sizes)]
        return Model(np.zeros(N_FEATURES), 0.0, np.zeros(2), np.zeros((2, 2)), np.array([sure, 0.0]))
    # Half of the windows may be of good documents and half of bad ones.
    drawn = {y: min(1.0, FIT_WINDOWS / 2 / n) for y, n in sizes.items()}
    limit = F.when(F.col("y") == 1, F.lit(drawn[1])).otherwise(F.lit(drawn[0]))
    rows = windows.where(unit_hash("features", "length", seed=SEED) < limit).orderBy("y", "length", "features").collect()
    kinds = len(_RATIOS) + 2 + 2 * _AROUND
    length = np.array([r.length for r in rows])
    features = np.zeros((len(rows), WINDOW, kinds), np.int16)
    for k, r in enumerate(rows):
        features[k, :r.length] = np.frombuffer(r.features, "<i2").reshape(r.length, kinds)
    y = np.array([r.y for r in rows])
    # Both kinds of documents weigh the same, whatever was drawn of them.
    lines = {v: max((length[y == v]).sum(), 1) for v in (0, 1)}
    weight = np.array([len(rows) / lines[int(v)] for v in y])
    tags = np.where(np.arange(WINDOW) < length[:, None], y[:, None], 0)
    for fit in range(FITS):
        weights, bias, start, move = fit_chain(features, length, tags, weight)
        if fit < FITS - 1:
            emission = np.where(np.arange(WINDOW) < length[:, None], weights[features].sum(axis=2) + bias, 0.0)
            p = marginals(emission, length, start, move)[0]
            tags = np.where((np.arange(WINDOW) < length[:, None]) & (y[:, None] == 1) & (p >= STAYS_BAD), 1, 0)
    model = Model(weights, bias, start, move, np.zeros(2))
    told = np.array([tuple(r) for r in _judged(sample, model, ["y"], "line").select("y", "line_mean").collect()], float)
    # Each row stands for as many documents as the sample left out.
    stands = np.array([1 / rates[int(v)] for v in told[:, 0]])
    model.scale = fit_scale(summary(told[:, 1]), told[:, 0], stands / stands.mean())
    return model


def _judged(docs: DataFrame, model: Model, keep: list[str], out: str) -> DataFrame:
    """`keep`, {out}_mean, {out}_score and {out}_bad_lines of every row with a `text`."""
    schema = docs.select(*keep).schema.add(f"{out}_mean", "double").add(f"{out}_score", "double").add(
        f"{out}_bad_lines", ArrayType(IntegerType())
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = len(texts)
            mean, bad = np.empty(0), [[] for _ in range(n)]
            if n:
                counts, doc, seen = line_counts(texts)
                p = model.line_marginals(line_features(counts, doc, seen)[0], doc, n)
                mean = weighted_means(p, counts[:, 0], doc, n)
                first = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
                for k in np.flatnonzero((p >= 0.5) & (counts[:, 6] > 0)).tolist():
                    bad[doc[k]].append(k - int(first[doc[k]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [
                    pa.array(mean, pa.float64()), pa.array(model.scores(mean), pa.float64()), pa.array(bad, pa.list_(pa.int32())),
                ], names=schema.names,
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(released(task), schema)


def score(docs: DataFrame, model: Model, keep: list[str], out: str = "quality") -> DataFrame:
    """`keep`, {out}_score (0 to 1, higher is better) and {out}_bad_lines (numbers from 0
    of the lines that are more likely bad than good) of every row.

    A null text counts as an empty one, which is a single empty line. `out` is the
    beginning of the new columns' names; no kept column may begin with it.
    """
    return _judged(docs, model, keep, out).drop(f"{out}_mean")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, bad_lines) of every document."""
    model = learn(docs, labels)
    told = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return told.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("quality_bad_lines").alias("bad_lines"),
    )
