"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as the
product of its letters' vectors, the first permuted twice and the second once, so
order counts. A text is the bundle (sum) of its trigrams' vectors, a language the
bundle of its texts' unit vectors, and a text gets the language whose prototype has
the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.llm.base import fold, released, unit_hash

DIMENSIONS = 1024
SEED = 11
#: Letters share this many vectors: a-z have their own, all others are dealt out by
#: code point. 0 is the gap between words.
LETTERS = 64
#: Expected number of texts per language that prototypes are learned from.
LEARN_DOCS = 2000
UNDETERMINED = "und"
#: Cosine below which a text is like none of the learned languages: two unlike vectors
#: of this many dimensions are rarely (two deviations) as close as that. It holds where
#: too few texts tell more (`least_likeness`).
LEAST_SCORE = 2 / DIMENSIONS**0.5
#: Share of a language's own texts that may fall below the least likeness, and the number
#: of texts that it takes to say so.
CUT_QUANTILE = 0.002
LEAST_MEASURED = 100
#: Texts below 2^7 and from 2^12 characters on are one size class each.
SIZES = (6, 12)

_CHUNK = 1 << 20
#: Most cells of a count matrix held at once: 32 MB.
_CELLS = 8_000_000


@lru_cache(maxsize=1)
def _letter_of() -> np.ndarray:
    """Letter number of every code point: 0 for whatever is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if not char.isalpha():
            continue
        low = unicodedata.normalize("NFC", char.lower())[0]
        table[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 16) % (LETTERS - 27)
    return table


@lru_cache(maxsize=1)
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all (first, second) letter pairs, and of last letters."""
    rng = np.random.default_rng(SEED)
    letters = rng.choice(np.array([-1, 1], np.float32), (LETTERS, DIMENSIONS))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None] * second[None]).reshape(-1, DIMENSIONS), letters


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a whole text and how often each occurs.

    Letters are folded to lower case, other characters become one gap between
    words, and a gap also stands before and after the text.
    """
    codes = []
    table = _letter_of()
    carry = np.zeros(1, np.uint8)
    for low in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[low:low + _CHUNK].encode("utf-32-le", "replace"), "<u4")
        letters = np.concatenate([carry, table[points]])
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
        letters = letters[keep]
        codes.append(letters)
        carry = letters[-1:]
        codes[-1] = letters[:-1]
    whole = np.concatenate([*codes, carry, np.zeros(1 if carry[-1] else 0, np.uint8)]).astype(np.int32)
    if not whole.any():
        return np.empty(0, np.int32), np.empty(0, np.int64)
    grams = (whole[:-2] * LETTERS + whole[1:-1]) * LETTERS + whole[2:]
    return np.unique(grams, return_counts=True)


def bundles(texts: list[str | None]) -> np.ndarray:
    """Bundled vector of each text; zero if it has no letter."""
    pairs, letters = _vectors()
    counted = [trigram_counts(t or "") for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    low = 0
    while low < len(counted):
        # As many texts as their count matrix stays small.
        high, grams = low, 0
        while high < len(counted) and (high == low or (grams + len(counted[high][0])) * (high + 1 - low) <= _CELLS):
            grams += len(counted[high][0])
            high += 1
        part = counted[low:high]
        seen, where = np.unique(np.concatenate([c for c, _ in part]), return_inverse=True)
        if len(seen):
            rows = np.repeat(np.arange(high - low), [len(c) for c, _ in part])
            matrix = np.zeros((high - low, len(seen)), np.float32)
            matrix[rows, where] = np.concatenate([n for _, n in part])
            out[low:high] = matrix @ (pairs[seen // LETTERS] * letters[seen % LETTERS])
        low = high
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, text, lang) of about so many rows of each language, by a hash of the id.

    The table of rates has a row per language, as the prototypes have, and is broadcast.
    """
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rates = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("rate"))
    return known.join(F.broadcast(rates), "lang").where(unit_hash("doc_id", seed=SEED) < F.col("rate")).drop("rate")


def learn(labelled: DataFrame, per_language: int = LEARN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from (doc_id, text, lang).

    A sample of about `per_language` texts of each language is bundled; rows are
    chosen by a hash of their id. Rows without a language are passed over. Only one
    vector per language comes to the driver.
    """
    sample = _sample(labelled, per_language)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            unit = _unit(bundles(batch.column("text").to_pylist()))
            for lang, vector in zip(batch.column("lang").to_pylist(), unit, strict=True):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            names = [n for n in sums for _ in range(DIMENSIONS)]
            axis = np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))
            # Whole numbers add up to the same in any order.
            value = np.round(np.concatenate(list(sums.values())) * 1e9).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(axis), pa.array(value)], names=["lang", "axis", "value"])

    added = sample.select("text", "lang").mapInArrow(released(task), "lang string, axis int, value long")
    rows = added.groupBy("lang", "axis").agg(F.sum("value").alias("value")).collect()
    names = sorted({r.lang for r in rows})
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    prototypes = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        prototypes[names.index(r.lang), r.axis] = r.value
    return names, _unit(prototypes).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, out: str = "language") -> DataFrame:
    """Add `language`, `language_score` and `language_lead` to any table with a `text`.

    `language_score` is the cosine with the chosen prototype, not below 0, and
    `language_lead` what it is above the second best (above 0, if one language was
    learned). A text that is null or has no letter, or any text if no language was
    learned, is `und` with score and lead 0.
    Equal cosines go to the language that comes first by name. `out` is the beginning of
    the new columns' names; no column of `docs` may begin with it.
    """
    columns = docs.columns
    schema = docs.select("*").schema.add(out, "string").add(f"{out}_score", "double").add(f"{out}_lead", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit(bundles(batch.column("text").to_pylist()))
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            score, lead = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if names and batch.num_rows:
                cosine = vectors @ prototypes.T
                best = cosine.argmax(axis=1)
                told = vectors.any(axis=1)
                lang[told] = np.array(names, object)[best[told]]
                top = cosine[np.arange(len(best)), best]
                score[told] = np.clip(top, 0, 1)[told]
                cosine[np.arange(len(best)), best] = -np.inf
                second = np.maximum(cosine.max(axis=1), 0)
                lead[told] = np.clip(top - second, 0, 1)[told]
            arrays = [batch.column(c) for c in columns] + [pa.array(lang, pa.string()), pa.array(score), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(released(task), schema)


def _size(text: str = "text") -> Column:
    """Size class: texts between two powers of two in length, but for the ends of SIZES."""
    return F.least(F.greatest(F.floor(F.log2(F.length(text) + 1)), F.lit(SIZES[0])), F.lit(SIZES[1])).cast("int")


Cut = tuple[int | None, float, float]


def least_likeness(labelled: DataFrame, names: list[str], prototypes: np.ndarray) -> list[Cut]:
    """(size class, least score, least lead) of the learned languages' own texts.

    `labelled` (doc_id, text, lang) are rows the prototypes were not learned from; every
    one that has a language is scored, and those that get their own language
    give the CUT_QUANTILE of score and lead per size class. Short texts score less, so
    each class has its own cut. The last one, of class None, is for classes with fewer
    than LEAST_MEASURED texts: that of all texts, or the noise level and no lead if they
    are too few as well. A row per class comes to the driver.
    """
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    told = predict(known, names, prototypes, out="told").where("told = lang")
    cut = [F.percentile_approx(f"told_{c}", CUT_QUANTILE).alias(c) for c in ("score", "lead")]
    rows = told.withColumn("size", _size()).rollup("size").agg(
        F.grouping("size").alias("whole"), F.count("*").alias("n"), *cut
    ).collect()
    enough = [r for r in rows if r.n >= LEAST_MEASURED]
    rest = next(((None, r.score, r.lead) for r in enough if r.whole), (None, LEAST_SCORE, 0.0))
    return [(r["size"], r.score, r.lead) for r in enough if not r.whole] + [rest]


def is_known(cuts: list[Cut], out: str = "language", text: str = "text") -> Column:
    """Whether a predicted text is as like its language as the language's own texts are."""
    def reaches(score: float, lead: float) -> Column:
        return (F.col(f"{out}_score") >= score) & (F.col(f"{out}_lead") >= lead)

    known = reaches(*cuts[-1][1:])
    for size, score, lead in cuts[:-1]:
        known = F.when(_size(text) == size, reaches(score, lead)).otherwise(known)
    return (F.col(out) != UNDETERMINED) & known


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows the prototypes are not learned from."""
    return fold(F.col(doc_id) if isinstance(doc_id, str) else doc_id, 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang)."""
    names, prototypes = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    told = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), names, prototypes)
    return told.select(
        "doc_id", held_out().alias("held_out"), F.col("language").alias("lang_pred"), F.col("language_score").alias("score")
    )
