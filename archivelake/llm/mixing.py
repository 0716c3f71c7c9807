"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed per cell of the dimensions - source, language, topic. Raking scales
the cells until the token shares along every dimension meet their targets, and keeps
each cell's weight per token within a bound. Documents are then sampled with a
probability in proportion to their cell's weight per token, so expected token shares
are the targets. All of it is DataFrame operations; only the cells are iterated over.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm.base import unit_hash
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable, durable_count

SEED = 31
#: Topics by what a text contains; the first that fits counts, the rest is prose.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("legal", ("Licensed under", "Copyright", "All rights reserved")), ("table", (" | ",)), ("contact", ("@",)),
)
OTHER_TOPIC = "prose"


@dataclass(frozen=True)
class Target:
    """Wanted token shares along one dimension.

    With `shares`, listed values get theirs and all others together get `other`, divided
    by their tokens. Without, every value's share is its token share to the power
    `exponent`: below 1 it lifts rare values. Shares are made to add up to one over the
    values that have tokens, so a target that nothing can meet is left out.
    """

    shares: dict[str, float] | None = None
    other: float = 0.0
    exponent: float = 1.0


@dataclass(frozen=True)
class Mix:
    targets: dict[str, Target] = field(default_factory=lambda: {
        "source": Target(exponent=0.7),
        "lang": Target(shares={"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.10}, other=0.01),
        "topic": Target(exponent=0.8),
    })
    #: Most weight per token of a cell, in multiples of the mean; 1 over it is the least
    #: share of all tokens that the sample is expected to keep.
    bound: float = 3.0
    rounds: int = 24
    tolerance: float = 1e-4
    #: Up to this many cells, or values of a dimension, are broadcast.
    broadcast_rows: int = 20_000


def topic(text: Column) -> Column:
    """Topic of a text by TOPICS; a null text is prose."""
    out = F.lit(OTHER_TOPIC)
    for name, marks in reversed(TOPICS):
        found = text.contains(marks[0])
        for mark in marks[1:]:
            found = found | text.contains(mark)
        out = F.when(found, name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Words of a text, for want of a tokenizer in the JVM; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: int, mix: Mix, spread_on: list[str]) -> DataFrame:
    if n <= mix.broadcast_rows:
        return rows.join(F.broadcast(table), keys)
    return salted_lookup(rows, table, keys, spread_on)


def _wanted(cells: DataFrame, name: str, target: Target) -> DataFrame:
    """(name, wanted): the share of every value with tokens, adding up to one."""
    sums = cells.where("tokens > 0").groupBy(name).agg(F.sum("tokens").cast("double").alias("have"))
    if target.shares is None:
        raw = sums.withColumn("raw", F.pow("have", F.lit(target.exponent)))
    else:
        listed = F.lit(None).cast("double")
        for value, share in target.shares.items():
            listed = F.when(F.col(name) == value, F.lit(float(share))).otherwise(listed)
        marked = sums.withColumn("listed", listed)
        rest = marked.agg(F.sum(F.when(F.col("listed").isNull(), F.col("have"))).alias("rest"))
        raw = marked.crossJoin(F.broadcast(rest)).withColumn(  # `rest` is one row
            "raw", F.coalesce("listed", F.lit(target.other) * F.col("have") / F.col("rest"))
        )
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select(name, (F.col("raw") / F.col("total")).alias("wanted"))


def rake(cells: DataFrame, mix: Mix) -> tuple[DataFrame, int, int]:
    """Cells with `weight`, their number, and the rounds it took.

    `cells` has the dimensions of the mix and `tokens`. A round scales the weights along
    each dimension in turn to the wanted shares and then bounds them; it is over when no
    scale is off by more than the tolerance, or after `rounds`, as bounds may keep
    targets out of reach: then a warning says by how much. Weights add up to about one.

    Up to `broadcast_rows` cells are put in one partition, where the rounds need no
    shuffle; more of them are shuffled by each dimension in turn.
    """
    names = list(mix.targets)
    total = F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("total")))  # one row
    current, n_cells = durable_count(
        cells.where("tokens > 0").crossJoin(total).select(
            *names, "tokens", (F.col("tokens") / F.col("total")).alias("share")
        ).withColumn("weight", F.col("share")), F.lit(True)
    )
    for i, (name, target) in enumerate(mix.targets.items()):
        table, n = durable_count(_wanted(cells, name, target), F.lit(True))
        others = [c for c in names if c != name]
        current = _lookup(current, table.withColumnRenamed("wanted", f"wanted{i}"), [name], n, mix, others)
    small = n_cells <= mix.broadcast_rows
    current = durable(current.coalesce(1) if small else current)
    done, columns = 0, current.columns
    while done < mix.rounds:
        step = (current.coalesce(1) if small else current).withColumn("off", F.lit(0.0))
        for i, name in enumerate(names):
            now = F.sum("weight").over(Window.partitionBy(name))
            step = step.withColumn("scale", F.when(now > 0, F.col(f"wanted{i}") / now).otherwise(1.0))
            step = step.withColumn("off", F.greatest("off", F.abs(F.col("scale") - 1))).withColumn(
                "weight", F.col("weight") * F.col("scale")
            ).drop("scale")
        step = step.withColumn("weight", F.least("weight", F.lit(mix.bound) * F.col("share")))
        done += 1
        current, off = durable_count(step.select(*columns, "off"), F.col("off") > mix.tolerance)
        if not off:
            break
        if done == mix.rounds:
            worst = current.agg(F.max("off")).first()[0]
            warnings.warn(
                f"targets unmet after {done} rounds: shares still move by up to {worst:.2%}", stacklevel=2
            )
        current = current.drop("off")
    return current.select(*names, "tokens", "share", "weight"), n_cells, done


def sampling_rates(cells: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """(dimensions, rate) per cell with tokens: the probability of keeping a document.

    The cell with most weight per token is kept whole, so no rate is above one and rates
    are in the exact proportion of the raked weights.
    """
    raked, n_cells, _ = rake(cells, mix)
    rated = raked.withColumn("per_token", F.col("weight") / F.col("share"))
    most = rated.agg(F.max("per_token").alias("most"))
    rate = F.round(F.col("per_token") / F.col("most"), 9)
    return durable(rated.crossJoin(F.broadcast(most)).select(*mix.targets, rate.alias("rate"))), n_cells


def sample(docs: DataFrame, mix: Mix | None = None, seed: int = SEED, out: str = "mix") -> DataFrame:
    """Add mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_sampled.

    `docs` needs doc_id, text, source and lang; all its columns are kept, and
    `out` is the beginning of the new ones' names, which none of them may have. A null source or language is the empty value. A text
    without words carries no tokens: its probability is its cell's, or 0 if no text of
    the cell has any. Whether a document is sampled depends on its id, its text and the
    seed alone, so repeated rows share a fate and a lost task repeats it.
    """
    mix = mix or Mix()
    names = list(mix.targets)
    keys = [f"{out}_{n}" for n in names]
    values = {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": topic(F.coalesce("text", F.lit(""))),
    }
    described = docs.withColumns(
        {f"{out}_{n}": values[n] for n in names} | {f"{out}_tokens": word_count(F.col("text"))}
    )
    cells = durable(described.groupBy(*keys).agg(F.sum(f"{out}_tokens").alias("tokens")).toDF(*names, "tokens"))
    rates, _ = sampling_rates(cells, mix)
    # Cells without tokens have no rate of their own.
    every = cells.select(*names).join(rates, names, "left").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.coalesce("rate", F.lit(0.0)).alias(f"{out}_probability")
    )
    rated = _lookup(described, every, keys, cells.count(), mix, ["doc_id"])
    draw = unit_hash("doc_id", F.xxhash64("text"), seed=seed)
    return rated.withColumn(f"{out}_sampled", draw < F.col(f"{out}_probability"))
