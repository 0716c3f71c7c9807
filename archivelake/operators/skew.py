"""Joins and group totals that stay even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def _salt(spread_on: str | list[str], salts: int) -> Column:
    names = [spread_on] if isinstance(spread_on, str) else spread_on
    return F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread_on: str | list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join `facts` to `dim` on `keys` when a key may be very frequent in facts.

    `dim` must have one row per key. The distinct (key, salt) pairs of the facts
    meet `dim` first: at most `salts` rows per key, pre-aggregated before the
    shuffle. The facts then join on (key, salt), so a hot key is spread over
    `salts` tasks and no side is broadcast or replicated as a whole.
    """
    salted = facts.withColumn("_salt", _salt(spread_on, salts))
    pairs = salted.select(*keys, "_salt").distinct()
    found = pairs.join(dim, keys, "inner")
    if how in ("left_semi", "left_anti"):
        found = found.select(*keys, "_salt")
    return salted.join(found, [*keys, "_salt"], how).drop("_salt")


def with_group_totals(
    facts: DataFrame,
    keys: list[str],
    partials: dict[str, tuple[Column, str]],
    spread_on: str | list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Attach per-key totals to every row without one task per key.

    `partials` maps an output name to (input column, combiner) where the
    combiner is `min`, `max` or `sum`. Rows with a null key keep null totals.
    """
    combine = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = facts.withColumn("_salt", _salt(spread_on, salts))
    part = salted.groupBy(*keys, "_salt").agg(
        *[combine[how](col).alias(name) for name, (col, how) in partials.items()]
    )
    # At most `salts` rows per key from here on.
    per_key = Window.partitionBy(*keys)
    lookup = part.select(
        *keys, "_salt",
        *[combine[how](name).over(per_key).alias(name) for name, (_, how) in partials.items()],
    )
    return salted.join(lookup, [*keys, "_salt"], "left").drop("_salt")


def keep_first(
    df: DataFrame, keys: list[str], order: list[str], row_id: str | list[str]
) -> DataFrame:
    """The first row of every key by `order`; ties are settled by `row_id`.

    The winner is found with a partially aggregated minimum and kept with a semi join
    on key and row id, so copies of one key are never gathered and a row id that comes
    again under another key does not save its row. Rows with a null key or id go.
    """
    ids = [row_id] if isinstance(row_id, str) else row_id
    names = list(dict.fromkeys([*order, *ids]))
    if len(names) == 1:  # a plain minimum stays in a hash aggregate
        winners = df.groupBy(*keys).agg(F.min(names[0]).alias(names[0]))
    else:
        best = df.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_best"))
        winners = best.select(*keys, *[F.col("_best")[i].alias(i) for i in ids if i not in keys])
    return df.join(winners, list(dict.fromkeys([*keys, *ids])), "left_semi")
