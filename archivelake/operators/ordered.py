"""Numbering, running sums and neighbours in two levels.

A plain window over `partitionBy(inbox)` puts a whole inbox in one task. Here the
order column is cut into buckets, the window runs inside (keys, bucket), and a
small table with one row per bucket carries the totals across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 50_000


def bucket(order: Column, width: int = WIDTH) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def _before(summary: DataFrame, keys: list[str], value: str, out: str, descending: bool) -> DataFrame:
    by = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str] | None = None,
    width: int = WIDTH,
    descending: bool = False,
    out: str = "rn",
) -> DataFrame:
    """Dense 1-based row numbers per key by a numeric `order` column."""
    names = [order, *(ties or [])]
    by = [F.col(n).desc() if descending else F.col(n).asc() for n in names]
    cut = df.withColumn("_bucket", bucket(F.col(order), width))
    local = cut.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*by))
    )
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = _before(sizes, keys, "_n", "_skip", descending).drop("_n")
    joined = local.join(offsets, [*keys, "_bucket"], "left")
    return joined.withColumn(out, (F.col(out) + F.col("_skip")).cast("long")).drop(
        "_bucket", "_skip"
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    width: int = WIDTH,
    descending: bool = False,
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum per key; `order` is unique within a key."""
    by = F.col(order).desc() if descending else F.col(order).asc()
    cut = df.withColumn("_bucket", bucket(F.col(order), width)).withColumn("_value", value)
    window = (
        Window.partitionBy(*keys, "_bucket").orderBy(by)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = cut.withColumn(out, F.sum("_value").over(window))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_n"))
    offsets = _before(sums, keys, "_n", "_skip", descending).drop("_n")
    joined = local.join(offsets, [*keys, "_bucket"], "left")
    return joined.withColumn(out, F.col(out) + F.col("_skip")).drop(
        "_bucket", "_skip", "_value"
    )


def running_from_end(
    changes: DataFrame, keys: list[str], order: str, step: Column, width: int = WIDTH
) -> DataFrame:
    """Adds left standing when deletes cancel adds, read from the newest back.

    `step` is +1 for a delete and -1 for an add. An add stands when the deletes
    after it are all used up by adds between. That is the case exactly when the
    balance at the add is a new minimum below zero, which a running minimum over
    later entries shows.
    """
    with_balance = running_sum(changes, keys, order, step, width, True, "_balance")
    cut = with_balance.withColumn("_bucket", bucket(F.col(order), width))
    window = (
        Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_low", F.min("_balance").over(window))
    lows = cut.groupBy(*keys, "_bucket").agg(F.min("_balance").alias("_b_low"))
    across = (
        Window.partitionBy(*keys).orderBy(F.col("_bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = lows.withColumn("_later_low", F.min("_b_low").over(across)).drop("_b_low")
    joined = local.join(carried, [*keys, "_bucket"], "left")
    low = F.least(
        F.coalesce(F.col("_low"), F.lit(0)), F.coalesce(F.col("_later_low"), F.lit(0)), F.lit(0)
    )
    stands = (F.col("op") == "m") & (F.col("_balance") < low)
    return joined.where(stands).select(*changes.columns)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str | list[str],
    ties: list[str] | None = None,
    width: int = WIDTH,
    previous: str | None = "prev",
    following: str | None = "next",
) -> DataFrame:
    """Struct of `value` columns of the previous and next row per key.

    With a single `value` name the columns hold plain values.
    """
    values = [value] if isinstance(value, str) else value
    names = [order, *(ties or [])]
    item = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*names)
    cut = df.withColumn("_bucket", bucket(F.col(order), width)).withColumn("_item", item)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*names)
    local = cut.withColumn("_prev", F.lag("_item").over(inside)).withColumn(
        "_next", F.lead("_item").over(inside)
    )
    edges = cut.groupBy(*keys, "_bucket").agg(
        F.min_by("_item", rank).alias("_head"), F.max_by("_item", rank).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.withColumn("_before", F.lag("_tail").over(across)).withColumn(
        "_after", F.lead("_head").over(across)
    ).drop("_head", "_tail")
    joined = local.join(edges, [*keys, "_bucket"], "left")

    def shown(near: str, far: str) -> Column:
        both = F.coalesce(F.col(near), F.col(far))
        return both[values[0]] if len(values) == 1 else both

    if previous:
        joined = joined.withColumn(previous, shown("_prev", "_before"))
    if following:
        joined = joined.withColumn(following, shown("_next", "_after"))
    return joined.drop("_bucket", "_item", "_prev", "_next", "_before", "_after")


def running_latest(
    df: DataFrame, keys: list[str], cut: Column, order: list[str], value: Column, out: str,
    largest: bool = False, inclusive: bool = True,
) -> DataFrame:
    """Latest non-null (or largest) `value` at or before each row, per key.

    `cut` is a bucket that never falls along the order. The window runs inside
    (keys, bucket); one row per bucket carries the value onward.
    """
    rows = df.withColumn("_bucket", cut).withColumn("_value", value)
    pick = F.max if largest else (lambda c: F.last(c, ignorenulls=True))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = rows.withColumn("_near", pick("_value").over(inside))
    known = rows.where(F.col("_value").isNotNull())
    per_bucket = known.groupBy(*keys, "_bucket").agg(
        (F.max("_value") if largest else F.max_by("_value", F.struct(*order))).alias("_end")
    )
    buckets = rows.select(*keys, "_bucket").distinct().join(per_bucket, [*keys, "_bucket"], "left")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_far", pick("_end").over(across)).drop("_end")
    joined = local.join(carried, [*keys, "_bucket"], "left")
    both = F.greatest("_near", "_far") if largest else F.coalesce("_near", "_far")
    return joined.withColumn(out, both).drop("_bucket", "_value", "_near", "_far")
