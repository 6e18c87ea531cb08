"""Ordered work on keyed rows without giving a key's whole history to one task.

A key may hold a large part of all rows, so nothing here sorts a whole key. Time is cut into
slices; each slice of a key is sorted alone, with the few rows around it that the look-back or
look-ahead needs. Where state must travel over any distance, a per-slice summary carries it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(float(width))).cast("bigint")


def reach_width(reach: float) -> float:
    """Width of the slices in which `with_next` and `with_previous` look for a neighbour."""
    return max(float(reach), 3600.0)


def with_next(
    df: DataFrame, keys: Sequence[str], at: str, tie: str, reach: float, value: Column, name: str,
    sliced: str | None = None,
) -> DataFrame:
    """Adds `name` = value of the next row of the key within `reach`, NULL if there is none.

    sliced: a column for the row's slice of `reach_width`. Rows lie by keys and slice, so work on slices
    of a key that goes by this column shuffles nothing again.
    """
    return _neighbour(df, keys, at, tie, reach, value, name, ahead=True, sliced=sliced)


def with_previous(
    df: DataFrame, keys: Sequence[str], at: str, tie: str, reach: float, value: Column, name: str
) -> DataFrame:
    """Adds `name` = value of the previous row of the key within `reach`, NULL if none."""
    return _neighbour(df, keys, at, tie, reach, value, name, ahead=False)


def _neighbour(df, keys, at, tie, reach, value, name, ahead: bool, sliced: str | None = None) -> DataFrame:
    width = reach_width(reach)
    own = slice_of(F.col(at), width)
    other = slice_of(F.col(at) - reach, width) if ahead else slice_of(F.col(at) + reach, width)
    first, last = (other, own) if ahead else (own, other)
    copies = df.withColumn("_slice", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_slice").orderBy(at, tie)
    step = F.lead if ahead else F.lag
    near = copies.select(
        "*", step(F.struct(F.col(at).alias("at"), value.alias("value"))).over(w).alias("_near")
    )
    rows = near.where(F.col("_slice") == own)
    distance = F.abs(F.col("_near.at") - F.col(at))
    found = rows.withColumn(
        name, F.when(distance <= F.lit(float(reach)), F.col("_near.value"))
    ).drop("_near")
    return found.withColumnRenamed("_slice", sliced) if sliced else found.drop("_slice")


def rank_by_slices(
    df: DataFrame, keys: Sequence[str], at: str, width: int, name: str
) -> DataFrame:
    """Adds `name` = 1 + number of the key's rows with a smaller `at` (a whole number).

    Slices of a key are ranked alone and shifted by the row counts of the slices before; only
    those counts are ordered per key.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(at) / F.lit(width)).cast("bigint"))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(at)
    ranked = sliced.withColumn("_rank", F.rank().over(inside))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.col("_rank")).cast("bigint").alias(name)
    )


def held_since(
    df: DataFrame, keys: Sequence[str], at: str, holds: str, width: float, name: str,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Adds `name` = when the current unbroken run of true `holds` began, NULL where it is false.

    carried: optional (keys, since) state of an earlier batch, older than every row here.
    """
    sliced = df.withColumn("_slice", slice_of(F.col(at), width))
    false_at = F.when(~F.col(holds), F.col(at))
    true_at = F.when(F.col(holds), F.col(at))
    last_false = sliced.groupBy(*keys, "_slice").agg(F.max(false_at).alias("_last_false"))
    # A run reaching the slice's end starts at the first true row after its last false row.
    tails = (
        sliced.join(last_false, [*keys, "_slice"])
        .groupBy(*keys, "_slice")
        .agg(
            F.max("_last_false").alias("_last_false"),
            F.min(
                F.when(
                    F.col("_last_false").isNull() | (F.col(at) > F.col("_last_false")), true_at
                )
            ).alias("_tail"),
        )
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    breaks = F.sum(F.col("_last_false").isNotNull().cast("int")).over(by_slice)
    runs = tails.withColumn("_run", breaks)
    before = (
        Window.partitionBy(*keys, "_run")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The run's start as known at the end of each slice; the next slice inherits it.
    ends = runs.withColumn("_since_end", F.min("_tail").over(before))
    carry = ends.select(
        *keys, "_slice", F.lag("_since_end").over(by_slice).alias("_carry"),
        F.row_number().over(by_slice).alias("_nth"),
        F.col("_run"),
    )
    if carried is not None:
        old = carried.select(*keys, F.col("since").alias("_old"))
        carry = carry.join(old, list(keys), "left")
    else:
        carry = carry.withColumn("_old", F.lit(None).cast("double"))
    # State of an earlier batch reaches a slice when no false row lies in the slices before it.
    prior_breaks = F.lag("_run", 1, 0).over(by_slice)
    carry = carry.withColumn("_reach", prior_breaks == 0)
    carry = carry.select(
        *keys,
        "_slice",
        F.when(F.col("_reach"), F.coalesce("_old", "_carry")).otherwise(F.col("_carry"))
        .alias("_carry"),
    )
    rows = sliced.join(carry, [*keys, "_slice"], "left")
    inside = Window.partitionBy(*keys, "_slice").orderBy(at)
    run = F.sum((~F.col(holds)).cast("int")).over(inside)
    marked = rows.withColumn("_run", run)
    in_run = (
        Window.partitionBy(*keys, "_slice", "_run")
        .orderBy(at)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    own_start = F.min(true_at).over(in_run)
    since = F.when(
        F.col(holds),
        F.when(F.col("_run") == 0, F.coalesce("_carry", own_start)).otherwise(own_start),
    )
    return marked.withColumn(name, since).select(*df.columns, name)
