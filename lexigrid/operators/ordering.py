"""Order-dependent steps over keys of any size: one exchange by ranges of (key, order), then
work within each range, and a small table of what the ranges before it hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written in ranges, with __part (its range) and __at (its place, rising in a range)."""
    by = [*keys, *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number holds the partition in its upper bits and the place in it in the lower ones
    found = materialize(sorted_.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    return found.withColumn("__part", F.shiftright("__at", 33))


def _with_before(ranged: DataFrame, keys: Sequence[str], made: Column, before) -> DataFrame:
    """ranged with __first (place of the key's first row in the range) and __before: what
    `before` says over the values `made` of the key's earlier ranges (a row for each range
    of a key)."""
    parts = ranged.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), made.alias("__made"))
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", before("__made").over(earlier)).drop("__made")
    condition = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranged.join(parts, condition).drop("__p", *[f"__k{i}" for i in range(len(keys))])


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with `out`, the place from 0 within the rows of its keys, by `order` (rows alike in
    it are numbered in any order)."""
    found = _with_before(_ranged(df, keys, order), keys, F.count("*"), F.sum)
    place = F.coalesce("__before", F.lit(0)) + F.col("__at") - F.col("__first")
    return found.withColumn(out, place).drop("__at", "__part", "__first", "__before")


def last_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with `out`: the last value that is not null at or before the row, within its keys."""
    ranged = _ranged(df, keys, order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at")))
    found = _with_before(ranged, keys, last, lambda c: F.last(c, ignorenulls=True))
    own = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(own), "__before")).drop("__at", "__part", "__first", "__before")


def median_within(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median and samples (values that are not null): the mean of the two middle values,
    picked by their places, so that no task holds the values of a key."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__value"))
    placed = number_within(rows, keys, ["__value"], "__place")
    sizes = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("samples"))
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    middle = placed.join(sizes, condition).where("__place = (samples - 1) DIV 2 OR __place = samples DIV 2")
    return middle.groupBy(*keys).agg((F.sum("__value") / F.count("*")).alias("median"), F.first("samples").alias("samples"))
