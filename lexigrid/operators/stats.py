"""Benchmark statistics: medians, noise, baselines, gates and completeness."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import median_within

NOISY = 0.05


def median_mad(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """samples, median, mad, noise (mad / median, null at a zero median) and noisy by group.

    The medians, then the medians of the distances to them, both exact and picked by place;
    the group table joins back by its keys, nulls included.
    """
    keys = list(group)
    medians = materialize(median_within(df, keys, value), "medians").withColumnsRenamed({g: f"__{g}" for g in keys})
    condition = F.lit(True)
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = df.join(medians, condition).select(*keys, F.abs(F.col(value) - F.col("median")).alias("__away"))
    mads = median_within(joined, keys, "__away").withColumnRenamed("median", "mad").drop("samples")
    found = mads.join(medians, condition).select(*keys, "samples", "median", "mad")
    found = found.withColumn("noise", F.when(F.col("median") != 0, F.col("mad") / F.col("median")))
    return found.withColumn("noisy", F.coalesce(F.col("noise") > NOISY, F.lit(False)))


def noise_state(median: Column, mad: Column) -> Column:
    """zero-baseline, noisy or stable."""
    return F.when(median == 0, "zero-baseline").when(mad / median > NOISY, "noisy").otherwise("stable")


def runtime_max(metrics: DataFrame, name: str, metric: str = "metric", stance: str = "stance") -> DataFrame:
    """metrics and a row `name` with the highest median of all stances, noisy if one is."""
    worst = metrics.agg(F.max("median").alias("median"), F.max("noisy").alias("noisy"))
    return metrics.select(metric, "median", "noisy").unionByName(worst.select(F.lit(name).alias(metric), "median", "noisy"))


def relative_to(df: DataFrame, keys: Sequence[str], variant: str, baseline: str, value: str) -> DataFrame:
    """df with baseline_value, ratio and percent against the row of the baseline variant
    that shares the keys; null where that is missing or zero."""
    base = df.where(F.col(variant) == baseline).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("baseline_value"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(base, condition, "left").drop(*[f"__{k}" for k in keys])
    ratio = F.when(F.col("baseline_value") != 0, F.col(value) / F.col("baseline_value"))
    return joined.withColumn("ratio", ratio).withColumn("percent", (ratio - 1) * 100)


def missing_cells(df: DataFrame, dimensions: dict[str, Sequence[str]]) -> DataFrame:
    """Cells of the expected matrix (the product of the given short lists) without a row."""
    names = list(dimensions)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*names).schema.fields}
    expected = df.sparkSession.createDataFrame(list(product(*dimensions.values())), ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return expected.join(df.select(*dimensions).distinct(), list(dimensions), "left_anti")


def repeated_cells(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    return df.groupBy(*dimensions).agg(F.count("*").alias("n")).where("n > 1")


def gates(metrics: DataFrame, thresholds: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """thresholds (metric, threshold) with outcome: missing, inconclusive (noisy, unless the
    metric is exempt), pass (median at most the threshold) or fail."""
    joined = thresholds.join(metrics, "metric", "left")
    noisy = F.col("noisy") & ~F.col("metric").isin(*exempt) if exempt else F.col("noisy")
    return joined.withColumn("outcome", F.when(F.col("median").isNull(), "missing").when(noisy, "inconclusive").when(F.col("median") <= F.col("threshold"), "pass").otherwise("fail"))


def ceilings(candidate: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """candidate (median, mad) against base + max(0.25 base, 3 MAD of either)."""
    b = base.select(*keys, F.col("median").alias("base_median"), F.col("mad").alias("base_mad"))
    joined = candidate.join(b, list(keys), "left")
    limit = F.col("base_median") + F.greatest(0.25 * F.col("base_median"), 3 * F.col("base_mad"), 3 * F.col("mad"))
    return joined.withColumn("ceiling", limit).withColumn("within", F.col("median") <= limit)


def failed_by(df: DataFrame, group: str, name: str) -> DataFrame:
    """Sorted names that are not within their ceiling, by group."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(F.when(~F.col("within"), F.col(name)))).alias("failed"))


def completeness(df: DataFrame, group: Sequence[str], sample: str, value: str, expected: int) -> DataFrame:
    """complete: the sample numbers are just 1..expected; stable: one value, never missing."""
    return df.groupBy(*group).agg(
        ((F.count(sample) == expected) & (F.count_distinct(sample) == expected) & (F.min(sample) == 1) & (F.max(sample) == expected)).alias("complete"),
        ((F.count(value) == F.count("*")) & (F.min(value) == F.max(value))).alias("stable"),
    )


def observed(df: DataFrame, group: Sequence[str], total: str, load: str, memory: str, before: str, after: str) -> DataFrame:
    """Distinct observed totals, highest load, lowest memory and the sum of positive growth."""
    growth = F.greatest(F.lit(0), F.col(after) - F.col(before))
    return df.groupBy(*group).agg(F.sort_array(F.collect_set(total)).alias("totals"), F.max(load).alias("max_load"), F.min(memory).alias("min_memory"), F.sum(growth).alias("growth"))
