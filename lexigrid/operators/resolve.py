"""Type references: candidates, three-valued outcomes and gap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key, reference_key


def candidate_keys(types: DataFrame, name_columns: Sequence[str] = ("name_primary", "name_alias"), metadata_column: str | None = None) -> DataFrame:
    """(key, id, spelling, from_metadata) of every name that a type can be referred to by."""
    found = None
    for name in [*name_columns, *([metadata_column] if metadata_column else [])]:
        rows = types.where(F.col(name).isNotNull()).select(
            normalize_key(name).alias("key"), F.col("id").alias("id"), reference_key(name).alias("spelling"), F.lit(name == metadata_column).alias("from_metadata")
        )
        found = rows if found is None else found.union(rows)
    return found


def resolve(references: DataFrame, keys: DataFrame, name: str = "target_name") -> DataFrame:
    """references with target_id, status (ok, unresolved, ambiguous) and candidates (sorted
    ids, if ambiguous).

    If several types share the key and none of them by a metadata name, those of the exact
    spelling (blanks kept) are taken instead where there are any. Each distinct written name
    is resolved once, so candidate lists do not multiply with the references.
    """
    wanted = references.select(F.col(name).alias("__name")).where("__name IS NOT NULL").distinct()
    wanted = wanted.withColumn("key", normalize_key("__name")).withColumn("__spelling", reference_key("__name"))
    matched = wanted.join(keys, "key")
    grouped = matched.groupBy("__name").agg(
        F.array_sort(F.collect_set("id")).alias("all"),
        F.array_sort(F.collect_set(F.when(F.col("spelling") == F.col("__spelling"), F.col("id")))).alias("exact"),
        F.max("from_metadata").alias("metadata"),
    )
    narrow = (F.size("all") > 1) & ~F.col("metadata") & (F.size("exact") > 0)
    chosen = grouped.select("__name", F.when(narrow, F.col("exact")).otherwise(F.col("all")).alias("__ids"))
    joined = references.join(chosen, references[name] == chosen["__name"], "left").drop("__name")
    n = F.coalesce(F.size("__ids"), F.lit(0))
    return (
        joined.withColumn("target_id", F.when(n == 1, F.col("__ids")[0]))
        .withColumn("status", F.when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("unresolved"))
        .withColumn("candidates", F.when(n > 1, F.col("__ids")))
        .drop("__ids")
    )


def resolve_constructors(references: DataFrame, owner: str = "owner_type_id") -> DataFrame:
    """A constructor's result always is its owner type."""
    own = (F.col("ref_kind") == "constructor_result") & F.col(owner).isNotNull()
    return (
        references.withColumn("target_id", F.when(own, F.col(owner)).otherwise(F.col("target_id")))
        .withColumn("status", F.when(own, "ok").otherwise(F.col("status")))
        .withColumn("candidates", F.when(own, None).otherwise(F.col("candidates")))
    )


def gap_roles(references: DataFrame, role: str = "ref_kind", weight: str | None = None, bindings: str = "bindings") -> DataFrame:
    """Counts by role and status, of those with a template binding, and a row of totals
    (role null)."""
    one = F.col(weight) if weight else F.lit(1)
    bound = F.col(bindings).isNotNull() if bindings in references.columns else F.lit(False)
    count = lambda s: F.sum(F.when(F.col("status") == s, one).otherwise(0)).cast("long")
    return references.rollup(F.col(role).alias("role")).agg(
        F.sum(one).cast("long").alias("total"), count("ok").alias("resolved"), count("unresolved").alias("unresolved"), count("ambiguous").alias("ambiguous"), F.sum(F.when(bound, one).otherwise(0)).cast("long").alias("with_binding")
    )


def gap_groups(references: DataFrame, role: str, name: str, example: str, limit: int = 10) -> DataFrame:
    """The `limit` most frequent unresolved or ambiguous (role, name): count, candidates of
    the group and at most three examples, the smallest. Only the running three smallest
    examples of a group are kept while rows are combined."""
    gaps = references.where(F.col("status") != "ok")
    counts = gaps.groupBy(F.col(role).alias("role"), F.col(name).alias("target_name")).agg(F.count("*").alias("n"), F.first("candidates", True).alias("candidates"))
    top = counts.orderBy(F.desc("n"), "role", "target_name").limit(limit)
    rows = gaps.join(F.broadcast(top.select(F.col("role").alias(role), F.col("target_name").alias(name))), [role, name])
    distinct = rows.select(F.col(role).alias("role"), F.col(name).alias("target_name"), F.col(example).alias("example")).distinct()
    examples = distinct.groupBy("role", "target_name").agg(F.slice(F.array_sort(F.collect_list("example")), 1, 3).alias("examples"))
    return top.join(examples, ["role", "target_name"], "left").orderBy(F.desc("n"), "role", "target_name")


def anchored_classes(references: DataFrame, anchors: DataFrame, name: str, scope_matches) -> DataFrame:
    """references with the class of the anchor of their name whose scope predicate holds
    (null if none): a left outer join with a residual condition."""
    condition = (references[name] == anchors["anchor_name"]) & scope_matches(references, anchors)
    return references.join(anchors, condition, "left")
