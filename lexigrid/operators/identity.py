"""De-duplication, unique lookups and template families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import manager_root, template_variant
from .ordering import number_within


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key, the one of the highest `seq` (unique within a key), and
    duplicate_count, the rows of the key. One aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"), F.count("*").alias("duplicate_count"))
    return found.select(key, "__row.*", "duplicate_count")


def duplicate_warnings(df: DataFrame, key: str) -> DataFrame:
    """DUPLICATE_DOCUMENT_ID rows with the count of each repeated key."""
    found = df.groupBy(key).agg(F.count("*").alias("duplicate_count")).where(F.col("duplicate_count") > 1)
    return found.select(F.lit("DUPLICATE_DOCUMENT_ID").alias("code"), F.col(key).alias("id"), "duplicate_count")


def with_key_count(df: DataFrame, key: Sequence[str], name: str = "same_count") -> DataFrame:
    """df with the number of rows that share the key: an aggregate and a join back, so that
    a frequent key is combined early and its join partition can be split."""
    counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias(name))
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(counts, condition, "left").drop(*[f"__{k}" for k in key])


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value if all values of the key are equal, else null."""
    same = F.min(value) == F.max(value)
    return df.groupBy(key).agg(F.when(same, F.min(value)).alias(value))


def missing_parents(drafts: DataFrame, owners: DataFrame, owner_key: str, owner_id: str = "owner_id") -> tuple[DataFrame, DataFrame]:
    """(drafts with the id of their owner, drafts whose owner has no identity)."""
    joined = drafts.join(owners.select(owner_key, owner_id), owner_key, "left")
    missing = joined.where(F.col(owner_key).isNotNull() & F.col(owner_id).isNull())
    return joined.where(F.col(owner_key).isNull() | F.col(owner_id).isNotNull()), missing.withColumn("code", F.lit("MISSING_PARENT_IDENTITY"))


def best_owner(documents: DataFrame, key: str, priority: str = "kind_priority", seq: str = "seq", doc_id: str = "id") -> DataFrame:
    """key -> id of the document of the lowest kind priority, then the first one."""
    return documents.groupBy(key).agg(F.min_by(doc_id, F.struct(priority, seq)).alias(doc_id))


def classify_templates(templates: DataFrame, managers: DataFrame, references: DataFrame) -> DataFrame:
    """templates (type_id, base) with family, variant and diagnostic.

    managers: name of manager types; the longest family that begins the base wins. Without
    one, references (type_id, family), the direct evidence, decide if they name exactly one
    family; several are AMBIGUOUS_TEMPLATE, none is UNCLASSIFIED_TEMPLATE. A base meets the
    roots by equality of its beginnings that are as long as some root.
    """
    roots = managers.select(manager_root("name").alias("root")).where("root IS NOT NULL").distinct()
    sizes = sorted(r[0] for r in roots.select(F.length("root")).distinct().collect())  # at most the longest name
    bases = templates.select("type_id", "base", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("n"))
    prefixed = bases.where("n <= length(base)").select("type_id", F.expr("substring(base, 1, n)").alias("root")).join(roots, "root")
    longest = prefixed.groupBy("type_id").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("by_root"))
    evidence = references.groupBy("type_id").agg(F.count_distinct("family").alias("n"), F.min("family").alias("by_reference"))
    found = templates.join(longest, "type_id", "left").join(evidence, "type_id", "left")
    family = F.coalesce("by_root", F.when(F.col("n") == 1, F.col("by_reference")))
    code = F.when(family.isNotNull(), None).when(F.col("n") > 1, "AMBIGUOUS_TEMPLATE").otherwise("UNCLASSIFIED_TEMPLATE")
    found = found.withColumn("family", family).withColumn("diagnostic", code)
    variant = F.when(F.col("family").isNotNull(), template_variant("base", "family"))
    return found.withColumn("variant", variant).drop("by_root", "by_reference", "n")


def family_scores(references: DataFrame) -> DataFrame:
    """Evidence rows of each (type_id, family)."""
    return references.groupBy("type_id", "family").agg(F.count("*").alias("score"))


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in key]
    found = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return found.select(*key, "__row.*")


def unique_segments(df: DataFrame, parent: str, base: str, order: str, out: str = "segment") -> DataFrame:
    """df with `out`: the base, or base-2, base-3 ... in `order` within the parent; a number
    that another title of the parent already spells is skipped.

    Repeats are numbered per (parent, base), the first takes the base itself. Only bases
    that collide with a numbered spelling (`x-2` beside a repeated `x`) need the sequential
    rule; their parents alone go to a grouped function.
    """
    numbered = number_within(df, [parent, base], [order], "__n").withColumn("__n", F.col("__n") + 1)
    plain = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("__n").cast("string")))
    numbered = numbered.withColumn(out, plain)
    clash = numbered.groupBy(parent, out).agg(F.count("*").alias("__c")).where("__c > 1").select(F.col(parent).alias("__p")).distinct()
    clear = numbered.join(clash, numbered[parent].eqNullSafe(clash["__p"]), "left_anti")
    tangled = numbered.join(clash, numbered[parent].eqNullSafe(clash["__p"]), "left_semi")

    def allot(pdf):
        pdf, used, names = pdf.sort_values(order), set(), []
        for title in pdf[base]:
            name, n = title, 1
            while name in used:
                n += 1
                name = f"{title}-{n}"
            used.add(name)
            names.append(name)
        return pdf.assign(**{out: names})

    return clear.unionByName(tangled.groupBy(parent).applyInPandas(allot, tangled.schema)).drop("__n")
