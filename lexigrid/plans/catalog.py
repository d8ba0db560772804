"""The fact catalogue over the star schema, as the index tables of `schemas`.

Regions own nations, nations own suppliers and customers, customers own orders; parts stand
alone. Every builder is a plain select, so columns that a query does not use are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_keys
from ..session import table

#: Kinds of the catalogue with their priority.
PRIORITY = {"region": 10, "nation": 20, "supplier": 30, "customer": 40, "part": 50, "order": 60}


def fact(kind: str, key: str, name, alias=None, owner_kind: str | None = None, owner_key: str | None = None) -> list:
    none = F.lit(None).cast("string")
    return [
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"),
        F.lit(kind).alias("kind"),
        F.lit(PRIORITY[kind]).alias("kind_priority"),
        F.col(name).alias("name_primary"),
        (F.col(alias) if alias else none).alias("name_alias"),
        (F.concat(F.lit(f"{owner_kind}:"), F.col(owner_key).cast("string")) if owner_kind else none).alias("owner_id"),
    ]


def documents(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("region", "nation", "supplier", "customer", "part")) -> DataFrame:
    """id, kind, kind_priority, name_primary, name_alias, owner_id of all facts of the kinds."""
    made = {
        "region": ("region", fact("region", "r_regionkey", "r_name")),
        "nation": ("nation", fact("nation", "n_nationkey", "n_name", None, "region", "n_regionkey")),
        "supplier": ("supplier", fact("supplier", "s_suppkey", "s_name", None, "nation", "s_nationkey")),
        "customer": ("customer", fact("customer", "c_custkey", "c_name", None, "nation", "c_nationkey")),
        "part": ("part", fact("part", "p_partkey", "p_name", "p_brand")),
    }
    found = None
    for kind in kinds:
        name, columns = made[kind]
        df = table(spark, sf_dir, name).select(*columns)
        found = df if found is None else found.unionByName(df)
    return found


def with_owner_names(docs: DataFrame, owners: DataFrame) -> DataFrame:
    return docs.join(owners.select(F.col("id").alias("owner_id"), F.col("name_primary").alias("owner_primary")), "owner_id", "left")


def document_names(docs: DataFrame) -> DataFrame:
    """(key, key_kind, document_id); needs owner_primary."""
    keys = name_keys(F.col("name_primary"), F.col("name_alias"), F.col("owner_primary"))
    return docs.select(F.col("id").alias("document_id"), F.explode(keys).alias("k")).select("k.key", "k.key_kind", "document_id")


def members(docs: DataFrame) -> DataFrame:
    owned = docs.where("owner_id IS NOT NULL")
    return owned.select(F.col("id").alias("member_id"), F.col("owner_id").alias("owner_type_id"), F.col("kind").alias("member_kind"), "name_primary", "name_alias", F.col("id").alias("document_id"))


def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written references of the order lines, one row for each distinct (role, name) with the
    number of lines: a line names its part, its supplier, and its part's brand."""
    lines = table(spark, sf_dir, "lineitem")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    by_part = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).join(part.select("p_partkey", "p_name", "p_brand"), "p_partkey")
    by_supplier = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")).join(supplier.select("s_suppkey", "s_name"), "s_suppkey")
    rows = by_part.select(F.lit("part").alias("ref_kind"), F.col("p_name").alias("target_name"), "n")
    rows = rows.union(by_part.select(F.lit("brand"), F.upper("p_brand"), "n")).union(by_supplier.select(F.lit("supplier"), F.upper("s_name"), "n"))
    return rows.groupBy("ref_kind", "target_name").agg(F.sum("n").alias("n"))
