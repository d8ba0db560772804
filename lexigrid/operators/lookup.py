"""Exact lookups over the fact index: plain filters and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..schemas import CALLABLE_KINDS

ORDER = ("kind_priority", "id")


def by_id(documents: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Documents of the given ids (a list, or a DataFrame with a column id)."""
    if isinstance(ids, DataFrame):
        return documents.join(ids.select("id").distinct(), "id", "left_semi")
    return documents.where(F.col("id").isin(*ids))


def by_kind(documents: DataFrame, kind: str) -> DataFrame:
    return documents.where(F.col("kind") == kind).orderBy("kind_priority", "name_primary", "id")


def by_name(names: DataFrame, documents: DataFrame, name: str | DataFrame, key_kinds: Sequence[str] | None = None) -> DataFrame:
    """Documents found under a name in any spelling of case and blanks. `name` may be a
    DataFrame with a column `query`: then each hit carries its query."""
    hits = names.where(F.col("key_kind").isin(*key_kinds)) if key_kinds else names
    if isinstance(name, DataFrame):
        wanted = name.select("query", normalize_key("query").alias("key")).distinct()
        return hits.join(wanted, "key").select("query", F.col("document_id").alias("id")).distinct().join(documents, "id")
    spark = documents.sparkSession
    wanted = spark.range(1).select(normalize_key(F.lit(name)).alias("key"))
    key = wanted.first()["key"]
    return hits.where(F.col("key") == key).select(F.col("document_id").alias("id")).distinct().join(documents, "id").orderBy(*ORDER)


def owner_member(names: DataFrame, documents: DataFrame, owner: str, member: str) -> DataFrame:
    return by_name(names, documents, f"{owner}.{member}", ["owner_member_primary", "owner_member_alias"])


def types_by_name(names: DataFrame, identities: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """Type documents by primary name or alias, without repeats, by id."""
    found = by_name(names, documents, name, ["primary", "alias"])
    return found.join(identities.select(F.col("document_id").alias("id"), "type_id"), "id").dropDuplicates(["id"]).orderBy("id")


def by_template(templates: DataFrame, documents: DataFrame, identities: DataFrame, family: str, variant: str) -> DataFrame:
    wanted = templates.where((F.col("family") == family) & (F.col("variant") == variant))
    return wanted.join(identities, "type_id").select(F.col("document_id").alias("id")).join(documents, "id").orderBy(*ORDER)


def members_of(members: DataFrame, documents: DataFrame, owner_type_id: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Members of a type, optionally of a name and a kind."""
    found = members.where(F.col("owner_type_id") == owner_type_id)
    if kind:
        found = found.where(F.col("member_kind") == kind)
    if name:
        key = normalize_key(F.lit(name))
        found = found.where((normalize_key("name_primary") == key) | (normalize_key("name_alias") == key))
    found = found.select(F.col("document_id").alias("id"), F.col("name_primary").alias("member_name"))
    return found.join(documents, "id").orderBy("kind_priority", "member_name", "id")


def callables_of(callables: DataFrame, documents: DataFrame, owner_type_id: str | None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Callables of an owner type (None: those without an owner)."""
    owner = F.col("owner_type_id").isNull() if owner_type_id is None else F.col("owner_type_id") == owner_type_id
    found = callables.where(owner)
    if kind:
        found = found.where(F.col("callable_kind") == kind)
    found = found.select(F.col("document_id").alias("id")).join(documents, "id")
    if name:
        key = normalize_key(F.lit(name))
        found = found.where((normalize_key("name_primary") == key) | (normalize_key("name_alias") == key))
    return found.orderBy(*ORDER)


def constructors_of(callables: DataFrame, documents: DataFrame, owner_type_id: str, limit: int = 100) -> DataFrame:
    return callables_of(callables, documents, owner_type_id, kind="constructor").limit(limit)


def callable_exists(documents: DataFrame, doc_id: str) -> bool:
    return bool(documents.where((F.col("id") == doc_id) & F.col("kind").isin(*CALLABLE_KINDS)).limit(1).count())


def in_context(names: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query, context): documents that have the query as a name key and the context
    as a module key."""
    a = names.where(F.col("key_kind") != "module_context").select(F.col("key").alias("query"), "document_id")
    b = names.where(F.col("key_kind") == "module_context").select(F.col("key").alias("context"), "document_id")
    found = a.join(b, "document_id").join(queries.select("query", "context").distinct(), ["query", "context"])
    return found.select("query", "context", F.col("document_id").alias("id")).distinct().join(documents, "id")


def owned_by_relation(relations: DataFrame, documents: DataFrame, owner_id: str, kind: str, limit: int = 100) -> DataFrame:
    wanted = relations.where((F.col("source_id") == owner_id) & (F.col("edge_kind") == "owns"))
    found = wanted.select(F.col("target_id").alias("id"), "weight").join(documents.where(F.col("kind") == kind), "id")
    return found.orderBy("weight", "id").limit(limit)


def owner_of(members: DataFrame, callables: DataFrame, document_id: str) -> str | None:
    """Owner type of a document, from its member or callable rows (the smallest id)."""
    rows = members.select("document_id", "owner_type_id").union(callables.select("document_id", "owner_type_id"))
    found = rows.where((F.col("document_id") == document_id) & F.col("owner_type_id").isNotNull()).distinct().agg(F.min("owner_type_id")).first()
    return found[0]


def target_types(type_refs: DataFrame, document_id: str) -> DataFrame:
    return type_refs.where((F.col("document_id") == document_id) & F.col("target_type_id").isNotNull()).select("target_type_id").distinct().orderBy("target_type_id")


def hydrate(hits: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """hits (a column id) with nested signatures, parameters and type references: each child
    table is aggregated once for the ids that were hit, then joined; never a query per hit."""
    ids = hits.select("id").distinct()
    refs = tables["type_refs"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi")
    item = F.struct("signature_ordinal", "parameter_ordinal", "ordinal", "target_type_name", "ref_kind", "target_type_id", "status", "candidates")
    refs = refs.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("type_refs"))
    calls = tables["callables"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select("callable_id", F.col("document_id").alias("id"))
    sigs = tables["signatures"].join(calls, "callable_id")
    params = tables["parameters"].join(sigs.select("signature_id"), "signature_id", "left_semi").groupBy("signature_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "required", "description"))).alias("parameters"))
    sigs = sigs.join(params, "signature_id", "left")
    sigs = sigs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "description", "parameters"))).alias("signatures"))
    return hits.join(sigs, "id", "left").join(refs, "id", "left")
