"""From parsed records to the tables of the fact index, as one declarative plan.

Records (one row for each parsed page or fact): seq (input order, unique), kind, name, owner,
owner_path, signatures, type_refs, extends, description, availability, since and so on, as
in RECORD. Order-dependent rules use seq, never the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as idf
from ..functions.text import name_keys
from ..operators import graph, identity, resolve, search
from ..schemas import CALLABLE_KINDS, KINDS, MEMBER_KINDS, TYPE_KINDS
from ..session import materialize

_PARAMETER = "struct<name:string,required:boolean,description:string,type_refs:array<string>>"
_SIGNATURE = f"struct<title:string,description:string,parameters:array<{_PARAMETER}>,return_types:array<string>>"
RECORD = (
    "seq long, kind string, name_primary string, name_alias string, owner_primary string, owner_alias string, owner_path array<string>, "
    f"signatures array<{_SIGNATURE}>, return_types array<string>, type_refs array<string>, extends array<string>, description string, "
    "availability array<string>, since string, metadata_kind string, identifier string, syntax_primary string, syntax_alias string, module string, source_path string, "
    "note string, default_value string, usage string, query_table_role string, type_kind string, object_kind string, source_book string, source_locale string, source_toc string, source_family string, "
    "parent_path string, semantic string, owner_semantic string"
)


def identified(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with id and owner_id, duplicate warnings, records whose owner is unknown).

    Types, enums and query tables are named by themselves, with a suffix where a name is
    not unique. What they own is named through its owner: the one on the page that the
    member's page lies below, else the one of its semantic key, else of those of its name
    that of the lowest kind priority and seq. Of rows with the same id the last one stays.
    """
    priorities = F.create_map(*[F.lit(x) for kind, priority, _ in KINDS for x in (kind, priority)])
    rows = records.withColumn("kind_priority", priorities[F.col("kind")])
    rows = rows.withColumn("__base", F.when(F.col("kind") == "query_table", F.coalesce(F.nullif(idf.part_key("identifier"), F.lit("")), idf.part_key("name_primary"))).otherwise(idf.part_key("name_primary")))
    roots = rows.where(F.col("kind").isin("platform_type", "enum", "query_table"))
    roots = identity.with_key_count(roots, ["kind", "__base"])
    root_id = (
        F.when(F.col("kind") == "platform_type", idf.type_id("name_primary", F.coalesce("owner_path", F.array().cast("array<string>")), F.col("same_count")))
        .when(F.col("kind") == "enum", idf.enum_id("name_primary", "name_alias", F.coalesce("source_path", F.lit("")), F.col("same_count")))
        .otherwise(idf.query_table_id("name_primary", "identifier", F.coalesce("owner_path", F.array().cast("array<string>")), F.col("same_count")))
    )
    roots = roots.withColumn("id", root_id).withColumn("owner_id", F.lit(None).cast("string")).drop("same_count")
    keyed = roots.select("id", "kind_priority", "seq", F.explode(F.array_compact(F.array(idf.part_key("name_primary"), idf.part_key("name_alias")))).alias("owner_key"))
    owners = identity.best_owner(keyed, "owner_key").select("owner_key", F.col("id").alias("owner_id"))
    by_path = identity.best_owner(roots.where("source_path IS NOT NULL").withColumn("__page", F.struct("source_book", "source_path")), "__page").select(F.col("__page").alias("__p"), F.col("id").alias("__by_path"))
    by_meaning = identity.best_owner(roots.where("semantic <> ''"), "semantic").select(F.col("semantic").alias("__s"), F.col("id").alias("__by_meaning"))
    owned = rows.where(~F.col("kind").isin("platform_type", "enum", "query_table")).withColumn("owner_key", idf.part_key("owner_primary"))
    owned = owned.join(by_path, F.struct("source_book", F.col("parent_path").alias("source_path")).eqNullSafe(F.col("__p")), "left").join(by_meaning, F.col("owner_semantic") == F.col("__s"), "left")
    owned = owned.join(owners.withColumnsRenamed({"owner_key": "__o", "owner_id": "__by_name"}), F.col("owner_key") == F.col("__o"), "left")
    owned = owned.withColumn("owner_id", F.coalesce("__by_path", "__by_meaning", "__by_name")).drop("__p", "__by_path", "__s", "__by_meaning", "__o", "__by_name")
    lost = F.col("owner_id").isNull() & (F.col("owner_key").isNotNull() | F.col("parent_path").isNotNull())
    orphans = owned.where(lost).withColumn("code", F.lit("MISSING_PARENT_IDENTITY"))
    good = owned.where(~lost).withColumn("id", idf.owned_id("kind", "owner_id", "name_primary")).drop("owner_key")
    both = roots.unionByName(good)
    warnings = identity.duplicate_warnings(both, "id")
    return identity.keep_last(both, "id", "seq").drop("__base", "duplicate_count"), warnings, orphans


def build(records: DataFrame) -> dict[str, DataFrame]:
    """The index tables of `schemas.TABLES` (without meta), and `diagnostics`. The identified
    records and their references, which most tables are made of, are written once."""
    docs, warnings, orphans = identified(records)
    docs, warnings = materialize(docs, "facts"), materialize(warnings, "warnings")
    orphans = materialize(orphans.select("code", "kind", "name_primary"), "orphans")
    none = lambda kind="string": F.lit(None).cast(kind)
    texts = F.array_join(F.transform(F.coalesce("signatures", F.array().cast(f"array<{_SIGNATURE}>")), lambda s: s["title"]), "\n")
    documents = docs.select("id", "kind", "kind_priority", "name_primary", "name_alias", "owner_primary", "owner_alias", F.nullif(texts, F.lit("")).alias("signature_text"), "description", F.col("availability").alias("availability_contexts"), F.col("since").alias("available_since"))
    query_keys = [("query_identifier", F.col("identifier")), ("query_syntax", F.col("syntax_primary")), ("query_syntax_alias", F.col("syntax_alias"))]
    names = docs.select(F.col("id").alias("document_id"), F.explode(name_keys(F.col("name_primary"), F.col("name_alias"), F.col("owner_primary"), F.col("owner_alias"), F.col("module"), query_keys)).alias("k"))
    types = docs.where(F.col("kind").isin(*TYPE_KINDS))
    identities = types.select(F.col("id").alias("type_id"), F.col("id").alias("document_id"), "name_primary", "name_alias")
    members = docs.where(F.col("kind").isin(*MEMBER_KINDS) & F.col("owner_id").isNotNull())
    members = members.select(F.col("id").alias("member_id"), F.col("owner_id").alias("owner_type_id"), F.col("kind").alias("member_kind"), "name_primary", "name_alias", F.col("id").alias("document_id"))
    called = docs.where(F.col("kind").isin(*CALLABLE_KINDS))
    callables = called.select(F.col("id").alias("callable_id"), F.col("id").alias("document_id"), F.col("kind").alias("callable_kind"), F.col("owner_id").alias("owner_type_id"))
    signed = called.select("id", F.posexplode("signatures").alias("o", "s")).withColumn("signature_id", F.concat_ws(":", "id", F.lit("signature"), "o"))
    signatures = signed.select("signature_id", F.col("id").alias("callable_id"), F.col("o").alias("ordinal"), "s.title", "s.description")
    listed = signed.select("id", "signature_id", "o", F.posexplode("s.parameters").alias("n", "p")).withColumn("parameter_id", F.concat_ws(":", "signature_id", F.lit("parameter"), "n"))
    parameters = listed.select("parameter_id", "signature_id", F.col("n").alias("ordinal"), "p.name", "p.required", "p.description")
    refs = materialize(resolved_references(docs, signed, listed), "references")
    templates = template_rows(types, refs)
    refs = bound(refs, docs, templates)
    edges = graph.derive(docs.select("id", "owner_id", "kind"), refs.select("document_id", "ref_kind", F.col("target_type_id").alias("target_id"), F.col("target_type_name").alias("target_name"), "status"))
    searched = F.concat_ws(" ", "name_primary", "name_alias", "owner_primary", "owner_alias", "signature_text", "description")
    worded = documents.select("id", searched.alias("text"))
    metadata = docs.select(
        "id", F.transform(F.coalesce("owner_path", F.array().cast("array<string>")), lambda n: F.struct(n.alias("primary"), none().alias("alias"))).alias("owner_path"), "note", "default_value",
        F.col("syntax_primary").alias("query_syntax_primary"), F.col("syntax_alias").alias("query_syntax_alias"), F.col("identifier").alias("query_identifier"), "query_table_role",
        idf.template_slots(F.coalesce("name_alias", "name_primary")).alias("template_parameters"), "source_book", "source_locale", "source_path", "source_toc", "source_family",
    )
    diagnostics = warnings.select("code", "id", F.col("duplicate_count").cast("long").alias("count"))
    diagnostics = diagnostics.unionByName(orphans.select("code", F.concat_ws(":", "kind", "name_primary").alias("id"), F.lit(1).cast("long").alias("count")))
    return {
        "documents": documents,
        "document_metadata": metadata,
        "type_identities": identities,
        "type_templates": templates,
        "members": members,
        "callables": callables,
        "signatures": signatures,
        "parameters": parameters,
        "type_refs": refs,
        "document_names": names.select("k.key", "k.key_kind", "document_id"),
        "document_search": search.lengths(worded, "text").withColumnRenamed("id", "document_id"),
        "postings": search.postings(worded, "text").withColumnRenamed("id", "document_id"),
        "relations": edges.withColumn("evidence", none()),
        "diagnostics": diagnostics,
    }


def resolved_references(docs: DataFrame, signed: DataFrame, listed: DataFrame) -> DataFrame:
    """Every written type with its place, kind and outcome."""
    ref = lambda doc, s, p, o, kind, name: [doc.alias("document_id"), s.cast("int").alias("signature_ordinal"), p.cast("int").alias("parameter_ordinal"), o.cast("int").alias("ordinal"), kind.alias("ref_kind"), name.alias("target_type_name")]
    none, id_ = F.lit(None), F.col("id")
    kinds = F.create_map(*[F.lit(x) for kind, _, r in KINDS if r and kind not in CALLABLE_KINDS for x in (kind, r)])
    own = docs.where("type_refs IS NOT NULL").select("id", "kind", F.posexplode("type_refs").alias("o", "t"))
    rows = own.select(*ref(id_, none, none, F.col("o"), F.coalesce(kinds[F.col("kind")], F.lit("property_type")), F.col("t")))
    up = docs.where("extends IS NOT NULL").select("id", F.posexplode("extends").alias("o", "t"))
    rows = rows.unionByName(up.select(*ref(id_, none, none, F.col("o"), F.lit("extends"), F.col("t"))))
    page = docs.where("return_types IS NOT NULL").select("id", F.posexplode("return_types").alias("o", "t"))
    rows = rows.unionByName(page.select(*ref(id_, none, none, F.col("o"), F.lit("return_type"), F.col("t"))))
    given = signed.select("id", F.col("o").alias("s"), F.posexplode("s.return_types").alias("n", "t"))
    rows = rows.unionByName(given.select(*ref(id_, F.col("s"), none, F.col("n"), F.lit("return_type"), F.col("t"))))
    taken = listed.select("id", "o", "n", F.posexplode("p.type_refs").alias("i", "t"))
    rows = rows.unionByName(taken.select(*ref(id_, F.col("o"), F.col("n"), F.col("i"), F.lit("parameter_type"), F.col("t"))))
    made = docs.where("kind = 'constructor' AND owner_id IS NOT NULL")
    rows = rows.unionByName(made.select(*ref(id_, none, none, F.lit(0), F.lit("constructor_result"), F.col("owner_primary"))))
    types = docs.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "name_primary", "name_alias", "metadata_kind")
    found = resolve.resolve(rows, resolve.candidate_keys(types, metadata_column="metadata_kind"), "target_type_name")
    owners = docs.where("kind = 'constructor'").select(F.col("id").alias("__doc"), F.col("owner_id").alias("owner_type_id"))
    found = resolve.resolve_constructors(found.join(owners, F.col("document_id") == F.col("__doc"), "left"))
    return found.select("document_id", "signature_ordinal", "parameter_ordinal", "ordinal", "ref_kind", "target_type_name", F.col("target_id").alias("target_type_id"), "status", "candidates")


def bound(refs: DataFrame, docs: DataFrame, templates: DataFrame) -> DataFrame:
    """refs with the template of their target and, where it is of the family of the owner's
    template, what its parameters are bound to."""
    known = templates.where("family IS NOT NULL").select("type_id", "family", "variant", "template_parameters")
    owner = docs.select(F.col("id").alias("document_id"), F.coalesce("owner_id", "id").alias("__owner"))
    mine = known.select(F.col("type_id").alias("__owner"), F.col("family").alias("__family"), F.col("template_parameters").alias("__own"))
    theirs = known.select(F.col("type_id").alias("target_type_id"), F.col("family").alias("template_family"), F.col("variant").alias("template_variant"), F.col("template_parameters").alias("__wanted"))
    found = refs.join(owner, "document_id", "left").join(mine, "__owner", "left").join(theirs, "target_type_id", "left")
    pairs = F.when(F.size("__wanted") > 0, idf.bindings("__own", "__wanted", F.coalesce(F.col("__family") == F.col("template_family"), F.lit(False))))
    return found.withColumn("bindings", pairs).select(*refs.columns, "template_family", "template_variant", "bindings")


def template_rows(types: DataFrame, refs: DataFrame) -> DataFrame:
    """Template families of the types that have a metadata kind."""
    kinded = types.where("metadata_kind IS NOT NULL").select(F.col("id").alias("type_id"), "metadata_kind", idf.template_slots(F.coalesce("name_alias", "name_primary")).alias("template_parameters"), F.coalesce(idf.template_base("name_primary", "name_alias", True), idf.clean_part("name_primary")).alias("base"))
    managers = types.select(F.col("name_primary").alias("name"))
    evidence = refs.where("target_type_id IS NOT NULL").join(types.select(F.col("id").alias("document_id"), idf.manager_root("name_primary").alias("family")).where("family IS NOT NULL"), "document_id")
    found = identity.classify_templates(kinded, managers, evidence.select(F.col("target_type_id").alias("type_id"), "family"))
    return found.select("type_id", "metadata_kind", "template_parameters", "family", "variant", "diagnostic")
