"""Fixed schemas of the fact index and the kind dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = 16
NAME = "struct<primary:string,alias:string>"
BINDINGS = "array<struct<owner_idx:int,target_idx:int>>"

#: Table name -> DDL of its columns.
TABLES = {
    "meta": "key string, value string",
    "documents": "id string, kind string, kind_priority int, name_primary string, name_alias string, owner_primary string, owner_alias string, signature_text string, description string, availability_contexts array<string>, available_since string",
    "document_metadata": f"id string, owner_path array<{NAME}>, note string, default_value string, query_syntax_primary string, query_syntax_alias string, query_identifier string, query_table_role string, template_parameters array<string>, source_book string, source_locale string, source_path string, source_toc string, source_family string",
    "type_identities": "type_id string, document_id string, name_primary string, name_alias string",
    "type_templates": "type_id string, metadata_kind string, template_parameters array<string>, family string, variant string, diagnostic string",
    "members": "member_id string, owner_type_id string, member_kind string, name_primary string, name_alias string, document_id string",
    "callables": "callable_id string, document_id string, callable_kind string, owner_type_id string",
    "signatures": "signature_id string, callable_id string, ordinal int, title string, description string",
    "parameters": "parameter_id string, signature_id string, ordinal int, name string, required boolean, description string",
    "type_refs": f"document_id string, signature_ordinal int, parameter_ordinal int, ordinal int, ref_kind string, target_type_name string, target_type_id string, status string, candidates array<string>, template_family string, template_variant string, bindings {BINDINGS}",
    "document_names": "key string, key_kind string, document_id string",
    "document_search": "document_id string, length int",
    "postings": "token string, document_id string, tf int, length int",
    "relations": "source_id string, target_id string, edge_kind string, label string, evidence string, weight int",
}

#: Document kinds with their priority, and the reference kind of their types.
KINDS = (
    ("platform_type", 10, None),
    ("enum", 20, None),
    ("query_table", 30, None),
    ("global_method", 40, "return_type"),
    ("global_property", 50, "property_type"),
    ("method", 60, "return_type"),
    ("property", 70, "property_type"),
    ("constructor", 80, "constructor_result"),
    ("type_event", 90, "parameter_type"),
    ("module_event", 100, "parameter_type"),
    ("event", 110, "parameter_type"),
    ("enum_value", 120, None),
    ("query_field", 130, "query_field_type"),
    ("query_parameter", 140, "query_parameter_type"),
    ("language_type", 150, None),
    ("language_function", 150, "return_type"),
    ("language_construct", 150, None),
    ("language_literal", 150, None),
    ("language_operator", 150, None),
    ("language_keyword", 150, None),
)
CALLABLE_KINDS = ("global_method", "method", "constructor", "type_event", "module_event", "event", "language_function")
MEMBER_KINDS = ("method", "property", "constructor", "type_event")
TYPE_KINDS = ("platform_type", "enum")
GRAPH_ROOT_KINDS = ("platform_type", "enum", "query_table", "language_type")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def kinds(spark: SparkSession) -> DataFrame:
    """Dimension of the document kinds (a few rows; always safe to broadcast)."""
    rows = [(k, p, k in CALLABLE_KINDS, k.startswith("language_"), k in TYPE_KINDS, r) for k, p, r in KINDS]
    return spark.createDataFrame(rows, "kind string, kind_priority int, is_callable boolean, is_language boolean, is_type boolean, ref_kind string")
