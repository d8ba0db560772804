"""Identities of facts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Text behind this mark in a title tells duplicates apart and is no part of the name.
DUPLICATE_MARK = "@@"


def clean_part(value: Column | str, mark: str = DUPLICATE_MARK) -> Column:
    return F.trim(F.element_at(F.split(col(value), mark.replace("|", r"\|"), 2), 1))


def part_key(value: Column | str, mark: str = DUPLICATE_MARK) -> Column:
    return F.lower(clean_part(value, mark))


def last_name(path: Column | str) -> Column:
    """Last non-blank name of an owner path (array of names); semantic_variant if none."""
    return F.coalesce(F.try_element_at(F.filter(col(path), lambda n: F.trim(n) != ""), F.lit(-1)), F.lit("semantic_variant"))


def type_id(name: Column | str, owner_path: Column | str, same_names: Column) -> Column:
    """platform_type:{name}, with the last owner name where the name is not unique."""
    base = F.concat(F.lit("platform_type:"), clean_part(name))
    return F.when(same_names <= 1, base).otherwise(F.concat_ws(":", base, last_name(owner_path)))


def query_table_id(name: Column | str, identifier: Column | str, owner_path: Column | str, same: Column) -> Column:
    path = F.array_join(F.transform(F.concat(col(owner_path), F.array(col(name))), lambda p: clean_part(p)), ":")
    base = F.concat(F.lit("query_table:"), F.coalesce(F.nullif(clean_part(identifier), F.lit("")), path))
    return F.when(same <= 1, base).otherwise(F.concat_ws(":", base, last_name(owner_path)))


def enum_id(name: Column | str, alias: Column | str, path: Column | str, same: Column) -> Column:
    """enum:{system or metadata_property}:{name}, with the alias where that is not unique."""
    system = F.startswith(col(path), F.lit("objects/catalog2/")) | (col(path) == "objects/catalog2.html")
    base = F.concat_ws(":", F.lit("enum"), F.when(system, "system").otherwise("metadata_property"), clean_part(name))
    other = F.nullif(clean_part(alias), F.lit(""))
    return F.when((same > 1) & other.isNotNull(), F.concat_ws(":", base, other)).otherwise(base)


def owned_id(kind: Column | str, owner_id: Column | str, name: Column | str, owner_name: Column | str | None = None) -> Column:
    """{kind}:{owner id}:{name}; an owner known only by name gets the prefix owner:."""
    named = F.concat(F.lit("owner:"), clean_part(owner_name)) if owner_name is not None else F.lit(None).cast("string")
    return F.concat_ws(":", col(kind), F.coalesce(col(owner_id), named), clean_part(name))


def semantic_key(path: Column | str, name: Column | str) -> Column:
    """Lower-case owner path and name joined by /; a name that ends the path is not repeated."""
    parts = F.transform(col(path), lambda p: part_key(p))
    tail = F.try_element_at(parts, F.lit(-1))
    full = F.when(tail == part_key(name), parts).otherwise(F.array_append(parts, part_key(name)))
    return F.array_join(full, "/")


def template_base(name: Column | str, alias: Column | str, allow_primary: bool = False) -> Column:
    """Name before the first . or < of a templated name; the alias goes first."""
    base = lambda c: F.when(F.rlike(col(c), F.lit("<.*>")), F.nullif(F.trim(F.regexp_extract(col(c), "^([^.<]*)", 1)), F.lit("")))
    return F.coalesce(base(alias), base(name)) if allow_primary else base(alias)


def template_slots(name: Column | str) -> Column:
    """Distinct <slots> of a name in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(name), F.lit("<([^>]*)>"), F.lit(1)), lambda slot: F.trim(slot)))


def manager_root(name: Column | str) -> Column:
    """The family that a manager type names; null for other names."""
    return F.nullif(F.regexp_extract(col(name), "^(.+)(?:Manager|Менеджер)$", 1), F.lit(""))


def template_variant(base: Column | str, family: Column | str) -> Column:
    """Rest of the base behind its family, or the base itself."""
    rest = F.substring(col(base), F.length(col(family)) + 1, F.length(col(base)))
    return F.when(F.startswith(col(base), col(family)) & (rest != ""), rest).otherwise(col(base))


def bindings(owner: Column | str, target: Column | str, same_family: Column) -> Column:
    """array of (owner_idx, target_idx) that gives each target parameter the owner parameter
    of its name; null unless the families match, the owner's parameters are unique and every
    target parameter is found."""
    own, wanted = col(owner), col(target)
    pairs = F.transform(wanted, lambda p, i: F.struct((F.array_position(own, p) - 1).cast("int").alias("owner_idx"), i.cast("int").alias("target_idx")))
    unique = F.size(F.array_distinct(own)) == F.size(own)
    return F.when(same_family & unique & F.forall(wanted, lambda p: F.array_contains(own, p)), pairs)
