"""Small extractions from page text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Entities that page text is decoded from, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Spellings of a property's use.
USAGE = {
    "Read": ("read", "read only", "readonly", "только чтение", "чтение"),
    "Write": ("write", "write only", "writeonly", "только запись", "запись"),
    "ReadWrite": ("read and write", "read/write", "readwrite", "чтение и запись", "чтение/запись"),
}
OPTIONAL = ("необязательный", "optional")


def split_alias(text: Column | str) -> Column:
    """(primary, alias) of "X (Y)": split at the last " (" if the text ends with )."""
    value = F.trim(col(text))
    found = F.rlike(value, F.lit(r"^.*\S \([^()]*\)$")) | F.rlike(value, F.lit(r"^.* \(.*\)$"))
    primary = F.trim(F.regexp_extract(value, r"^(.*) \((.*)\)$", 1))
    alias = F.trim(F.regexp_extract(value, r"^(.*) \((.*)\)$", 2))
    return F.struct(F.when(found, primary).otherwise(value).alias("primary"), F.when(found, F.nullif(alias, F.lit(""))).alias("alias"))


def bracketed(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit("<([^>]*)>"), F.lit(1))


def type_list(text: Column | str) -> Column:
    """Names up to the first period, split at , and ;, trimmed, without empty ones."""
    head = F.element_at(F.split(col(text), r"\.", 2), 1)
    return F.filter(F.transform(F.split(head, "[,;]"), lambda p: F.trim(F.regexp_replace(p, "[\t\n\r]", " "))), lambda p: p != "")


def version_of(text: Column | str) -> Column:
    """First run of digits and periods that begins with a digit, without periods at its end."""
    return F.nullif(F.regexp_replace(F.regexp_extract(col(text), "[0-9][0-9.]*", 0), r"\.+$", ""), F.lit(""))


def version_parts(text: Column | str) -> Column:
    """Numbers of a version, to compare versions by."""
    return F.split(version_of(text), r"\.").cast("array<int>")


def usage_of(text: Column | str) -> Column:
    """Read, Write, ReadWrite or Unknown."""
    value = F.rtrim(F.lower(F.trim(col(text))), F.lit("."))
    chain = None
    for name, spellings in USAGE.items():
        chain = F.when(value.isin(*spellings), name) if chain is None else chain.when(value.isin(*spellings), name)
    return chain.otherwise("Unknown")


def is_required(text: Column | str) -> Column:
    value = F.lower(col(text))
    return ~(F.contains(value, F.lit(OPTIONAL[0])) | F.contains(value, F.lit(OPTIONAL[1])))


def strip_type_prose(text: Column | str) -> Column:
    """Description without the leading "Type: A, B." sentence."""
    return F.trim(F.regexp_replace(col(text), r"^\s*(?:Тип|Type):\s*[^.]*\.?\s*", ""))


def decode_entities(text: Column | str) -> Column:
    value = col(text)
    for name, char in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def camel_part(text: Column | str) -> Column:
    """Identifier part of a phrase: each word's first letter in upper case, no white space."""
    words = F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def json_number(json: Column | str, path: str) -> Column:
    """Number at a path of a JSON text; null for booleans, strings and objects."""
    raw = F.get_json_object(col(json), path)
    return F.when(F.rlike(raw, F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")), raw.cast("double"))


def localized(ru: Column | str, en: Column | str, locale: str) -> Column:
    """Title of the locale, or else the other one that is not empty."""
    first, second = (en, ru) if locale in ("root", "en") else (ru, en)
    return F.coalesce(F.nullif(col(first), F.lit("")), F.nullif(col(second), F.lit("")))
