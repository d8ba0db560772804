"""Language facts from pages of three families: a page's key selects what it yields."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import page_key
from ..functions.text import normalize_key
from . import page_model

#: The pages of the families, (family, page key, fact kind).
PAGES = (
    ("shlang", "def_Null", "type"),
    ("shlang", "def_Undefined", "type"),
    ("shlang", "def_Number", "type"),
    ("shlang", "def_String", "type"),
    ("shlang", "def_Date", "type"),
    ("shlang", "def_Boolean", "type"),
    ("shlang", "def_Type", "type"),
    ("shlang", "def_Func", "construct"),
    ("shquery", "SELECTStatement", "construct"),
    ("shquery", "SUM", "function"),
    ("shquery", "STRING", "function"),
    ("shquery", "LitString", "literal"),
    ("dcsui", "SKD_Functions_Strings", "function"),
    ("dcsui", "SKD_ExtQueryLangv", "construct"),
)
#: Keywords that a page names, (page key, keyword).
KEYWORDS = (("SKD_ExtQueryLangv", "ВЫБРАТЬ"), ("SKD_ExtQueryLangv", "ГДЕ"), ("SKD_ExtQueryLangv", "SELECT"), ("SKD_ExtQueryLangv", "WHERE"))
#: Facts that a section of a page describes, (page key, name, alias).
SECTION_FUNCTIONS = (("SKD_Functions_Strings", "ДлинаСтроки", "StringLength"),)
#: Domain of each family, types that texts may name, and labels.
DOMAINS = {"shlang": "bsl", "shquery": "query", "dcsui": "query"}
TYPE_NAMES = ("Строка", "String", "Число", "Number", "Булево", "Boolean", "Дата", "Date", "NULL", "Неопределено", "Undefined")
SYNTAX, RETURNS, PARAMETER_LABELS = ("Синтаксис", "Syntax"), ("Возвращаемое значение", "Return value"), ("Параметр", "Parameter")
#: Targets of the type names of a family, (family, name key, document id).
TYPE_IDS = (("shquery", "строка", "shquery:LitString"), ("shquery", "string", "shquery:LitString"), ("dcsui", "строка", "shlang:def_String"), ("dcsui", "string", "shlang:def_String"))
FACT = "id string, source_family string, domain string, kind string, name_primary string, name_alias string, syntax string, parameters array<struct<name:string,type_refs:array<string>,description:string>>, return_types array<string>, description string"


def types_named(text: str) -> list[str]:
    return [x for x in TYPE_NAMES if x in text]


def named(title: str) -> tuple[str, str | None]:
    """Primary name and alias of `Name (alias)`."""
    found = re.fullmatch(r"(.*\S)\s+\(([^()]*)\)\s*", title)
    return (found[1].strip(), found[2].strip()) if found else (title.strip(), None)


def behind(lines: Sequence[str], labels: Sequence[str]) -> str | None:
    """What follows a label in the first line that has one and says something."""
    for line in lines:
        for label in labels:
            rest = line.partition(label)[2].strip().lstrip(":").strip() if label in line else ""
            if rest:
                return rest
    return None


def facts_of(family: str, key: str, kind: str, page: str, locale: str) -> list[dict]:
    """The facts of one page."""
    items = page_model.walk(page or "")
    said = [x.text for x in items if x.kind in ("line", "title", "heading")]
    body = " ".join(said)
    heading = re.search(r"(?is)<h1[^>]*>(.*?)</h1>", page or "")
    title = " ".join(page_model.walk(heading[1])[0].text.split()) if heading and page_model.walk(heading[1]) else key
    rest = [x for x in said if x != title]
    plain = next((x for x in rest if not x.startswith((*SYNTAX, *PARAMETER_LABELS))), None)
    base = {"id": f"{family}:{key}", "source_family": family, "domain": DOMAINS[family], "kind": f"language_{kind}", "syntax": None, "parameters": [], "return_types": [], "description": plain}
    primary, alias = named(title)
    base |= {"name_primary": primary, "name_alias": alias}
    if family == "shlang":
        return [base | {"syntax": behind(rest, SYNTAX) if kind == "construct" else None}]
    code = re.search(r"(?is)<pre[^>]*>(.*?)</pre>", page or "")
    shown = code and " ".join(x.text for x in page_model.walk(code[1])) or None
    if family == "shquery":
        made = base | {"syntax": shown or (rest[0] if rest else None)}
        if key == "SELECTStatement":
            made["name_alias"] = alias or "SELECT"
        if kind == "function":
            quoted = re.search(r"(?is)<blockquote[^>]*>(.*?)</blockquote>", page or "")
            text = next((x.text for x in page_model.walk(quoted[1])), None) if quoted else None
            if text:
                name, _, described = text.partition(" - ") if " - " in text else text.partition(". ")
                made["parameters"] = [{"name": name.strip(), "type_refs": types_named(described), "description": described.strip() or None}]
            given = behind(rest, RETURNS)
            made["return_types"] = types_named(given)[:1] if given else []
        return [made]
    found = []
    for page_name, ru, en in SECTION_FUNCTIONS:
        at = min((i for i in (body.find(ru), body.find(en)) if i >= 0), default=-1)
        if page_name == key and at >= 0:
            text = behind([body[at:]], SYNTAX)
            syntax = text and re.split("|".join(PARAMETER_LABELS), text)[0].strip() or None
            names = (ru, en) if locale == "ru" else (en, None)
            word = TYPE_NAMES[0] if locale == "ru" else TYPE_NAMES[1]
            found.append(base | {"id": f"{family}:{key}:{en}", "name_primary": names[0], "name_alias": names[1], "syntax": syntax, "description": title, "parameters": [{"name": word, "type_refs": [word], "description": None}]})
    if kind != "function":
        found.append(base)
    for page_name, word in KEYWORDS:
        if page_name == key and word in body:
            found.append(base | {"id": f"{family}:{key}:{word}", "kind": "language_keyword", "name_primary": "{" + word + "}", "name_alias": None, "description": None})
    return found


def facts(pages: DataFrame, family_col: str = "family", path_col: str = "path", html_col: str = "html", locale: str = "ru") -> DataFrame:
    """The facts (FACT) of the pages that PAGES lists; other pages yield none."""
    table = F.create_map(*[x for family, key, kind in PAGES for x in (F.lit(f"{family}:{key}"), F.lit(kind))])
    keyed = pages.select(F.col(family_col).alias("family"), page_key(path_col).alias("page_key"), F.col(html_col).alias("html"))
    keyed = keyed.withColumn("kind", table[F.concat_ws(":", "family", "page_key")]).where("kind IS NOT NULL")
    fields = [(n, pa.string()) for n in ("id", "source_family", "domain", "kind", "name_primary", "name_alias", "syntax")]
    fields += [("parameters", pa.list_(pa.struct([("name", pa.string()), ("type_refs", pa.list_(pa.string())), ("description", pa.string())]))), ("return_types", pa.list_(pa.string())), ("description", pa.string())]

    def run(batches):
        for batch in batches:
            rows = [fact for row in batch.to_pylist() for fact in facts_of(row["family"], row["page_key"], row["kind"], row["html"], locale)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

    return keyed.mapInArrow(run, FACT)


def type_targets(found: DataFrame) -> DataFrame:
    """(document_id, target_type_name, target_type_id) of the types that facts name: the fixed
    targets of a family; null where there is none."""
    table = F.create_map(*[x for family, key, target in TYPE_IDS for x in (F.lit(f"{family}:{key}"), F.lit(target))])
    names = F.array_distinct(F.concat(F.flatten(F.transform("parameters", lambda p: p["type_refs"])), F.col("return_types")))
    each = found.select("source_family", F.col("id").alias("document_id"), F.explode(names).alias("target_type_name"))
    return each.select("document_id", "target_type_name", table[F.concat_ws(":", "source_family", normalize_key("target_type_name"))].alias("target_type_id"))


def keyword_facts(pages: DataFrame, keywords: Sequence[tuple[str, str]], id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page, keyword, kind) for each keyword of a short fixed list that the text holds."""
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(kind).alias("kind")) for k, kind in keywords))
    held = F.filter(table, lambda row: F.contains(F.col(text_col), row["keyword"]))
    return pages.select(id_col, F.explode(held).alias("f")).select(id_col, "f.*")
