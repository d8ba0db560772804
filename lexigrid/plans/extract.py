"""From a book's table of contents and pages to the records that `build` takes.

Every node of the table of contents is classified by its path and the titles above it; the
pages of classified nodes are parsed once (first visit of a page wins), and the nearest node
above that is a type, enum or query table owns what lies below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import availability, identity as idf, paths, values
from ..operators import ordering, pages as page_ops, tree
from ..session import materialize
from .build import RECORD

#: Record kind of each page class that yields a record.
RECORD_KINDS = {
    "object_type": "platform_type",
    "enum": "enum",
    "query_table": "query_table",
    "global_method": "global_method",
    "global_property": "global_property",
    "object_method": "method",
    "object_property": "property",
    "constructor": "constructor",
    "type_event": "type_event",
    "module_event": "module_event",
    "unknown_event": "event",
    "enum_value": "enum_value",
    "query_table_field": "query_field",
    "query_table_parameter": "query_parameter",
}
OWNERS = ("platform_type", "enum", "query_table")
OWNED = ("method", "property", "constructor", "type_event", "enum_value", "query_field", "query_parameter")


def classified(toc: DataFrame) -> DataFrame:
    """Nodes with depth, index_path, chain (titles and paths above, root first), branch, page_class
    and kind (null if the page yields no record).

    toc: book, id, parent_id, ordinal, title, html_path; ids are unique within a book.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "book", F.col(c).cast("string")))
    nodes = toc.select("book", key("id").alias("id"), key("parent_id").alias("parent_id"), "ordinal", F.trim("title").alias("title"), paths.storage_path(F.coalesce("html_path", F.lit(""))).alias("html_path"))
    flat = materialize(tree.flatten(nodes), "toc")
    above = flat.select("id", F.posexplode("ancestors").alias("o", "a")).join(flat.select(F.col("id").alias("a"), F.col("title").alias("t"), F.col("html_path").alias("p")), "a")
    chains = above.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", F.col("t").alias("title"), F.col("p").alias("path")))).alias("c"))
    chain = F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path")))
    joined = flat.join(chains, "id", "left").withColumn("chain", F.coalesce(chain, F.array().cast("array<struct<title:string,path:string>>"))).drop("c")
    parents = flat.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    joined = joined.join(parents, "id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    titles = F.transform(F.array_append(F.transform("chain", lambda x: x["title"]), F.col("title")), lambda t: F.lower(t))
    joined = joined.withColumn("titles", titles).withColumn("branch", tree.branch_kind(F.col("html_path"), F.col("titles")))
    joined = joined.withColumn("page_class", tree.page_class(F.col("html_path"), F.col("branch"), F.col("titles"), F.col("has_children")))
    kinds = F.create_map(*[F.lit(x) for pair in RECORD_KINDS.items() for x in pair])
    return joined.withColumn("kind", kinds[F.col("page_class")]).drop("titles")


def type_kind(name: Column, branch: Column) -> Column:
    """Primitive, MetadataTemplate, Extension or Regular."""
    extension = F.rlike(F.lower(name), F.lit("^(?:расширение|extension)"))
    return F.when(branch == "primitive_types", "Primitive").when(F.contains(name, F.lit("<")) & F.contains(name, F.lit(">")), "MetadataTemplate").when(extension, "Extension").otherwise("Regular")


def object_kind(kind: Column, branch: Column) -> Column:
    return (
        F.when((branch == "platform_objects") & (kind == "Regular"), "RegularPlatformType")
        .when((branch == "managed_forms") & (kind == "Extension"), "FormExtension")
        .when(branch == "managed_forms", "ManagedForm")
        .when(branch == "metadata_objects", "MetadataObject")
    )


def metadata_kind(name: Column) -> Column:
    """Kind of a templated name: what stands before its first . or <."""
    head = F.nullif(F.trim(F.regexp_extract(name, "^([^.<]*)", 1)), F.lit(""))
    return F.when(F.contains(name, F.lit("<")) & F.contains(name, F.lit(">")), head)


def parent_path(path: Column) -> Column:
    """Page of the type or table that a member's page lies below; null for other pages."""
    head = F.regexp_extract(path, "^(.*?)/(?:methods|properties|formparams|ctors|events|fields|params)/", 1)
    return F.when(head != "", F.concat(head, F.lit(".html")))


def records(toc: DataFrame, pages: DataFrame, locale: str | None = None, family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records of RECORD, page diagnostics as code and id). pages: book, html_path, html."""
    nodes = materialize(classified(toc), "classified")
    visited = ordering.number_within(nodes.where("kind IS NOT NULL AND html_path <> ''"), [], ["book", "index_path"], "seq")
    visited = tree.visit_once(visited.withColumn("page", F.struct("book", "html_path")), "page", "seq").drop("page")
    name = values.split_alias("title")
    path = tree.owner_path(F.col("page_class"), F.col("branch"), F.col("chain"))
    visited = visited.withColumn("n", name).withColumn("owner_path", path).withColumn("semantic", idf.semantic_key("owner_path", F.col("n")["primary"]))
    visited = materialize(visited, "visited")
    # the nearest node above that can own it
    typed = visited.where(F.col("kind").isin(*OWNERS)).select(F.col("id").alias("a"), F.struct(F.col("n")["primary"].alias("primary"), F.col("n")["alias"].alias("alias"), "semantic").alias("owner"))
    owners = visited.select("id", F.posexplode("ancestors").alias("o", "a")).join(typed, "a").groupBy("id").agg(F.max_by("owner", "o").alias("owner"))
    stored = pages.select("book", paths.storage_path("html_path").alias("html_path"), "html")
    stored = stored.groupBy("book", "html_path").agg(F.min("html").alias("html"))
    read = page_ops.parse(visited.select("id", "book", "html_path").join(stored, ["book", "html_path"]).select("id", "html"), "id", "html")
    found = visited.join(owners, "id", "left").join(read, "id", "left")
    owned = F.col("kind").isin(*OWNED)
    line = F.try_element_at(F.split(F.col("sections")["syntax"], "\n"), F.lit(1))
    table = F.col("kind") == "query_table"
    ordered = lambda given: F.transform(given, lambda p: F.struct(p["name"].alias("name"), p["required"].alias("required"), p["description"].alias("description"), p["type_refs"].alias("type_refs")))
    signature = F.transform("signatures", lambda s: F.struct(s["text"].alias("title"), F.coalesce(s["description"], s["variant"]).alias("description"), ordered(s["parameters"]).alias("parameters"), s["return_types"].alias("return_types")))
    typed_kind = type_kind(F.col("n")["primary"], F.col("branch"))
    platform = F.col("kind") == "platform_type"
    made = {
        "seq": F.col("seq"),
        "kind": F.col("kind"),
        "name_primary": F.col("n")["primary"],
        "name_alias": F.col("n")["alias"],
        "owner_primary": F.when(owned, F.col("owner.primary")),
        "owner_alias": F.when(owned, F.col("owner.alias")),
        "owner_path": F.col("owner_path"),
        "signatures": signature,
        "return_types": F.when(F.size("return_types") > 0, F.col("return_types")),
        "type_refs": F.when(F.col("kind").isin("property", "global_property", "query_field", "query_parameter") & (F.size("type_refs") > 0), F.col("type_refs")),
        "description": F.col("description"),
        "availability": F.when(F.col("availability_text").isNotNull(), availability.parse_contexts("availability_text")),
        "since": values.version_of("since_text"),
        "metadata_kind": F.when(platform, metadata_kind(F.col("n")["primary"])),
        "identifier": F.when(table, F.trim(line)),
        "syntax_primary": F.when(table, F.trim(line)),
        "module": F.when(F.col("kind") == "module_event", tree.module_kind(F.transform("owner_path", lambda t: F.lower(t)))),
        "source_path": F.col("html_path"),
        "note": F.col("note"),
        "default_value": F.col("default_value"),
        "usage": F.when(F.col("kind").isin("property", "global_property"), values.usage_of("usage")),
        "query_table_role": F.when(table, tree.query_table_role(line)),
        "type_kind": F.when(platform, typed_kind),
        "object_kind": F.when(platform, object_kind(typed_kind, F.col("branch"))),
        "source_book": F.col("book"),
        "source_locale": F.lit(locale) if locale else paths.locale_of(F.regexp_replace(F.element_at(F.split("book", "/"), -1), r"\.[^.]*$", "")),
        "source_toc": F.array_join(F.col("index_path").cast("array<string>"), "."),
        "source_family": F.lit(family),
        "parent_path": F.when(owned, parent_path(F.col("html_path"))),
        "semantic": F.col("semantic"),
        "owner_semantic": F.when(owned, F.col("owner.semantic")),
    }
    fields = [x.strip().split(" ")[0] for x in _top_level(RECORD)]
    out = found.select(*[made.get(f, F.lit(None)).alias(f) for f in fields])
    out = materialize(out.select(*[F.col(f).cast(t).alias(f) for f, t in zip(fields, (x.strip().split(" ", 1)[1] for x in _top_level(RECORD)), strict=True)]), "records")
    checked = found.select("id", "page_class", (F.size("signatures") > 0).alias("has_syntax"), F.coalesce(F.col("owner.primary"), parent_path(F.col("html_path"))).alias("owner"), F.transform("signatures", lambda s: F.array_join(s["return_types"], ",")).alias("overload_returns"))
    unknown = nodes.where("page_class IN ('unknown', 'unknown_event')").select("id", "page_class", F.lit(False).alias("has_syntax"), F.lit(None).cast("string").alias("owner"), F.array().cast("array<string>").alias("overload_returns"))
    return out, tree.page_diagnostics(checked.unionByName(unknown.where("page_class = 'unknown'")))


def _top_level(ddl: str) -> list[str]:
    """The columns of a DDL string: split at commas outside of < >."""
    found, depth = [""], 0
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            found.append("")
        else:
            found[-1] += char
    return found


def book_index(books: DataFrame, locale: str = "ru") -> tuple[dict[str, DataFrame], DataFrame]:
    """(index tables, page diagnostics) of books (path, content): contents, pages, records, tables."""
    from ..sources import books as source
    from .build import build

    toc = source.read_toc(books).where("error IS NULL")
    toc = toc.select(F.col("path").alias("book"), "id", "parent_id", "ordinal", values.localized("title_ru", "title_en", locale).alias("title"), "html_path")
    pages = source.read_pages(books).where("error IS NULL").select(F.col("path").alias("book"), "html_path", "html")
    found, diagnostics = records(toc, pages, locale)
    return build(found), diagnostics
