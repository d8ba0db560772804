"""Tables of contents: flattening, inherited owners, classification and merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..session import materialize
from .ordering import last_within, number_within


def flatten(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, ordinal, ...) with depth, index_path (ordinals from the root)
    and ancestors (ids from the root), for all that the roots reach at any depth; see
    `tree_problems` for the others. Sorting by index_path gives the pre-order.

    One join on the parent for each level; the level is written before the next one starts.
    """
    nodes = materialize(nodes, "nodes")
    base = nodes.select("id", "parent_id", F.col("ordinal").cast("int").alias("ordinal"))
    level = base.where("parent_id IS NULL").select("id", F.lit(0).alias("depth"), F.array("ordinal").alias("index_path"), F.array().cast("array<string>").alias("ancestors"))
    level = materialize(level, "tree")
    found, depth = level, 0
    children = base.where("parent_id IS NOT NULL").withColumnRenamed("id", "child")
    while not level.isEmpty():
        depth += 1
        if depth % 64 == 0 and depth > nodes.count():
            raise ValueError("a repeated id makes the tree endless")
        joined = children.join(level, children["parent_id"] == level["id"])
        level = materialize(joined.select(F.col("child").alias("id"), F.lit(depth).alias("depth"), F.array_append("index_path", F.col("ordinal")).alias("index_path"), F.array_append("ancestors", F.col("parent_id").cast("string")).alias("ancestors")), "tree")
        found = found.unionByName(level)
    return nodes.join(found, "id")


def tree_problems(nodes: DataFrame, flat: DataFrame) -> DataFrame:
    """(code, id) of the nodes that `flatten` does not reach: ORPHAN_NODE if the parent is no
    node, else UNREACHED_NODE (below an orphan, or in a cycle)."""
    lost = nodes.join(flat.select("id"), "id", "left_anti").select("id", "parent_id")
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    code = F.when(F.col("known"), "UNREACHED_NODE").otherwise("ORPHAN_NODE")
    return lost.join(known, "parent_id", "left").select(code.alias("code"), "id")


def number_siblings(nodes: DataFrame, parent: str, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """nodes with `out`, the place among the siblings from 0 in the given order; a parent of
    very many children is numbered by many tasks."""
    return number_within(nodes, [parent], order, out).withColumn(out, F.col(out).cast("int"))


def by_index_path(flat: DataFrame, path: list[int]) -> DataFrame:
    return flat.where(F.col("index_path") == F.array(*map(F.lit, path)))


def by_html_path(flat: DataFrame, path: str) -> DataFrame:
    return flat.where(F.col("html_path") == path)


def carry_owner(flat: DataFrame, owner: str, parent: str = "parent_id", order: str = "ordinal") -> DataFrame:
    """flat with carried_owner: the owner that the nearest sibling at or before the node
    names."""
    return last_within(flat, [parent], [order], owner, "carried_owner")


def visit_once(pages: DataFrame, key: str = "html_path", order: str = "visit") -> DataFrame:
    """The first visit of each page."""
    rest = [c for c in pages.columns if c != key]
    return pages.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def has(titles: Column, *words: str) -> Column:
    """Does any lower-case title hold one of the words?"""
    return F.exists(titles, lambda t: F.rlike(t, F.lit("|".join(words))))


def word_prefix(titles: Column, *prefixes: str) -> Column:
    """Does a word of any title begin with one of the prefixes?"""
    return F.exists(titles, lambda t: F.rlike(t, F.lit(r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(prefixes) + ")")))


#: Rules of a page's branch, in order: (branch, path pattern, words in a title of
#: the page or its ancestors, beginnings of words in them); a rule holds if any of them does.
BRANCHES = (
    ("query_tables", "^tables/", "таблицы запросов|query tables", None),
    ("primitive_types", None, "примитивные типы|primitive types", None),
    ("global_context", r"^objects/Global context(/|\.html$)", None, None),
    ("system_enums", r"^objects/catalog2(/|\.html$)", None, None),
    ("metadata_objects", None, "прикладные объекты|application objects|metadata", None),
    ("managed_forms", None, None, ("форм", "form")),
    ("automation_external_api", None, "automation|external api", None),
    ("platform_objects", "^objects/catalog", None, None),
)
MODULE_WORDS, FORM_PARAMETERS = "модул|module", "параметры формы|form parameters"
MEMBER_BRANCHES = ("system_enums", "metadata_objects", "managed_forms", "platform_objects", "automation_external_api")
#: Rules of a page's class, in order: (class, branches, path pattern, title words);
#: a rule holds if its branches (None: any) hold and, where given, the path or the words do.
CLASSES = (
    ("catalog", None, r"^objects/catalog[0-9]*(?:/catalog[0-9]*)*\.html$", None),
    ("module_event", None, "^objects/Global context/events/", None),
    ("global_method", None, "^objects/Global context/methods/", None),
    ("global_property", None, "^objects/Global context/properties/", None),
    ("query_table_field", ("query_tables",), "/fields/", None),
    ("query_table_parameter", ("query_tables",), "/params/", None),
    ("query_table", ("query_tables",), "^tables/", None),
    ("object_property", ("managed_forms",), "/params/", FORM_PARAMETERS),
    ("module_event", ("global_context",), "/events/", None),
    ("event", None, "/events/", None),
    ("object_method", None, "/methods/", None),
    ("enum_value", None, "/catalog2/(?:.*/)?properties/|/properties/(?:.*/)?catalog2/", None),
    ("object_property", None, "/properties/", None),
    ("constructor", None, "/ctors/", None),
    ("enum", None, "^objects/catalog2/", None),
    ("object_type", None, "^objects/catalog", None),
)


def first_rule(rules: Sequence[tuple], holds, name=lambda rule: F.lit(rule[0])) -> Column:
    """CASE over the rules: the name of the first one that holds."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        found = found.when(holds(rule), name(rule))
    return found


def branch_kind(path: Column, titles: Column) -> Column:
    """Branch of a page from its path and the lower-case titles of itself and its ancestors."""

    def holds(rule) -> Column:
        _, pattern, words, prefixes = rule
        ways = [F.rlike(path, F.lit(pattern))] if pattern else []
        ways += [has(titles, words)] if words else []
        ways += [word_prefix(titles, *prefixes)] if prefixes else []
        return reduce(or_, (F.coalesce(w, F.lit(False)) for w in ways))

    return F.coalesce(first_rule(BRANCHES, holds), F.lit("unknown"))


def page_class(path: Column, branch: Column, titles: Column, has_children: Column) -> Column:
    """Class of a page. Events belong to a module, a type of the member branches, or are
    unknown; what no rule names is a catalogue if it has children."""

    def holds(rule) -> Column:
        _, branches, pattern, words = rule
        found = F.rlike(path, F.lit(pattern))
        found = found | has(titles, words) if words else found
        return found & branch.isin(*branches) if branches else found

    event = F.when(has(titles, MODULE_WORDS), "module_event").when(branch.isin(*MEMBER_BRANCHES), "type_event").otherwise("unknown_event")
    named = first_rule(CLASSES, holds, lambda rule: event if rule[0] == "event" else F.lit(rule[0]))
    return F.coalesce(named, F.when(has_children, "catalog").otherwise("unknown"))


def query_table_role(syntax: Column) -> Column:
    """primary for up to two segments of the syntax, additional for more, unknown for none."""
    n = F.size(F.filter(F.split(syntax, r"\."), lambda s: F.trim(s) != ""))
    return F.when(syntax.isNull() | (n == 0), "unknown").when(n <= 2, "primary").otherwise("additional")


#: Words of an owner's title that tell the kind of its module, in order.
MODULES = (
    ("form", "form|форм"),
    ("manager", "manager|менеджер"),
    ("record_set", "recordset|record set|набор"),
    ("object", "object|объект"),
    ("session", "session|сеанс"),
    ("external_connection", "external connection|внешн"),
    ("application", "application|приложен"),
    ("command", "command|команд"),
)


def module_kind(owner_titles: Column) -> Column:
    """Kind of module from the lower-case owner titles."""
    return F.coalesce(first_rule(MODULES, lambda rule: has(owner_titles, rule[1])), F.lit("common"))


def discover_roots(flat: DataFrame) -> DataFrame:
    """Depth-1 nodes under objects/ with their root kind: the global context, an enum
    catalogue (children under catalog2), a type catalogue, else unknown with a diagnostic."""
    roots = flat.where((F.col("depth") == 1) & F.startswith(F.col("html_path"), F.lit("objects/")))
    children = flat.groupBy(F.col("parent_id").alias("id")).agg(F.max(F.startswith(F.col("html_path"), F.lit("objects/catalog2/"))).alias("enums"), F.max(F.startswith(F.col("html_path"), F.lit("objects/catalog"))).alias("types"))
    kind = (
        F.when(F.startswith(F.col("html_path"), F.lit("objects/Global context")), "global_context")
        .when(F.coalesce("enums", F.lit(False)) | F.startswith(F.col("html_path"), F.lit("objects/catalog2")), "enum_catalog")
        .when(F.coalesce("types", F.lit(False)) | F.startswith(F.col("html_path"), F.lit("objects/catalog")), "type_catalog")
        .otherwise("unknown")
    )
    found = roots.join(children, "id", "left").withColumn("root_kind", kind)
    return found.withColumn("diagnostic", F.when(F.col("root_kind") == "unknown", "UNKNOWN_ROOT")).drop("enums", "types")


def merge_books(nodes: DataFrame) -> DataFrame:
    """One tree of the nodes of many books of a locale: siblings with the same page address,
    or else the same section title, become one node; the first book (lowest book_seq, then
    ordinal) gives its title and page.

    nodes: locale, book_seq, id, parent_id, ordinal, title, page_key (null for sections).
    Result: locale, node_path (merge keys from the root, the node's identity), parent_path,
    title, page_key, ordinal, books. Level by level down to the deepest, one aggregate each.
    """
    keyed = nodes.withColumn("merge_key", F.coalesce(F.concat(F.lit("page:"), "page_key"), F.concat(F.lit("title:"), title_key("title"))))
    level = materialize(keyed.where("parent_id IS NULL").withColumn("parent_path", F.array().cast("array<string>")), "merge")
    children = keyed.where("parent_id IS NOT NULL")
    found, depth = None, 0
    while found is None or not level.isEmpty():
        depth += 1
        if depth % 64 == 0 and depth > nodes.count():
            raise ValueError("a repeated id makes the tree endless")
        placed = level.withColumn("node_path", F.array_append("parent_path", F.col("merge_key")))
        merged = placed.groupBy("locale", "node_path").agg(F.min_by(F.struct("title", "page_key", F.col("book_seq").alias("first_book"), "ordinal", "parent_path"), F.struct("book_seq", "ordinal")).alias("r"), F.count_distinct("book_seq").alias("books"))
        merged = merged.select("locale", "node_path", "r.*", "books")
        found = merged if found is None else found.unionByName(merged)
        parents = placed.select("locale", "book_seq", F.col("id").alias("parent_id"), F.col("node_path").alias("parent_path"))
        level = materialize(children.join(parents, ["locale", "book_seq", "parent_id"]), "merge")
    return found


def resolve_placeholders(nodes: DataFrame, key: str = "title_branch", page: str = "page_key") -> DataFrame:
    """nodes whose page is null take the page of their title branch if exactly one is known."""
    known = nodes.where(F.col(page).isNotNull()).groupBy(key).agg(F.when(F.min(page) == F.max(page), F.min(page)).alias("__page"))
    return nodes.join(known, key, "left").withColumn(page, F.coalesce(page, "__page")).drop("__page")


def child_counts(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    return nodes.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("children"))


def link_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links (book, path) with target: the own book's path, else the path that names a book
    first, else the path without the own book's prefix."""
    own = pages.select(F.col("book").alias("__b1"), F.col("path").alias("__p1"), F.col("page_id").alias("own"))
    full = pages.select(F.concat_ws("/", "book", "path").alias("__p2"), F.col("page_id").alias("prefixed"))
    bare = pages.select(F.col("book").alias("__b3"), F.concat_ws("/", "book", "path").alias("__p3"), F.col("page_id").alias("stripped"))
    found = links.join(own, (F.col("book") == F.col("__b1")) & (F.col("path") == F.col("__p1")), "left")
    found = found.join(full, F.col("path") == F.col("__p2"), "left")
    found = found.join(bare, (F.col("book") == F.col("__b3")) & (F.concat_ws("/", "book", F.regexp_replace("path", "^[^/]*/", "")) == F.col("__p3")), "left")
    return found.withColumn("target", F.coalesce("own", "prefixed", "stripped")).drop("__b1", "__p1", "__p2", "__b3", "__p3", "own", "prefixed", "stripped")


def owner_path(kind: Column, branch: Column, ancestors: Column) -> Column:
    """Titles of the ancestors (array of title, path; root first) that own a page of this
    class: tables and registers for query pages, all but the root for members, all (on the
    platform branch: those with a page) for types, none for others."""
    table = lambda a: F.startswith(a["path"], F.lit("objects/catalog")) | F.startswith(a["path"], F.lit("tables/")) | F.rlike(F.lower(a["title"]), F.lit("таблицы|table|регистр|register"))
    titled = lambda a: F.trim(a["title"]) != ""
    titles = lambda found: F.transform(found, lambda a: F.trim(a["title"]))
    rest = F.slice(ancestors, F.lit(2), F.greatest(F.size(ancestors) - 1, F.lit(0)))
    typed = F.when(branch == "platform_objects", F.filter(ancestors, lambda a: a["path"] != "")).otherwise(ancestors)
    return (
        F.when(kind.isin("query_table", "query_table_field", "query_table_parameter"), titles(F.filter(ancestors, table)))
        .when(kind.isin("module_event", "type_event", "unknown_event", "object_property", "constructor", "object_method"), titles(F.filter(rest, titled)))
        .when(kind == "object_type", titles(typed))
        .otherwise(F.array().cast("array<string>"))
    )


def attach(parents: DataFrame, children: DataFrame, key: str, name: str, order: str = "seq") -> DataFrame:
    """parents (unique in key) with their children as an array of structs in `order`;
    children without a parent are dropped."""
    columns = [order, *(c for c in children.columns if c not in (key, order))]
    nested = children.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    empty = F.array_compact(F.array(F.lit(None)))
    joined = parents.join(nested, parents[key] == F.col("__k"), "left").drop("__k")
    return joined.withColumn(name, F.coalesce(F.col(name), empty.cast(nested.schema[name].dataType)))


def page_diagnostics(pages: DataFrame) -> DataFrame:
    """(code, id) of pages (id, page_class, has_syntax, owner, overload_returns): unknown
    pages, callables without syntax, members without an owner, differing overload returns."""
    kind = F.col("page_class")
    codes = F.array_compact(
        F.array(
            F.when(kind.isin("unknown", "unknown_event"), "UNKNOWN_PAGE"),
            F.when(kind.isin("object_method", "global_method", "constructor") & ~F.col("has_syntax"), "MISSING_SYNTAX"),
            F.when(kind.isin("object_method", "object_property", "constructor", "type_event", "enum_value", "query_table_field", "query_table_parameter") & F.col("owner").isNull(), "MISSING_OWNER"),
            F.when(F.size(F.array_distinct("overload_returns")) > 1, "MULTIPLE_OVERLOAD_RETURNS"),
        )
    )
    return pages.select(F.explode(codes).alias("code"), "id")
