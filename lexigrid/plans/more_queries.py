"""Further driver queries with the SQL each one must equal: trees, identities, statistics,
facts of an index, search postings and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import availability, identity, paths, text, values
from ..operators import export, graph, identity as ids, lookup, ordering, pages, resolve, search, stats, tree
from ..schemas import CALLABLE_KINDS, kinds
from ..session import spread, table
from . import catalog, extract
from .build import template_rows
from .queries import _CLASSED, KEY, WS, catalog_sql, classed, named, query

# --- statistics -----------------------------------------------------------------------------


@query(f"WITH {_CLASSED} SELECT class, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM classed GROUP BY class, event_type")
def q51_class_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).groupBy("class", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    """SELECT l_shipmode AS operation, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS totals, max(l_quantity) AS max_load, min(l_discount) AS min_memory,
  round(sum(greatest(0, l_tax - l_discount)), 6) AS growth FROM (SELECT l_returnflag AS l_shipmode, * FROM lineitem) GROUP BY l_shipmode"""
)
def q52_observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.observed(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity", "l_discount", "l_discount", "l_tax")
    return found.select(F.col("l_returnflag").alias("operation"), F.array_join(F.col("totals").cast("array<string>"), ",").alias("totals"), "max_load", "min_memory", F.round("growth", 6).alias("growth"))


@query(
    """WITH c AS (SELECT n.k AS c_nationkey, s.m AS c_mktsegment FROM range(0, 30) n(k), (VALUES ('AUTOMOBILE'), ('BUILDING'), ('NONE')) s(m))
SELECT CAST(c_nationkey AS INTEGER) AS c_nationkey, c_mktsegment FROM c WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = c.c_nationkey AND x.c_mktsegment = c.c_mktsegment)"""
)
def q53_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing_cells(table(spark, sf_dir, "customer"), {"c_nationkey": list(range(30)), "c_mktsegment": ["AUTOMOBILE", "BUILDING", "NONE"]})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def q54_repeated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repeated_cells(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


_GATES = "(VALUES ('click', 80.0), ('view', 10.0), ('error', 1000.0), ('worst', 60.0), ('none', 1.0))"


@query(
    f"""WITH med AS (SELECT event_type AS metric, median(value) AS m FROM events GROUP BY event_type),
mads AS (SELECT metric, any_value(m) AS m, median(abs(value - m)) AS mad FROM events JOIN med ON event_type = metric GROUP BY metric),
metrics AS (SELECT metric, m, coalesce(mad / nullif(m, 0) > 0.05, false) AS noisy FROM mads),
full_ AS (SELECT * FROM metrics UNION ALL SELECT 'worst', max(m), bool_or(noisy) FROM metrics)
SELECT metric, CASE WHEN m IS NULL THEN 'missing' WHEN noisy AND metric NOT IN ('click', 'worst') THEN 'inconclusive' WHEN m <= threshold THEN 'pass' ELSE 'fail' END AS outcome
FROM {_GATES} t(metric, threshold) LEFT JOIN full_ USING (metric)"""
)
def q55_threshold_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = stats.median_mad(table(spark, sf_dir, "events"), ["event_type"], "value").withColumnRenamed("event_type", "metric")
    thresholds = spark.createDataFrame([("click", 80.0), ("view", 10.0), ("error", 1000.0), ("worst", 60.0), ("none", 1.0)], "metric string, threshold double")
    return stats.gates(stats.runtime_max(metrics, "worst"), thresholds, ["click", "worst"]).select("metric", "outcome")


_HALVES = """med AS (SELECT user_id % 2 AS half, event_type, median(value) AS m FROM events GROUP BY ALL),
mads AS (SELECT e.user_id % 2 AS half, e.event_type, any_value(m) AS m, median(abs(value - m)) AS mad FROM events e JOIN med ON e.user_id % 2 = half AND e.event_type = med.event_type GROUP BY ALL)"""


@query(
    f"""WITH {_HALVES} SELECT c.event_type, round(b.m + greatest(0.25 * b.m, 3 * b.mad, 3 * c.mad), 6) AS ceiling, c.m <= b.m + greatest(0.25 * b.m, 3 * b.mad, 3 * c.mad) AS within
FROM mads c JOIN mads b ON c.half = 1 AND b.half = 0 AND c.event_type = b.event_type"""
)
def q56_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    found = stats.median_mad(events, ["half", "event_type"], "value")
    checked = stats.ceilings(found.where("half = 1"), found.where("half = 0"), ["event_type"])
    return checked.select("event_type", F.round("ceiling", 6).alias("ceiling"), "within")


@query(
    f"""WITH {_HALVES} SELECT half, coalesce(array_to_string(list_sort(list(event_type) FILTER (WHERE NOT within)), ','), '') AS failed FROM (
  SELECT c.half, c.event_type, c.m <= 1.0001 * b.m AS within FROM mads c JOIN mads b ON b.half = 0 AND c.event_type = b.event_type) GROUP BY half"""
)
def q57_failed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    medians = ordering.median_within(events, ["half", "event_type"], "value")
    base = medians.where("half = 0").select("event_type", F.col("median").alias("base"))
    failed = stats.failed_by(medians.join(base, "event_type").withColumn("within", F.col("median") <= 1.0001 * F.col("base")), "half", "event_type")
    return failed.select("half", F.array_join("failed", ",").alias("failed"))


@query(
    """SELECT l_orderkey, count(l_linenumber) = 4 AND count(DISTINCT l_linenumber) = 4 AND min(l_linenumber) = 1 AND max(l_linenumber) = 4 AS complete,
  count(l_linestatus) = count(*) AND min(l_linestatus) = max(l_linestatus) AS stable FROM lineitem GROUP BY l_orderkey"""
)
def q58_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.completeness(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linestatus", 4)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'zero-baseline' WHEN (o_totalprice / 10) / o_totalprice > 0.05 AND o_orderkey % 2 = 0 THEN 'noisy' ELSE 'stable' END AS state FROM orders")
def q59_noise_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice"))
    mad = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 10).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", stats.noise_state(median, mad).alias("state"))


# --- trees of pages -------------------------------------------------------------------------

#: (path, title of an ancestor, children) of pages by number, with the class and branch expected.
CASES = [
    ("objects/catalog1/catalog4.html", "types", True, "platform_objects", "catalog"),
    ("objects/Global context/events/a.html", "x", False, "global_context", "module_event"),
    ("objects/Global context/methods/a.html", "x", False, "global_context", "global_method"),
    ("objects/Global context/properties/a.html", "x", False, "global_context", "global_property"),
    ("tables/t/fields/a.html", "x", False, "query_tables", "query_table_field"),
    ("tables/t/params/a.html", "x", False, "query_tables", "query_table_parameter"),
    ("tables/t.html", "x", False, "query_tables", "query_table"),
    ("objects/catalog1/o/params/a.html", "Form fields", False, "managed_forms", "object_property"),
    ("objects/catalog1/o/events/a.html", "Modules", False, "platform_objects", "module_event"),
    ("objects/catalog1/o/events/a.html", "x", False, "platform_objects", "type_event"),
    ("else/events/a.html", "x", False, "unknown", "unknown_event"),
    ("objects/catalog1/o/methods/a.html", "Application objects", False, "metadata_objects", "object_method"),
    ("objects/catalog2/o/properties/a.html", "x", False, "system_enums", "enum_value"),
    ("objects/catalog1/o/properties/a.html", "External API", False, "automation_external_api", "object_property"),
    ("objects/catalog1/o/ctors/a.html", "x", False, "platform_objects", "constructor"),
    ("objects/catalog2/o.html", "x", False, "system_enums", "enum"),
    ("objects/catalog1/o.html", "Primitive types", False, "primitive_types", "object_type"),
    ("else/a.html", "x", True, "unknown", "catalog"),
    ("else/a.html", "x", False, "unknown", "unknown"),
]
_CASES = ", ".join(f"({i}, '{branch}', '{kind}')" for i, (_, _, _, branch, kind) in enumerate(CASES))


@query(f"SELECT p_partkey, branch, page_class FROM part JOIN (VALUES {_CASES}) t(i, branch, page_class) ON p_partkey % {len(CASES)} = i")
def q60_page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t.lower()).alias("title"), F.lit(c).alias("children")) for p, t, c, _, _ in CASES))
    part = table(spark, sf_dir, "part").select("p_partkey", F.element_at(made, (F.col("p_partkey") % len(CASES) + 1).cast("int")).alias("x"))
    titles = F.array(F.col("x.title"), F.lit("root"))
    part = part.withColumn("branch", tree.branch_kind(F.col("x.path"), titles))
    return part.select("p_partkey", "branch", tree.page_class(F.col("x.path"), F.col("branch"), titles, F.col("x.children")).alias("page_class"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'form' WHEN 1 THEN 'manager' WHEN 2 THEN 'record_set' WHEN 3 THEN 'object' WHEN 4 THEN 'session'
  WHEN 5 THEN 'external_connection' WHEN 6 THEN 'application' WHEN 7 THEN 'command' ELSE 'common' END AS module FROM orders"""
)
def q61_module_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = ["form of a manager", "manager", "record set of an object", "the object", "session", "external connection", "application", "commands", "plain"]
    titles = F.array(F.lit("root"), F.element_at(F.array(*map(F.lit, owners)), (F.col("o_orderkey") % 9 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tree.module_kind(titles).alias("module"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'primary' WHEN 2 THEN 'primary' ELSE 'additional' END AS role FROM part")
def q62_query_table_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    syntax = F.element_at(F.array(F.lit(" "), F.col("p_type"), F.concat("p_type", F.lit("."), "p_brand"), F.concat("p_type", F.lit(".x."), "p_brand")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tree.query_table_role(syntax).alias("role"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'global_context' WHEN 1 THEN 'enum_catalog' WHEN 2 THEN 'type_catalog' ELSE 'unknown' END AS root_kind, CASE WHEN n_nationkey % 4 = 3 THEN 'UNKNOWN_ROOT' END AS diagnostic FROM nation")
def q63_root_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("objects/Global context.html"), F.lit("objects/catalog2.html"), F.lit("objects/catalog7.html"), F.lit("objects/other.html"))
    flat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(-1).alias("parent_id"), F.lit(1).alias("depth"), F.element_at(names, F.col("n_nationkey") % 4 + 1).alias("html_path"))
    return tree.discover_roots(flat).select("id", "root_kind", "diagnostic")


@query(
    """SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag = 'R' THEN l_suppkey END IGNORE NULLS) OVER (PARTITION BY l_partkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_owner FROM lineitem"""
)
def q64_carried_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("parent_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("owner"))
    return tree.carry_owner(lines, "owner").select("ordinal.l_orderkey", "ordinal.l_linenumber", "carried_owner")


@query("SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) AS l_suppkey, min(l_orderkey * 100 + l_linenumber) AS visit FROM lineitem GROUP BY l_partkey")
def q65_visit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("visit"))
    return tree.visit_once(lines, "l_partkey", "visit")


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderstatus = 'F' AS syntax, o_orderkey % 3 = 0 AS unowned, o_orderkey % 7 = 0 AS differing FROM orders)
SELECT 'UNKNOWN_PAGE' AS code, id FROM p WHERE k = 0 UNION ALL SELECT 'MISSING_SYNTAX', id FROM p WHERE k IN (1, 2) AND NOT syntax
UNION ALL SELECT 'MISSING_OWNER', id FROM p WHERE k IN (1, 3) AND unowned UNION ALL SELECT 'MULTIPLE_OVERLOAD_RETURNS', id FROM p WHERE differing"""
)
def q66_page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("unknown", "object_method", "global_method", "object_property", "catalog"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    owner = F.when(F.col("o_orderkey") % 3 != 0, "o")
    returns = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("A")))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("page_class"), (F.col("o_orderstatus") == "F").alias("has_syntax"), owner.alias("owner"), returns.alias("overload_returns"))
    return tree.page_diagnostics(found)


@query(
    f"""WITH b AS (SELECT c_custkey % 3 AS book, c_nationkey, c_mktsegment, c_custkey FROM customer),
top AS (SELECT 'en' AS locale, 'title:' || lower(c_mktsegment) AS path, min(book) AS first_book, count(DISTINCT book) AS books FROM b GROUP BY c_mktsegment),
low AS (SELECT 'en' AS locale, 'title:' || lower(c_mktsegment) || '/page:n' || c_nationkey AS path, min(book) AS first_book, count(DISTINCT book) AS books FROM b GROUP BY c_mktsegment, c_nationkey)
SELECT locale, path, CAST(first_book AS BIGINT) AS first_book, books FROM top UNION ALL SELECT locale, path, CAST(first_book AS BIGINT), books FROM low"""
)
def q67_merge_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("book_seq"), "c_nationkey", "c_mktsegment", "c_custkey")
    top = rows.groupBy("book_seq", "c_mktsegment").agg(F.min("c_custkey").alias("ordinal")).select("book_seq", F.col("c_mktsegment").alias("id"), F.lit(None).cast("string").alias("parent_id"), "ordinal", F.initcap(F.lower("c_mktsegment")).alias("title"), F.lit(None).cast("string").alias("page_key"))
    low = rows.groupBy("book_seq", "c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("ordinal"))
    low = low.select("book_seq", F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("id"), F.col("c_mktsegment").alias("parent_id"), "ordinal", F.lit("page").alias("title"), F.concat(F.lit("n"), "c_nationkey").alias("page_key"))
    merged = tree.merge_books(top.unionByName(low).withColumn("locale", F.lit("en")))
    return merged.select("locale", F.array_join("node_path", "/").alias("path"), "first_book", "books")


@query(
    """WITH n AS (SELECT p_partkey, p_name AS title_branch, CASE WHEN p_size % 9 = 0 THEN p_type END AS page FROM part), k AS (SELECT title_branch, CASE WHEN min(page) = max(page) THEN min(page) END AS one FROM n GROUP BY 1)
SELECT p_partkey, coalesce(page, one) AS page_key FROM n JOIN k USING (title_branch)"""
)
def q68_placeholder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title_branch"), F.when(F.col("p_size") % 9 == 0, F.col("p_type")).alias("page_key"))
    return tree.resolve_placeholders(nodes).select("p_partkey", "page_key")


@query("SELECT o_custkey AS parent_id, count(*) AS children FROM orders GROUP BY o_custkey")
def q69_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.child_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id")))


@query(
    """WITH p AS (SELECT 'b' || n_regionkey AS book, 'p' || n_nationkey AS path, n_nationkey AS id FROM nation), l AS (SELECT c_custkey, 'b' || (c_custkey % 5) AS book,
  CASE c_custkey % 3 WHEN 0 THEN 'p' || c_nationkey WHEN 1 THEN 'b' || (c_nationkey % 5) || '/p' || c_nationkey ELSE 'x/p' || c_nationkey END AS path FROM customer)
SELECT c_custkey, coalesce(a.id, b.id, c.id) AS target FROM l LEFT JOIN p a ON l.book = a.book AND l.path = a.path LEFT JOIN p b ON l.path = b.book || '/' || b.path
LEFT JOIN p c ON l.book = c.book AND regexp_replace(l.path, '^[^/]*/', '') = c.path"""
)
def q70_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), "n_regionkey").alias("book"), F.concat(F.lit("p"), "n_nationkey").alias("path"), F.col("n_nationkey").alias("page_id"))
    key = F.col("c_custkey") % 3
    path = F.when(key == 0, F.concat(F.lit("p"), "c_nationkey")).when(key == 1, F.concat(F.lit("b"), F.col("c_nationkey") % 5, F.lit("/p"), "c_nationkey")).otherwise(F.concat(F.lit("x/p"), "c_nationkey"))
    links = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("b"), F.col("c_custkey") % 5).alias("book"), path.alias("path"))
    return tree.link_targets(links, stored).select("c_custkey", "target")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2 AND n_nationkey < 12 UNION ALL SELECT 1000 + n_nationkey FROM nation WHERE n_name = 'NATION_3'")
def q71_find_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_regionkey"), F.when(F.col("n_nationkey") < 12, 0).otherwise(1)).alias("index_path"), F.col("n_name").alias("html_path"))
    return tree.by_index_path(flat, [2, 0]).select("id").union(tree.by_html_path(flat, "NATION_3").select(F.col("id") + 1000))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Register ' || p_type WHEN 1 THEN p_name || '/' || p_type WHEN 2 THEN p_brand ELSE '' END AS owners FROM part"""
)
def q72_owner_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda title, path: F.struct(F.trim(title).alias("title"), F.lit(path).alias("path"))
    chains = [
        F.array(node(F.lit("Root"), "x"), node(F.concat(F.lit("Register "), "p_type"), "y")),
        F.array(node(F.lit("Root"), "x"), node(F.col("p_name"), "y"), node(F.lit(" "), ""), node(F.col("p_type"), "z")),
        F.array(node(F.lit("No page"), ""), node(F.col("p_brand"), "objects/a.html")),
        F.array(node(F.lit("Root"), "x")),
    ]
    kind = F.element_at(F.array(*map(F.lit, ("query_table", "object_method", "object_type", "enum"))), (F.col("p_size") % 4 + 1).cast("int"))
    chain = F.element_at(F.array(*chains), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tree.owner_path(kind, F.lit("platform_objects"), chain), "/").alias("owners"))


# --- lookups and facts ----------------------------------------------------------------------


def _fact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of every kind in turn, owned by their customer."""
    dimension = [r.kind for r in kinds(spark).orderBy("kind_priority", "kind").collect()]  # the short fixed list
    kind = F.element_at(F.array(*map(F.lit, dimension)), (F.col("o_orderkey") % len(dimension) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("name_primary"), F.lit(None).cast("string").alias("name_alias"), F.col("o_custkey").alias("owner"))


_KINDS = "enum enum_value event global_method global_property language_construct language_function language_keyword language_literal language_operator language_type constructor method module_event platform_type property query_field query_parameter query_table type_event".split()


def _kind_sql() -> str:
    from ..schemas import KINDS

    ordered = [k for _, k in sorted((p, k) for k, p, _ in KINDS)]
    return f"facts AS (SELECT 'o' || o_orderkey AS id, [{', '.join(repr(k) for k in ordered)}][o_orderkey % {len(ordered)} + 1] AS kind, o_orderpriority AS name_primary, o_custkey AS owner FROM orders)"


@query(
    f"""WITH {_kind_sql()} SELECT CAST(sum(CASE WHEN kind IN ({', '.join(repr(k) for k in CALLABLE_KINDS)}) THEN 1 ELSE 0 END) AS BIGINT) AS callables,
  CAST(sum(CASE WHEN starts_with(kind, 'language_') THEN 1 ELSE 0 END) AS BIGINT) AS languages, CAST(sum(CASE WHEN kind IN ('platform_type', 'enum') THEN 1 ELSE 0 END) AS BIGINT) AS types FROM facts"""
)
def q73_kind_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _fact_kinds(spark, sf_dir).join(F.broadcast(kinds(spark)), "kind")
    one = lambda c: F.sum(F.col(c).cast("long"))
    return joined.agg(one("is_callable").alias("callables"), one("is_language").alias("languages"), one("is_type").alias("types"))


@query(f"WITH {_kind_sql()} SELECT id, kind FROM facts WHERE kind IN ({', '.join(repr(k) for k in CALLABLE_KINDS)}) AND owner = 7")
def q74_callables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _fact_kinds(spark, sf_dir).withColumn("kind_priority", F.lit(1))
    callables = docs.where(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("callable_id"), F.col("id").alias("document_id"), F.col("kind").alias("callable_kind"), F.concat(F.lit("c"), F.col("owner").cast("string")).alias("owner_type_id"))
    return lookup.callables_of(callables, docs.drop("owner"), "c7").select("id", "kind")


@query(f"WITH docs AS ({catalog_sql()}) SELECT m.id, m.name_primary FROM docs m WHERE m.owner_id = 'nation:3' AND m.kind = 'customer' AND {KEY.format('m.name_primary')} LIKE '%7'")
def q75_members_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir)
    found = lookup.members_of(catalog.members(docs), docs, "nation:3", kind="customer")
    return found.where(F.endswith("member_name", F.lit("7"))).select("id", "name_primary")


@query(
    f"""WITH docs AS ({catalog_sql('region nation supplier customer')}) SELECT id, kind FROM docs WHERE owner_id = 'nation:4' AND kind = 'supplier' ORDER BY id LIMIT 100"""
)
def q76_owned_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier", "customer"))
    none = docs.select(F.lit("").alias("document_id"), F.lit("").alias("ref_kind"), F.lit("").alias("target_id"), F.lit("").alias("target_name"), F.lit("").alias("status")).where("false")
    return lookup.owned_by_relation(graph.derive(docs, none), docs, "nation:4", "supplier").select("id", "kind")


@query(
    f"""WITH docs AS ({catalog_sql('region nation supplier customer')}) SELECT id AS target_id, 'owns' AS edge_kind, 10 AS weight FROM docs WHERE owner_id = 'nation:5'
UNION ALL SELECT owner_id, 'member_of', 20 FROM docs WHERE id = 'nation:5'"""
)
def q77_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier", "customer"))
    none = docs.select(F.lit("").alias("document_id"), F.lit("").alias("ref_kind"), F.lit("").alias("target_id"), F.lit("").alias("target_name"), F.lit("").alias("status")).where("false")
    return graph.neighbours(graph.derive(docs, none), "nation:5").select("target_id", "edge_kind", "weight")


@query(
    f"""SELECT 'part:' || p_partkey AS id, {KEY.format('p_name')} AS key, 'primary' AS key_kind FROM part UNION ALL SELECT 'part:' || p_partkey, {KEY.format('p_brand')}, 'alias' FROM part
UNION ALL SELECT 'part:' || p_partkey, {KEY.format("p_type || '.' || p_name")}, 'owner_member_primary' FROM part UNION ALL SELECT 'part:' || p_partkey, {KEY.format("p_type || '.' || p_brand")}, 'owner_member_alias' FROM part
UNION ALL SELECT 'part:' || p_partkey, 'm' || p_size, 'module_context' FROM part"""
)
def q78_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = text.name_keys(F.col("p_name"), F.col("p_brand"), F.col("p_type"), None, F.concat(F.lit("M "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.explode(keys).alias("k")).select("id", "k.key", "k.key_kind")


@query("SELECT p_name AS owner_key, arg_min(p_partkey, CAST(p_size AS BIGINT) * 1000000000 + p_partkey) AS id FROM part GROUP BY p_name")
def q79_best_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select(F.col("p_name").alias("owner_key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("kind_priority"), F.col("p_partkey").alias("seq"))
    return ids.best_owner(docs, "owner_key")


@query(
    """SELECT 'customer:' || c_custkey AS id, coalesce('nation:' || n_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'region:' || (c_custkey % 5) END) AS owner_id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_nationkey < 20"""
)
def q80_parent_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("nations/n"), F.col("c_nationkey").cast("string"), F.lit("/methods/m.html")).alias("html_path"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string"))).alias("meaning"))
    pages_ = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("nations/n"), F.col("n_nationkey").cast("string"), F.lit(".html")).alias("page"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("a"))
    meanings = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("meaning"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("b"))
    found = people.withColumn("page", extract.parent_path(F.col("html_path"))).join(pages_, "page", "left").join(meanings, "meaning", "left")
    return found.select("id", F.coalesce("a", "b").alias("owner_id"))


@query("SELECT 'DUPLICATE_DOCUMENT_ID' AS code, p_name AS id, count(*) AS duplicate_count FROM part GROUP BY p_name HAVING count(*) > 1")
def q81_duplicate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.duplicate_warnings(table(spark, sf_dir, "part").withColumn("id", F.col("p_name")), "id")


@query("SELECT p_type AS type_id, p_brand AS family, count(*) AS score FROM part GROUP BY ALL")
def q82_family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.family_scores(table(spark, sf_dir, "part").select(F.col("p_type").alias("type_id"), F.col("p_brand").alias("family")))


@query(
    """WITH t AS (SELECT p_partkey, p_brand || '.x' AS base, p_brand, p_type, p_size FROM part), roots AS (SELECT DISTINCT p_brand AS root FROM part WHERE p_size % 3 = 0),
lead_ AS (SELECT p_partkey, arg_max(root, length(root)) AS by_root FROM t JOIN roots ON starts_with(base, root) GROUP BY 1),
ev AS (SELECT p_partkey, count(DISTINCT f) AS n, min(f) AS one FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE p_type END AS f FROM part UNION ALL SELECT p_partkey, 'even' FROM part WHERE p_size % 5 = 0) GROUP BY 1)
SELECT p_partkey AS type_id, coalesce(by_root, CASE WHEN n = 1 THEN one END) AS family, CASE WHEN coalesce(by_root, CASE WHEN n = 1 THEN one END) IS NOT NULL THEN NULL WHEN n > 1 THEN 'AMBIGUOUS_TEMPLATE' ELSE 'UNCLASSIFIED_TEMPLATE' END AS diagnostic,
  CASE WHEN by_root IS NOT NULL THEN substr(base, length(by_root) + 1) WHEN n = 1 THEN base END AS variant
FROM t LEFT JOIN lead_ USING (p_partkey) LEFT JOIN ev USING (p_partkey)"""
)
def q83_template_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    templates = part.select(F.col("p_partkey").alias("type_id"), F.concat("p_brand", F.lit(".x")).alias("base"))
    managers = part.where("p_size % 3 = 0").select(F.concat("p_brand", F.lit("Manager")).alias("name"))
    evidence = part.select(F.col("p_partkey").alias("type_id"), F.when(F.col("p_size") % 2 == 0, "even").otherwise(F.col("p_type")).alias("family"))
    evidence = evidence.union(part.where("p_size % 5 = 0").select("p_partkey", F.lit("even")))
    return ids.classify_templates(templates, managers, evidence).select("type_id", "family", "diagnostic", "variant")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS made, CASE WHEN o_orderkey % 2 = 0 THEN 'ambiguous' ELSE 'ok' END AS status FROM orders)
SELECT o_orderkey, CASE WHEN made THEN 'ok' ELSE status END AS status, CASE WHEN made THEN 'owner' WHEN status = 'ok' THEN 'target' END AS target_id, CASE WHEN NOT made AND status = 'ambiguous' THEN 'a,b' END AS candidates FROM r"""
)
def q84_constructor_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.col("o_orderkey") % 2 == 0
    refs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "constructor_result").otherwise("return_type").alias("ref_kind"), F.lit("owner").alias("owner_type_id"),
        F.when(many, "ambiguous").otherwise("ok").alias("status"), F.when(~many, "target").alias("target_id"), F.when(many, F.array(F.lit("a"), F.lit("b"))).alias("candidates"),
    )
    return resolve.resolve_constructors(refs).select("o_orderkey", "status", "target_id", F.array_join("candidates", ",").alias("candidates"))


@query(
    """SELECT 'nation:' || n_nationkey AS id, n_name AS name, coalesce(s, '') AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
)
def q85_nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    children = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("seq"), "s_name")
    found = tree.attach(parents, children, "k", "suppliers")
    return found.select(F.concat(F.lit("nation:"), F.col("k").cast("string")).alias("id"), F.col("n_name").alias("name"), F.array_join(F.transform("suppliers", lambda s: s["s_name"]), ",").alias("suppliers"))


# --- scalar functions ------------------------------------------------------------------------


@query(
    rf"""WITH s AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_size % 3 + 1 AS same FROM part)
SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS reference_key,
  'query_table:' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type || ':' || p_name END || CASE WHEN same > 1 THEN ':' || p_type ELSE '' END AS table_id,
  'enum:' || CASE WHEN p_size % 2 = 0 THEN 'system' ELSE 'metadata_property' END || ':' || p_name || CASE WHEN same > 1 THEN ':' || p_brand ELSE '' END AS enum_id,
  'method:' || CASE WHEN p_size % 2 = 0 THEN 'platform_type:' || p_type ELSE 'owner:' || p_brand END || ':' || p_name AS owned_id,
  lower(p_type) || '/' || lower(p_name) AS semantic, p_type AS template_base, 'a b|' || p_brand AS slots, p_type AS root, '.' || p_brand AS variant FROM s"""
)
def q86_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    same, even, path = (F.col("p_size") % 3 + 1), F.col("p_size") % 2 == 0, F.array("p_type")
    marked = F.concat(F.col("p_name"), F.lit(identity.DUPLICATE_MARK + "2"))
    templated = F.concat("p_type", F.lit(".<a b>.<"), "p_brand", F.lit(">.< a b >"))
    manager = F.concat("p_type", F.lit("Manager"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.reference_key(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("reference_key"),
        identity.query_table_id(marked, F.when(even, F.col("p_brand")).otherwise(F.lit(" ")), path, same).alias("table_id"),
        identity.enum_id(marked, "p_brand", F.when(even, "objects/catalog2/x.html").otherwise("objects/catalog1/x.html"), same).alias("enum_id"),
        identity.owned_id(F.lit("method"), F.when(even, F.concat(F.lit("platform_type:"), "p_type")), marked, "p_brand").alias("owned_id"),
        identity.semantic_key(F.array("p_type", "p_name"), "p_name").alias("semantic"),
        identity.template_base("p_name", templated).alias("template_base"),
        F.array_join(identity.template_slots(templated), "|").alias("slots"),
        identity.manager_root(manager).alias("root"),
        identity.template_variant(F.concat("p_type", F.lit("."), "p_brand"), "p_type").alias("variant"),
    )


@query(
    """SELECT p_partkey, sha256(p_name || p_brand) AS sha, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE NULL END AS bit, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS localized,
  p_size % 2 = 0 AS locale_ok, '<' || p_name || '> & "' || p_brand || '"' AS decoded, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS number, 'The ' || p_name AS described, 'a,' || p_name AS bracketed FROM part"""
)
def q87_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    json = F.concat(F.lit('{"a": {"b": '), F.when(even, F.col("p_size").cast("string")).otherwise("true"), F.lit("}}"))
    code = F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "other"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.sha2(F.concat("p_name", "p_brand"), 256).alias("sha"),
        availability.bit_of(code, ("click", "error", "purchase", "signup", "view")).alias("bit"),
        values.localized(F.when(even, F.col("p_name")).otherwise(""), "p_brand", "ru").alias("localized"),
        paths.valid_locale(F.when(even, "en_GB-1").otherwise("en GB")).alias("locale_ok"),
        values.decode_entities(F.concat(F.lit("&lt;"), "p_name", F.lit("&gt; &amp; &quot;"), "p_brand", F.lit("&quot;"))).alias("decoded"),
        values.json_number(json, "$.a.b").cast("double").alias("number"),
        values.strip_type_prose(F.concat(F.lit("Type: A, B. The "), "p_name")).alias("described"),
        F.array_join(values.bracketed(F.concat(F.lit("f(<a>, <"), "p_name", F.lit(">)"))), ",").alias("bracketed"),
    )


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Primitive' WHEN 1 THEN 'MetadataTemplate' WHEN 2 THEN 'Extension' ELSE 'Regular' END AS type_kind,
  CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'MetadataObject' WHEN 2 THEN 'FormExtension' ELSE 'RegularPlatformType' END AS object_kind, CASE WHEN p_size % 4 = 1 THEN p_type END AS metadata_kind FROM part"""
)
def q88_type_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_size") % 4 + 1).cast("int")
    name = F.element_at(F.array(F.col("p_name"), F.concat("p_type", F.lit(".<"), "p_brand", F.lit(">")), F.concat(F.lit("Extension of "), "p_name"), F.col("p_name")), at)
    branch = F.element_at(F.array(*map(F.lit, ("primitive_types", "metadata_objects", "managed_forms", "platform_objects"))), at)
    kind = extract.type_kind(name, branch)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("type_kind"), extract.object_kind(kind, branch).alias("object_kind"), extract.metadata_kind(name).alias("metadata_kind"))


# --- text index, exports ----------------------------------------------------------------------

_TOKENS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"WITH t AS (SELECT conv_id * 1000 + turn AS id, {_TOKENS} AS t FROM conversations) SELECT token, id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(length) AS INTEGER) AS length FROM (SELECT id, len(t) AS length, unnest(t) AS token FROM t) GROUP BY token, id")
def q89_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.postings(rows, "text")


@query(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {_TOKENS} AS t FROM conversations)
SELECT id, CAST(len(t) AS INTEGER) AS length, CAST(len(list_filter(t, lambda w: starts_with(w, 'the'))) AS INTEGER) AS tf0, CAST(len(list_filter(t, lambda w: starts_with(w, 'wh'))) AS INTEGER) AS tf1
FROM t WHERE len(list_filter(t, lambda w: starts_with(w, 'the') OR starts_with(w, 'wh'))) > 0"""
)
def q90_postings_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.counted_from(search.postings(rows, "text"), ["the", "wh"])


@query(
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '/abs' || o_orderkey WHEN 2 THEN 'C:' || o_orderkey WHEN 3 THEN 'a\\' || o_orderkey WHEN 4 THEN '../' || o_orderkey
  WHEN 5 THEN 'twice' WHEN 6 THEN 'f' || o_orderkey || '/x' ELSE 'f' || (o_orderkey - 1) END AS path FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'EMPTY_PATH' WHEN 1 THEN 'ABSOLUTE_PATH' WHEN 2 THEN 'DRIVE_PATH' WHEN 3 THEN 'BACKSLASH' WHEN 4 THEN 'PARENT_SEGMENT' WHEN 5 THEN 'DUPLICATE_PATH'
  WHEN 7 THEN CASE WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = p.o_orderkey - 1) THEN 'FILE_IS_FOLDER' END END AS problem FROM p"""
)
def q91_file_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, before = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") - 1).cast("string")
    made = [F.lit(""), F.concat(F.lit("/abs"), key), F.concat(F.lit("C:"), key), F.concat(F.lit("a\\"), key), F.concat(F.lit("../"), key), F.lit("twice"), F.concat(F.lit("f"), key, F.lit("/x")), F.concat(F.lit("f"), before)]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*made), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("html_path"))
    return export.plan_files(rows).select("o_orderkey", "problem")


@query("SELECT 'pages/' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def q92_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), "html")
    return export.artifacts(files, "file", "html")


# --- resolution ---------------------------------------------------------------------------------


@query(
    """SELECT kind || '/' || id AS id, kind, name FROM (SELECT 'goods' AS src, 'part:' || p_partkey AS id, 'part' AS kind, p_name AS name FROM part UNION ALL
  SELECT 'geography', 'nation:' || n_nationkey, 'nation', n_name FROM nation) t WHERE true"""
)
def q93_global_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resolver import CompositeResolver, IndexSource

    sources = []
    for source, kind in (("part", "part"), ("nation", "nation")):
        names, docs = named(spark, sf_dir, kind)
        sources.append(IndexSource(source, {"documents": docs, "document_names": names}))
    found = CompositeResolver(sources).global_context(("part", "nation"))
    return found.select("id", "kind", F.col("name_primary").alias("name"))


@query(
    f"""WITH RECURSIVE docs AS ({catalog_sql('region nation supplier')}), edges AS (SELECT owner_id AS s, id AS t FROM docs WHERE owner_id IS NOT NULL UNION ALL SELECT id, owner_id FROM docs WHERE owner_id IS NOT NULL),
hops AS (SELECT 'nation:2' AS node, 0 AS depth UNION SELECT t, depth + 1 FROM hops JOIN edges ON s = node WHERE depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM hops GROUP BY node"""
)
def q94_type_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier"))
    none = docs.select(F.lit("").alias("document_id"), F.lit("").alias("ref_kind"), F.lit("").alias("target_id"), F.lit("").alias("target_name"), F.lit("").alias("status")).where("false")
    edges = graph.derive(docs, none)
    return graph.type_graph(edges, none, "nation:2", limit=1_000_000, max_depth=2).select("node", "depth")


@query("SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS target_id, 'owns' AS edge_kind, min('k' || event_id) AS label, 10 AS weight FROM events GROUP BY ALL")
def q95_first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("u"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("label"))
    return graph.first_edges(rows.select(*graph.edge(F.col("event_type"), F.col("u"), "owns", F.col("label")))).select("source_id", "target_id", "edge_kind", "label", "weight")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def q96_number_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 3).alias("k"))
    return ordering.number_within(orders, ["k"], ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query(
    """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'ORPHAN_NODE' ELSE 'UNREACHED_NODE' END AS code FROM nation WHERE n_nationkey % 5 = 4 OR (n_nationkey - 1) % 5 = 4 AND n_nationkey > 0 OR n_nationkey IN (1, 2)"""
)
def q97_tree_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    # 1 and 2 own each other; k % 5 = 4 has a parent that does not exist and owns k + 1
    parent = F.when(n == 1, 2).when(n == 2, 1).when(n % 5 == 4, 1000).when((n > 0) & ((n - 1) % 5 == 4), n - 1)
    nodes = table(spark, sf_dir, "nation").select(n.alias("id"), parent.alias("parent_id"), F.lit(0).alias("ordinal"))
    return tree.tree_problems(nodes, tree.flatten(nodes))


@query("SELECT 'OWNER_CYCLE' AS code, n_nationkey AS id FROM nation WHERE n_nationkey < 6")
def q98_owner_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    parent = F.when(n < 6, (n + 1) % 6).when(n < 12, n - 6).when(n < 20, n - 1)
    return graph.owner_cycles(table(spark, sf_dir, "nation").select(n.alias("id"), parent.alias("parent_id")))


_BODY = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->|<![^>]*>', '', 'g'), '(?i)</?(?:b|a|i|em|strong|span|html|meta|link|code|u|small|sup|sub|img|font)(?:\\s[^>]*)?/?>', '', 'g'), '<[^>]*>', ' ', 'g'))"


@query(f"SELECT page_id, CAST(len(list_filter(regexp_split_to_array({_BODY}, '{WS}'), lambda w: w <> '')) AS INTEGER) AS words FROM pages")
def q99_body_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pages.parse(spread(table(spark, sf_dir, "pages").select("page_id", "html")))
    return parsed.select("page_id", F.size(F.filter(F.split("text", WS), lambda w: w != "")).alias("words"))
