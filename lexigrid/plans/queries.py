"""Driver queries for the engine's operators, with the SQL each one must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import availability, identity, paths, text, values
from ..operators import graph, identity as ids, lookup, ordering, pages, resolve, search, stats, tree
from ..session import spread, table
from . import catalog
from .provider import status_of
from .resolver import composite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def catalog_sql(kinds: str = "region nation supplier customer part") -> str:
    made = {
        "region": "SELECT 'region:' || r_regionkey AS id, 'region' AS kind, 10 AS kind_priority, r_name AS name_primary, CAST(NULL AS VARCHAR) AS name_alias, CAST(NULL AS VARCHAR) AS owner_id FROM region",
        "nation": "SELECT 'nation:' || n_nationkey, 'nation', 20, n_name, NULL, 'region:' || n_regionkey FROM nation",
        "supplier": "SELECT 'supplier:' || s_suppkey, 'supplier', 30, s_name, NULL, 'nation:' || s_nationkey FROM supplier",
        "customer": "SELECT 'customer:' || c_custkey, 'customer', 40, c_name, NULL, 'nation:' || c_nationkey FROM customer",
        "part": "SELECT 'part:' || p_partkey, 'part', 50, p_name, p_brand, NULL FROM part",
    }
    first = "SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS kind_priority, CAST(NULL AS VARCHAR) AS name_primary, CAST(NULL AS VARCHAR) AS name_alias, CAST(NULL AS VARCHAR) AS owner_id WHERE false"
    return " UNION ALL ".join([first, *(made[k] for k in kinds.split())])


KEY = "lower(regexp_replace({}, '\\s+', '', 'g'))"
WS = r"[ \t\n\x0B\f\r]+"
CANDIDATES = "SELECT '{q}' AS query"


# --- pages and text -------------------------------------------------------------------

_TAG = "nullif(trim(regexp_replace({decoded}, '" + WS + "', ' ', 'g')), '')"
_DECODE = "replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, coalesce({_TAG.format(decoded=_DECODE.format(t='title'))}, {_TAG.format(decoded=_DECODE.format(t='h1'))}, '') AS title FROM pages")
def q01_page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", pages.title("html").alias("title"))


@query(f"SELECT doc_id, substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 240) AS preview FROM documents")
def q02_text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.preview("text").alias("preview"))


_LINKS = """links AS (
  SELECT page_id, url, unnest(range(len(h))) AS ordinal, unnest(h) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))"""


@query(f"WITH {_LINKS} SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, href FROM links")
def q03_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"))


_NORMAL = f"""{_LINKS}, bare AS (
  SELECT page_id, ordinal, href, trim(href) AS link, regexp_extract(trim(href), '^([^?#]*)', 1) AS b,
    regexp_replace(CASE WHEN regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) END, '^/+', '') AS here FROM links),
targets AS (
  SELECT *, CASE WHEN link = '' THEN NULL WHEN starts_with(link, '#') THEN here WHEN contains(b, ':') THEN NULL WHEN b = '' THEN here
    WHEN starts_with(b, '/') THEN b ELSE regexp_replace(here, '[^/]*$', '') || b END AS target FROM bare),
folded AS (
  SELECT page_id, ordinal, href, CASE WHEN target IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(target, '/'), lambda s: s NOT IN ('', '.')), '/') END AS normalized_path
  FROM targets)"""


@query(f"WITH {_NORMAL} SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, normalized_path FROM folded")
def q04_link_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.links(table(spark, sf_dir, "pages"), keep=["url"])
    return found.select("page_id", "ordinal", paths.normalize_link("href", paths.url_path("url")).alias("normalized_path"))


@query(
    f"""WITH {_NORMAL}, stored AS (SELECT DISTINCT array_to_string(list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), lambda s: s NOT IN ('', '.')), '/') AS p FROM pages)
SELECT page_id, count(*) AS n_links, CAST(sum(CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_resolved,
  CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_diagnostics
FROM folded LEFT JOIN stored ON normalized_path = p GROUP BY page_id"""
)
def q05_link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "pages").withColumn("path", paths.url_path("url"))
    stored = source.select(paths.fold("path").alias("stored_path"))
    toc = stored.where("false").select(F.col("stored_path").alias("toc_path"), F.col("stored_path").alias("toc_title"))
    found = pages.resolve_links(pages.links(source, keep=["path"]), toc, stored)
    resolved = F.col("status") == "resolved"
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.sum(F.when(resolved, 1).otherwise(0)).alias("n_resolved"), F.sum(F.when(resolved, 0).otherwise(1)).alias("n_diagnostics"))


@query("SELECT p_partkey, p_name AS name_primary, p_brand AS name_alias FROM part")
def q06_name_alias_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "part").withColumn("label", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    split = values.split_alias("label")
    return joined.select("p_partkey", split["primary"].alias("name_primary"), split["alias"].alias("name_alias"))


@query(
    r"""WITH parts AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(string_split(text, '.')[1], '[,;]'), lambda p: trim(regexp_replace(p, '[\t\n\r]', ' ', 'g'))), lambda p: p <> '') AS names FROM conversations)
SELECT conv_id, turn, CAST(len(names) AS INTEGER) AS n_types, array_to_string(names, '|') AS type_names FROM parts"""
)
def q07_type_ref_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").withColumn("names", values.type_list("text"))
    return found.select("conv_id", "turn", F.size("names").alias("n_types"), F.array_join("names", "|").alias("type_names"))


EVENT_CODES = ("click", "error", "purchase", "signup", "view")
_MASKS = """masks AS (SELECT user_id, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'view' THEN 16 ELSE 0 END) AS INTEGER) AS mask FROM events GROUP BY user_id)"""


def user_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.coalesce(availability.bit_of("event_type", EVENT_CODES), F.lit(0)).alias("bit"))
    return events.groupBy("user_id").agg(F.bit_or("bit").alias("mask"))


@query(f"WITH {_MASKS} SELECT user_id, mask FROM masks")
def q08_availability_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_masks(spark, sf_dir)


@query(
    r"""SELECT 'part' AS kind, p_partkey AS key, nullif(rtrim(regexp_extract(p_brand, '[0-9][0-9.]*'), '.'), '') AS version FROM part
UNION ALL SELECT 'customer', c_custkey, nullif(rtrim(regexp_extract(c_name, '[0-9][0-9.]*'), '.'), '') FROM customer"""
)
def q09_version_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), values.version_of("p_brand").alias("version"))
    b = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), values.version_of("c_name").alias("version"))
    return a.unionByName(b)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ReadWrite' WHEN o_orderpriority = '3-MEDIUM' THEN 'Read'
  WHEN o_orderpriority = '5-LOW' THEN 'Write' ELSE 'Unknown' END AS usage FROM orders"""
)
def q10_usage_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    written = F.when(p.isin("1-URGENT", "2-HIGH"), " Read and Write. ").when(p == "3-MEDIUM", "READ").when(p == "5-LOW", "Write only.").otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", values.usage_of(written).alias("usage"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_replace(string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/')[-1], '\.html?$', '') AS page_key FROM p"""
)
def q11_page_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.page_key("url").alias("page_key"))


_TREE = f"""RECURSIVE docs AS ({catalog_sql('region nation supplier customer')}),
ordered AS (SELECT id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY kind_priority, name_primary, id) - 1 AS o FROM docs),
flat AS (SELECT id, 0 AS depth, CAST(o AS VARCHAR) AS index_path FROM ordered WHERE owner_id IS NULL
  UNION ALL SELECT c.id, f.depth + 1, f.index_path || '.' || c.o FROM ordered c JOIN flat f ON c.owner_id = f.id)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned facts as tree nodes; ordinals are given within each owner."""
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier", "customer"))
    placed = tree.number_siblings(docs, "owner_id", ["kind_priority", "name_primary", "id"])
    return placed.select("id", F.col("owner_id").alias("parent_id"), "kind", "ordinal")


@query(f"WITH {_TREE} SELECT id, CAST(depth AS INTEGER) AS depth, index_path FROM flat")
def q12_hierarchy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tree.flatten(hierarchy(spark, sf_dir))
    return flat.select("id", "depth", F.array_join(F.col("index_path").cast("array<string>"), ".").alias("index_path"))


# --- lookups ----------------------------------------------------------------------------


@query("SELECT 'part:' || p_partkey AS id, p_name AS name_primary, p_brand AS name_alias FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def q13_get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"))
    return lookup.by_id(catalog.documents(spark, sf_dir, ("part",)), wanted).select("id", "name_primary", "name_alias")


@query(f"WITH docs AS ({catalog_sql()}) SELECT id, kind_priority, name_primary FROM docs WHERE kind = 'supplier'")
def q14_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_kind(catalog.documents(spark, sf_dir), "supplier").select("id", "kind_priority", "name_primary")


@query(f"WITH {_MASKS} SELECT user_id, (mask = 0 OR (mask & 12) <> 0) AS any_match, (mask = 0 OR (mask & 12) = 12) AS all_match FROM masks")
def q15_availability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = availability.mask_of(["purchase", "signup"], EVENT_CODES)
    both = [availability.available("mask", request, m).alias(f"{m}_match") for m in ("any", "all")]
    return user_masks(spark, sf_dir).select("user_id", *both)


_SPELLED = "('  Small Ring '), ('RED widget'), ('nation_7'), ('asia'), ('Customer#000000001'), ('no such name')"
SPELLED = ["  Small Ring ", "RED widget", "nation_7", "asia", "Customer#000000001", "no such name"]
_KEYED = f"""docs AS ({catalog_sql()}), wanted AS (SELECT q AS query, {KEY.format('q')} AS key FROM (VALUES {_SPELLED}) t(q)),
names AS (SELECT {KEY.format('name_primary')} AS key, id FROM docs UNION SELECT {KEY.format('name_alias')}, id FROM docs WHERE name_alias IS NOT NULL)"""


def spelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in SPELLED], "query string")


def named(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, DataFrame]:
    """(document_names, documents with owner names) of the catalogue."""
    docs = catalog.documents(spark, sf_dir, kinds or ("region", "nation", "supplier", "customer", "part"))
    owners = catalog.documents(spark, sf_dir, ("region", "nation"))
    full = catalog.with_owner_names(docs, owners)
    return catalog.document_names(full), full


@query(f"WITH {_KEYED} SELECT DISTINCT query, docs.id, kind, name_primary FROM wanted JOIN names USING (key) JOIN docs ON docs.id = names.id")
def q16_exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, docs = named(spark, sf_dir)
    return lookup.by_name(names, docs, spelled(spark)).select("query", "id", "kind", "name_primary")


@query(
    f"""WITH docs AS ({catalog_sql()}) SELECT o.name_primary AS owner_name, m.name_primary AS member_name, m.id,
  {KEY.format("o.name_primary || '.' || m.name_primary")} AS key FROM docs m JOIN docs o ON m.owner_id = o.id"""
)
def q17_owner_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, docs = named(spark, sf_dir)
    keys = names.where("key_kind = 'owner_member_primary'").select("key", F.col("document_id").alias("id"))
    return keys.join(docs, "id").select(F.col("owner_primary").alias("owner_name"), F.col("name_primary").alias("member_name"), "id", "key")


@query(f"WITH docs AS ({catalog_sql()}) SELECT o.id AS owner_type_id, m.kind AS member_kind, m.name_primary, m.id AS document_id FROM docs m JOIN docs o ON m.owner_id = o.id WHERE m.kind = 'supplier'")
def q18_members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = catalog.members(catalog.documents(spark, sf_dir)).where("member_kind = 'supplier'")
    owners = catalog.documents(spark, sf_dir, ("nation",)).select(F.col("id").alias("owner_type_id"))
    return members.join(owners, "owner_type_id").select("owner_type_id", "member_kind", "name_primary", "document_id")


@query("SELECT lower(o_orderstatus) AS query, lower(o_orderpriority) AS context, 'order:' || o_orderkey AS id FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def q19_context_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus", "o_orderpriority")
    keys = F.array(*(F.struct(text.normalize_key(c).alias("key"), F.lit(k).alias("key_kind")) for c, k in (("o_orderstatus", "primary"), ("o_orderpriority", "module_context"))))
    names = orders.select(F.col("id").alias("document_id"), F.explode(keys).alias("k")).select("k.*", "document_id")
    asked = orders.select(text.normalize_key("o_orderstatus").alias("query"), text.normalize_key("o_orderpriority").alias("context")).distinct()
    asked = asked.where("context <> '4-notspecified'")
    return lookup.in_context(names, orders.select("id"), asked).select("query", "context", "id")


@query(
    """SELECT l_orderkey, l_linenumber, 'part:' || p_partkey AS target_id, p_name AS target_name, s_name AS supplier_name
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
)
def q20_ref_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("supplier_id"))
    part = catalog.documents(spark, sf_dir, ("part",)).select(F.col("id").alias("target_id"), F.col("name_primary").alias("target_name"))
    supplier = catalog.documents(spark, sf_dir, ("supplier",)).select(F.col("id").alias("supplier_id"), F.col("name_primary").alias("supplier_name"))
    return lines.join(part, "target_id").join(supplier, "supplier_id").select("l_orderkey", "l_linenumber", "target_id", "target_name", "supplier_name")


ANCHORS = [("click", "low", "interaction"), ("view", "any", "interaction"), ("purchase", "high", "revenue"), ("signup", "low", "growth")]
_CLASSED = """anchors(anchor_name, scope, class) AS (VALUES ('click', 'low', 'interaction'), ('view', 'any', 'interaction'), ('purchase', 'high', 'revenue'), ('signup', 'low', 'growth')),
typed AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
classed AS (SELECT event_id, user_id, event_type, coalesce(class, CASE WHEN event_type LIKE 's%' THEN 'session' WHEN event_type LIKE '%r%' THEN 'other_r' ELSE 'other' END) AS class
  FROM typed LEFT JOIN anchors ON event_type = anchor_name AND (scope = 'any' OR (scope = 'low' AND k < 50) OR (scope = 'high' AND k NOT IN (0, 1, 2))))"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.createDataFrame(ANCHORS, "anchor_name string, scope string, class string")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    fits = lambda e, a: (a["scope"] == "any") | ((a["scope"] == "low") & (e["k"] < 50)) | ((a["scope"] == "high") & ~e["k"].isin(0, 1, 2))
    found = resolve.anchored_classes(events, F.broadcast(anchors), "event_type", fits)
    other = F.when(F.col("event_type").like("s%"), "session").when(F.col("event_type").like("%r%"), "other_r").otherwise("other")
    return found.select("event_id", "user_id", "event_type", F.coalesce("class", other).alias("class"))


@query(f"WITH {_CLASSED} SELECT event_id, event_type, class FROM classed")
def q21_anchored_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).select("event_id", "event_type", "class")


# --- references and aggregates --------------------------------------------------------------

_REFS = f"""docs AS ({catalog_sql('supplier part')}),
refs AS (SELECT ref_kind, target_name, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT 'part' AS ref_kind, p_name AS target_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name
    UNION ALL SELECT 'brand', upper(p_brand), count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
    UNION ALL SELECT 'supplier', upper(s_name), count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name) GROUP BY ref_kind, target_name),
cands AS (SELECT {KEY.format('name_primary')} AS key, id FROM docs),
hits AS (SELECT ref_kind, target_name, any_value(refs.n) AS n, count(id) AS c, string_agg(id, ',' ORDER BY id) AS ids
  FROM refs LEFT JOIN cands ON {KEY.format('target_name')} = key GROUP BY ref_kind, target_name),
resolved AS (SELECT ref_kind, target_name, n, CASE WHEN c = 0 THEN 'unresolved' WHEN c = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
  CASE WHEN c = 1 THEN ids END AS target_id, CASE WHEN c > 1 THEN ids END AS candidates FROM hits)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = resolve.candidate_keys(catalog.documents(spark, sf_dir, ("supplier", "part")), ("name_primary",))
    return resolve.resolve(catalog.part_references(spark, sf_dir), keys)


@query(f"WITH {_REFS} SELECT ref_kind, target_name, status, target_id, candidates FROM resolved")
def q22_ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("ref_kind", "target_name", "status", "target_id", F.array_join("candidates", ",").alias("candidates"))


@query(f"WITH docs AS ({catalog_sql()}) SELECT kind, count(*) AS n FROM docs GROUP BY kind")
def q23_document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.documents(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_REFS} SELECT ref_kind AS role, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN status = 'ok' THEN n ELSE 0 END) AS BIGINT) AS resolved,
  CAST(sum(CASE WHEN status = 'unresolved' THEN n ELSE 0 END) AS BIGINT) AS unresolved, CAST(sum(CASE WHEN status = 'ambiguous' THEN n ELSE 0 END) AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS with_binding
FROM resolved GROUP BY ROLLUP (ref_kind)"""
)
def q24_gap_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.gap_roles(resolved(spark, sf_dir), "ref_kind", "n")


@query(
    f"""WITH docs AS ({catalog_sql('part')}), keyed AS (SELECT {KEY.format('name_primary')} AS key, count(*) AS c FROM docs GROUP BY 1),
lines AS (SELECT l_orderkey, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
gaps AS (SELECT name, count(*) AS n, list_sort(list_distinct(list(l_orderkey)))[1:3] AS e FROM lines JOIN keyed ON {KEY.format('name')} = key WHERE c <> 1 GROUP BY name)
SELECT 'part' AS role, name AS target_name, n, array_to_string(e, ',') AS examples FROM gaps ORDER BY n DESC, role, target_name LIMIT 10"""
)
def q25_gap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog.documents(spark, sf_dir, ("part",))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"))
    refs = lines.join(part.select("id", F.col("name_primary").alias("name")), "id").select(F.lit("part").alias("ref_kind"), "name", "l_orderkey")
    found = resolve.resolve(refs, resolve.candidate_keys(part, ("name_primary",)), "name")
    top = resolve.gap_groups(found, "ref_kind", "name", "l_orderkey", 10)
    return top.select("role", "target_name", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(f"WITH {_CLASSED} SELECT class, count(*) AS n, count(DISTINCT user_id) AS n_users FROM classed GROUP BY class")
def q26_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    """SELECT l_partkey, min(nullif(l_returnflag, 'A')) AS evidence, min(l_orderkey) AS example, count(*) AS n
FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 80"""
)
def q27_min_nullif_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    found = lines.agg(F.min(F.nullif("l_returnflag", F.lit("A"))).alias("evidence"), F.min("l_orderkey").alias("example"), F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "l_partkey").limit(80)


@query("SELECT p_name, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS p_type FROM part GROUP BY p_name")
def q28_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.unique_lookup(table(spark, sf_dir, "part").select("p_name", "p_type"), "p_name", "p_type")


_MEDIANS = """med AS (SELECT event_type, median(value) AS m, count(value) AS samples FROM events GROUP BY event_type),
mads AS (SELECT e.event_type, any_value(samples) AS samples, any_value(m) AS m, median(abs(value - m)) AS mad FROM events e JOIN med USING (event_type) GROUP BY e.event_type)"""


@query(
    f"""WITH {_MEDIANS} SELECT event_type, samples, round(m, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN m <> 0 THEN mad / m END, 6) AS noise,
  coalesce(CASE WHEN m <> 0 THEN mad / m END > 0.05, false) AS noisy FROM mads"""
)
def q29_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.median_mad(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", "samples", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("noise", 6).alias("noise"), "noisy")


@query(
    """WITH med AS (SELECT event_type, median(value) AS m FROM events GROUP BY event_type), base AS (SELECT m AS b FROM med WHERE event_type = 'click')
SELECT event_type, round(m, 6) AS median, round(CASE WHEN b <> 0 THEN m / b END, 6) AS ratio, round((CASE WHEN b <> 0 THEN m / b END - 1) * 100, 6) AS percent FROM med LEFT JOIN base ON true"""
)
def q30_relative_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = ordering.median_within(table(spark, sf_dir, "events"), ["event_type"], "value")
    found = stats.relative_to(medians, [], "event_type", "click", "median")
    return found.select("event_type", F.round("median", 6).alias("median"), F.round("ratio", 6).alias("ratio"), F.round("percent", 6).alias("percent"))


TERMS = "Apache licensed under token"


@query(
    r"""WITH toks AS (SELECT doc_id, source, lang, list_filter(string_split(lower(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS t FROM documents),
c AS (SELECT doc_id, source, lang, len(t) AS length, len(list_filter(t, lambda w: starts_with(w, 'apache'))) AS a, len(list_filter(t, lambda w: starts_with(w, 'licensed'))) AS b,
  len(list_filter(t, lambda w: starts_with(w, 'token'))) AS d, len(list_filter(t, lambda w: starts_with(w, 'under'))) AS e FROM toks),
s AS (SELECT count(*) AS n, avg(length) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS dd, sum(CASE WHEN e > 0 THEN 1 ELSE 0 END) AS de FROM c),
scored AS (SELECT doc_id, source, lang, -(
    greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * (a * 2.2) / (a + 1.2 * (0.25 + 0.75 * length / mean))
  + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * (b * 2.2) / (b + 1.2 * (0.25 + 0.75 * length / mean))
  + greatest(ln((n - dd + 0.5) / (dd + 0.5)), 1e-6) * (d * 2.2) / (d + 1.2 * (0.25 + 0.75 * length / mean))
  + greatest(ln((n - de + 0.5) / (de + 0.5)), 1e-6) * (e * 2.2) / (e + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM c, s WHERE a + b + d + e > 0),
w AS (SELECT doc_id, CAST(trunc(score * 1000000) AS BIGINT) AS score FROM scored ORDER BY 2, doc_id LIMIT 200)
SELECT doc_id AS id, score, 10 AS tier FROM w ORDER BY score, doc_id LIMIT 20"""
)
def q31_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    docs = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("name_primary"), F.col("lang").alias("name_alias"), F.lit(None).cast("string").alias("owner_primary"), F.lit(0).alias("kind_priority"))
    return search.keywords(docs, "text", TERMS, 20)


@query(f"WITH docs AS ({catalog_sql()}) SELECT owner_id FROM docs WHERE kind = 'supplier' UNION SELECT owner_id FROM docs WHERE kind = 'customer'")
def q32_union_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("supplier", "customer"))
    a, b = (docs.where(F.col("kind") == k).select("owner_id") for k in ("supplier", "customer"))
    return a.union(b).distinct()


@query("SELECT DISTINCT l_orderkey, l_partkey AS target_id FROM lineitem")
def q33_distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target_id")).distinct()


# --- scalar functions ------------------------------------------------------------------


@query(
    f"""SELECT 'part' AS kind, p_partkey AS id, {KEY.format("'  ' || upper(p_name) || ' '")} AS key FROM part UNION ALL SELECT 'nation', n_nationkey, {KEY.format('n_name')} FROM nation
UNION ALL SELECT 'segment', c_custkey, {KEY.format('c_mktsegment')} FROM customer"""
)
def q34_normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), text.normalize_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("key"))
    b = table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), text.normalize_key("n_name").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.lit("segment").alias("kind"), F.col("c_custkey").alias("id"), text.normalize_key("c_mktsegment").alias("key"))
    return a.unionByName(b).unionByName(c)


@query(
    r"""WITH n AS (SELECT p_partkey, upper(substr(string_split(p_name, ' ')[1], 1, 1)) || substr(string_split(p_name, ' ')[1], 2) || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) || '_' || p_brand AS name FROM part)
SELECT p_partkey, name, lower(regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]', ' ', 'g')) AS searchable FROM n"""
)
def q35_searchable_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named_ = table(spark, sf_dir, "part").select("p_partkey", F.concat(values.camel_part("p_name"), F.lit("_"), "p_brand").alias("name"))
    return named_.withColumn("searchable", text.searchable_name("name"))


MISSPELT = "Smal rimg"


@query(
    f"""WITH docs AS ({catalog_sql('part')}), names AS (SELECT DISTINCT id FROM (SELECT {KEY.format('name_primary')} AS key, id FROM docs UNION ALL SELECT {KEY.format('name_alias')}, id FROM docs) WHERE starts_with(key, 'smal')),
w AS (SELECT docs.* FROM names JOIN docs USING (id) ORDER BY kind_priority, id LIMIT 400),
scored AS (SELECT id, kind, name_primary, least(levenshtein('smalrimg', {KEY.format('name_primary')}), levenshtein('smalrimg', {KEY.format('name_alias')})) AS distance FROM w)
SELECT id, name_primary, CAST(distance AS INTEGER) AS distance FROM scored WHERE distance <= 2 ORDER BY distance, kind, id LIMIT 20"""
)
def q36_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, docs = named(spark, sf_dir, "part")
    return search.fuzzy(names, docs, MISSPELT, 20).select("id", "name_primary", "distance")


@query("SELECT p_partkey, trim(p_name) AS clean, lower(trim(p_name)) AS key FROM part")
def q37_clean_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "part").withColumn("title", F.concat(F.lit(" "), "p_name", F.lit(f" {identity.DUPLICATE_MARK}"), F.col("p_partkey").cast("string")))
    return marked.select("p_partkey", identity.clean_part("title").alias("clean"), identity.part_key("title").alias("key"))


@query(
    """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
SELECT p_partkey, 'platform_type:' || p_name || CASE WHEN n > 1 THEN ':' || p_brand ELSE '' END AS type_id FROM part JOIN c USING (p_name)"""
)
def q38_identity_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ids.with_key_count(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name"])
    return part.select("p_partkey", identity.type_id("p_name", F.array("p_type", "p_brand", F.lit(" ")), F.col("same_count")).alias("type_id"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_type || '/' || p_brand ELSE p_brand || '/x' END AS folded FROM part"""
)
def q39_path_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 3
    raw = F.when(kind == 0, F.concat(F.lit("/a/../../"), "p_brand")).when(kind == 1, F.concat(F.lit("./"), "p_type", F.lit("//./"), "p_brand")).otherwise(F.concat("p_type", F.lit("/../"), "p_brand", F.lit("/x")))
    return table(spark, sf_dir, "part").select("p_partkey", paths.fold(raw).alias("folded"))


@query(
    """WITH l AS (SELECT p_partkey, p_type, p_brand FROM part)
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_brand || '.md' ELSE '../ECONOMY/' || p_brand || '.md' END AS relative FROM l"""
)
def q40_relative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("book/"), "p_type", F.lit("/index.md"))
    target = F.concat(F.lit("book/ECONOMY/"), "p_brand", F.lit(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", paths.relative_link(source, target).alias("relative"))


@query(
    r"""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN b = '' THEN 'page' ELSE b END AS base FROM (SELECT p_brand, p_partkey, regexp_replace(lower(regexp_replace(p_name || '!', '[^\p{L}\p{N}]+', '-', 'g')), '^-|-$', '', 'g') AS b FROM part)),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS i FROM s)
SELECT p_partkey, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS segment FROM n"""
)
def q41_title_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select("p_brand", "p_partkey", paths.slug(F.concat("p_name", F.lit("!"))).alias("base"))
    return ids.unique_segments(titles, "p_brand", "base", "p_partkey").select("p_partkey", "segment")


@query(f"SELECT doc_id, lower(trim(regexp_replace(string_split(text, chr(10))[1], '{WS}', ' ', 'g'))) AS title_key FROM documents")
def q42_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.title_key(text.first_line("text")).alias("title_key"))


# --- graph ------------------------------------------------------------------------------

_EDGES = f"""docs AS ({catalog_sql('region nation supplier customer')}),
edges AS (SELECT owner_id AS source_id, id AS target_id, 'owns' AS edge_kind, 10 AS weight FROM docs WHERE owner_id IS NOT NULL
  UNION ALL SELECT id, owner_id, 'member_of', 20 FROM docs WHERE owner_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'has_type', 12 FROM lineitem)"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier", "customer"))
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("document_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id")).distinct()
    refs = pairs.select("document_id", F.lit("property_type").alias("ref_kind"), "target_id", F.lit(None).cast("string").alias("target_name"), F.lit("ok").alias("status"))
    return graph.derive(docs, refs)


@query(f"WITH {_EDGES} SELECT source_id, target_id, edge_kind, weight FROM edges")
def q43_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select("source_id", "target_id", "edge_kind", "weight")


@query(
    f"""WITH RECURSIVE {_EDGES}, hops AS (SELECT 'region:1' AS node, 0 AS depth UNION SELECT target_id, depth + 1 FROM hops JOIN edges ON source_id = node AND edge_kind IN ('owns', 'member_of') WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM hops GROUP BY node"""
)
def q44_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("region:1",)], "node string")
    return graph.bfs(edges_of(spark, sf_dir), roots, 3, ["owns", "member_of"]).select("node", "depth")


@query(
    """SELECT DISTINCT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id FROM lineitem
UNION ALL SELECT 'language_customer:' || c_custkey, 'nation:' || c_nationkey FROM customer"""
)
def q45_typed_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("document_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id")).distinct()
    refs = lines.select("document_id", F.lit("property_type").alias("ref_kind"), F.lit(0).alias("ordinal"), "target_id", F.lit(None).cast("string").alias("target_name"), F.lit("ok").alias("status"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("language_customer:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("nation"))
    edges = people.select(*graph.edge(F.col("id"), F.col("nation"), "has_type")).unionByName(lines.select(*graph.edge(F.col("document_id"), F.lit("region:0"), "has_type")))
    docs = people.select("id", F.lit("language_type").alias("kind")).unionByName(lines.select(F.col("document_id").alias("id"), F.lit("order").alias("kind")).distinct())
    return graph.typed_edges(edges, refs, docs, "has_type").select("source_id", "target_id")


@query(
    """SELECT 'customer:' || c_custkey AS node, 'nation:' || n_nationkey AS ancestor, 1 AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def q46_owner_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir, ("region", "nation", "supplier", "customer"))
    people = docs.where("kind = 'customer'").select(F.col("id").alias("node"))
    return graph.ancestors(docs.select("id", F.col("owner_id").alias("parent_id")), people).select("node", "ancestor", "distance")


# --- identity, templates, provider ----------------------------------------------------------


@query(
    """SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS duplicate_count FROM events GROUP BY user_id"""
)
def q47_dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return ids.keep_last(rows, "id", "seq")


@query(
    """WITH o AS (SELECT p_partkey, [p_brand, p_type, p_name] AS own, CASE WHEN p_size % 2 = 0 THEN [p_type, p_brand] ELSE [p_name, 'missing'] END AS wanted, p_size % 5 <> 0 AS same FROM part)
SELECT p_partkey, CASE WHEN same AND len(list_distinct(own)) = len(own) AND len(list_filter(wanted, lambda w: NOT list_contains(own, w))) = 0
  THEN array_to_string(list_transform(wanted, lambda w, i: CAST(list_position(own, w) - 1 AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), ',') END AS bindings FROM o"""
)
def q48_template_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("own", F.array("p_brand", "p_type", "p_name"))
    part = part.withColumn("wanted", F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand")).otherwise(F.array("p_name", F.lit("missing"))))
    found = part.withColumn("b", identity.bindings("own", "wanted", F.col("p_size") % 5 != 0))
    return found.select("p_partkey", F.expr("CASE WHEN b IS NOT NULL THEN array_join(transform(b, x -> concat(x.owner_idx, ':', x.target_idx)), ',') END").alias("bindings"))


@query(
    f"""WITH {_KEYED}, hits AS (SELECT query, count(DISTINCT names.id) AS n, min(names.id) AS one FROM wanted LEFT JOIN names USING (key) GROUP BY query)
SELECT query, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, n AS n_candidates, CASE WHEN n = 1 THEN one END AS result_id FROM hits"""
)
def q49_status_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, docs = named(spark, sf_dir)
    asked = spelled(spark)
    hits = lookup.by_name(names, docs, asked).select("query", "id")
    found = asked.join(hits.groupBy("query").agg(F.count("*").alias("n"), F.min("id").alias("one")), "query", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("query", status_of(n, "get").alias("status"), n.alias("n_candidates"), F.when(n == 1, F.col("one")).alias("result_id"))


@query(
    f"""WITH {_KEYED}, sourced AS (SELECT CASE WHEN kind = 'part' THEN 'goods' ELSE 'geography' END AS source, query, docs.id FROM wanted JOIN names USING (key) JOIN docs ON docs.id = names.id GROUP BY ALL),
per AS (SELECT query, source, count(*) AS n, min(id) AS one FROM sourced GROUP BY query, source),
tot AS (SELECT query, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS amb, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM per GROUP BY query)
SELECT w.query, CASE WHEN amb = 1 THEN 'ambiguous' WHEN ok = 1 THEN 'ok' WHEN ok > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, coalesce(ok, 0) AS n_facts FROM wanted w LEFT JOIN tot USING (query)"""
)
def q50_composite_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spelled(spark)
    answers = None
    for source, kinds in (("goods", ("part",)), ("geography", ("region", "nation", "supplier", "customer"))):
        names, docs = named(spark, sf_dir, *kinds)
        hits = lookup.by_name(names, docs, asked).select("query", "id").withColumn("source", F.lit(source))
        answers = hits if answers is None else answers.unionByName(hits)
    return composite(asked, answers, ["goods", "geography"]).select("query", "status", "n_facts")


from . import more_queries  # noqa: E402, F401 - registers q51 and on
