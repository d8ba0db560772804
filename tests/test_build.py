"""Records to index to answers, exports and the stream extension."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import export, tree
from lexigrid.plans import build, facade
from lexigrid.schemas import TABLES, kinds
from lexigrid.sources import index
from lexigrid.streaming import events as stream


def record(seq, kind, name, alias=None, owner=None, **more):
    base = dict.fromkeys(x.strip().split(" ")[0] for x in "signatures return_types type_refs extends description availability since metadata_kind identifier syntax_primary syntax_alias module source_path owner_path owner_alias".split())
    return {"seq": seq, "kind": kind, "name_primary": name, "name_alias": alias, "owner_primary": owner} | base | more


def signature(title, parameters=(), returns=()):
    return {"title": title, "description": None, "parameters": [{"name": n, "required": True, "description": None, "type_refs": list(t)} for n, t in parameters], "return_types": list(returns)}


RECORDS = [
    record(1, "platform_type", "Array", "Массив", availability=["server", "thin_client"], since="8.0", description="a list of values"),
    record(2, "platform_type", "Map", owner_path=["Collections"]),
    record(3, "platform_type", "Map", owner_path=["Geography"]),
    record(4, "platform_type", "String", "Строка"),
    record(5, "method", "Add", "Добавить", "Array", signatures=[signature("Add(<Value>)", [("Value", ["String", "Nothing"])], ["Array"])], availability=["server"], description="appends"),
    record(6, "method", "Find", "Найти", "Array", signatures=[signature("Find(<Value>)", [("Value", ["String"])], ["Map"])]),
    record(7, "constructor", "Default", None, "Array", signatures=[signature("New Array()")]),
    record(8, "property", "Name", None, "Array", type_refs=["string"]),
    record(9, "method", "Add", "Добавить", "Array", signatures=[signature("Add(<Value>)", [("Value", ["String"])])], description="the later one"),
    record(10, "global_method", "Message", "Сообщить", "Array", module="Session module"),
    record(11, "method", "Lost", None, "Nobody"),
    record(12, "platform_type", "CatalogRef.<Name>", "CatalogRef.<Name>", metadata_kind="Catalog"),
    record(13, "platform_type", "CatalogManager"),
    record(14, "query_table", "Register.Turnovers", identifier="Turnovers", syntax_primary="Register.Turnovers"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return build.build(spark.createDataFrame(RECORDS, build.RECORD))


@pytest.fixture(scope="module")
def opened(spark, tables, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    index.publish(spark, {n: t for n, t in tables.items() if n in TABLES}, folder)
    return facade.FactIndex.open(spark, folder)


def test_identities(tables):
    ids = {r.id for r in tables["documents"].collect()}
    assert {"platform_type:Array", "platform_type:Map:Collections", "platform_type:Map:Geography", "method:platform_type:Array:Add", "query_table:Turnovers"} <= ids
    assert len(ids) == 12
    found = {(r.code, r.id, r["count"]) for r in tables["diagnostics"].collect()}
    assert found == {("DUPLICATE_DOCUMENT_ID", "method:platform_type:Array:Add", 2), ("MISSING_PARENT_IDENTITY", "method:Lost", 1)}
    kept = tables["documents"].where("id = 'method:platform_type:Array:Add'").first()
    assert kept.description == "the later one"


def test_references(tables):
    found = {(r.document_id.split(":")[-1], r.ref_kind, r.target_type_name): (r.status, r.target_type_id) for r in tables["type_refs"].collect()}
    assert found["Name", "property_type", "string"] == ("ok", "platform_type:String")
    assert found["Find", "return_type", "Map"] == ("ambiguous", None)
    assert found["Default", "constructor_result", "Array"] == ("ok", "platform_type:Array")
    assert ("Add", "parameter_type", "Nothing") not in found
    assert {(r.family, r.variant) for r in tables["type_templates"].collect()} == {("Catalog", "Ref")}
    assert tables["signatures"].count() == 3 and tables["parameters"].count() == 2


def test_facade(opened):
    assert opened.get(id="platform_type:Array")[0] == "ok"
    assert opened.get(name="a r r a y")[0] == "ok" and opened.get(type="map")[0] == "ambiguous"
    assert opened.get(owner="Массив", member="добавить")[0] == "ok"
    assert opened.get(owner="Map", member="x")[0] == "ambiguous" and opened.get(owner="None", member="x")[0] == "not_found"
    assert sorted(r.id for r in opened.get(members_of="Array")[1].collect()) == [f"{k}:platform_type:Array:{n}" for k, n in (("constructor", "Default"), ("method", "Add"), ("method", "Find"), ("property", "Name"))]
    assert opened.get(constructors_of="Array")[1].count() == 1 and opened.get(kind="query_table")[1].count() == 1
    assert opened.get(query_table="turnovers")[0] == "ok" and opened.get(template="Catalog.Ref")[0] == "ok"
    assert opened.get(name="message", context="session MODULE")[0] == "ok" and opened.get(name="message", context="other")[0] == "not_found"
    assert opened.get(id="x", kind="y")[0] == "unsupported"
    assert opened.owner("method:platform_type:Array:Add") == "platform_type:Array" and opened.since("platform_type:Array") == "8.0"
    assert [r.id for r in opened.search("find").collect()][0] == "method:platform_type:Array:Find"
    assert [r.id for r in opened.search("Arrya", "fuzzy").collect()] == []
    assert [r.id for r in opened.search("Arrayy", "fuzzy").collect()][0] == "platform_type:Array"
    assert {r.node for r in opened.related("Array").collect()} >= {"method:platform_type:Array:Find", "property:platform_type:Array:Name"}
    assert [r.target_id for r in opened.related("property:platform_type:Array:Name", "has_type").collect()] == ["platform_type:String"]
    assert opened.type_graph("Array").where("node = 'platform_type:String'").first().depth == 2
    with pytest.raises(facade.AmbiguousLookup):
        opened.related("Map")
    roles = {r.role: r.total for r in opened.gap_roles().collect()}
    assert roles[None] == sum(v for k, v in roles.items() if k)
    assert [(r.target_name, r.examples) for r in opened.gap_groups().collect()] == [("Map", ["method:platform_type:Array:Find"])]
    available = {r.id for r in opened.available(["thin_client"]).collect()}
    assert "platform_type:Array" in available and "platform_type:String" in available
    nested = opened.hydrated(opened.get(id="method:platform_type:Array:Find")[1]).first()
    assert nested.signatures[0].parameters[0].name == "Value" and len(nested.type_refs) == 2
    assert opened.counts().count() == 6
    assert kinds(opened.t["documents"].sparkSession).where("is_type").count() == 2


def test_file_plan(spark):
    paths = ["a.html", "b/c.html", "b", "/x", "C:x", "a\\b", "../x", "", None, "d", "d"]
    found = {r.html_path: r.problem for r in export.plan_files(spark.createDataFrame([(p,) for p in paths], "html_path string")).collect()}
    assert found == {"a.html": None, "b/c.html": None, "b": "FILE_IS_FOLDER", "/x": "ABSOLUTE_PATH", "C:x": "DRIVE_PATH", "a\\b": "BACKSLASH", "../x": "PARENT_SEGMENT", "": "EMPTY_PATH", None: "EMPTY_PATH", "d": "DUPLICATE_PATH"}
    with pytest.raises(ValueError):
        export.check_format("raw", "toc")


def test_markdown_book(spark, tmp_path):
    nodes = spark.createDataFrame([(1, None, 0, "Guide", None), (2, 1, 0, "Part A", "a.html"), (3, 1, 1, "Part A", "b.html")], "id long, parent_id long, ordinal int, title string, html_path string")
    pages = spark.createDataFrame([("a.html", "<h1>A</h1><p>text</p>"), ("b.html", "<p>b</p>")], "html_path string, html string")
    export.export_markdown(nodes, pages, str(tmp_path / "book"))
    assert (tmp_path / "book/guide/index.md").read_text() == "# Guide\n"
    assert (tmp_path / "book/guide/part-a/index.md").read_text() == "# A\n\ntext\n"
    assert (tmp_path / "book/guide/part-a-2/index.md").read_text() == "# Part A\n\nb\n"


def test_site(spark, tmp_path):
    nodes = spark.createDataFrame([("en", 1, 1, None, 0, "Guide", None), ("en", 1, 2, 1, 0, "A", "a")], "locale string, book_seq int, id int, parent_id int, ordinal int, title string, page_key string")
    site = export.site_tables(tree.merge_books(nodes), spark.createDataFrame([("en", "a", "# A")], "locale string, page_key string, markdown string"))
    export.write_site(site, str(tmp_path / "site"))
    again = spark.read.json(str(tmp_path / "site/nodes"))
    parents = {r.title: (r.node_id, r.parent_id, r.children) for r in again.collect()}
    assert parents["A"][1] == parents["Guide"][0] and parents["Guide"][2] == 1
    assert tuple(spark.read.json(str(tmp_path / "site/manifest")).select("nodes", "pages", "books").first()) == (2, 1, 1)


def test_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(1, at(1), 7, "view", 1.0, "{}"), (2, at(2), 7, "click", 2.0, "{}")], schema).write.parquet(str(tmp_path / "in"), mode="append")
    stream.keep_latest(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([(3, at(3), 7, "view", 1.0, "{}"), (4, at(1), 8, "view", 1.0, "{}")], schema).write.parquet(str(tmp_path / "in"), mode="append")
    stream.keep_latest(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()} == {(7, 3), (8, 4)}
    counted = stream.windowed(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert counted.agg(F.sum("n")).first()[0] == 4
    assert stream.sessions(spark.read.schema(schema).parquet(str(tmp_path / "in"))).count() == 4
