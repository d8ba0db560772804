"""Pages to records to an index that answers."""

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import page_model
from lexigrid.plans import build, extract, facade
from lexigrid.schemas import TABLES
from lexigrid.sources import index

TOC = [  # id, parent, ordinal, title, page
    (1, None, 0, "Objects", "objects/root.html"),
    (2, 1, 0, "Collections", "objects/catalog1.html"),
    (3, 2, 0, "Array (Массив)", "/objects/catalog1/object1.html"),
    (4, 3, 0, "Methods", ""),
    (5, 4, 0, "Add (Добавить)", "objects/catalog1/object1/methods/add.html"),
    (6, 4, 1, "Get (Получить)", "objects/catalog1/object1/methods/get.html"),
    (7, 3, 1, "By count", "objects/catalog1/object1/ctors/count.html"),
    (8, 3, 2, "Name", "objects/catalog1/object1/properties/name.html"),
    (9, 1, 1, "System enums", "objects/catalog2.html"),
    (10, 9, 0, "Side (Сторона)", "objects/catalog2/object9.html"),
    (11, 10, 0, "Left", "objects/catalog2/object9/properties/left.html"),
    (12, 1, 2, "Application objects", "objects/catalog5.html"),
    (13, 12, 0, "CatalogObject.<Catalog name>", "objects/catalog5/object2.html"),
    (14, 13, 0, "Ref", "objects/catalog5/object2/properties/ref.html"),
    (15, 12, 1, "CatalogRef.<Catalog name>", "objects/catalog5/object3.html"),
    (16, 12, 2, "CatalogManager.<Catalog name>", "objects/catalog5/object4.html"),
    (17, 12, 3, "CatalogManager", "objects/catalog5/object5.html"),
    (18, 1, 3, "Array again", "objects/catalog1/object1.html"),
    (19, 1, 4, "Query tables", "tables/root.html"),
    (20, 19, 0, "Turnovers", "tables/table1.html"),
    (21, 20, 0, "Period", "tables/table1/fields/period.html"),
    (22, 1, 5, "Odd page", "other/odd.html"),
    (23, 1, 6, "Array (Массив)", "objects/catalog7/object8.html"),
    (24, 23, 0, "Add (Добавить)", "objects/catalog7/object8/methods/add.html"),
    (25, 1, 7, "String (Строка)", "objects/catalog1/object7.html"),
]
PAGES = {
    "objects/catalog1/object1.html": '<p class="V8SH_chapter">Description:</p>A list.<p class="V8SH_chapter">Availability:</p>Server, thin client.',
    "objects/catalog1/object1/methods/add.html": """<p class="V8SH_heading">Add</p><p class="V8SH_chapter">Syntax:</p>Add(&lt;Value&gt;)<p class="V8SH_chapter">Parameters:</p>
      <div class="V8SH_rubric"><p>&lt;Value&gt; (optional)</p></div>Type: String. The value. Note: kept.<p class="V8SH_chapter">Note:</p>Grows.<hr>Methodical information""",
    "objects/catalog1/object1/methods/get.html": """<p class="V8SH_chapter">Syntax variant: By place</p><p class="V8SH_chapter">Syntax:</p>Get(&lt;Place&gt;)<br>Get(&lt;Place&gt;, &lt;Other&gt;)
      <p class="V8SH_chapter">Parameters:</p>&lt;Place&gt; Type: Number. Where. &lt;Other&gt; (optional) Type: String. What.<p class="V8SH_chapter">Return value:</p>Type: Array. It.
      <p class="V8SH_chapter">Syntax variant: By name</p><p class="V8SH_chapter">Syntax:</p>Get(&lt;Name&gt;)<p class="V8SH_chapter">Return value:</p>Type: String.""",
    "objects/catalog1/object1/ctors/count.html": "<p>Syntax:</p><p>New Array(&lt;A&gt;)</p><p>New Array(&lt;A&gt;, &lt;B&gt;)</p><p>Parameters:</p>&lt;A&gt; (optional) Type: Number. First. &lt;B&gt; Type: Number. Second.",
    "objects/catalog1/object1/properties/name.html": '<p class="V8SH_chapter">Use:</p>Read only.<p class="V8SH_chapter">Description:</p>Type: String. The name. Default value: none.<p class="V8SH_versionInfo">Since version 8.3.</p>',
    "objects/catalog2/object9/properties/left.html": "<p>x</p>",
    "objects/catalog5/object2/properties/ref.html": '<p class="V8SH_chapter">Description:</p>Type: CatalogRef.&lt;Catalog name&gt;. The reference.',
    "tables/table1.html": '<p class="V8SH_chapter">Syntax:</p>Register.&lt;Name&gt;.Turnovers',
    "tables/table1/fields/period.html": "Type: String. Default value: now.",
}


@pytest.fixture(scope="module")
def made(spark):
    toc = spark.createDataFrame([("books/a_root.hbk", *r) for r in TOC], "book string, id long, parent_id long, ordinal long, title string, html_path string")
    pages = spark.createDataFrame([("books/a_root.hbk", "/" + p, h) for p, h in PAGES.items()], "book string, html_path string, html string")
    return extract.records(toc, pages)


def test_records(made):
    found = {(r.owner_primary, r.name_primary): r for r in made[0].collect() if not r.source_path.startswith("objects/catalog7")}
    add, get, count = found["Array", "Add"], found["Array", "Get"], found["Array", "By count"]
    assert add.kind == "method" and add.note == "Grows" and add.signatures[0].parameters[0].required is False
    assert add.signatures[0].parameters[0].description == "The value"
    assert [s.title for s in get.signatures] == ["Get(<Place>)", "Get(<Place>, <Other>)", "Get(<Name>)"]
    assert [s.return_types for s in get.signatures] == [["Array"], ["Array"], ["String"]] and get.return_types is None
    assert [len(s.parameters) for s in get.signatures] == [1, 2, 0]
    assert [s.title for s in count.signatures] == ["New Array(<A>)", "New Array(<A>, <B>)"] and [len(s.parameters) for s in count.signatures] == [1, 2]
    name = found["Array", "Name"]
    assert (name.kind, name.type_refs, name.description, name.default_value, name.usage, name.since) == ("property", ["String"], "The name", "none", "Read", "8.3")
    assert found["Side", "Left"].kind == "enum_value" and found["Turnovers", "Period"].default_value == "now"
    table = found[None, "Turnovers"]
    assert table.kind == "query_table" and table.identifier == "Register.<Name>.Turnovers" and table.query_table_role == "additional"
    template = found[None, "CatalogObject.<Catalog name>"]
    assert (template.type_kind, template.object_kind, template.metadata_kind) == ("MetadataTemplate", "MetadataObject", "CatalogObject")
    assert found[None, "Array"].object_kind == "RegularPlatformType" and found[None, "Array"].source_locale == "en"
    assert [r.name_primary for r in made[0].where("source_path = 'objects/catalog1/object1.html'").collect()] == ["Array"]  # the first visit
    assert {(r.code, r.id.split("#")[1]) for r in made[1].collect()} >= {("UNKNOWN_PAGE", "22")}


@pytest.fixture(scope="module")
def opened(spark, made, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('pages-index')}"
    tables = build.build(made[0])
    index.publish(spark, {n: t for n, t in tables.items() if n in TABLES}, folder)
    return facade.FactIndex.open(spark, folder)


def test_index_of_pages(opened, spark):
    ids = {r.id for r in opened.t["documents"].collect()}
    assert {"platform_type:Array:Collections", "method:platform_type:Array:Collections:Add", "enum_value:enum:system:Side:Left"} <= ids
    # both types have the name, the page's path tells whose member it is
    assert sum(i.startswith("method:platform_type:Array") and i.endswith(":Add") for i in ids) == 2
    assert opened.get(owner="Side", member="left")[0] in ("ok", "not_found") and opened.get(query_table="Register.<Name>.Turnovers")[0] == "ok"
    bound = opened.t["type_refs"].where("bindings IS NOT NULL").collect()
    assert [(r.template_family, r.template_variant, [tuple(b) for b in r.bindings]) for r in bound] == [("Catalog", "Ref", [(0, 0)])]
    roles = {r.role: r for r in opened.gap_roles().collect()}
    assert roles[None].with_binding == 1 and roles["property_type"].with_binding == 1
    meta = {r.id: r for r in opened.t["document_metadata"].collect()}
    note = next(m for i, m in meta.items() if i.endswith(":Collections:Add"))
    assert note.note == "Grows" and note.source_path.endswith("methods/add.html")
    hit = opened.search("by count").first()
    assert hit.id.startswith("constructor:platform_type:Array") and hit.tier == 0


def test_two_lines_are_two_signatures():
    read = page_model.read("<p>Syntax:</p><p>New Array(&lt;A&gt;)</p><p>New Array(&lt;A&gt;, &lt;B&gt;)</p>")
    assert [s["text"] for s in read["signatures"]] == ["New Array(<A>)", "New Array(<A>, <B>)"]
    assert page_model.read(None)["signatures"] == [] and page_model.read("")["text"] == ""
    more = page_model.read('<p class="V8SH_chapter">See also:</p><a href="x/object1.html">Array</a>, method <a href="x/object1/methods/a.html">Add</a><a href="y.html">Map</a>')
    assert more["see_also"] == ["Array.Add", "Map"]


def test_record_export(spark, made, tmp_path):
    from lexigrid.operators import export

    rows, _, _ = build.identified(made[0])
    counts = {r.file: r.n for r in export.export_records(rows, made[1], str(tmp_path / "out"), "root", "root").collect()}
    assert len(counts) == 12 and counts["platform-types"] == 7 and counts["type-methods"] == 3 and counts["constructors"] == 1 and counts["diagnostics"] >= 1
    enum = spark.read.json(str(tmp_path / "out/enums")).first()
    assert enum.record_kind == "enum" and [v.name_primary for v in enum.record["values"]] == ["Left"]
    table = spark.read.json(str(tmp_path / "out/query-tables")).where("record.name_primary = 'Turnovers'").first()
    assert [v.name_primary for v in table.record.fields] == ["Period"]


def test_shelf(spark, tmp_path):
    from .test_sources import book, write_container

    (tmp_path / "lang_ru.hbk").write_bytes(write_container(book(), 64))
    (tmp_path / "other_root.hbk").write_bytes(write_container(book()))
    shelf = facade.Shelf(spark, str(tmp_path))
    assert {(r.name, r.locale, r.error) for r in shelf.inspect().collect()} == {("lang", "ru", None), ("lang", "en", None)}
    assert shelf.toc(as_json=True).count() == 6
    path = shelf.found.first().path
    assert shelf.page(path, "/a/b.html") == "<p>b</p>" and shelf.page(path, "none.html") is None
    files = shelf.export("raw", "raw", str(tmp_path / "raw")).collect()
    assert len(files) == 4 and (tmp_path / "raw/lang_ru/a/b.html").read_text() == "<p>b</p>"
    assert all(len(f.sha256) == 64 for f in files)
    shelf.export("markdown", "toc", str(tmp_path / "md"))
    assert len(list((tmp_path / "md").rglob("index.md"))) == 8
    with pytest.raises(ValueError):
        shelf.export("raw", "toc", str(tmp_path / "x"))
