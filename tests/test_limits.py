"""What must hold at any depth and size, and small reports."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import export, graph, ordering, pages, search, stats, tree
from lexigrid.plans import provider, resolver
from lexigrid.sources import index, records


def test_deep_chain(spark):
    n = 66
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(n)] + [(900, 901, 0), (901, 900, 0), (950, 999, 0)], "id int, parent_id int, ordinal int")
    flat = tree.flatten(nodes)
    assert flat.count() == n and flat.agg(F.max("depth")).first()[0] == n - 1
    assert {(r.code, r.id) for r in tree.tree_problems(nodes, flat).collect()} == {("UNREACHED_NODE", 900), ("UNREACHED_NODE", 901), ("ORPHAN_NODE", 950)}


def test_deep_ancestors_and_cycles(spark):
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(36)] + [(100, 101), (101, 102), (102, 100), (103, 100)], "id int, parent_id int")
    found = graph.ancestors(parents, spark.createDataFrame([(35,), (103,)], "node int"))
    by = {}
    for r in found.collect():
        by.setdefault(r.node, {})[r.ancestor] = r.distance
    assert by[35] == {i: 35 - i for i in range(35)} and by[103] == {100: 1, 101: 2, 102: 3}
    assert sorted(r.id for r in graph.owner_cycles(parents).collect()) == [100, 101, 102]


def test_deep_merge(spark):
    n = 35
    rows = [("en", b, i, i - 1 if i else None, 0, f"T{i}", None) for b in (1, 2) for i in range(n)]
    merged = tree.merge_books(spark.createDataFrame(rows, "locale string, book_seq int, id int, parent_id int, ordinal int, title string, page_key string"))
    assert merged.count() == n and merged.where("books = 2").count() == n


def test_order_over_ranges(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([None, "a", "a", "a", "b"]), rnd.randint(0, 50), rnd.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k string, o int, v int").repartition(5)
    placed = {r.i: r.n for r in ordering.number_within(df, ["k"], ["o", "i"], "n").collect()}
    carried = {r.i: r.last for r in ordering.last_within(df, ["k"], ["o", "i"], "v", "last").collect()}
    for key in (None, "a", "b"):
        rows, last = sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0])), None
        for at, (i, _, _, v) in enumerate(rows):
            last = v if v is not None else last
            assert placed[i] == at and carried[i] == last
    medians = {r.k: (r.median, r.samples) for r in ordering.median_within(df, ["k"], "o").collect()}
    for key in (None, "a", "b"):
        held = sorted(r[2] for r in data if r[1] == key)
        assert medians[key] == ((held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2, len(held))
    assert stats.median_mad(df.where("false"), ["k"], "o").count() == 0


def test_search_from_postings_equals_search_of_texts(spark):
    docs = spark.createDataFrame(
        [("a", "FindRows caféBar", None, "Table", "Таблица", "finds rows of a table", 1), ("b", "Find", "Найти", "Array", None, "find it", 2), ("c", "Rows", None, None, None, "no hit here, café only", 3), ("d", "Sort", None, "Find", None, "sorts", 4)],
        "id string, name_primary string, name_alias string, owner_primary string, owner_alias string, text string, kind_priority int",
    )
    text = F.concat_ws(" ", "name_primary", "name_alias", "owner_primary", "text")
    stored = search.postings(docs, text), search.lengths(docs, text)
    for query in ("find", "find rows", "caféBar", "bar", "таблица", "Find.Sort", "!"):
        plain = [tuple(r) for r in search.keywords(docs, text, query).collect()]
        assert [tuple(r) for r in search.keywords(docs, None, query, index=stored).collect()] == plain
    tiers = {r.id: r.tier for r in search.keywords(docs, text, "find sort").collect()}
    assert tiers["d"] == 1 and tiers["b"] == 2  # owner.member; the alias is a part of the owner's shown name


def test_unsafe_files_are_not_written(spark, tmp_path):
    for bad in ("../x.md", "/abs.md", "a\\b.md"):
        rows = spark.createDataFrame([("ok.md", "x"), (bad, "y")], "file string, markdown string")
        with pytest.raises(export.UnsafePath):
            export.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_publishing_is_locked(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    (tmp_path / "index").mkdir()
    with index.locked(spark, folder), pytest.raises(index.IndexFormatError), index.locked(spark, folder, wait=0.2):
        pass
    with index.locked(spark, folder):
        pass
    assert index.index_path("x") == "x" and index.index_path(None, "NOT_SET_ANYWHERE") == ".lexigrid/index"


def test_markdown_of_code_and_layout():
    code = pages.to_markdown('<h2><a name="top">T</a></h2><table><tr><td><font face="Courier New">A = 1;<br>B = &lt;2;</font></td></tr></table>', "T")
    assert code == '<a id="top"></a>\n## T\n\n```bsl\nA = 1;\nB = <2;\n```\n'
    quote = pages.to_markdown("<h1>Q</h1><blockquote><table><tr><td>one</td></tr></table><table><tr><td></td><td>two</td></tr></table></blockquote><p>end</p>", "Q")
    assert quote == "# Q\n\n> one\n>\n> two\n\nend\n"
    same = pages.to_markdown('<h1>Q</h1><a href="me.html#x">a</a> <a href="me.html">b</a> <a href="http://x#y">c</a>', "Q", {"": "me.md", "me.html": "me.md"})
    assert "[a](#x) [b](me.md) [c](http://x#y)" in same
    plain = pages.to_markdown('<h1>Q</h1><blockquote><font face="courier">SELECT</font></blockquote><table><tr><td>a</td><td>b</td></tr></table>', "Q")
    assert "```bsl\nSELECT\n```" in plain and "a" in plain


def test_reports(spark):
    hits = spark.createDataFrame([("m:1", "method", "Add", "Добавить"), ("m:2", "method", "Get", None)], "id string, kind string, name_primary string, name_alias string")
    assert [r.line.split() for r in provider.text_lines(hits).collect()] == [["method", "m:1", "Add", "(Добавить)"], ["method", "m:2", "Get"]]
    assert provider.compact(hits).columns == ["id", "kind", "name_primary", "name_alias"]
    signatures = spark.createDataFrame([("m:1", 1, "b"), ("m:1", 0, "a")], "callable_id string, ordinal int, title string")
    assert [r.line for r in provider.constructor_lines(hits, signatures).collect()] == ["a", "b"]
    edges = spark.createDataFrame([("r", "x", "owns", None, 10)], graph.EDGE)
    found = graph.bfs(edges, spark.createDataFrame([("r",)], "node string")).where("depth > 0")
    assert [r.line.split() for r in provider.related_lines(found).collect()] == [["1", "owns", "x"]]
    roles = spark.createDataFrame([(None, 3, 1, 1, 1, 0)], "role string, total int, resolved int, unresolved int, ambiguous int, with_binding int")
    groups = spark.createDataFrame([("r", "T", 2)], "role string, target_name string, n int")
    assert [r.line.split()[0] for r in provider.gap_lines(roles, groups).collect()] == ["total", "2"]


def test_module_contexts():
    one, two = resolver.ModuleContext("a/m", ["a"], "self-a"), resolver.ModuleContext("b/m", ["b", "a"], "self-b", facts=["f"])
    merged = resolver.merge_contexts("object_module", [one, two])
    assert (merged.id, merged.sources, merged.self_member, merged.facts) == ("a/m", ["a", "b"], "self-a", ["self-b", "f"])
    assert resolver.merge_contexts("object_module", []) is None


def test_sources_of_language_and_tables(spark):
    from lexigrid.operators import language

    facts = spark.createDataFrame([("shquery:SUM", "shquery", "query", "language_function", "SUM", "СУММА", None, [], ["Number"], None), ("shlang:def_Type", "shlang", "bsl", "language_type", "Type", None, None, [], [], None)], language.FACT)
    source = resolver.LanguageSource("sdbl", facts, "query")
    asked = spark.createDataFrame([("сумма",), ("type",)], "query string")
    assert [tuple(r) for r in source.resolve(asked).collect()] == [("сумма", "shquery:SUM")]
    both = resolver.CompositeResolver([source])
    assert both.members("sdbl/shquery:SUM") == ("unsupported", None) and both.callables("sdbl/", "sum")[1].count() == 1
    assert both.module_context("object_module") == ("unsupported", None) and both.metadata_module(" Object ") == "object_module" and both.metadata_module("x") is None
    docs = spark.createDataFrame([("t", "query_table", 30, "Turnovers", None), ("f", "query_field", 130, "Period", None), ("p", "query_parameter", 140, "Begin", None)], "id string, kind string, kind_priority int, name_primary string, name_alias string")
    names = spark.createDataFrame([("turnovers", "primary", "t"), ("period", "primary", "f")], "key string, key_kind string, document_id string")
    edges = spark.createDataFrame([("t", "f", "owns", None, 10), ("t", "p", "owns", None, 10)], graph.EDGE)
    tables = resolver.QueryTableSource("tables", {"documents": docs, "document_names": names, "relations": edges})
    assert [r.id for r in tables.resolve(spark.createDataFrame([("Turnovers",), ("Period",)], "query string")).collect()] == ["t"]
    assert [r.id for r in tables.fields("t").collect()] == ["f"] and tables.fields("t", "none").count() == 0 and [r.id for r in tables.parameters("t", "begin").collect()] == ["p"]
    assert tables.describe() == {"source": "tables", "capabilities": ["resolve"]} and tables.members("t") is None


def test_lines_that_are_no_objects(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a":1}\n\n[2]\n{"a":\n')
    with pytest.raises(records.RecordError, match="line 3"):
        records.check_jsonl(spark, str(tmp_path / "r.jsonl"))
    (tmp_path / "ok.jsonl").write_text('{"a":1}\r\n \n{"b":{}}')
    records.check_jsonl(spark, str(tmp_path / "ok.jsonl"))


def test_site_sections(spark):
    rows = [("en", 1, i, p, o, t, None) for i, p, o, t in ((1, None, 0, "Guide"), (2, 1, 0, "A"), (3, 2, 0, "B"), (4, 3, 0, "C"), (5, 1, 1, "D"))]
    site = export.site_tables(tree.merge_books(spark.createDataFrame(rows, "locale string, book_seq int, id int, parent_id int, ordinal int, title string, page_key string")), spark.createDataFrame([], "locale string, page_key string, markdown string"))
    parts = export.site_sections(site["nodes"])
    assert {(r.title, r.section_nodes) for r in parts["root"].collect()} == {("Guide", 0), ("A", 2), ("D", 0)}
    assert {r.title for r in parts["sections"].collect()} == {"B", "C"}


def test_family_counts_and_stored_bytes(spark, tmp_path):
    from lexigrid.schemas import TABLES, schema

    folder = f"file://{tmp_path}/i"
    index.publish(spark, {"documents": spark.createDataFrame([("a", "enum", 20, "A")], "id string, kind string, kind_priority int, name_primary string").selectExpr("*", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema("documents").fields[4:]])}, folder)
    opened = index.open_index(spark, folder)
    assert {(r.family, r.n) for r in index.family_counts(opened).collect()} == {("documents/enum", 1), ("documents", 1)}
    assert index.stored_bytes(spark, folder)["documents"] > 0 and "meta" in TABLES
