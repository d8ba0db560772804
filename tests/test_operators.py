"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import graph, identity, language, lookup, ordering, page_model, pages, resolve, search, stats, tree
from lexigrid.plans import provider, resolver


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


HTML = """<html><head><title> Add &amp; go </title><style>p{}</style></head><body><h1>Array.Add (Массив.Добавить)</h1>
<p>Syntax:</p><div>Add(&lt;Value&gt;)</div><p>Parameters:</p><div>&lt;Value&gt; (optional) Type: String, Number. The value.</div>
<p>Return value:</p>Type: Array. It.<p>Availability:</p>Server, thin client.<p>See also:</p><a href="/x.html">x</a><a class="c" href="y.html#f">y</a></body></html>"""


def test_page_parsing(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<h1>Only <b>head</b></h1>")], "page_id long, html string")
    titles = {r.page_id: r.t for r in df.select("page_id", pages.title("html").alias("t")).collect()}
    assert titles == {1: "Add & go", 2: "", 3: "Only head"}
    found = {r.page_id: r for r in pages.parse(df).collect()}
    assert found[2].text == "" and found[2].signatures == []
    assert found[1].sections["availability"] == "Server, thin client." and "syntax" in found[1].sections
    (signature,) = found[1].signatures
    assert signature.text == "Add(<Value>)" and signature.return_types == [] and found[1].return_types == ["Array"]
    (parameter,) = signature.parameters
    assert (parameter.name, parameter.required, parameter.type_refs, parameter.description) == ("Value", False, ["String", "Number"], "The value.")
    assert rows(pages.links(df), "ordinal", "href") == [(0, "/x.html"), (1, "y.html#f")]


def test_link_resolution(spark):
    links = spark.createDataFrame([("d/p.html", "x.html"), ("d/p.html", "/q.html"), ("d/p.html", "none"), ("d/p.html", None)], "path string, href string")
    toc = spark.createDataFrame([("d/x.html", "X")], "toc_path string, toc_title string")
    stored = spark.createDataFrame([("q.html",), ("d/x.html",)], "stored_path string")
    found = pages.resolve_links(links, toc, stored)
    assert {r.href: (r.status, r.link_title) for r in found.collect()} == {"x.html": ("resolved", "X"), "/q.html": ("resolved", None), "none": ("unresolved", None), None: ("unresolved", None)}
    assert pages.link_diagnostics(found).count() == 2


def test_page_helpers():
    assert pages.body_text("<body>a<b>b</b><br>c<script>x</script><p>d</p></body>") == "ab c d"
    assert page_model.normalize_example(['A  =  "x  y', 'z  w"  ;']) == ['A = "x  y', 'z  w" ;']
    assert page_model.fuse_see_also([("owner", "Array"), ("member", "Add"), ("owner", "Map")]) == ["Array.Add", "Map"]
    assert page_model.overload_returns([{"return_types": ["A"]}, {"return_types": []}], ["B"])[1] == ["B"]
    assert page_model.overload_returns([{"return_types": ["A"]}], ["B"])[1] == []
    text = pages.to_markdown('<h2>T</h2><p>a <b>b</b></p><ul><li>x</li></ul><a href="p.html#f">l</a><a href="http://h">e</a>', "T", {"p.html": "p.md"})
    assert text.startswith("## T\n") and "a **b**" in text and "- x" in text and "[l](p.md#f)" in text and "[e](http://h)" in text
    assert pages.to_markdown("", "Only") == "# Only\n"


def test_markdown_and_language(spark):
    df = spark.createDataFrame([(1, "lang/def_string.html", "<h1>String (Строка)</h1><p>Description:</p>Text."), (2, "lang/other.html", "x")], "page_id long, path string, html string")
    assert rows(pages.render_markdown(df.withColumn("title", F.lit("T")))) [0][1].startswith("# String")
    made = [
        ("shlang", "v8help://x/def_String.html", "<h1>String (Строка)</h1><p>A text.</p>"), ("shlang", "def_Func", "<h1>Function</h1><p>Declares.</p><p>Syntax: Function Name()</p>"), ("shlang", "other.html", "x"),
        ("shquery", "SUM", "<h1>SUM</h1><pre>SUM(&lt;Expr&gt;)</pre><p>Adds.</p><blockquote><p>Expr - a Number field</p></blockquote><p>Return value: Number</p>"),
        ("shquery", "STRING", "<h1>STRING</h1><pre>STRING(n)</pre><p>Return value: String or Number</p>"),
        ("dcsui", "SKD_Functions_Strings.htm", "<h1>Strings</h1><p>StringLength</p><p>Syntax: StringLength(s) Parameter: s</p>"), ("dcsui", "SKD_ExtQueryLangv", "<h1>Extension</h1><p>Use SELECT here.</p>"), ("dcsui", "def_String", "y"),
    ]
    found = language.facts(spark.createDataFrame(made, "family string, path string, html string"), locale="root")
    facts = {r.id: r for r in found.collect()}
    assert sorted(facts) == ["dcsui:SKD_ExtQueryLangv", "dcsui:SKD_ExtQueryLangv:SELECT", "dcsui:SKD_Functions_Strings:StringLength", "shlang:def_Func", "shlang:def_String", "shquery:STRING", "shquery:SUM"]
    assert (facts["shlang:def_String"].kind, facts["shlang:def_String"].name_primary, facts["shlang:def_String"].name_alias, facts["shlang:def_String"].description) == ("language_type", "String", "Строка", "A text.")
    assert facts["shlang:def_Func"].syntax == "Function Name()" and facts["dcsui:SKD_ExtQueryLangv:SELECT"].name_primary == "{SELECT}"
    total = facts["shquery:SUM"]
    assert (total.syntax, total.parameters[0].name, total.parameters[0].type_refs, total.return_types) == ("SUM(<Expr>)", "Expr", ["Number"], ["Number"])
    assert facts["dcsui:SKD_Functions_Strings:StringLength"].syntax == "StringLength(s)"
    targets = {(r.document_id, r.target_type_name): r.target_type_id for r in language.type_targets(found).collect()}
    assert targets["shquery:STRING", "String"] == "shquery:LitString" and targets["dcsui:SKD_Functions_Strings:StringLength", "String"] == "shlang:def_String" and targets["shquery:SUM", "Number"] is None
    words = df.select("page_id", F.col("html").alias("text"))
    assert rows(language.keyword_facts(words, [("String", "type"), ("None", "x")]), "page_id", "keyword") == [(1, "String")]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "a", 0), ("d", "b", 0), ("e", None, 1)], "id string, parent_id string, ordinal int")
    flat = {r.id: (r.depth, r.index_path, r.ancestors) for r in tree.flatten(nodes).collect()}
    assert flat == {"a": (0, [0], []), "b": (1, [0, 1], ["a"]), "c": (1, [0, 0], ["a"]), "d": (2, [0, 1, 0], ["a", "b"]), "e": (0, [1], [])}
    assert rows(tree.by_index_path(tree.flatten(nodes), [0, 1]), "id") == [("b",)]
    carried = tree.carry_owner(spark.createDataFrame([("p", 0, "T"), ("p", 1, None), ("p", 2, "U"), ("q", 0, None)], "parent_id string, ordinal int, owner string"), "owner")
    assert rows(carried.na.fill("-"), "parent_id", "ordinal", "carried_owner") == [("p", 0, "T"), ("p", 1, "T"), ("p", 2, "U"), ("q", 0, "-")]


@pytest.mark.parametrize(
    "path,titles,branch,kind",
    [
        ("objects/Global context/methods/m.html", [], "global_context", "global_method"),
        ("tables/t.html", [], "query_tables", "query_table"),
        ("tables/t/fields/f.html", [], "query_tables", "query_table_field"),
        ("objects/catalog2/e.html", [], "system_enums", "enum"),
        ("objects/catalog2/e/properties/v.html", [], "system_enums", "enum_value"),
        ("objects/catalog1/catalog2/e/properties/v.html", [], "platform_objects", "enum_value"),
        ("objects/catalog1/t.html", ["application objects"], "metadata_objects", "object_type"),
        ("objects/catalog1/t/events/e.html", ["forms"], "managed_forms", "type_event"),
        ("objects/catalog1/t/events/e.html", ["object module"], "platform_objects", "module_event"),
        ("objects/catalog1/t/ctors/c.html", [], "platform_objects", "constructor"),
        ("objects/catalog12.html", [], "platform_objects", "catalog"),
        ("other.html", [], "unknown", "unknown"),
    ],
)
def test_page_classes(spark, path, titles, branch, kind):
    names = F.array(*map(F.lit, titles)).cast("array<string>")
    found = spark.range(1).select(tree.branch_kind(F.lit(path), names).alias("b"))
    assert found.first().b == branch
    assert spark.range(1).select(tree.page_class(F.lit(path), F.lit(branch), names, F.lit(False)).alias("k")).first().k == kind


def test_merge_and_placeholders(spark):
    nodes = spark.createDataFrame(
        [("en", 1, 1, None, 0, "Guide", None), ("en", 1, 2, 1, 0, "A", "a"), ("en", 2, 1, None, 0, " guide ", None), ("en", 2, 2, 1, 0, "A2", "a"), ("en", 2, 3, 1, 1, "B", None)],
        "locale string, book_seq int, id int, parent_id int, ordinal int, title string, page_key string",
    )
    merged = {tuple(r.node_path): (r.title, r.books) for r in tree.merge_books(nodes).collect()}
    assert merged == {("title:guide",): ("Guide", 2), ("title:guide", "page:a"): ("A", 2), ("title:guide", "title:b"): ("B", 1)}
    holes = spark.createDataFrame([("x", None), ("x", "p"), ("y", None), ("y", "p"), ("y", "q")], "title_branch string, page_key string")
    assert rows(tree.resolve_placeholders(holes).na.fill("-"), "title_branch", "page_key") == [("x", "p"), ("x", "p"), ("y", "-"), ("y", "p"), ("y", "q")]


def test_link_targets(spark):
    sites = spark.createDataFrame([("b", "x.html", 1), ("c", "x.html", 2)], "book string, path string, page_id int")
    links = spark.createDataFrame([("b", "x.html"), ("b", "c/x.html"), ("b", "b/x.html"), ("b", "no")], "book string, path string")
    assert rows(tree.link_targets(links, sites).na.fill(0), "path", "target") == [("b/x.html", 1), ("c/x.html", 2), ("no", 0), ("x.html", 1)]


def test_reference_resolution(spark):
    types = spark.createDataFrame([("t1", "Value Table", "ТЗ", None), ("t2", "ValueTable", None, None), ("t3", "Array", None, "Catalog"), ("t4", "Map", None, None), ("t5", "map", None, "Map")], "id string, name_primary string, name_alias string, meta string")
    keys = resolve.candidate_keys(types, metadata_column="meta")
    refs = spark.createDataFrame([("value table",), ("VALUETABLE ",), ("v aluetable",), ("тз",), ("catalog",), ("map",), ("none",), (None,)], "target_name string").withColumn("ref_kind", F.lit("property_type"))
    found = {r.target_name: (r.status, r.target_id, r.candidates) for r in resolve.resolve(refs, keys).collect()}
    assert found["value table"] == ("ok", "t1", None)
    assert found["VALUETABLE "] == ("ok", "t2", None)
    assert found["v aluetable"] == ("ambiguous", None, ["t1", "t2"])
    assert found["тз"][1] == "t1" and found["catalog"][1] == "t3"
    assert found["map"] == ("ambiguous", None, ["t4", "t5"])
    assert found["none"][0] == found[None][0] == "unresolved"
    gaps = resolve.gap_roles(resolve.resolve(refs, keys)).where("role IS NULL").first()
    assert (gaps.total, gaps.resolved, gaps.unresolved, gaps.ambiguous) == (8, 4, 2, 2)
    made = refs.withColumn("ref_kind", F.lit("constructor_result")).withColumn("owner_type_id", F.lit("t9"))
    assert {r.target_id for r in resolve.resolve_constructors(resolve.resolve(made, keys)).collect()} == {"t9"}


def test_identity_operators(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, seq int, v string")
    assert rows(identity.keep_last(df, "id", "seq"), "id", "v", "duplicate_count") == [("a", "y", 2), ("b", "z", 1)]
    assert rows(identity.duplicate_warnings(df, "id")) == [("DUPLICATE_DOCUMENT_ID", "a", 2)]
    assert rows(identity.unique_lookup(df, "id", "v").na.fill("-")) == [("a", "-"), ("b", "z")]
    titles = spark.createDataFrame([("p", "x", 1), ("p", "x", 2), ("p", "x-2", 3), ("p", "y", 4), ("q", "x", 1), ("q", "x", 2), (None, "x", 1)], "parent string, base string, o int")
    assert rows(identity.unique_segments(titles, "parent", "base", "o").na.fill("-"), "parent", "o", "segment") == [
        ("-", 1, "x"), ("p", 1, "x"), ("p", 2, "x-2"), ("p", 3, "x-2-2"), ("p", 4, "y"), ("q", 1, "x"), ("q", 2, "x-2"),
    ]
    owners = spark.createDataFrame([("k1", "o1")], "key string, owner_id string")
    good, bad = identity.missing_parents(spark.createDataFrame([("d1", "k1"), ("d2", "k2"), ("d3", None)], "id string, key string"), owners, "key")
    assert rows(good, "id") == [("d1",), ("d3",)] and rows(bad, "id", "code") == [("d2", "MISSING_PARENT_IDENTITY")]


def test_template_families(spark):
    templates = spark.createDataFrame([("t1", "CatalogTabularRef"), ("t2", "Widget"), ("t3", "Thing"), ("t4", "Lone")], "type_id string, base string")
    managers = spark.createDataFrame([("CatalogManager",), ("CatalogTabularManager",), ("Other",)], "name string")
    evidence = spark.createDataFrame([("t2", "Widgets"), ("t3", "A"), ("t3", "B")], "type_id string, family string")
    found = {r.type_id: (r.family, r.variant, r.diagnostic) for r in identity.classify_templates(templates, managers, evidence).collect()}
    assert found == {"t1": ("CatalogTabular", "Ref", None), "t2": ("Widgets", "Widget", None), "t3": (None, None, "AMBIGUOUS_TEMPLATE"), "t4": (None, None, "UNCLASSIFIED_TEMPLATE")}


def test_bfs(spark):
    edges = [("r", "a", "owns", None, 10), ("r", "b", "has_type", None, 12), ("b", "c", "owns", None, 10), ("a", "c", "has_type", None, 12), ("c", "r", "owns", None, 10), ("c", "d", "owns", None, 10), ("x", "y", "owns", None, 10)]
    df = spark.createDataFrame(edges, graph.EDGE)
    roots = spark.createDataFrame([("r",)], "node string")
    found = {r.node: (r.depth, r.parent) for r in graph.bfs(df, roots).collect()}
    assert found == {"r": (0, None), "a": (1, "r"), "b": (1, "r"), "c": (2, "a"), "d": (3, "c")}
    assert {r.node for r in graph.bfs(df, roots, limit=2).collect()} == {"r", "a", "b"}
    assert {r.node for r in graph.bfs(df, roots, 1).collect()} == {"r", "a", "b"}
    path = [r.path for r in graph.bfs(df, roots).collect() if r.node == "c"][0]
    assert [(s.kind, s.node) for s in path] == [("owns", "a"), ("has_type", "c")]
    assert rows(graph.neighbours(df, "r"), "target_id") == [("a",), ("b",)]


def test_edges(spark):
    docs = spark.createDataFrame([("m", "t", "method"), ("c", "t", "constructor"), ("t", None, "platform_type")], "id string, owner_id string, kind string")
    refs = spark.createDataFrame([("m", "return_type", "u", "U", "ok"), ("m", "parameter_type", None, "V", "unresolved"), ("m", "parameter_type", "u", "U", "ok"), ("m", "parameter_type", "u", "U2", "ok")], "document_id string, ref_kind string, target_id string, target_name string, status string")
    found = rows(graph.derive(docs, refs).na.fill(""), "source_id", "target_id", "edge_kind", "label")
    assert found == [("c", "t", "constructs", ""), ("c", "t", "member_of", ""), ("m", "t", "member_of", ""), ("m", "u", "has_type", "U"), ("m", "u", "returns", "U"), ("t", "c", "owns", ""), ("t", "m", "owns", "")]


def test_search(spark):
    docs = spark.createDataFrame(
        [("d1", "Find", "Найти", "Array", "find an item in the array", 60, "method"), ("d2", "FindRows", None, "Table", "find rows", 60, "method"), ("d3", "Sort", None, "Array", "sorts; see find", 60, "method"), ("d4", "Other", None, None, "nothing", 10, "enum")],
        "id string, name_primary string, name_alias string, owner_primary string, text string, kind_priority int, kind string",
    )
    hits = search.keywords(docs, "text", "find", 10).collect()
    assert [(h.id, h.tier) for h in hits] == [("d1", 0), ("d2", 2), ("d3", 10)]
    assert search.keywords(docs, "text", " ", 10).count() == 0
    names = docs.select(F.col("id").alias("document_id"), F.lower("name_primary").alias("key"), F.lit("primary").alias("key_kind"))
    assert rows(search.fuzzy(names, docs, "Findd"), "id", "distance") == [("d1", 1)]
    assert rows(lookup.by_name(names, docs, " F ind"), "id") == [("d1",)]
    with pytest.raises(ValueError):
        search.search("exact")


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), (None, 0.0)], "g string, v double")
    found = {r.g: r for r in stats.median_mad(df, ["g"], "v").collect()}
    assert (found["a"].median, found["a"].mad, found["a"].noisy, found["a"].samples) == (2.0, 1.0, True, 3)
    assert found[None].noise is None and not found[None].noisy
    cells = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "p")], "d string, s string")
    assert rows(stats.missing_cells(cells, {"d": ["x", "y"], "s": ["p", "q"]})) == [("y", "q")]
    assert rows(stats.repeated_cells(cells, ["d", "s"]), "d", "s", "n") == [("y", "p", 2)]
    metrics = spark.createDataFrame([("m1", 5.0, False), ("m2", 5.0, True), ("m3", 9.0, False), ("m4", 5.0, True)], "metric string, median double, noisy boolean")
    limits = spark.createDataFrame([(m, 6.0) for m in ("m1", "m2", "m3", "m4", "m5")], "metric string, threshold double")
    assert rows(stats.gates(metrics, limits, ["m4"]), "metric", "outcome") == [("m1", "pass"), ("m2", "inconclusive"), ("m3", "fail"), ("m4", "pass"), ("m5", "missing")]
    samples = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 5), ("b", 3, 6)], "g string, s int, v int")
    assert rows(stats.completeness(samples, ["g"], "s", "v", 2)) == [("a", True, True), ("b", False, False)]


def test_provider(spark):
    assert provider.classify({"id": "x"}) == ("by_id", None)
    assert provider.classify({"owner": "a", "member": "b", "id": " "}) == ("owner_member", None)
    assert provider.classify({})[0] == provider.classify({"id": "x", "kind": "y"})[0] == "unsupported"
    for value in ("0", "-1", "x", None):
        with pytest.raises(ValueError):
            provider.positive(value)
    hits = spark.createDataFrame([("d1", "k"), ("d2", "k")], "id string, kind string")
    answer = provider.envelope(provider.ranked(hits, "id"), "get", {"name": "n"}).first()
    assert answer.status == "ambiguous" and answer.results == [] and answer.diagnostics[0].candidates == ["d1", "d2"]
    assert provider.envelope(provider.ranked(hits.limit(1), "id"), "get", {}).first().status == "ok"
    assert provider.envelope(provider.ranked(hits.where("false"), "id"), "get", {}).first().status == "not_found"
    assert provider.envelope(provider.ranked(hits.where("false"), "id"), "search", {}).first().status == "ok"


def test_composite(spark):
    asked = spark.createDataFrame([(q,) for q in "one two torn none".split()], "query string")
    answers = spark.createDataFrame([("one", "s", "1"), ("two", "s", "1"), ("two", "t", "2"), ("torn", "s", "1"), ("torn", "t", "2"), ("torn", "t", "3"), ("none", "off", "9")], "query string, source string, id string")
    found = {r.query: (r.status, r.candidates) for r in resolver.composite(asked, answers, ["s", "t"]).collect()}
    assert found == {"one": ("ok", []), "two": ("ambiguous", ["1", "2"]), "torn": ("ambiguous", ["1", "2", "3"]), "none": ("not_found", [])}


def test_composite_resolver(spark):
    docs = spark.createDataFrame([("t", "platform_type", 10, "T", None), ("m", "method", 60, "M", None), ("p", "property", 70, "P", None)], "id string, kind string, kind_priority int, name_primary string, name_alias string")
    names = docs.select(F.lower("name_primary").alias("key"), F.lit("primary").alias("key_kind"), F.col("id").alias("document_id"))
    members = spark.createDataFrame([("m", "t", "method", "M", None, "m"), ("p", "t", "property", "P", None, "p")], "member_id string, owner_type_id string, member_kind string, name_primary string, name_alias string, document_id string")
    both = resolver.CompositeResolver([resolver.IndexSource("a", {"documents": docs, "document_names": names, "members": members}), resolver.IndexSource("b", {"documents": docs, "document_names": names})])
    asked = spark.createDataFrame([("t",), ("zz",)], "query string")
    assert rows(both.by_name(asked), "query", "status") == [("t", "ambiguous"), ("zz", "not_found")]
    assert both.by_id("a/t")[0] == "ok" and both.by_id("c/t")[0] == "not_found"
    assert both.members("b/t")[0] == "unsupported"
    assert [r.id for r in both.module_members("object", "a/t")[1].collect()] == ["p", "m"]
    assert both.module_members("session", "a/t")[0] == "unsupported"


def test_owner_paths_and_children(spark):
    chain = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(p).alias("path")) for t, p in (("Root", "objects/x.html"), ("Register tables", "q"), (" ", "e"), ("Type", ""))))
    path = lambda kind, branch="x": spark.range(1).select(tree.owner_path(F.lit(kind), F.lit(branch), chain).alias("p")).first().p
    assert path("query_table") == ["Register tables"]
    assert path("object_method") == ["Register tables", "Type"]
    assert path("object_type", "platform_objects") == ["Root", "Register tables", ""]
    assert path("enum") == []
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    children = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("z", 1, "lost")], "key string, seq int, name string")
    found = {r.key: [c.name for c in r.fields] for r in tree.attach(parents, children, "key", "fields").collect()}
    assert found == {"a": ["x", "y"], "b": []}


def test_page_diagnostics(spark):
    rows_ = [("1", "unknown", True, None, None), ("2", "object_method", False, None, ["A", "B"]), ("3", "object_method", True, "o", ["A", "A"])]
    df = spark.createDataFrame(rows_, "id string, page_class string, has_syntax boolean, owner string, overload_returns array<string>")
    assert rows(tree.page_diagnostics(df)) == [("MISSING_OWNER", "2"), ("MISSING_SYNTAX", "2"), ("MULTIPLE_OVERLOAD_RETURNS", "2"), ("UNKNOWN_PAGE", "1")]
