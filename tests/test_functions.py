"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import availability, identity, paths, text, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value):
    return F.lit(value) if value is not None else F.lit(None).cast("string")


@pytest.mark.parametrize("raw,key", [("  Small  Ring ", "smallring"), ("A B\tC", "abc"), ("ИмяТипа", "иматипа".replace("има", "имя")), ("", ""), (None, None)])
def test_normalize_key(spark, raw, key):
    assert one(spark, text.normalize_key(lit(raw))) == key


@pytest.mark.parametrize("raw,want", [("FindByName", "find by name"), ("Array<Any>.Add", "array any  add"), ("НайтиПоКоду", "найти по коду"), ("ABCd", "abcd")])
def test_searchable_name(spark, raw, want):
    assert one(spark, text.searchable_name(lit(raw))) == want


def test_searchable_text_and_terms(spark):
    assert one(spark, text.searchable_text(lit(" OneTwo  three.Four "))) == "one two three four"
    assert one(spark, text.tokens(lit("Ab, c"))) == ["ab", "c"]
    assert text.query_terms("GetItem get") == ["get", "item"]
    assert "composition" in text.query_terms("СКД")
    assert text.query_terms("  ") == []


def test_fuzzy(spark):
    assert [text.fuzzy_threshold("x" * n) for n in (0, 8, 9, 20, 21, 40)] == [2, 2, 3, 3, 4, 8]
    assert one(spark, text.fuzzy_distance(F.lit("кот"), [lit(None), F.lit("коты"), F.lit("собака")])) == 1


def test_name_keys(spark):
    keys = one(spark, text.name_keys(F.lit("Add"), F.lit("Добавить"), F.lit("Array")))
    assert [(k.key, k.key_kind) for k in keys] == [("add", "primary"), ("добавить", "alias"), ("array.add", "owner_member_primary"), ("array.добавить", "owner_member_alias")]
    assert [k.key for k in one(spark, text.name_keys(F.lit("Add"), lit(None), lit(None)))] == ["add"]


@pytest.mark.parametrize(
    "path,want",
    [("/a/./b/../c", "a/c"), ("../x", None), ("a/../..", None), ("", ""), ("a//b/", "a/b"), ("a/..", "")],
)
def test_fold(spark, path, want):
    assert one(spark, paths.fold(lit(path))) == want


@pytest.mark.parametrize(
    "href,want",
    [(" x.html ", "d/x.html"), ("/r/x.html#f", "r/x.html"), ("#f", "d/p.html"), ("?q=1", "d/p.html"), ("", None), (None, None), ("http://h/x", None), ("mailto:a", None), ("../x", "x"), ("../../x", None)],
)
def test_normalize_link(spark, href, want):
    assert one(spark, paths.normalize_link(lit(href), F.lit("/d/p.html"))) == want


@pytest.mark.parametrize("a,b,want", [("d/a.md", "d/b.md", "b.md"), ("a.md", "b.md", "b.md"), ("d/e/a.md", "d/f/b.md", "../f/b.md"), ("d/a.md", "b.md", "../b.md"), ("a.md", "d/b.md", "d/b.md")])
def test_relative_link(spark, a, b, want):
    assert one(spark, paths.relative_link(F.lit(a), F.lit(b))) == want


def test_paths(spark):
    assert one(spark, paths.page_key(F.lit("http://h/a/b.html?x=1#y"))) == "b"
    assert one(spark, paths.page_key(F.lit("a/b.htm"))) == "b"
    assert one(spark, paths.url_path(F.lit("https://h"))) == "/"
    assert one(spark, paths.slug(F.lit(" A b -- Ц! "))) == "a-b-ц"
    assert one(spark, paths.slug(F.lit("!!"))) == "page"
    assert one(spark, paths.display_title(F.lit("  "))) == "Untitled"
    assert one(spark, paths.same_page_fragment(F.lit("p.html#x"), F.lit("p.html"))) == "#x"
    assert one(spark, paths.book_link_ids(F.lit("lang_ru"), F.lit("lang"))) == ["lang_ru", "lang"]
    assert [one(spark, paths.locale_of(F.lit(s))) for s in ("x_ru", "x_root", "x")] == ["ru", "en", None]
    assert paths.fnv1a64("") == 0xCBF29CE484222325 and paths.fnv1a64("a") == 0xAF63DC4C8601EC8C
    assert one(spark, paths.stable_id(F.lit("a"))) == "af63dc4c8601ec8c"


def test_identity(spark):
    assert one(spark, identity.clean_part(F.lit(" Name @@2"))) == "Name"
    assert one(spark, identity.type_id(F.lit("T"), F.array(F.lit("A"), F.lit(" ")), F.lit(2))) == "platform_type:T:A"
    assert one(spark, identity.type_id(F.lit("T"), F.array(F.lit("A")), F.lit(1))) == "platform_type:T"
    assert one(spark, identity.type_id(F.lit("T"), F.array().cast("array<string>"), F.lit(2))) == "platform_type:T:semantic_variant"
    assert one(spark, identity.enum_id(F.lit("E"), F.lit("Псевдоним"), F.lit("objects/catalog2/x"), F.lit(2))) == "enum:system:E:Псевдоним"
    assert one(spark, identity.enum_id(F.lit("E"), lit(None), F.lit("y"), F.lit(2))) == "enum:metadata_property:E"
    assert one(spark, identity.owned_id(F.lit("method"), lit(None), F.lit("M"), F.lit("O"))) == "method:owner:O:M"
    assert one(spark, identity.semantic_key(F.array(F.lit("A"), F.lit("B")), F.lit("b"))) == "a/b"
    assert one(spark, identity.template_base(F.lit("X"), F.lit("Catalog<Name>.Ref"))) == "Catalog"
    assert one(spark, identity.template_slots(F.lit("A<x>.<y><x>"))) == ["x", "y"]
    assert one(spark, identity.manager_root(F.lit("CatalogManager"))) == "Catalog"
    assert one(spark, identity.template_variant(F.lit("CatalogRef"), F.lit("Catalog"))) == "Ref"
    bound = one(spark, identity.bindings(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")), F.lit(True)))
    assert [(b.owner_idx, b.target_idx) for b in bound] == [(1, 0)]
    assert one(spark, identity.bindings(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a")), F.lit(True))) is None


def test_availability(spark):
    codes = one(spark, availability.parse_contexts(F.lit("Server, web‑client; Thin client.")))
    assert codes == ["thin_client", "web_client", "server"]
    mask = one(spark, availability.array_mask(F.array(*map(F.lit, codes))))
    assert mask == 1 | 2 | 8 == availability.mask_of(codes)
    assert [one(spark, availability.available(F.lit(m), 12, "any")) for m in (0, 4, 3)] == [True, True, False]
    assert [one(spark, availability.available(F.lit(m), 12, "all")) for m in (0, 4, 12, 15)] == [True, False, True, True]
    assert [one(spark, availability.available(F.lit(m), 0, "any")) for m in (0, 4)] == [True, False]
    assert one(spark, availability.available(F.lit(4), 0, "all"))
    with pytest.raises(ValueError):
        availability.mask_of(["nowhere"])


def test_values(spark):
    split = lambda s: tuple(one(spark, values.split_alias(lit(s))))
    assert split("Add (Добавить)") == ("Add", "Добавить")
    assert split("F(x) (G(y))") == ("F(x)", "G(y)")
    assert split("Plain") == ("Plain", None)
    assert one(spark, values.type_list(F.lit("A, B;C . D"))) == ["A", "B", "C"]
    assert [one(spark, values.version_of(lit(v))) for v in ("since 8.3.6.", "no", "v2")] == ["8.3.6", None, "2"]
    assert one(spark, values.version_parts(F.lit("8.3.10"))) == [8, 3, 10]
    assert [one(spark, values.usage_of(lit(v))) for v in ("Read and Write.", " только чтение", "x")] == ["ReadWrite", "Read", "Unknown"]
    assert [one(spark, values.is_required(lit(v))) for v in ("(optional)", "required")] == [False, True]
    assert one(spark, values.strip_type_prose(F.lit("Type: String. The name."))) == "The name."
    assert one(spark, values.decode_entities(F.lit("a &lt;b&gt; &amp;lt;"))) == "a <b> &lt;"
    assert one(spark, values.camel_part(F.lit(" one two"))) == "OneTwo"
    assert [one(spark, values.json_number(F.lit('{"a":{"b":1.5,"c":true}}'), p)) for p in ("$.a.b", "$.a.c")] == [1.5, None]
    assert one(spark, values.localized(F.lit("р"), F.lit(""), "en")) == "р"
    assert one(spark, values.bracketed(F.lit("f(<A>, <B c>)"))) == ["A", "B c"]
