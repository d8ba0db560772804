"""Containers, brace texts, books, records and index generations."""

import io
import struct
import zipfile

import pytest

from lexigrid.schemas import TABLES
from lexigrid.sources import books, braces, index, records
from lexigrid.sources.container import BLOCK, HEADER, NONE, Container, ContainerError, write_container, zip_entry, zip_pages


def zipped(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


META = '{1,"lang",{1,1,{"en","Language ""book"""}},1,"tag",{1,1},0}'
TOC = '﻿{3,{1,0,2,2,3,{0,0,{0,0,{"en","Root"},{"ru","Корень"}},"/root.html"}},{2,1,0,{0,0,{0,0,{"#","Child"}},"a/b.html"}},{3,1,0,{0,0,{0,0},""}}}'


def book(toc=TOC):
    pages = zipped(("/root.html", "<p>root</p>"), ("a/b.html", "<p>b</p>"), ("__meta", "x"), ("dir/", ""))
    return [("Book", META.encode()), ("PackBlock", zipped(("toc", toc)) if toc else None), ("FileStorage", pages)]


@pytest.mark.parametrize("size", [None, 7, 512])
def test_container_round_trip(size):
    data = write_container([("Имя", b"x" * 1000), ("empty", None), ("zero", b"")], size)
    opened = Container(data)
    assert list(opened.bodies) == ["Имя", "empty", "zero"] and opened.count_hint == 3
    assert opened.read("Имя") == b"x" * 1000 and opened.read("zero") == b""
    for name, code in (("empty", "ENTITY_HAS_NO_BODY"), ("other", "MISSING_ENTITY")):
        with pytest.raises(ContainerError) as problem:
            opened.read(name)
        assert problem.value.code == code


def broken(kind):
    data = bytearray(write_container([("e", b"0123456789" * 3)], 10))
    body = struct.unpack_from("<3I", data, HEADER + BLOCK)[1]
    if kind == "BLOCK_CYCLE":
        data[body + 20 : body + 28] = b"%08x" % body
    elif kind == "SHORT_CHAIN":
        data[body + 20 : body + 28] = b"%08x" % NONE
    elif kind == "OVERSIZE_PAYLOAD":
        data[body + 2 : body + 10] = b"7ffffff0"
    elif kind == "NO_PROGRESS":
        data[body + 11 : body + 19] = b"%08x" % 0
    elif kind == "BAD_BLOCK_HEADER":
        data[body] = 0
    elif kind == "BAD_SPLITTER":
        struct.pack_into("<I", data, HEADER + BLOCK + 8, 1)
    else:
        del data[8:]
    return bytes(data)


@pytest.mark.parametrize("kind", ["BLOCK_CYCLE", "SHORT_CHAIN", "OVERSIZE_PAYLOAD", "NO_PROGRESS", "BAD_BLOCK_HEADER", "BAD_SPLITTER", "BAD_HEADER"])
def test_broken_containers(kind):
    with pytest.raises(ContainerError) as problem:
        Container(broken(kind)).read("e")
    assert problem.value.code == kind


def test_zip():
    data = zipped(("a", "1"), ("/b/c.html", "2"), ("__x", "3"), ("d/", ""))
    assert zip_entry(data) == b"1" and zip_entry(data, "/b/c.html") == b"2"
    assert zip_pages(data) == [("a", b"1"), ("b/c.html", b"2")]
    with pytest.raises(ContainerError):
        zip_entry(data, "none")


def test_braces():
    assert braces.parse('﻿{1,"a""b﻿",{2 , 3},-4}\n') == [1, 'a"b', [2, 3], -4]
    assert braces.book_meta(META) == {"name": "lang", "description": 'Language "book"', "tags": ["tag"]}
    assert [(r["id"], r["parent_id"], r["title_en"], r["title_ru"], r["html_path"]) for r in braces.toc_rows(TOC)] == [(1, 0, "Root", "Корень", "root.html"), (2, 1, "Child", "", "a/b.html"), (3, 1, "", "", "")]
    deep = "{" * 5000 + "}" * 5000
    assert len(braces.parse(deep)) == 1
    for text in ("{1", "}", "{x}", "", '{1,"a",{1,1,{"en","d"}},0,1}'):
        with pytest.raises(braces.BraceError):
            braces.book_meta(text)


def test_books(spark, tmp_path):
    (tmp_path / "lang_ru.hbk").write_bytes(write_container(book(), 64))
    (tmp_path / "flat_root.HBK").write_bytes(write_container(book(None)))
    (tmp_path / "bad.hbk").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    found = books.discover(spark, str(tmp_path)).collect()
    assert [(r.file, r.locale) for r in found] == [("bad.hbk", None), ("flat_root.HBK", "en"), ("lang_ru.hbk", "ru")]
    assert [r.file for r in books.discover(spark, str(tmp_path), ["lang_ru"]).collect()] == ["lang_ru.hbk"]
    data = books.contents(spark, [r.path for r in found])
    meta = {r.path.rsplit("/", 1)[-1]: r for r in books.read_meta(data).collect()}
    assert meta["lang_ru.hbk"].name == "lang" and meta["bad.hbk"].error == "BAD_HEADER"
    toc = books.read_toc(data).collect()
    by_file = lambda f: [(r.id, r.parent_id, r.ordinal, r.html_path) for r in toc if r.path.endswith(f) and not r.error]
    assert by_file("lang_ru.hbk") == [(1, None, 0, "root.html"), (2, 1, 0, "a/b.html"), (3, 1, 1, "")]
    assert by_file("flat_root.HBK") == [(1, None, 0, "root.html"), (2, None, 1, "a/b.html")]
    pages = books.read_pages(data).where("error IS NULL").collect()
    assert sorted({(r.html_path, r.html) for r in pages}) == [("a/b.html", "<p>b</p>"), ("root.html", "<p>root</p>")]


def test_records(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("kind\tpath\nenum\ta.html\n")
    assert [tuple(r) for r in records.read_tsv(spark, str(tmp_path / "m.tsv"), ["kind", "path"]).collect()] == [("enum", "a.html")]
    (tmp_path / "r.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert sorted(r.a for r in records.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").where("a IS NOT NULL").collect()) == [1, 2]
    df = spark.createDataFrame([("x", "", [], ["t"])], "name string, note string, tags array<string>, types array<string>")
    records.write_records(df, str(tmp_path / "out"), "types", "en", "root")
    (line,) = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert line == '{"schema_version":11,"locale":"en","source_locale":"root","record_kind":"types","record":{"name":"x","types":["t"]}}'


def test_index_generations(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = lambda n: spark.range(n).selectExpr("concat('part:', id) AS id", "'part' AS kind", "50 AS kind_priority", "'n' AS name_primary", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (x.rsplit(" ", 1) for x in TABLES["documents"].split(", ")[4:])])
    first = index.publish(spark, {"documents": docs(3)}, folder)
    assert index.publish(spark, {"documents": docs(3).repartition(2)}, folder) == first
    old = index.open_index(spark, folder, verify=True)["documents"]
    second = index.publish(spark, {"documents": docs(5)}, folder)
    assert second != first and index.current(spark, folder) == second
    assert old.count() == 3 and index.open_index(spark, folder)["documents"].count() == 5
    assert index.metadata(spark, folder)["generation"] == second
    with pytest.raises(index.IndexFormatError):
        index.publish(spark, {"documents": docs(0)}, folder)
    with pytest.raises(index.IndexFormatError):
        index.publish(spark, {"nothing": docs(1)}, folder)
    assert index.current(spark, folder) == second
