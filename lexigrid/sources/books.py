"""Help books as DataFrames: one binaryFile scan, parsed in Arrow batches.

A broken book gives a row with an error code, never a failed job.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import locale_of
from .braces import BraceError, book_meta, toc_rows
from .container import Container, ContainerError, zip_entry, zip_pages

#: Entity names of a book.
META, TOC, STORAGE = "Book", "PackBlock", "FileStorage"


def discover(spark: SparkSession, folder: str, include: Sequence[str] | None = None) -> DataFrame:
    """path, file, stem, locale, length of the book files (extension in any case) of a folder,
    by file name, then path; the content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[hH][bB][kK]").load(folder).select("path", "length")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    if include is not None:
        files = files.where(F.col("file").isin(*include) | F.col("stem").isin(*include))
    return files.withColumn("locale", locale_of("stem")).orderBy("file", "path")


def contents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")


def read_meta(books: DataFrame) -> DataFrame:
    """path, name, description, tags, error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"path": path, "name": None, "description": None, "tags": None, "error": None}
                try:
                    row |= book_meta(Container(data).read(META).decode("utf-8-sig"))
                except (ContainerError, BraceError, UnicodeDecodeError) as problem:
                    row["error"] = getattr(problem, "code", type(problem).__name__)
                rows.append(row)
            yield _batch(rows, [("path", pa.string()), ("name", pa.string()), ("description", pa.string()), ("tags", pa.list_(pa.string())), ("error", pa.string())])

    return books.select("path", "content").mapInArrow(run, "path string, name string, description string, tags array<string>, error string")


def read_toc(books: DataFrame) -> DataFrame:
    """path, id, parent_id (null at the root), seq, ordinal (among its siblings), title_en,
    title_ru, html_path, error. A book without a packed table has a flat page for each file."""
    names = ["id", "parent_id", "seq", "ordinal", "title_en", "title_ru", "html_path"]
    kinds = [("path", pa.string())] + [(n, pa.int64()) for n in names[:4]] + [(n, pa.string()) for n in names[4:]] + [("error", pa.string())]

    def rows_of(data: bytes) -> list[dict]:
        book = Container(data)
        try:
            rows = toc_rows(zip_entry(book.read(TOC)).decode("utf-8-sig"))
        except ContainerError as problem:
            if problem.code != "ENTITY_HAS_NO_BODY":
                raise
            pages = [p for p, _ in zip_pages(book.read(STORAGE))]
            rows = [{"id": i + 1, "parent_id": 0, "seq": i, "title_en": "", "title_ru": "", "html_path": p} for i, p in enumerate(pages)]
        counts: dict[int, int] = {}
        for row in rows:
            row["ordinal"] = counts.get(row["parent_id"], 0)
            counts[row["parent_id"]] = row["ordinal"] + 1
            row["parent_id"] = row["parent_id"] or None
        return rows

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"path": path, "error": None} | r for r in rows_of(data)]
                except (ContainerError, BraceError, UnicodeDecodeError) as problem:
                    rows = [dict.fromkeys(n for n, _ in kinds) | {"path": path, "error": getattr(problem, "code", type(problem).__name__)}]
                yield _batch(rows, kinds)

    schema = "path string, id long, parent_id long, seq long, ordinal long, title_en string, title_ru string, html_path string, error string"
    return books.select("path", "content").mapInArrow(run, schema)


def read_pages(books: DataFrame) -> DataFrame:
    """path, html_path, html, error: a row for each stored page, a book's pages in portions."""
    kinds = [("path", pa.string()), ("html_path", pa.string()), ("html", pa.string()), ("error", pa.string())]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = zip_pages(Container(data).read(STORAGE))
                except ContainerError as problem:
                    yield _batch([{"path": path, "html_path": None, "html": None, "error": problem.code}], kinds)
                    continue
                for i in range(0, len(pages), 256):
                    yield _batch([{"path": path, "html_path": n, "html": body.decode("utf-8-sig", "replace"), "error": None} for n, body in pages[i : i + 256]], kinds)

    return books.select("path", "content").mapInArrow(run, "path string, html_path string, html string, error string")


def _batch(rows: list[dict], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds], [n for n, _ in kinds])
