"""Exports: safe file plans, Markdown books, and the site of many books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import display_title, slug, stable_id
from ..sources.records import write_records
from .identity import first_of, unique_segments
from .pages import render_markdown
from .tree import attach, flatten

FORMATS = {("raw", "raw"), ("markdown", "toc")}


class UnsafePath(ValueError):
    """A path that cannot be a file below the folder of an export."""


def check_format(kind: str, layout: str) -> None:
    if (kind, layout) not in FORMATS:
        raise ValueError(f"{kind} cannot be exported as {layout}")


def plan_files(pages: DataFrame, path: str = "html_path") -> DataFrame:
    """pages with problem: why a page's path cannot be a file, null if it can.

    Absolute, with a drive, a backslash, `..` or empty: refused; a path that occurs twice, or
    that another path uses as a folder, collides. Folders are compared with files by a join
    on the exploded prefixes of each path.
    """
    p = F.col(path)
    own = (
        F.when(p.isNull() | (F.trim(p) == ""), "EMPTY_PATH")
        .when(F.startswith(p, F.lit("/")), "ABSOLUTE_PATH")
        .when(F.rlike(p, F.lit("^[A-Za-z]:")), "DRIVE_PATH")
        .when(F.contains(p, F.lit("\\")), "BACKSLASH")
        .when(F.array_contains(F.split(p, "/"), ".."), "PARENT_SEGMENT")
    )
    counts = pages.groupBy(p.alias("__p")).agg(F.count("*").alias("__n"))
    parts = F.split("__f", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = pages.select(p.alias("__f")).where(F.size(parts) > 1).select(F.explode(prefixes).alias("__d")).distinct()
    found = pages.join(counts, p == F.col("__p"), "left").join(folders, p == F.col("__d"), "left")
    clash = F.when(F.col("__n") > 1, "DUPLICATE_PATH").when(F.col("__d").isNotNull(), "FILE_IS_FOLDER")
    return found.withColumn("problem", F.coalesce(own, clash)).drop("__p", "__n", "__d")


def title_files(nodes: DataFrame, title: str = "title") -> DataFrame:
    """nodes (id, parent_id, ordinal, title) with file: the folders of the titles from the
    root, unique among siblings, and index.md."""
    named = unique_segments(nodes.withColumn("__base", slug(display_title(F.col(title)))), "parent_id", "__base", "ordinal").drop("__base")
    flat = flatten(named.select("id", "parent_id", "ordinal", title, "segment"))
    chain = flat.select("id", F.posexplode(F.array_append("ancestors", F.col("id").cast("string"))).alias("o", "a"))
    segments = named.select(F.col("id").cast("string").alias("a"), "segment")
    joined = chain.join(segments, "a").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "segment"))).alias("s"))
    return nodes.join(joined.select("id", F.concat(F.array_join(F.transform("s", lambda x: x["segment"]), "/"), F.lit("/index.md")).alias("file")), "id")


def write_files(df: DataFrame, folder: str, path: str = "file", content: str = "markdown") -> None:
    """One file for each row, written by the executors to a folder that all of them mount.
    Nothing is written if `plan_files` finds a problem with any path."""
    planned = plan_files(df.select(path, content), path)
    bad = planned.where("problem IS NOT NULL").select(path, "problem").orderBy(path).limit(5).collect()
    if bad:
        raise UnsafePath("; ".join(f"{r.problem}: {r[0]}" for r in bad))
    rows = planned.select(path, content)
    base = folder.rstrip("/")
    if not base.startswith("file:") and "://" in base:
        raise ValueError("single files are written to a mounted folder; other stores take write_site")
    local = base.removeprefix("file://").removeprefix("file:")

    def put(part):
        import os

        for name, text in part:
            full = os.path.join(local, name)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as out:
                out.write(text)

    rows.foreachPartition(put)


def export_raw(pages: DataFrame, folder: str) -> DataFrame:
    """Every stored page under its own path; returns path, bytes and sha256 of the files.
    pages: html_path, html."""
    write_files(pages, folder, "html_path", "html")
    return artifacts(pages, "html_path", "html")


def artifacts(files: DataFrame, path: str = "file", content: str = "markdown") -> DataFrame:
    """path, bytes and sha256 of the content of each file."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


#: Files of a record export, (file, record kind of the file, kind of its records).
FAMILIES = (
    ("global-methods", "global_method", "global_method"),
    ("global-properties", "global_property", "global_property"),
    ("module-events", "module_event", "module_event"),
    ("type-events", "type_event", "type_event"),
    ("unknown-events", "unknown_event", "event"),
    ("platform-types", "platform_type", "platform_type"),
    ("type-methods", "type_method", "method"),
    ("type-properties", "type_property", "property"),
    ("query-tables", "query_table", "query_table"),
    ("constructors", "constructor", "constructor"),
    ("enums", "enum", "enum"),
    ("diagnostics", "diagnostic", None),
)


def record_families(records: DataFrame, diagnostics: DataFrame) -> dict[str, DataFrame]:
    """The rows of each file of FAMILIES: identified records by kind; enums with their values and
    query tables with their fields and parameters, by owner identity, the first of an id.
    Parts of no known owner are left to the diagnostics."""
    own = [c for c in records.columns if c not in ("kind", "seq", "kind_priority", "owner_id")]
    part = lambda kind: records.where((F.col("kind") == kind) & F.col("owner_id").isNotNull()).select("owner_id", "seq", "id", "name_primary", "name_alias", "type_refs", "description", "note", "default_value")
    found = {}
    for file, _, kind in FAMILIES:
        if kind is None:
            found[file] = diagnostics
            continue
        rows = records.where(F.col("kind") == kind)
        if kind in ("enum", "query_table"):
            rows = first_of(rows, ["id"], [F.col("seq")])
            for name, owned in (("values", "enum_value"),) if kind == "enum" else (("fields", "query_field"), ("parameters", "query_parameter")):
                rows = attach(rows.withColumn("__id", F.col("id")), part(owned).withColumnRenamed("owner_id", "__id"), "__id", name).drop("__id")
            own_now = [*own, *[c for c in rows.columns if c in ("values", "fields", "parameters")]]
        else:
            own_now = own
        found[file] = rows.select(*own_now)
    return found


def export_records(records: DataFrame, diagnostics: DataFrame, folder: str, locale: str, source_locale: str) -> DataFrame:
    """Write every family as record lines, and metadata (file, record_kind, n), which is
    returned. Each family is written under Spark's commit protocol: no partial files."""
    base, counts = folder.rstrip("/"), None
    for file, kind, _ in FAMILIES:
        rows = record_families(records, diagnostics)[file]
        write_records(rows, f"{base}/{file}", kind, locale, source_locale)
        n = rows.agg(F.count("*").alias("n")).select(F.lit(file).alias("file"), F.lit(kind).alias("record_kind"), "n")
        counts = n if counts is None else counts.unionByName(n)
    counts.coalesce(1).write.mode("overwrite").json(f"{base}/metadata")
    return records.sparkSession.read.schema("file string, record_kind string, n long").json(f"{base}/metadata")


def export_markdown(nodes: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """One index.md for each node of the table of contents; a node without a page is a
    heading. nodes: id, parent_id, ordinal, title, html_path; pages: html_path, html."""
    planned = title_files(nodes).join(pages.select("html_path", "html").dropDuplicates(["html_path"]), "html_path", "left")
    rendered = render_markdown(planned, "id", "html", "title").join(planned.select("id", "file"), "id")
    write_files(rendered, folder)
    return rendered


def site_tables(merged: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """Artifacts of a site from tree.merge_books and pages (locale, page_key, markdown):
    manifest counts, nodes with stable ids, pages with stable ids."""
    nodes = merged.withColumn("node_id", stable_id("locale", F.array_join("node_path", "/"))).withColumn("parent_id", F.when(F.size("parent_path") > 0, stable_id("locale", F.array_join("parent_path", "/"))))
    keyed = pages.withColumn("page_id", stable_id("locale", "page_key"))
    manifest = nodes.groupBy("locale").agg(F.count("*").alias("nodes"), F.count("page_key").alias("pages"), F.max("books").alias("books"))
    children = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    return {"manifest": manifest, "nodes": nodes.join(children, "node_id", "left").na.fill(0, ["children"]), "pages": keyed}


def site_sections(nodes: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
    """The tables of contents of a site: `root`, the nodes of less than `depth` levels, and
    `sections`, all others with the section (node at `depth` - 1) that they are loaded with,
    and how many nodes each section has."""
    level = F.size("parent_path")
    owner = F.when(level >= depth, stable_id("locale", F.array_join(F.slice("node_path", 1, depth), "/")))
    placed = nodes.withColumn("section_id", owner)
    sections = placed.where("section_id IS NOT NULL")
    sizes = sections.groupBy("locale", "section_id").agg(F.count("*").alias("section_nodes"))
    root = placed.where("section_id IS NULL").drop("section_id")
    root = root.join(sizes.withColumnRenamed("section_id", "node_id"), ["locale", "node_id"], "left").na.fill(0, ["section_nodes"])
    return {"root": root, "sections": sections}


def write_site(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON lines by locale for each artifact."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("locale").json(f"{folder.rstrip('/')}/{name}")
