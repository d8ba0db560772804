"""The query surface over an opened index: one method for each command."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.availability import array_mask, available, mask_of
from ..functions.paths import storage_path
from ..functions.values import localized
from ..operators import export, graph, lookup, resolve, search
from ..schemas import TABLES
from ..sources import books
from ..sources.index import open_index, publish
from . import build, extract, provider


class AmbiguousLookup(LookupError):
    """More than one fact where one is needed; candidates holds their ids."""

    def __init__(self, candidates: list[str]):
        super().__init__(", ".join(candidates))
        self.candidates = candidates


class Shelf:
    """The books of a folder: what they hold, their pages, exports, and the index of their facts."""

    def __init__(self, spark: SparkSession, folder: str, include: list[str] | None = None):
        self.spark, self.found = spark, books.discover(spark, folder, include)

    def contents(self) -> DataFrame:
        return books.contents(self.spark, [r.path for r in self.found.select("path").collect()])  # one row a file

    def inspect(self) -> DataFrame:
        """path, name, description, tags, error and locale of each book."""
        return books.read_meta(self.contents()).join(self.found.select("path", "locale", "length"), "path")

    def toc(self, as_json: bool = False) -> DataFrame:
        found = books.read_toc(self.contents())
        return found.select("path", F.to_json(F.struct(*found.columns)).alias("json")) if as_json else found

    def page(self, path: str, html_path: str) -> str | None:
        """The source of one page of a book, None if the book does not have it."""
        one = books.contents(self.spark, path)
        wanted = storage_path(F.lit(html_path))
        row = books.read_pages(one).where(storage_path("html_path") == wanted).select("html").first()
        return row and row.html

    def export(self, kind: str, form: str, folder: str, locale: str = "ru") -> DataFrame:
        """raw/raw: every stored page; markdown/toc: a file for each node. A folder for each book."""
        export.check_format(kind, form)
        pages = books.read_pages(self.contents()).where("error IS NULL")
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        if kind == "raw":
            return export.export_raw(pages.select(F.concat_ws("/", stem, storage_path("html_path")).alias("html_path"), "html"), folder)
        key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "path", F.col(c).cast("string")))
        at = lambda c: F.concat_ws("#", "path", storage_path(c))
        toc = self.toc().where("error IS NULL")
        roots = self.found.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ordinal"), F.regexp_replace("file", r"\.[^.]*$", "").alias("title"), F.lit(None).cast("string").alias("html_path"))
        nodes = toc.select(key("id").alias("id"), F.coalesce(key("parent_id"), "path").alias("parent_id"), F.col("ordinal").cast("int").alias("ordinal"), localized("title_ru", "title_en", locale).alias("title"), at("html_path").alias("html_path"))
        return export.export_markdown(roots.unionByName(nodes), pages.select(at("html_path").alias("html_path"), "html"), folder)

    def records(self, locale: str = "ru") -> tuple[DataFrame, DataFrame]:
        """(records, page diagnostics) of all books."""
        toc = self.toc().where("error IS NULL").select(F.col("path").alias("book"), "id", "parent_id", "ordinal", localized("title_ru", "title_en", locale).alias("title"), "html_path")
        pages = books.read_pages(self.contents()).where("error IS NULL").select(F.col("path").alias("book"), "html_path", "html")
        return extract.records(toc, pages, locale)

    def export_facts(self, folder: str, locale: str = "ru") -> DataFrame:
        """Record files of all families; returns their counts."""
        found, diagnostics = self.records(locale)
        rows, _, _ = build.identified(found)
        return export.export_records(rows, diagnostics, folder, locale, locale)

    def index(self, folder: str, locale: str = "ru") -> FactIndex:
        """Build and publish the index of all books, and open it."""
        tables = build.build(self.records(locale)[0])
        publish(self.spark, {n: t for n, t in tables.items() if n in TABLES}, folder)
        return FactIndex.open(self.spark, folder)


class FactIndex:
    """Lookups, search, graph and reports over the tables of an index."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.t = dict(tables)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, generation: str | None = None) -> FactIndex:
        return cls(open_index(spark, folder, generation))

    # lookups

    def types(self, name: str) -> DataFrame:
        return lookup.types_by_name(self.t["document_names"], self.t["type_identities"], self.t["documents"], name)

    def one_type(self, name: str) -> str:
        found = [r.id for r in self.types(name).select("id").limit(2).collect()]
        if len(found) != 1:
            raise AmbiguousLookup(found) if found else LookupError(name)
        return found[0]

    def get(self, **arguments: str) -> tuple[str, DataFrame | None]:
        """(status, hits) of one lookup; see provider.SHAPES for the arguments. An owner is
        resolved first: if its name is ambiguous, its candidates are returned as such."""
        shape, problem = provider.classify(arguments)
        docs, names = self.t["documents"], self.t["document_names"]
        if problem:
            return "unsupported", None
        if shape == "by_id":
            hits = lookup.by_id(docs, [arguments["id"]])
        elif shape == "by_kind":
            return "ok", lookup.by_kind(docs, arguments["kind"])
        elif shape == "by_name":
            hits = lookup.by_name(names, docs, arguments["name"])
        elif shape == "type_by_name":
            hits = self.types(arguments["type"])
        elif shape == "type_by_template":
            family, _, variant = arguments["template"].partition(".")
            hits = lookup.by_template(self.t["type_templates"], docs, self.t["type_identities"], family, variant)
        elif shape == "in_context":
            asked = docs.sparkSession.createDataFrame([(arguments["name"], arguments["context"])], "q string, c string")
            asked = asked.select(*[F.lower(F.regexp_replace(c, r"(?U)\s+", "")).alias(n) for c, n in (("q", "query"), ("c", "context"))])
            hits = lookup.in_context(names, docs, asked)
        elif shape == "query_table":
            hits = lookup.by_name(names, docs.where("kind = 'query_table'"), arguments["query_table"])
        else:
            owner = arguments.get("owner") or arguments.get("members_of") or arguments["constructors_of"]
            owners = [r.id for r in self.types(owner).select("id").limit(2).collect()]
            if len(owners) > 1:
                return "ambiguous", self.types(owner)
            if not owners:
                if shape != "owner_member":
                    return "not_found", None
                hits = lookup.owner_member(names, docs, owner, arguments["member"])
            elif shape == "owner_member":
                hits = lookup.members_of(self.t["members"], docs, owners[0], arguments["member"])
            elif shape == "constructors":
                hits = lookup.constructors_of(self.t["callables"], docs, owners[0])
            else:
                return "ok", lookup.members_of(self.t["members"], docs, owners[0])
        n = hits.select("id").distinct().limit(2).count()
        return ("not_found" if n == 0 else "ok" if n == 1 else "ambiguous"), hits

    def hydrated(self, hits: DataFrame) -> DataFrame:
        return lookup.hydrate(hits, self.t)

    def available(self, contexts: list[str], mode: str = "any") -> DataFrame:
        mask = array_mask(F.coalesce("availability_contexts", F.array().cast("array<string>")))
        return self.t["documents"].where(available(mask, mask_of(contexts), mode))

    def since(self, document_id: str) -> str | None:
        row = self.t["documents"].where(F.col("id") == document_id).select("available_since").first()
        return row and row[0]

    # search

    def search(self, query: str, mode: str = "keywords", limit: int = 20) -> DataFrame:
        limit = provider.positive(limit)
        if mode == "fuzzy":
            return search.fuzzy(self.t["document_names"], self.t["documents"], query, limit)
        if mode != "keywords":
            raise ValueError(f"unknown search mode {mode!r}")
        stored = (self.t["postings"].withColumnRenamed("document_id", "id"), self.t["document_search"])
        return search.keywords(self.t["documents"], None, query, limit, index=stored)

    # graph

    def root(self, name_or_id: str) -> str:
        hits = lookup.by_id(self.t["documents"], [name_or_id]).select("id").limit(1).collect()
        if not hits:
            hits = lookup.by_name(self.t["document_names"], self.t["documents"], name_or_id).select("id").limit(2).collect()
        if len(hits) != 1:
            raise AmbiguousLookup([r.id for r in hits]) if hits else LookupError(name_or_id)
        return hits[0].id

    def related(self, name_or_id: str, edge: str | None = None, max_depth: int = 1, limit: int = 200) -> DataFrame:
        """Facts that the root leads to; with an edge kind one step of that kind."""
        start = self.root(name_or_id)
        if edge:
            refs = self.t["type_refs"].withColumnsRenamed({"target_type_id": "target_id", "target_type_name": "target_name"})
            return graph.typed_edges(self.t["relations"], refs, self.t["documents"], edge).where(F.col("source_id") == start)
        roots = self.t["relations"].sparkSession.createDataFrame([(start,)], "node string")
        return graph.bfs(self.t["relations"], roots, max_depth, limit=provider.positive(limit)).where("depth > 0")

    def type_graph(self, name_or_id: str, max_depth: int = 2, limit: int = 200) -> DataFrame:
        refs = self.t["type_refs"].withColumnsRenamed({"target_type_id": "target_id", "target_type_name": "target_name"})
        return graph.type_graph(self.t["relations"], refs, self.root(name_or_id), limit, max_depth)

    def owner(self, document_id: str) -> str | None:
        return lookup.owner_of(self.t["members"], self.t["callables"], document_id)

    def target_types(self, document_id: str) -> DataFrame:
        return lookup.target_types(self.t["type_refs"], document_id)

    # reports

    def gap_roles(self) -> DataFrame:
        return resolve.gap_roles(self.t["type_refs"])

    def gap_groups(self, limit: int = 10) -> DataFrame:
        return resolve.gap_groups(self.t["type_refs"], "ref_kind", "target_type_name", "document_id", provider.positive(limit))

    def counts(self) -> DataFrame:
        return self.t["documents"].groupBy("kind").agg(F.count("*").alias("n"))
