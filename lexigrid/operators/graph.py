"""Typed edges: derivation, neighbours and bounded traversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GRAPH_ROOT_KINDS
from ..session import materialize

#: Weight of each edge kind; smaller ones are visited first.
WEIGHTS = {"owns": 10, "has_type": 12, "returns": 12, "constructs": 15, "member_of": 20}
MAX_DEPTH = 5
EDGE = "source_id string, target_id string, edge_kind string, label string, weight int"


def edge(source, target, kind: str, label=None) -> list:
    return [source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_kind"), (F.lit(None) if label is None else label).cast("string").alias("label"), F.lit(WEIGHTS[kind]).alias("weight")]


def first_edges(edges: DataFrame, seq: str | None = None) -> DataFrame:
    """One edge for each (source, target, kind), the first by `seq` (by label without one)."""
    order = F.struct(F.col(seq)) if seq else F.struct(F.coalesce("label", F.lit("")))
    return edges.groupBy("source_id", "target_id", "edge_kind").agg(F.min_by("label", order).alias("label"), F.min("weight").alias("weight"))


def derive(owned: DataFrame, references: DataFrame) -> DataFrame:
    """The edge list.

    owned: id, owner_id, kind. An owner owns its parts, they are members of it, and a
    constructor constructs it. references: document_id, ref_kind, target_id, target_name,
    status; only references with one target make edges: return types `returns`, others
    `has_type`.
    """
    parts = owned.where("owner_id IS NOT NULL")
    known = references.where("status = 'ok' AND target_id IS NOT NULL")
    gives = known.where("ref_kind IN ('return_type', 'constructor_result')")
    types = known.where("ref_kind NOT IN ('return_type', 'constructor_result')")
    found = parts.select(*edge(F.col("owner_id"), F.col("id"), "owns"))
    found = found.union(parts.select(*edge(F.col("id"), F.col("owner_id"), "member_of")))
    found = found.union(parts.where("kind = 'constructor'").select(*edge(F.col("id"), F.col("owner_id"), "constructs")))
    found = found.union(types.select(*edge(F.col("document_id"), F.col("target_id"), "has_type", F.col("target_name"))))
    found = found.union(gives.select(*edge(F.col("document_id"), F.col("target_id"), "returns", F.col("target_name"))))
    return first_edges(found)


def neighbours(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("source_id") == node)
    if kind:
        return found.where(F.col("edge_kind") == kind).orderBy("weight", "target_id")
    return found.orderBy("weight", "edge_kind", "target_id")


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, kinds: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """node, depth, parent, path (kinds and nodes on the way) of what the roots (a column
    node) reach in at most min(max_depth, 5) steps; roots have depth 0.

    A node is visited once, from the parent that was visited first; the order of visits is
    (parent's order, weight, edge kind, target). Each level is written to the shared folder,
    so the plan does not grow with the depth. With `limit`, visits (roots not counted) stop
    at that many in visit order. The order is a sortable array and needs no global numbering.
    """
    steps = edges.where(F.col("edge_kind").isin(*kinds)) if kinds else edges
    steps = materialize(steps.select("source_id", "target_id", "edge_kind", "weight"), "steps")
    start = roots.select("node").distinct()
    level = materialize(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<struct<kind:string,node:string>>").alias("path"), F.array("node").alias("visit")), "bfs")
    seen = level
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        out = level.join(steps, level["node"] == steps["source_id"]).where("target_id IS NOT NULL")
        visit = F.concat("visit", F.array(F.lpad(F.col("weight").cast("string"), 10, "0"), "edge_kind", "target_id"))
        row = F.struct(visit.alias("visit"), F.col("node").alias("parent"), F.array_append("path", F.struct(F.col("edge_kind").alias("kind"), F.col("target_id").alias("node"))).alias("path"))
        first = out.groupBy(F.col("target_id").alias("node")).agg(F.min_by(row, visit).alias("r"))
        fresh = first.join(seen.select("node"), "node", "left_anti")
        level = materialize(fresh.select("node", F.lit(depth).alias("depth"), "r.parent", "r.path", "r.visit"), "bfs")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if limit is not None:
        hits = seen.where("depth > 0").orderBy("depth", "visit").limit(limit)
        seen = seen.where("depth = 0").unionByName(hits)
    return seen


def typed_edges(edges: DataFrame, references: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """One-hop edges of a kind for all documents: those of the reference table first; for
    language documents and query fields and parameters without such references, the edge
    list instead.

    references: document_id, ref_kind, ordinal, target_id, target_name, status.
    """
    if kind not in ("has_type", "returns", "constructs", "member_of"):
        raise ValueError(f"edge kind {kind!r} cannot be asked for")
    by_kind = {"returns": F.col("ref_kind") == "return_type", "constructs": F.col("ref_kind") == "constructor_result", "has_type": ~F.col("ref_kind").isin("return_type", "constructor_result", "extends"), "member_of": F.lit(False)}
    direct = references.where(by_kind[kind] & F.col("target_id").isNotNull())
    direct = direct.select(F.col("document_id").alias("source_id"), "target_id", F.col("target_name").alias("label"), F.col("ordinal").cast("int").alias("ordinal"))
    falls = documents.where(F.startswith(F.col("kind"), F.lit("language_")) | F.col("kind").isin("query_field", "query_parameter") | F.lit(kind == "member_of"))
    other = edges.where(F.col("edge_kind") == kind).join(falls.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    other = other.join(direct.select("source_id").distinct(), "source_id", "left_anti")
    return direct.unionByName(other.select("source_id", "target_id", "label", F.col("weight").alias("ordinal")))


def graph_root_problem(documents: DataFrame, root: str) -> str | None:
    """Why a document cannot be the root of a type graph, None if it can."""
    found = documents.where(F.col("id") == root).select("kind").first()
    if found is None:
        return "ROOT_NOT_FOUND"
    return None if found.kind in GRAPH_ROOT_KINDS else "ROOT_IS_NO_TYPE"


def type_graph(edges: DataFrame, references: DataFrame, root: str, limit: int = 200, max_depth: int = 2) -> DataFrame:
    """node, depth and the type references of the root and its first limit - 1 hits."""
    roots = edges.sparkSession.createDataFrame([(root,)], "node string")
    nodes = bfs(edges, roots, max_depth, limit=limit - 1).select("node", "depth", "parent")
    refs = references.join(nodes.select(F.col("node").alias("document_id")), "document_id", "left_semi")
    refs = refs.groupBy(F.col("document_id").alias("node")).agg(F.array_sort(F.collect_list(F.struct("target_name", "status", "target_id"))).alias("type_references"))
    return nodes.join(refs, "node", "left")


def ancestors(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) up the owner links (id, parent_id) of the given nodes, to
    any depth. A node meets an ancestor once and never itself, so that cycles end; they
    are told by `owner_cycles`."""
    return _up(parents, nodes).where("node <> ancestor")


def owner_cycles(parents: DataFrame) -> DataFrame:
    """(code, id) of the nodes that are their own ancestors."""
    found = _up(parents, parents.where("parent_id IS NOT NULL").select(F.col("id").alias("node")))
    return found.where("node = ancestor").select(F.lit("OWNER_CYCLE").alias("code"), F.col("node").alias("id"))


def _up(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    up = materialize(parents.where("parent_id IS NOT NULL").select(F.col("id").alias("at"), F.col("parent_id").alias("next")), "owners")
    level = materialize(nodes.select("node").distinct().join(up, F.col("node") == F.col("at")).select("node", F.col("next").alias("ancestor"), F.lit(1).alias("distance")).dropDuplicates(["node", "ancestor"]), "ancestors")
    found, distance = level, 1
    while not level.isEmpty():
        distance += 1
        step = level.join(up, level["ancestor"] == up["at"]).select("node", F.col("next").alias("ancestor"), F.lit(distance).alias("distance")).dropDuplicates(["node", "ancestor"])
        level = materialize(step.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "ancestors")
        found = found.unionByName(level)
    return found
