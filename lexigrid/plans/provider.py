"""Provider answers: query shapes, status and the envelope."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE_VERSION = 1
#: Lookup shapes by the arguments that are given.
SHAPES = {
    frozenset({"id"}): "by_id",
    frozenset({"kind"}): "by_kind",
    frozenset({"name"}): "by_name",
    frozenset({"type"}): "type_by_name",
    frozenset({"template"}): "type_by_template",
    frozenset({"owner", "member"}): "owner_member",
    frozenset({"members_of"}): "member_list",
    frozenset({"constructors_of"}): "constructors",
    frozenset({"query_table"}): "query_table",
    frozenset({"name", "context"}): "in_context",
}


def classify(arguments: Mapping[str, str | None]) -> tuple[str, str | None]:
    """(shape, None), or (unsupported, what is wrong) unless the arguments name one shape."""
    given = frozenset(k for k, v in arguments.items() if v is not None and v.strip())
    if given in SHAPES:
        return SHAPES[given], None
    return "unsupported", "one lookup is needed" if not given else f"arguments do not go together: {', '.join(sorted(given))}"


def status_of(count: Column | int, command: str) -> Column:
    """member lists and searches are ok however many rows they have; a get of none is
    not_found, of one ok, of more ambiguous."""
    n = F.lit(count) if isinstance(count, int) else count
    if command in ("member_list", "search"):
        return F.lit("ok")
    return F.when(n == 0, "not_found").when((n > 1) & F.lit(command == "get"), "ambiguous").otherwise("ok")


def envelope(hits: DataFrame, command: str, query: Mapping[str, str]) -> DataFrame:
    """One row {schema_version, command, status, query, results, diagnostics}. A get that is
    ambiguous has no results; its candidates go to the diagnostics."""
    rows = F.collect_list(F.struct(F.col("rank"), *[c for c in hits.columns if c != "rank"]))
    found = hits.agg(F.array_sort(rows).alias("rows"))
    many = status_of(F.size("rows"), command)
    ids = F.transform("rows", lambda r: r["id"])
    return found.select(
        F.lit(ENVELOPE_VERSION).alias("schema_version"),
        F.lit(command).alias("command"),
        many.alias("status"),
        F.create_map(*[F.lit(x) for pair in query.items() for x in pair]).alias("query") if query else F.lit(None).cast("map<string,string>").alias("query"),
        F.when(many != "ambiguous", F.col("rows")).otherwise(F.slice("rows", 1, 0)).alias("results"),
        F.when(many == "ambiguous", F.array(F.struct(F.lit("AMBIGUOUS_LOOKUP").alias("code"), ids.alias("candidates")))).otherwise(F.array().cast("array<struct<code:string,candidates:array<string>>>")).alias("diagnostics"),
    )


def ranked(hits: DataFrame, *order: Column | str) -> DataFrame:
    """hits with rank from 1 in the given order; for the few rows of an answer."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def to_json(answer: DataFrame) -> DataFrame:
    return answer.select(F.to_json(F.struct(*answer.columns)).alias("json"))


def text_lines(hits: DataFrame) -> DataFrame:
    """`kind id name (alias)` lines of hits."""
    alias = F.when(F.col("name_alias").isNotNull(), F.concat(F.lit(" ("), "name_alias", F.lit(")"))).otherwise("")
    return hits.select(F.concat(F.rpad("kind", 20, " "), F.lit(" "), "id", F.lit(" "), "name_primary", alias).alias("line"))


def related_lines(hits: DataFrame) -> DataFrame:
    """`depth edge kind id` lines of what a root leads to (graph.bfs)."""
    step = F.coalesce(F.try_element_at("path", F.lit(-1))["kind"], F.lit(""))
    return hits.select(F.concat_ws(" ", F.col("depth").cast("string"), F.rpad(step, 10, " "), "node").alias("line"))


def constructor_lines(hits: DataFrame, signatures: DataFrame) -> DataFrame:
    """The signatures of constructors, in order; hits: id; signatures: callable_id, ordinal, title."""
    return hits.join(signatures, F.col("id") == F.col("callable_id")).orderBy("id", "ordinal").select(F.col("title").alias("line"))


def gap_lines(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """The gap report: totals by role, then the most frequent gaps."""
    total = roles.select(F.concat(F.rpad(F.coalesce("role", F.lit("total")), 24, " "), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("total", "resolved", "unresolved", "ambiguous", "with_binding")])).alias("line"))
    return total.unionByName(groups.select(F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 8, " "), "role", "target_name").alias("line")))


def compact(documents: DataFrame) -> DataFrame:
    return documents.select("id", "kind", "name_primary", "name_alias")


def positive(value: str | int, name: str = "limit") -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a positive number: {value!r}") from None
    if number < 1:
        raise ValueError(f"{name} must be a positive number: {value!r}")
    return number
