"""Ranked keyword search and bounded fuzzy search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_distance, fuzzy_threshold, normalize_key, query_terms, relation_tier, searchable_line, searchable_name, tokens
from ..session import materialize

K1, B = 1.2, 0.75


def postings(documents: DataFrame, text: Column | str, id_col: str = "id") -> DataFrame:
    """(token, id, tf, length) of every document, the stored form for repeated searches:
    in ranges of (token, id), so that a search reads the row groups of its words only, and
    a frequent word lies in many of them."""
    words = documents.select(F.col(id_col).alias("id"), tokens(text).alias("t"))
    each = words.select("id", F.size("t").alias("length"), F.explode("t").alias("token"))
    counted = each.groupBy("token", "id").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"))
    return counted.repartitionByRange("token", "id").sortWithinPartitions("token", "id")


def lengths(documents: DataFrame, text: Column | str, id_col: str = "id") -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.size(tokens(text)).alias("length"))


def counted(documents: DataFrame, text: Column | str, terms: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, length, tf0, tf1 ...) by one pass over the texts: each is normalized once, then
    its words, and those that begin with a term, are counted in it."""
    count = lambda line, pattern: F.regexp_count(line, F.lit(pattern))
    one = lambda line: F.struct(count(line, "[^ ]+").alias("length"), *[count(line, f"(?:^| ){re.escape(t)}").alias(f"tf{i}") for i, t in enumerate(terms)])
    bound = F.element_at(F.transform(F.array(searchable_line(text)), one), 1)
    return materialize(documents.select(F.col(id_col).alias("id"), bound.alias("c")).select("id", "c.*"), "term-counts")


def counted_from(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, length, tf0, tf1 ...) of the documents that hold a term, from stored postings;
    the beginnings of tokens are pushed to the scan."""
    begins = [F.startswith(F.col("token"), F.lit(t)) for t in terms]
    held = index.where(reduce(or_, begins))
    return held.groupBy("id").agg(F.first("length").alias("length"), *[F.sum(F.when(b, F.col("tf")).otherwise(0)).cast("int").alias(f"tf{i}") for i, b in enumerate(begins)])


def bm25(found: DataFrame, n: int, mean: float, n_terms: int) -> DataFrame:
    """(id, length, score) of the documents (id, length, tf0 ...) that hold a term, of `n`
    documents of `mean` length in all; lower scores are better."""
    held = found.where(" OR ".join(f"tf{i} > 0" for i in range(n_terms)))
    df_ = held.agg(*[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(n_terms)]).first()
    total = F.lit(0.0)
    for i in range(n_terms):
        df, tf = F.lit(df_[f"df{i}"] or 0), F.col(f"tf{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / (mean or 1.0)))
    return held.select("id", "length", (-total).alias("score"))


def keywords(
    documents: DataFrame,
    text: Column | str | None,
    query: str,
    limit: int = 20,
    id_col: str = "id",
    name: str = "name_primary",
    alias: str = "name_alias",
    owner: str = "owner_primary",
    owner_alias: str = "owner_alias",
    priority: str = "kind_priority",
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Keyword hits with score, tier and rank: the best max(10 * limit, 50) by (score,
    priority, id), reranked by how the query relates to the names, then cut to `limit`.

    The words come from the column `text`, or from `index`, the stored (postings, lengths).
    An owner is compared in the form it is shown in, `primary (alias)`. The score is in millionths, cut to an
    integer.
    """
    terms = query_terms(query)
    if not terms:
        scored = documents.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    else:
        found = counted(documents, text, terms, id_col) if index is None else materialize(counted_from(index[0], terms), "term-counts")
        n, mean = (found if index is None else index[1]).agg(F.count("*"), F.avg("length")).first()
        scored = bm25(found, n, mean, len(terms))
    shown = F.col(owner)
    if owner_alias in documents.columns:
        shown = F.when(F.trim(F.col(owner_alias)) != "", F.concat(owner, F.lit(" ("), owner_alias, F.lit(")"))).otherwise(shown)
    member = F.when(F.col(owner).isNotNull(), searchable_name(F.concat_ws(".", shown, F.col(name))))
    tier = relation_tier(query, searchable_name(name), searchable_name(alias), member, F.col(priority))
    scored = scored.select("id", (F.col("score") * 1_000_000).cast("long").alias("score")).join(documents.select(F.col(id_col).alias("id"), F.col(priority).alias("__priority"), tier.alias("__tier")), "id")
    window = scored.orderBy("score", "__priority", "id").limit(max(10 * limit, 50))
    ranked = window.orderBy("__tier", "score", "id").limit(limit)
    return ranked.select("id", "score", F.col("__tier.tier").alias("tier"))


def fuzzy(names: DataFrame, documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Documents within the edit distance that the query's length tolerates.

    Candidates are documents with a name key that begins with the query's first four
    characters, the first 20 * limit by (priority, id); then by (distance, kind, id).
    documents: id, kind, kind_priority, name_primary, name_alias, owner_primary.
    """
    key = "".join(query.split()).lower()
    prefix = names.where(F.startswith(F.col("key"), F.lit(key[:4]))).select(F.col("document_id").alias("id")).distinct()
    window = prefix.join(documents, "id").orderBy("kind_priority", "id").limit(20 * limit)
    keys = [normalize_key("name_primary"), normalize_key("name_alias")]
    owned = [F.when(F.col("owner_primary").isNotNull(), normalize_key(F.concat(F.col("owner_primary"), F.lit("."), F.col(n)))) for n in ("name_primary", "name_alias")]
    scored = window.withColumn("distance", fuzzy_distance(F.lit(key), keys + owned))
    return scored.where(F.col("distance") <= fuzzy_threshold(key)).orderBy("distance", "kind", "id").limit(limit)


def search(mode: str, **arguments) -> DataFrame:
    if mode not in ("keywords", "fuzzy"):
        raise ValueError(f"unknown search mode {mode!r}")
    return keywords(**arguments) if mode == "keywords" else fuzzy(**arguments)
