"""URL verdicts from a trie over reversed host labels and path segments.

The trie is broadcast up to MAX_RULES rules. More rules are a table; then the same longest
match is found by joining the hosts and path beginnings of a url with it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map

#: Most rules of a trie that is sent to every executor.
MAX_RULES = 500_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first :// up to / ? # or the end, A-Z in lower case) and path (from
    there up to ? # or the end); both empty for null or without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    slash = rest.find("/")
    return (rest, "")[0].translate(LOWER) if slash < 0 else rest[:slash].translate(LOWER), "" if slash < 0 else rest[slash:]


class UrlTrie:
    """Entries (verdict, "host/path"). An entry fits its host and all subdomains if the
    path of the url starts with the entry's path. The longest match wins: first by host
    labels, then by path; of an allow and a block entry of equal text, block wins."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.setdefault(label, {})
            # None leads from a host to its path trie; the last segment is a prefix, the others are exact
            node = node.setdefault(None, {})
            *inner, last = (slash + path).split("/")
            for segment in inner:
                node = node.setdefault(("in", segment), {})
            held = node.get(("end", last))
            if held is None or (verdict != "block", rule) < (held[0] != "block", held[1]):
                node["end", last] = (verdict, rule)
            node.setdefault("lengths", set()).add(len(last))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        nodes, node = [], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if None in node:
                nodes.append(node[None])
        for paths in reversed(nodes):
            found = self._path(paths, path)
            if found:
                return found
        return None

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            for length in sorted(node.get("lengths", ())):
                if length <= len(segment):
                    best = node.get(("end", segment[:length]), best)
            node = node.get(("in", segment))
            if node is None:
                break
        return best


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path as `split_url` gives them, in expressions."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://([^?#]*)", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)/.*$", 0)


def filter_by_join(df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """What `filter_urls` returns, for any number of rules: a table of verdict and rule.

    A url meets the rules by equality of (host or parent domain, beginning of the path); only
    beginnings as long as some rule's path are tried, and rules are unique by that key, so a
    url has at most one row for each host label and path length.
    """
    bad = rules.where("verdict IS NULL OR verdict NOT IN ('allow', 'block') OR rule IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"rule {bad[0]}")
    slash = F.instr("rule", "/")
    keyed = rules.select("verdict", "rule", F.translate(F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("p"))
    # of equal entries block wins, then the smaller spelling
    keyed = materialize(keyed.groupBy("h", "p").agg(F.min(F.struct((F.col("verdict") != "block").alias("o"), "rule", "verdict")).alias("entry")), "url-rules")
    lengths = sorted(r[0] for r in keyed.select(F.length("p")).distinct().collect())  # at most the longest path
    host, path = parts_of(F.coalesce(F.col(url_col), F.lit("")))
    urls = materialize(df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.where("host <> ''").select("row", "path", F.posexplode(hosts).alias("at", "h"))
    tried = tried.select("row", "at", "h", "path", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.col("n") <= F.length("path"))
    tried = tried.select("row", "at", "h", "n", F.expr("substring(path, 1, n)").alias("p"))
    best = tried.join(keyed, ["h", "p"]).groupBy("row").agg(F.max_by("entry", F.struct(-F.col("at"), "n")).alias("entry"))
    found = urls.join(best, "row", "left")
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("entry.rule").alias("rule"), F.coalesce("entry.verdict", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, host, path, rule (null if none fits) and verdict of every row.

    rules: (allow or block, "host/path"), or a DataFrame of verdict and rule. Null urls and
    urls without :// have an empty host and path and get the default verdict. Repeated rows
    are kept one by one; very long urls are read whole, other columns are not. One scan
    without a shuffle, as the trie is broadcast, up to MAX_RULES; beyond, `filter_by_join`
    gives the same rows.
    """
    if isinstance(rules, DataFrame):
        if rules.count() > MAX_RULES:
            return filter_by_join(df, rules, default, id_col, url_col)
        rules = [tuple(r) for r in rules.select("verdict", "rule").collect()]
    elif len(rules) > MAX_RULES:
        return filter_by_join(df, df.sparkSession.createDataFrame(list(rules), "verdict string, rule string"), default, id_col, url_col)
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie, hosts, paths, names, verdicts = shared.value, [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            verdict, name = trie.match(host, path) or (default, None)
            hosts.append(host)
            paths.append(path)
            names.append(name)
            verdicts.append(verdict)
        columns = [pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "host", "path", "rule", "verdict"])

    found = arrow_map(df, [df[id_col].alias("id"), df[url_col].alias("url")], f"id {kind}, host string, path string, rule string, verdict string", per_slice, rows=4096)
    return found.withColumnRenamed("id", id_col)
