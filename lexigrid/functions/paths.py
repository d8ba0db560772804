"""Page paths, links and slugs as Column functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse


def url_path(url: Column | str) -> Column:
    """Path of a url or path, without scheme, host, query and fragment; / if it has none."""
    bare = F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.when(bare == "", "/").otherwise(bare)


def page_key(path: Column | str) -> Column:
    """Last segment of a path without .html or .htm."""
    return F.regexp_replace(F.element_at(F.split(url_path(path), "/"), -1), r"\.html?$", "")


def storage_path(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "^/+", "")


def fold(path: Column | str) -> Column:
    """Segments joined by /, with . and empty ones dropped and .. resolved; null if .. leads
    above the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("under"))

    def step(acc: Column, seg: Column) -> Column:
        up = seg == ".."
        empty = F.size(acc["parts"]) == 0
        parts = (
            F.when((seg == "") | (seg == "."), acc["parts"])
            .when(up, F.when(empty, acc["parts"]).otherwise(F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))))
            .otherwise(F.array_append(acc["parts"], seg))
        )
        return F.struct(parts.alias("parts"), (acc["under"] | (up & empty)).alias("under"))

    return F.aggregate(F.split(col(path), "/"), start, step, lambda acc: F.when(~acc["under"], F.array_join(acc["parts"], "/")))


def normalize_link(href: Column | str, current: Column | str) -> Column:
    """Folded storage path that a link on the page `current` leads to.

    Null for empty links, foreign schemes and paths above the root; a fragment alone is the
    page itself; query and fragment are cut; a relative path starts in the page's folder.
    """
    link, here = F.trim(col(href)), storage_path(current)
    bare = F.regexp_extract(link, "^([^?#]*)", 1)
    folder = F.regexp_replace(here, "[^/]*$", "")
    target = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(F.startswith(link, F.lit("#")), fold(here))
        .when(F.contains(bare, F.lit(":")), None)
        .when(bare == "", fold(here))
        .otherwise(fold(target))
    )


def relative_link(source: Column | str, target: Column | str) -> Column:
    """Relative path from the file `source` to the file `target`: their common folders are
    left out, one .. for each folder of the source that is not shared."""
    a, b = F.split(col(source), "/"), F.split(col(target), "/")
    shorter = F.least(F.size(a), F.size(b)) - 1  # folders only
    same = F.aggregate(
        F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))),
        F.lit(0),
        lambda n, i: F.when((n == i) & (i < shorter) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n),
    )
    ups = F.array_repeat(F.lit(".."), F.size(a) - 1 - same)
    return F.array_join(F.concat(ups, F.slice(b, same + 1, F.size(b) - same)), "/")


def slug(title: Column | str) -> Column:
    """Path segment of a title: letters and digits in lower case, runs of others become one
    dash, `page` if nothing is left."""
    dashed = F.lower(F.regexp_replace(col(title), r"[^\p{L}\p{N}]+", "-"))
    bare = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(bare == "", "page").otherwise(bare)


def same_page_fragment(href: Column | str, page: Column | str) -> Column:
    """`page#x` on the page itself becomes `#x`."""
    return F.when(F.startswith(col(href), F.concat(col(page), F.lit("#"))), F.regexp_extract(col(href), "(#.*)$", 1)).otherwise(col(href))


def book_link_ids(stem: Column | str, name: Column | str) -> Column:
    """Names that links may use for a book: its stem, the stem without locale suffix, its name."""
    return F.array_distinct(F.array_compact(F.array(col(stem), F.regexp_replace(col(stem), "_[A-Za-z]+$", ""), col(name))))


def locale_of(stem: Column | str) -> Column:
    """Locale from a file stem: _root is en, else the text behind the last underscore."""
    suffix = F.regexp_extract(col(stem), "_([A-Za-z0-9-]+)$", 1)
    return F.when(suffix == "root", "en").when(suffix == "", None).otherwise(suffix)


def valid_locale(code: Column | str) -> Column:
    return F.rlike(col(code), F.lit("^[A-Za-z0-9_-]+$"))


def display_title(title: Column | str) -> Column:
    return F.coalesce(F.nullif(collapse(title), F.lit("")), F.lit("Untitled"))


def fnv1a64(text: str) -> int:
    """64-bit FNV-1a of the UTF-8 bytes."""
    value = 0xCBF29CE484222325
    for byte in text.encode():
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def stable_id(*parts: Column | str) -> Column:
    """16 hex digits of the FNV-1a hash of the parts joined by |. Arrow-batched: the hash
    multiplies modulo 2**64, which SQL arithmetic does not."""
    def hashes(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{fnv1a64(v):016x}" for v in values.to_pylist()], pa.string())

    joined = F.concat_ws("|", *map(col, parts))
    run: Callable = F.arrow_udf(hashes, "string")
    return run(joined)
