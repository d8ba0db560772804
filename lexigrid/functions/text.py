"""Name keys and search text as Column functions (all stay in the JVM)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the \s of the regex dialects differs on VT and on non-ASCII blanks.
BLANK = r"[ \t\n\x0B\f\r]"
#: A query word that is looked up under further words as well.
SYNONYMS = {"скд": ("система", "компоновки", "данных", "компоновка", "data", "composition")}


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_key(value: Column | str) -> Column:
    """Lookup key of a name: no white space of any kind, lower case."""
    return F.lower(F.regexp_replace(col(value), r"(?U)\s+", ""))


def reference_key(value: Column | str) -> Column:
    """Key of a written type reference: trimmed, lower case, inner blanks kept."""
    return F.lower(F.trim(col(value)))


def owner_member_key(owner: Column | str, member: Column | str) -> Column:
    return normalize_key(F.concat_ws(".", col(owner), col(member)))


def collapse(value: Column | str) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(value), BLANK + "+", " "))


def title_key(value: Column | str) -> Column:
    return F.lower(collapse(value))


def first_line(value: Column | str) -> Column:
    return F.element_at(F.split(col(value), "\n", 2), 1)


def preview(value: Column | str, characters: int = 240) -> Column:
    return F.substring(collapse(value), 1, characters)


def searchable_name(value: Column | str) -> Column:
    """Lower case, a blank at each lower-to-upper border, other characters become blanks."""
    split = F.regexp_replace(col(value), r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.lower(F.regexp_replace(split, r"[^\p{L}\p{N}]", " "))


def searchable_line(value: Column | str) -> Column:
    """The tokens of a value with one blank between them (and perhaps at the ends)."""
    split = F.regexp_replace(col(value), r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.lower(F.regexp_replace(split, r"[^\p{L}\p{N}]+", " "))


def searchable_text(value: Column | str) -> Column:
    """searchable_name of each blank-separated word, joined by one blank."""
    words = F.filter(F.split(col(value), r"(?U)\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, searchable_name), " ")


def tokens(value: Column | str) -> Column:
    """The words of searchable_text: what is no letter or digit separates, and blanks do, so
    the rules run once over the whole value."""
    return F.filter(F.split(searchable_name(value), " +"), lambda w: F.length(w) > 0)


@lru_cache(maxsize=1)
def _case_borders() -> re.Pattern:
    """A border between a lower-case and an upper-case letter of any script."""
    kinds = {"Ll": [], "Lu": []}
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))
        if kind in kinds:
            last = kinds[kind][-1] if kinds[kind] else None
            if last and last[1] == point - 1:
                last[1] = point
            else:
                kinds[kind].append([point, point])
    low, high = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in ("Ll", "Lu"))
    return re.compile(f"(?<=[{low}])(?=[{high}])")


def searchable_words(text: str) -> list[str]:
    """The words of a query, by the rules of `tokens`."""
    split = _case_borders().sub(" ", text)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in split).lower().split()


def query_terms(text: str) -> list[str]:
    """Prefix terms of a keyword query, sorted, with synonyms."""
    found = set(searchable_words(text))
    for word in [w for w in found if w in SYNONYMS]:
        found |= set(SYNONYMS[word])
    return sorted(found)


def fuzzy_threshold(query: str) -> int:
    """Largest edit distance that a query of this length tolerates."""
    n = len(query)
    return 2 if n <= 8 else 3 if n <= 20 else max(n // 5, 4)


def fuzzy_threshold_col(query: Column) -> Column:
    n = F.length(query)
    return F.when(n <= 8, 2).when(n <= 20, 3).otherwise(F.greatest(F.floor(n / 5), F.lit(4))).cast("int")


def fuzzy_distance(query: Column, keys: Sequence[Column]) -> Column:
    """Smallest edit distance, in characters, to any of the keys that is not null."""
    return F.least(*[F.levenshtein(query, k) for k in keys]) if len(keys) > 1 else F.levenshtein(query, keys[0])


def relation_tier(query: str, name: Column, alias: Column, owner_member: Column, priority: Column) -> Column:
    """(tier, tie) of a keyword hit; lower is better.

    0 the query is the name or alias (tie: kind priority); 1 it is owner.member (the same
    tie); 2 the name and 3 the alias begins with its first word; 4 the name and 5 the alias
    holds all its words; 10 other.
    """
    words = searchable_words(query)
    key, first = " ".join(words), words[0] if words else ""
    holds = lambda c: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)) if words else F.lit(True)
    name, alias, owner_member = (F.coalesce(c, F.lit("")) for c in (name, alias, owner_member))
    some, begins = F.lit(bool(key)), F.lit(bool(first))
    tier = (
        F.when(some & ((name == key) | (alias == key)), 0)
        .when(some & (owner_member == key), 1)
        .when(begins & F.startswith(name, F.lit(first)), 2)
        .when(begins & F.startswith(alias, F.lit(first)), 3)
        .when(holds(name), 4)
        .when(holds(alias), 5)
        .otherwise(10)
    )
    return F.struct(tier.alias("tier"), F.when(tier <= 1, priority).otherwise(0).cast("int").alias("tie"))


def name_keys(name: Column, alias: Column, owner: Column, owner_alias: Column | None = None, module: Column | None = None, query: Sequence[tuple[str, Column]] = ()) -> Column:
    """array of (key, key_kind), without repeats, that a document is found under: its
    primary name, alias, up to three owner.member pairs and the given query keys."""
    none = F.lit(None).cast("string")
    owner_alias = none if owner_alias is None else owner_alias
    pairs = [("primary", normalize_key(name)), ("alias", normalize_key(alias)), *((k, normalize_key(v)) for k, v in query)]
    member = lambda o, m: F.when(o.isNotNull() & m.isNotNull(), owner_member_key(o, m))
    pairs += [("owner_member_primary", member(owner, name)), ("owner_member_alias", member(owner, alias)), ("owner_member_alias", member(owner_alias, name)), ("owner_member_alias", member(owner_alias, alias))]
    if module is not None:
        pairs.append(("module_context", normalize_key(module)))
    built = F.array(*(F.struct(k.alias("key"), F.lit(kind).alias("key_kind")) for kind, k in pairs))
    return F.array_distinct(F.filter(built, lambda p: p["key"].isNotNull() & (p["key"] != "")))
