"""Availability contexts as bit masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Context codes in the order of their bits, with the labels that name them.
CONTEXTS = {
    "thin_client": ("thin client", "тонкий клиент"),
    "web_client": ("web-client", "web client", "веб-клиент", "веб клиент"),
    "mobile_client": ("mobile client", "мобильный клиент"),
    "server": ("server", "сервер"),
    "thick_client": ("thick client", "толстый клиент"),
    "external_connection": ("external connection", "внешнее соединение"),
    "mobile_application_client": ("mobile application (client)", "мобильное приложение (клиент)"),
    "mobile_application_server": ("mobile application (server)", "мобильное приложение (сервер)"),
    "mobile_standalone_server": ("mobile standalone server", "мобильный автономный сервер"),
}
#: Non-breaking hyphen and en dash are written for a hyphen.
DASHES = "‑–"


def bit_of(code: Column | str, codes: Sequence[str] = tuple(CONTEXTS)) -> Column:
    """1 << position of the code; null if it is unknown."""
    at = F.array_position(F.array(*map(F.lit, codes)), col(code)).cast("int")
    return F.when(at > 0, F.pow(F.lit(2), at - 1).cast("int"))


def mask_of(codes: Sequence[str], known: Sequence[str] = tuple(CONTEXTS)) -> int:
    """Mask of a request; an unknown code is an error."""
    unknown = sorted(set(codes) - set(known))
    if unknown:
        raise ValueError(f"unknown availability context: {', '.join(unknown)}")
    return sum(1 << list(known).index(c) for c in set(codes))


def parse_contexts(text: Column | str, labels: Mapping[str, Sequence[str]] = CONTEXTS) -> Column:
    """Codes named in a text, in bit order: split at , ; and ., trimmed, lower case, dashes
    unified, whole labels only."""
    parts = F.transform(F.split(col(text), "[,;.]"), lambda p: F.translate(F.lower(F.trim(p)), DASHES, "-" * len(DASHES)))
    table = F.array(*(F.struct(F.lit(code).alias("code"), F.array(*map(F.lit, names)).alias("names")) for code, names in labels.items()))
    return F.transform(F.filter(table, lambda row: F.arrays_overlap(row["names"], parts)), lambda row: row["code"])


def array_mask(codes: Column | str, known: Sequence[str] = tuple(CONTEXTS)) -> Column:
    return F.aggregate(col(codes), F.lit(0), lambda acc, c: acc.bitwiseOR(F.coalesce(bit_of(c, known), F.lit(0))))


def available(mask: Column | str, request: int, mode: str = "any") -> Column:
    """Does a fact with this mask answer the request? A fact without contexts (mask 0)
    always does; an empty `all` asks nothing, an empty `any` admits only such facts."""
    have = col(mask)
    if mode == "all":
        return (have == 0) | (have.bitwiseAND(F.lit(request)) == request)
    if mode != "any":
        raise ValueError(f"mode {mode!r}")
    return (have == 0) | (have.bitwiseAND(F.lit(request)) != 0)
