"""Secret scans in DataFrame operations: patterns, and sliding-window entropy.

Matches of a pattern are found by splitting: the parts between the matches and the matches
themselves alternate, so running sums of their lengths are the positions. Candidate strings
of token characters, outside of these matches, are scored by the Shannon entropy of a window
that slides over them; its symbol counts change by one symbol in and one out at each step.
Each character class has a threshold of its own, and an allow-list suppresses strings that
are known to be harmless.

Nothing here takes time with the square of a text or of its matches: running sums double
their reach in each pass, and long texts are cut into pieces before parts are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
#: A whole run of token characters, 20 or more, with a digit.
TOKEN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"((?<![{TOKEN}])(?=[A-Za-z+/_=-]*[0-9])[{TOKEN}]{{20,}})"
MIN_VALUE, MIN_ACCESS, WINDOW = 6, 20, 20
#: Character classes, the narrowest first, and the bits a window must reach.
CLASSES = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("upper", "^[0-9A-Z]+$", 3.6), ("lower", "^[0-9a-z]+$", 3.6), ("mixed", "", 3.9))
#: Numbers, UUIDs, paths of words, dates and versions.
ALLOW = (
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]+[0-9]*|[0-9]+)(?:[/_-](?:[A-Za-z]+[0-9]*|[0-9]+))++/?$",
)
#: A part between equals signs that holds one of these words is no secret.
PLACEHOLDERS = "example|sample|placeholder|dummy|xxxx"
PART = TOKEN.replace("=", "")
#: Code points of the pieces of a long text.
PIECE = 1024


def let(**values: str) -> Callable[[str], str]:
    """SQL of a body in which each name stands for its value, computed once; later values
    may use the earlier names."""

    def around(body: str) -> str:
        for name, value in reversed(values.items()):
            body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
        return body

    return around


def running(values: str, joined: str) -> str:
    """SQL array of the running totals of `values`; `joined` combines x (a total) and y (the
    one before what x covers). Every pass doubles what a total covers."""
    before = joined.replace("y", "acc[i - shiftleft(1, k)]")
    return f"""aggregate(sequence(0, CAST(ceil(log2(greatest(size({values}), 1))) AS INT)), {values},
      (acc, k) -> transform(acc, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN {before} ELSE x END))"""


def located(pattern: str, kind: int, keep: str, text: str = "text") -> Column:
    """array of (start, kind, stop, value, whole) of the leftmost non-overlapping matches, in
    code points, that fulfil `keep`, a condition on m, m.value being group 1."""
    p = quoted(pattern)
    walk = let(
        gaps=f"split({text}, {p}, -1)",
        wholes=f"regexp_extract_all({text}, {p}, 0)",
        vals=f"regexp_extract_all({text}, {p}, 1)",
        lens="transform(wholes, (w, j) -> length(gaps[j]) + length(w))",
        ends=running("lens", "x + y"),
    )(f"filter(transform(wholes, (w, j) -> named_struct('start', ends[j] - length(w), 'kind', {kind}, 'stop', ends[j], 'value', vals[j], 'whole', w)), m -> {keep})")
    none = "CAST(array() AS array<struct<start:int,kind:int,stop:int,value:string,whole:string>>)"
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {walk} ELSE {none} END")


def rewritten(text: str, spans: str, piece: str) -> str:
    """SQL of the text with `piece` for every span m (sorted by start) in place of what it
    covers; in `piece`, past is the end of what the spans before m cover."""
    part = lambda a, b: f"""CASE WHEN {b} <= {a} THEN '' ELSE substring(array_join(slice(pieces, CAST({a} DIV {PIECE} AS INT) + 1,
      CAST(({b} - 1) DIV {PIECE} AS INT) - CAST({a} DIV {PIECE} AS INT) + 1), ''), {a} % {PIECE} + 1, {b} - {a}) END"""  # noqa: E731
    body = let(
        pieces=f"regexp_extract_all({text}, {quoted(f'(?s).{{1,{PIECE}}}')}, 0)",
        stops=f"transform({spans}, m -> m.stop)",
        reach=running("stops", "greatest(x, y)"),
    )(f"""concat(array_join(transform({spans}, (m, j) -> element_at(transform(array(CASE WHEN j = 0 THEN 0 ELSE reach[j - 1] END),
      past -> concat({part('past', 'm.start')}, {piece})), 1)), ''), element_at(transform(array(reach[size(reach) - 1]), past -> {part('past', f'length({text})')}), 1))""")
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {body} END"


def blanked(text: str, pattern: str) -> str:
    """SQL of the text with blanks in place of the matches."""
    p = quoted(pattern)
    body = let(gaps=f"split({text}, {p}, -1)", wholes=f"regexp_extract_all({text}, {p}, 0)")(
        "array_join(transform(gaps, (g, j) -> concat(g, CASE WHEN j < size(wholes) THEN repeat(' ', length(wholes[j])) ELSE '' END)), '')"
    )
    return f"CASE WHEN {text} RLIKE {p} THEN {body} ELSE {text} END"


def entropy(value: str, window: int = WINDOW) -> str:
    """SQL for the highest Shannon entropy in bits of any window of the string `value`.

    Of the counts c of a window of w symbols, the entropy is log2(w) - sum(c * log2(c)) / w,
    and the sum changes by the two symbols that come and go.
    """
    table = ", ".join(repr(c * math.log2(c)) + "D" if c else "0D" for c in range(window + 1))
    f = f"array({table})"
    return f"""element_at(transform(array({value}), v -> element_at(transform(
      array(split(v, '')), chars -> element_at(transform(
      array(array_distinct(chars)), letters -> log2(CAST(least(length(v), {window}) AS DOUBLE)) - aggregate(
        sequence(1, length(v)),
        named_struct('counts', transform(letters, x -> 0), 'sum', 0D, 'least', CAST('Infinity' AS DOUBLE)),
        (acc, i) -> element_at(transform(array(named_struct(
            'come', CAST(array_position(letters, chars[i - 1]) AS INT) - 1,
            'go', CASE WHEN i > {window} THEN CAST(array_position(letters, chars[i - {window} - 1]) AS INT) - 1 ELSE -1 END)), s ->
          element_at(transform(array(CASE WHEN s.come = s.go THEN acc.sum ELSE acc.sum
              + {f}[acc.counts[s.come] + 1] - {f}[acc.counts[s.come]]
              + CASE WHEN s.go >= 0 THEN {f}[acc.counts[s.go] - 1] - {f}[acc.counts[s.go]] ELSE 0D END END), total -> named_struct(
            'counts', CASE WHEN s.come = s.go THEN acc.counts ELSE
              transform(acc.counts, (c, k) -> c + CASE WHEN k = s.come THEN 1 WHEN k = s.go THEN -1 ELSE 0 END) END,
            'sum', total,
            'least', CASE WHEN i >= least(length(v), {window}) THEN least(acc.least, total) ELSE acc.least END)), 1)), 1),
        acc -> acc.least) / least(length(v), {window})), 1)), 1)), 1)"""


def threshold(value: str) -> str:
    cases = " ".join(f"WHEN {value} RLIKE {quoted(pattern)} THEN {bits}D" for _, pattern, bits in CLASSES[:-1])
    return f"CASE {cases} ELSE {CLASSES[-1][2]}D END"


def scanned(df: DataFrame, text_col: str, allow: Sequence[str] = ALLOW, placeholders: str = PLACEHOLDERS) -> DataFrame:
    """df with __base and __spans, arrays of (start, kind, stop)."""
    found = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumn("__assign", located(ASSIGN, 0, f"length(m.value) >= {MIN_VALUE}", "__text"))
    found = found.withColumn("__access", located(ACCESS, 1, f"length(m.whole) >= {MIN_ACCESS}", "__text"))
    found = found.withColumn("__hex", located(HEX, 2, "true", "__text"))
    plain = "transform(concat(__assign, __access, __hex), m -> named_struct('start', m.start, 'kind', m.kind, 'stop', m.stop))"
    found = found.withColumn("__base", F.array_sort(F.expr(plain)))
    # what is left for the method: no base span, no part with a placeholder
    blank = "repeat(' ', greatest(0, m.stop - greatest(m.start, past)))"
    found = found.withColumn("__text", F.expr(rewritten("__text", "__base", blank)))
    if placeholders:
        found = found.withColumn("__text", F.expr(blanked("__text", rf"(?<![{PART}])[{PART}]*?(?i:{placeholders})[{PART}]*")))
    allowed = " OR ".join(f"m.whole RLIKE {quoted(p)}" for p in allow) or "false"
    high = f"{entropy('m.whole')} >= {threshold('m.whole')}"
    found = found.withColumn("__more", located(CANDIDATE, 3, f"CASE WHEN {allowed} THEN false ELSE {high} END", "__text"))
    more = "transform(__more, m -> named_struct('start', m.start, 'kind', m.kind, 'stop', m.stop))"
    found = found.withColumn("__spans", F.array_sort(F.expr(f"concat(__base, {more})")))
    return found.drop("__text", "__assign", "__access", "__hex", "__more")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW, placeholders: str = PLACEHOLDERS) -> DataFrame:
    """`id_col`, base and spans, arrays of (start, kind, stop) by start, then kind (numbers
    into KINDS), stop exclusive, in code points. base holds the pattern kinds; spans adds the
    strings of high entropy between base spans: runs of token characters that no base span
    covers, without the parts between equals signs that hold a placeholder word, and not
    as a whole on the allow-list.

    A null text is empty: no spans. Repeated rows are scanned one by one, very long texts and
    texts of very many matches whole; other columns are not read. One scan without a
    shuffle, in built-in expressions only.
    """
    found = scanned(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__source")), "__source", allow, placeholders)
    return found.select(F.col("__id").alias(id_col), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:stop of an array of spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, m -> concat({names}[m.kind], ':', m.start, ':', m.stop)), ',')")


def redact(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """df with every secret in the text replaced by `mark` (overlapping spans by one), and
    `length_col`, if it is there, set to the new length. Texts without secrets, and null
    texts, stay as they are."""
    found = scanned(df.select(F.struct(*df.columns).alias("__row"), F.col(text_col).alias("__source")), "__source")
    # a span that begins inside the last one only moves its end
    text = rewritten("__source", "__spans", f"CASE WHEN j > 0 AND m.start < past THEN '' ELSE {quoted(mark)} END")
    found = found.withColumn("__changed", F.size("__spans") > 0).withColumn("__source", F.expr(text))
    changed = {text_col: F.col("__source").cast(dict(df.dtypes)[text_col])}
    if length_col in df.columns:
        changed[length_col] = F.when(F.col("__changed"), F.length("__source").cast(dict(df.dtypes)[length_col])).otherwise(F.col(f"__row.`{length_col}`"))
    return found.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in df.columns])
