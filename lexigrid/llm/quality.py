"""Quality rules: counts that anyone can repeat, and divergence from a language reference.

The divergence rule compares two histograms of a document, over character classes and over
the common words of its language, to the reference of the language by the Jensen-Shannon
distance (base 2, so 0 to 1). Documents under a minimum length are not judged by it.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "punctuation", "symbol", "other")
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: From this many words on windows are numbered instead of held as tuples.
LONG_WORDS = 20_000


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes, and of common words among all words."""

    classes: tuple[float, ...]
    words: dict[str, float] = field(default_factory=dict)


def _spread(total: float, words: str) -> dict[str, float]:
    """Shares that fall as 1 / rank and add up to `total`."""
    names = words.split()
    harmonic = sum(1 / (i + 1) for i in range(len(names)))
    return {w: total / (i + 1) / harmonic for i, w in enumerate(names)}


#: Prose: about one capital in thirty letters, few digits, one blank after five letters.
PROSE = (0.765, 0.028, 0.01, 0.165, 0.03, 0.002, 0.0)
#: Frequent function words of each language, most frequent first.
REFERENCES = {
    "en": Reference(PROSE, _spread(0.3, "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you we")),
    "fr": Reference(PROSE, _spread(0.3, "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il ce sont avec on elle nous")),
    "de": Reference(PROSE, _spread(0.3, "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach")),
    "es": Reference(PROSE, _spread(0.3, "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si")),
}


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules; a document is kept unless a rule rejects it."""

    min_words: int = MIN_WORDS
    max_repeat_percent: int = MAX_REPEAT_PERCENT
    #: Divergence is judged from this many words on, the word histogram from this many.
    min_class_words: int = 20
    min_common_words: int = 100
    max_class_distance: float = 0.3
    max_word_distance: float = 0.35
    references: dict[str, Reference] = field(default_factory=lambda: REFERENCES)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane."""
    table = np.full(0x10000, CLASSES.index("other"), np.uint8)
    kinds = {"Ll": "lower", "Lo": "lower", "Lm": "lower", "Mn": "lower", "Mc": "lower", "Lu": "upper", "Lt": "upper", "N": "digit", "Z": "blank", "P": "punctuation", "S": "symbol"}
    for point in range(0x10000):
        kind = unicodedata.category(chr(point))
        name = kinds.get(kind) or kinds.get(kind[0])
        if name:
            table[point] = CLASSES.index(name)
    for char in BLANKS:
        table[ord(char)] = CLASSES.index("blank")
    for char in SYMBOLS + "@^~_+=\\/`{}[]":
        table[ord(char)] = CLASSES.index("symbol")
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(class_table()[np.where(points < 0x10000, points, 0xFFFF)], minlength=len(CLASSES))


def js_distance(p: list[float], q: list[float]) -> float:
    """Root of the Jensen-Shannon divergence in bits of two histograms (any totals)."""
    n, m = sum(p), sum(q)
    if not n or not m:
        return 0.0 if n == m else 1.0
    total = 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / n, b / m
        mid = (a + b) / 2
        total += (a * math.log2(a / mid) if a else 0.0) + (b * math.log2(b / mid) if b else 0.0)
    return math.sqrt(max(total / 2, 0.0))


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which the list holds twice or more."""
    if len(words) <= window:
        return 0
    if len(words) > LONG_WORDS:
        return _repeated_in_long(words, window)
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = reach = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, reach)
            reach = i + window
    return covered


def _repeated_in_long(words: list, window: int) -> int:
    """The same count in a few numbers a word: windows get exact numbers by pairing those of
    windows of half the length (the last two may overlap)."""
    index: dict = {}
    codes, size = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)), 1
    while size < window:
        step = min(size, window - size)
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        codes, size = np.unique(pairs, return_inverse=True)[1].astype(np.int64), size + step
    twice = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str, lang: str | None, rules: QualityRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept of one whole text."""
    words = text.encode("utf-8", "replace").split()  # bytes split at just the six blanks
    n = len(words)
    blanks = sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    reference = rules.references.get(lang)
    far_class = far_word = None
    if reference and n >= rules.min_class_words:
        far_class = js_distance(class_counts(text).tolist(), reference.classes)
    if reference and reference.words and n >= rules.min_common_words:
        counts = Counter(x.strip(".,;:!?\"'()") for x in text.lower().split())
        shares = [counts[w] / n for w in reference.words]
        far_word = js_distance([*shares, max(0.0, 1 - sum(shares))], [*reference.words.values(), 1 - sum(reference.words.values())])
    kept = not failed and (far_class is None or far_class <= rules.max_class_distance) and (far_word is None or far_word <= rules.max_word_distance)
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats, far_class, far_word, failed, kept


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
KINDS = (*["long"] * 5, "double", "double", "boolean", "boolean")


def judge(df: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`id_col` and FIELDS of every row.

    A null text has no words (and fails the base rules); a null or unknown language has no
    reference, so only the base rules hold. Repeated rows are judged one by one, very long
    texts whole (their windows as numbers from LONG_WORDS words on); other columns are not read. One scan without a shuffle.
    """
    kind, rules = df.schema[id_col].dataType.simpleString(), rules or QualityRules()
    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [measure(t or "", lang, rules) for t, lang in zip(texts, langs, strict=True)]
        columns = [pa.array([x[i] for x in found], types[k]) for i, k in enumerate(KINDS)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *FIELDS])

    schema = f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(FIELDS, KINDS, strict=True))
    found = arrow_map(df, [df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang")], schema, per_slice)
    return found.withColumnRenamed("id", id_col)


def kept(rules: QualityRules | None = None):
    """The verdict as a function of the columns text and lang, for filters."""
    rules = rules or QualityRules()

    def verdict(texts: pa.Array, langs: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), langs.to_pylist(), strict=True)
        return pa.array([measure(t or "", lang, rules)[-1] for t, lang in pairs], pa.bool_())

    return F.arrow_udf(verdict, "boolean")


def keep_good(df: DataFrame, rules: QualityRules | None = None, text_col: str | Column = "text", lang_col: str | Column = "lang") -> DataFrame:
    """The rows of df that the rules keep, with all their columns."""
    return df.where(kept(rules)(text_col, lang_col))
