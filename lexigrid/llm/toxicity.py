"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > j) = sigmoid(w . x - cut_j): one weight vector for all thresholds, ordered cuts.
x holds log(1 + count) of selected terms, words and beginnings of words. Output is the
expected grade. The model is fitted
on a bounded sample of labelled documents; everything else runs over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Memory, arrow_map

#: Most labelled documents that are fitted, terms that are kept, grades above 0, fewest
#: sampled documents of a term, and its least deviation from independence in standard errors.
SAMPLE_ROWS, TERMS, GRADES, MIN_DOCS, MIN_Z = 32768, 2048, 3, 4, 4.0
#: Beginnings of longer words that are terms as well; they are written with a dash.
STEMS = (6, 8)
WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


class Terms:
    """Counts of known terms in a text; words already looked up are remembered, bounded."""

    def __init__(self, known):
        self.known = known
        self.words = Memory(lambda w: tuple(t for t in terms_of(w) if t in known), 1 << 17, 48)

    def counts(self, text: str | None) -> Counter:
        held = map(self.words.__getitem__, WORDS((text or "").lower()))
        return Counter(t for found in held if found for t in found)


@dataclass(frozen=True)
class Model:
    """weights by term, rising cuts; no terms: every document has grade 0."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def probabilities(self, text: str | None, terms: Terms | None = None) -> list[float]:
        """P(grade > j) for each cut."""
        counts = (terms or Terms(self.weights)).counts(text)
        at = sum(self.weights[t] * float(np.log1p(n)) for t, n in sorted(counts.items()))
        return [1 / (1 + float(np.exp(min(50.0, cut - at)))) for cut in self.cuts]


def fit_cuts(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_terms: int, n_grades: int = GRADES, steps: int = 2000, l1: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by proximal gradient steps with momentum on the mean loss of the
    binary problems "grade > j", which share the weights; l1 keeps the weights sparse."""
    n = len(grades)
    above = (grades[:, None] > np.arange(n_grades)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    w, cuts = np.zeros(n_terms), np.log(1 / share - 1)
    vw, vc = np.zeros(n_terms), np.zeros(n_grades)
    # the curvature is at most a quarter of the mean squared row length for each threshold
    length = np.bincount(rows, values * values, n)
    step = 4.0 / (n_grades * float(np.maximum(length, 1).mean()))
    for t in range(steps):
        momentum = t / (t + 3)
        yw, yc = w + momentum * vw, cuts + momentum * vc
        z = np.bincount(rows, yw[cols] * values, n)[:, None] - yc[None, :]
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - above) / n
        new = yw - step * np.bincount(cols, gap.sum(axis=1)[rows] * values, n_terms)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_cuts = np.maximum.accumulate(yc + step * gap.sum(axis=0))
        vw, vc, w, cuts = new - w, new_cuts - cuts, new, new_cuts
    return w, cuts


def _terms(sample: DataFrame, column: str) -> DataFrame:
    """(label, word) once for each document and word."""

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, words = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted({t for w in set(WORDS((text or "").lower())) for t in terms_of(w)})
            labels += [label] * len(found)
            words += found
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(words, pa.string())], ["label", "word"])

    return arrow_map(sample, [F.col("label"), F.col(column).alias("text")], "label int, word string", per_slice)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from `labels` (id, 0/1 label; the largest label of an id counts, nulls are
    left out), joined to `docs`.

    At most `sample_rows` labelled documents take part, picked by a seeded hash of the id;
    they are broadcast as ids only. Of rows that repeat an id the smallest text is fitted; a
    null text has no terms, a very long one is read whole. Terms are the TERMS words whose
    presence separates the labels best, ties to the smaller word. A labelled document has grade 0 if clean, else 1 to GRADES by how many of
    the separating words (in thirds of the toxic documents) it holds. No usable labels, or
    one class only: a model without terms.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = clean.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")
    sample = materialize(joined.groupBy("__id", "label").agg(F.min("text").alias("text")), "toxic-sample")
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = Model({}, tuple(float(50 + j) for j in range(GRADES)))
    if not n_toxic or n_toxic == n_all:
        return empty
    counts = _terms(sample, "text").groupBy("word").agg(F.sum("label").alias("t"), F.count("*").alias("d")).where(F.col("d") >= MIN_DOCS)
    rate = F.lit(n_toxic / n_all)
    surprise = F.abs(F.col("t") - F.col("d") * rate) / F.sqrt(F.col("d") * rate * (1 - rate) + 1)
    terms = counts.withColumn("z", surprise).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(TERMS).collect()
    if not terms:
        return empty
    index = {row.word: i for i, row in enumerate(terms)}
    strong = {i for i, row in enumerate(terms) if row.t > row.d * n_toxic / n_all and not row.word.endswith("-")}

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols, values, known = [], [], Terms(index)
        for text in batch.column(2).to_pylist():
            found = sorted((index[t], n) for t, n in known.counts(text).items())
            cols.append([i for i, _ in found])
            values.append([n for _, n in found])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["id", "label", "cols", "counts"])

    # sample_rows rows at most; texts are read in parallel, only the counts come to the driver
    rows = arrow_map(sample, ["__id", "label", "text"], f"id {kind}, label int, cols array<int>, counts array<int>", features).orderBy("id").collect()
    toxic = np.array([r.label for r in rows])
    hits = np.array([sum(n for i, n in zip(r.cols, r.counts, strict=True) if i in strong) for r in rows])
    grades = np.zeros(len(rows), int)
    edges = np.quantile(hits[toxic > 0], [j / GRADES for j in range(1, GRADES)]) if (toxic > 0).any() else []
    grades[toxic > 0] = 1 + np.searchsorted(edges, hits[toxic > 0], side="left")
    lengths = [len(r.cols) for r in rows]
    cols = np.concatenate([np.array(r.cols, int) for r in rows])
    values = np.log1p(np.concatenate([np.array(r.counts, float) for r in rows]))
    w, cuts = fit_cuts(np.repeat(np.arange(len(rows)), lengths), cols, values, grades, len(index))
    return Model({word: float(w[i]) for word, i in index.items() if w[i]}, tuple(map(float, cuts)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", toxic_from: float = 0.5) -> DataFrame:
    """`id_col`, severity double (expected grade, 0 to the number of cuts), grade int (the
    number of cuts passed with probability 0.5 or more) and toxic boolean (P(grade > 0) of
    `toxic_from` or more).

    A null text has no terms. Repeated rows are scored one by one, very long texts whole;
    other columns are not read. One scan without a shuffle; the model has at most TERMS weights.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = Terms(model.weights)
        found = [model.probabilities(x, terms) for x in batch.column(1).to_pylist()]
        columns = [pa.array([sum(p) for p in found], pa.float64()), pa.array([sum(x >= 0.5 for x in p) for p in found], pa.int32()), pa.array([p[0] >= toxic_from for p in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "severity", "grade", "toxic"])

    found = arrow_map(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], f"id {kind}, severity double, grade int, toxic boolean", per_slice)
    return found.withColumnRenamed("id", id_col)
