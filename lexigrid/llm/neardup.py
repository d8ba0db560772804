"""Near-duplicate texts by the similarity of their word shingles.

SimHash finds the candidates: three fingerprints, of a text's distinct words, of its distinct
word pairs and of its shingles. The first two change little where a few words change, so
that similar texts lie within 7 bits in one of the three; the fingerprint of the shingles
also sorts out texts that only share common words (over 20 bits apart). A passage more or
less moves those bits further, so MinHash bands of the shingles find candidates as well: two
texts share one of the 20 bands of five least hashes with probability 1 - (1 - s^5)^20 at
similarity s, over 0.9996 from 0.8 on, wherever the texts differ. Candidates make families,
and inside a family the shingle sets decide: two texts are linked if the Jaccard similarity
of their sets is at least the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map
from .simhash import BITS, BROADCAST_ROWS, by_group, connected, links, near_pairs

WIDTH, SIMILARITY, RADIUS, SHINGLE_RADIUS = 5, 0.8, 7, 20
PRINTS = ("words", "pairs", "shingles")
BAND_ROWS = 5
BANDS = tuple(f"band{i}" for i in range(20))
#: What makes BAND_ROWS hashes for each band out of one: (h ^ first) * second, second odd.
MIXERS = np.random.default_rng(42).integers(0, 1 << 64, (2, len(BANDS) * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
#: Families above this number of texts, or of shingles, are compared in pairs of chunks of
#: about this size.
FAMILY_ROWS, FAMILY_SHINGLES = 256, 1 << 18


def hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles (fewer words: of the whole sequence)."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def simhash(values: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    total = np.zeros(BITS, np.int64)
    for start in range(0, len(values), 4096):
        total += np.unpackbits(values[start : start + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(values)).view(">u8")[0])


def bands(values: np.ndarray) -> list[int]:
    """A hash for each band of the BAND_ROWS least mixed hashes (no hashes: zeros)."""
    if not len(values):
        return [0] * len(BANDS)
    least = np.full(MIXERS.shape[1], (1 << 64) - 1, np.uint64)
    for start in range(0, len(values), 1024):
        np.minimum(least, ((values[start : start + 1024, None] ^ MIXERS[0]) * MIXERS[1]).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(len(BANDS), BAND_ROWS))]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def prints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (128-bit hash of the word sequence), size (number of shingles), words, pairs and
    shingles (SimHashes), and the bands."""

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, cols = [], [], [[] for _ in (*PRINTS, *BANDS)]
        for text in batch.column(1).to_pylist():
            words = split_words(text)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets = [hashes(words, n) for n in (1, 2, width)]
            sizes.append(len(sets[-1]))
            for column, value in zip(cols, (*map(simhash, sets), *bands(sets[-1])), strict=True):
                column.append(value)
        made = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in cols]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *made], ["id", "key", "size", *PRINTS, *BANDS])

    schema = "id long, key binary, size long, " + ", ".join(f"{c} long" for c in (*PRINTS, *BANDS))
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], schema, per_slice)


def band_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of every node to the smallest one of each band that it shares."""
    rows = nodes.select("node", F.explode(F.array(*BANDS)).alias("band"))
    first = rows.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    # written first: both sides of the join are then plain ones, whose hot band can be split
    return rows.join(materialize(first, "bands"), "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def band_pairs(keys: np.ndarray, bands_: list[np.ndarray], root):
    """Pairs (a, b) of row numbers of one key that share a band and have not met in an
    earlier one, in portions; rows that `root` already connects are left out."""
    for number, values in enumerate(bands_):
        order = np.lexsort((values, keys))
        new = (keys[order][1:] != keys[order][:-1]) | (values[order][1:] != values[order][:-1])
        edges = np.flatnonzero(np.r_[True, new, True])
        for start in np.flatnonzero(np.diff(edges) > 1):
            rows = order[edges[start] : edges[start + 1]]
            roots = np.array([root(i) for i in rows.tolist()])
            if (roots == roots[0]).all():
                continue
            for k in range(len(rows) - 1):
                others = rows[k + 1 :][roots[k + 1 :] != roots[k]]
                for earlier in bands_[:number]:
                    others = others[earlier[others] != earlier[rows[k]]]
                if len(others):
                    yield np.repeat(rows[k], len(others)), others


def linked(keys: np.ndarray, node: np.ndarray, prints_: list[np.ndarray], bands_: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) of what the similarity connects within each key; keys are
    sorted. Pairs already connected are not compared again."""
    up = list(range(len(keys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def compare(pairs) -> None:
        for i, j in pairs:
            x, y = root(i), root(j)
            if x == y:
                continue
            m, n = len(sets[i]), len(sets[j])
            if min(m, n) < similarity * max(m, n):
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (m + n - shared):
                small, large = (x, y) if node[x] <= node[y] else (y, x)
                up[large] = small

    for values in prints_:
        for a, b in near_pairs(keys, values, RADIUS):
            order = np.argsort(np.bitwise_count(values[a] ^ values[b]), kind="stable")
            compare(zip(a[order].tolist(), b[order].tolist(), strict=True))
    for a, b in band_pairs(keys, bands_, root):
        compare(zip(a.tolist(), b.tolist(), strict=True))
    roots = np.array([root(i) for i in range(len(keys))], dtype=np.int64)
    moved = np.flatnonzero(roots != np.arange(len(keys)))
    return node[moved], node[roots[moved]]


def components(df: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id and key (128-bit hash of the words) of every row; and key, component_id (the
    smallest id, null if no row of the component has one) and first_key (the key of that
    row) of every text.

    The nodes are the texts, whatever their ids: rows that repeat an id or have none go
    through the same links. Families are split into chunks, and each pair of chunks is a
    group of its own; edges are a forest, so nothing grows with the square of a family.
    """
    found = materialize(prints(df, width, id_col, text_col), "near-prints")
    nodes = found.groupBy("key").agg(F.min("id").alias("id"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in (*PRINTS, *BANDS)])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    near = links(nodes.select("node", *PRINTS, F.col("shingles").alias("other")), RADIUS, SHINGLE_RADIUS, PRINTS)
    families = connected(near.union(band_edges(nodes)))
    families = materialize(families.union(families.select("root", "root").distinct()), "families")
    members = families.join(nodes.select("node", "id", "key", "size", *PRINTS, *BANDS), "node")
    counts = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("all_sizes"))
    members = materialize(members.join(counts, "root"), "near-members")

    few = members.select(F.col("id").alias("__id"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sets = [], []
        for text in batch.column(1).to_pylist():
            words = split_words(text)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(hashes(words, width).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "hashes"])

    sets = arrow_map(texts, ["id", "text"], "key binary, hashes binary", shingled)
    sets = materialize(sets, "near-sets").dropDuplicates(["key"])
    rows = members.join(sets, "key")
    chunks = F.greatest(F.ceil(F.col("n") / F.lit(FAMILY_ROWS)), F.least(F.col("n"), F.ceil(F.col("all_sizes") / F.lit(FAMILY_SHINGLES)))).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(F.xxhash64("root", F.least("own", "partner"), F.greatest("own", "partner")).alias("g"), "node", *PRINTS, *BANDS, "hashes")

    def edges(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return linked(cols[0], cols[1], [c.view(np.uint64) for c in cols[2:5]], cols[5:-1], [np.frombuffer(x, np.uint64) for x in cols[-1]], similarity)

    roots = connected(by_group(rows, edges))
    roots = materialize(roots.union(roots.select("root", "root").distinct()), "near-roots")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    named = roots.join(roots.join(nodes.select("node", "id", "key"), "node").groupBy("root").agg(smallest), "root").select("node", "least")
    # written first: both sides of the joins with it are then plain shuffles, whose hot key can be split
    of = nodes.select("node", "id", "key").join(named, "node", "left")
    of = of.select("key", F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"), F.coalesce("least.key", "key").alias("first_key"))
    return found.select("id", "key"), materialize(of, "components")


def groups(df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key and component_id (the smallest id that a text reaches over links, null if it
    reaches none) of every row.

    Words are runs of non-blanks with A-Z in lower case; texts of equal words count once.
    Ids must be integral; rows that share an id but not a text are linked only if their
    texts are.
    """
    found, of = components(df, width, similarity, id_col, text_col)
    return found.join(of.drop("first_key"), "key", "left").select("id", "key", "component_id")


def keep_one(df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without all but one document of each group: one with the smallest id stays, or one
    of those without an id where no other is there. An id must be integral."""
    found, of = components(df, width, similarity, id_col, text_col)
    stay = of.where("key = first_key").select(F.col("component_id").alias("__stay"), F.col("key").alias("__stay_key"))
    ids = found.agg(F.count("*"), F.count_distinct("id")).first()
    if ids[0] == ids[1]:
        # a shuffle join at every size: the ids grow with the documents
        return df.join(stay.select("__stay").hint("merge"), F.col(id_col) == F.col("__stay"), "left_semi")
    # the id does not name the text: null ids are spread by their texts
    marked = df.withColumn("__key", key_of(F.col(text_col)))
    same = (F.col("__key") == F.col("__stay_key")) & F.col(id_col).eqNullSafe(F.col("__stay"))
    return marked.join(stay.hint("merge"), same, "left_semi").dropDuplicates([id_col, "__key"]).drop("__key")


def key_of(text):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(b" ".join(split_words(t))) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(text)
