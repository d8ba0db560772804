"""SimHash near-duplicate groups with bit-sliced comparison.

Distinct fingerprints meet in buckets of equal bits: cut into m blocks of bits, two
fingerprints within radius r agree on at least m - r whole blocks, so one bucket for each
choice of m - r blocks finds every link. Inside a bucket the fingerprints are stored as
vertical bit planes, 64 to a machine word; a query's distances to 64 others are carry-save
counters that all planes are added to, and a block of 64 is abandoned once all its
counters exceed the radius. A bucket only has to tell what it connects, so it returns a
spanning forest: never more rows than it read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map

BITS = 64
#: Buckets above this size are compared in pairs of chunks of about this size.
CHUNK_ROWS = 1024
#: More blocks are chosen when an average bucket would exceed this.
MEAN_BUCKET = 1024
#: Hot buckets are broadcast up to this number (24 bytes each).
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over word shingles; see `fingerprints`."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, six blanks only
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype=">u8")
    total, n = np.zeros(BITS, np.int64), len(hashes)
    for start in range(0, n, 4096):
        total += np.unpackbits(hashes[start : start + 4096].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, fp long: words are runs of non-blanks with A-Z in lower case; a shingle is
    `width` words joined by a space (fewer words: all of them), its hash XXH64 with seed 42;
    a bit of the fingerprint is set if over half of the hashes have it. No words: 0."""

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], "id long, fp long", per_slice)


def bucket_masks(count: int, radius: int) -> list[int]:
    """Masks of the bits that a bucket's fingerprints share; any two fingerprints within the
    radius agree under at least one of them. The number of blocks grows with the count."""
    for blocks in range(radius + 1, min(radius + 8, BITS) + 1):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
        masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
        if count >> min(m.bit_count() for m in masks) <= MEAN_BUCKET:
            break
    return masks


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def exceeds(c: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter (or its overflow) is above the radius (at most 7)."""
    above, equal = np.zeros_like(over), ~np.zeros_like(over)
    for bit in (2, 1, 0):
        if radius >> bit & 1:
            equal &= c[bit]
        else:
            above |= equal & c[bit]
            equal &= ~c[bit]
    return above | over


def near_pairs(group: np.ndarray, fp: np.ndarray, radius: int, at_once: int = 1 << 16):
    """Pairs (i, j) of row numbers with i before j in one group and fp within the radius, in
    portions. group is sorted; fp is uint64."""
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first_word = np.r_[0, np.cumsum(words)[:-1]] if n else starts
    number = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[number]
    word, lane = first_word[number] + place // 64, (place % 64).astype(np.uint64)
    n_words = int(words.sum())
    grid = np.zeros((n_words, 64), np.uint64)
    grid[word, lane.astype(int)] = fp
    valid = np.zeros(n_words, np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << lane)
    row_of = np.zeros((n_words, 64), np.int64)
    row_of[word, lane.astype(int)] = np.arange(n)
    one = np.uint64(1)
    planes = [np.packbits(((grid >> np.uint64(b)) & one).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel() for b in range(BITS)]
    # each row meets its own word (later lanes only) and the later words of its group
    meets = first_word[number] + words[number] - word
    ends = np.cumsum(meets)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + at_once, side="right")))
        rows = np.repeat(np.arange(low, high), meets[low:high])
        other = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(meets[low:high])[:-1]], meets[low:high]) + word[rows]
        mask = valid[other].copy()
        own = other == word[rows]
        mask[own] &= ~((np.uint64(2) << lane[rows[own]]) - one)
        keep = mask != 0
        rows, other, mask = rows[keep], other[keep], mask[keep]
        c = [np.zeros(len(rows), np.uint64) for _ in range(3)]
        over, bits = np.zeros(len(rows), np.uint64), fp[rows]
        for b in range(BITS):
            x = planes[b][other] ^ (np.uint64(0) - ((bits >> np.uint64(b)) & one))
            for i in range(3):
                x, c[i] = c[i] & x, c[i] ^ x
            over |= x
            if b % 8 == 7:
                alive = (mask & ~exceeds(c, over, radius)) != 0
                if not alive.all():
                    rows, other, mask, over, bits = rows[alive], other[alive], mask[alive], over[alive], bits[alive]
                    c = [v[alive] for v in c]
                if not len(rows):
                    break
        if len(rows):
            hits = mask & ~exceeds(c, over, radius)
            at, lanes = np.nonzero(np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield rows[at], row_of[other[at], lanes]
        low = high


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b); labels[i] is the smallest row number connected to i."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        small = np.minimum(x, y)
        np.minimum.at(labels, x, small)
        np.minimum.at(labels, y, small)
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
    return labels


def forest(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, other: np.ndarray | None = None, other_radius: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of what its bucket connects) of all buckets in `keys`; with
    `other` fingerprints these must be within `other_radius` as well."""
    order = np.lexsort((node, keys))
    keys, fp, node = keys[order], fp[order], node[order]
    size = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])) if len(keys) else np.zeros(0, int)
    many = np.repeat(size, size) > 1
    keys, fp, node = keys[many], fp[many], node[many]
    other = None if other is None else other[order][many]
    labels = np.arange(len(keys))
    for a, b in near_pairs(keys, fp, radius):
        if other is not None:
            fits = np.bitwise_count(other[a] ^ other[b]) <= other_radius
            a, b = a[fits], b[fits]
        labels = merge_labels(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return node[linked], node[labels[linked]]


def links(nodes: DataFrame, radius: int = 4, other_radius: int | None = None, prints: Sequence[str] = ("fp",)) -> DataFrame:
    """Edges (a, b) that connect exactly what links within the radius connect, in any one of
    the fingerprints `prints`.

    nodes: node long (distinct) and the fingerprints, long; with `other_radius` also other
    long, a further fingerprint that a link must fulfil. Buckets over CHUNK_ROWS are split by
    hash into chunks, and each pair of chunks is a group of its own.
    """
    more = [] if other_radius is None else ["other"]
    if not 0 <= radius <= 7:
        raise ValueError("a radius from 0 to 7")
    masks = bucket_masks(nodes.count(), radius)
    keys = [(p, signed(m)) for p in prints for m in masks]
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(p).bitwiseAND(F.lit(m)).alias("v"), F.col(p).alias("fp")) for i, (p, m) in enumerate(keys))))
    rows = nodes.select("node", *more, key.alias("key")).select("key.*", "node", *more)
    hot = materialize(rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_ROWS), "hot")
    rows = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["k", "v"], "left")
    chunks = F.coalesce(F.ceil(F.col("n") / F.lit(CHUNK_ROWS)), F.lit(1)).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = [F.least("own", "partner").alias("x"), F.greatest("own", "partner").alias("y")]
    rows = rows.select("k", "v", *pair, "fp", "node", *more)
    # a 64-bit hash names the group: if two groups ever shared it they would only be compared with each other as well
    rows = rows.select(F.xxhash64("k", "v", "x", "y").alias("g"), "fp", "node", *more)

    def edges(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        other = cols[3].view(np.uint64) if more else None
        return forest(cols[0], cols[1].view(np.uint64), cols[2], radius, other, other_radius or 0)

    return by_group(rows, edges)


def by_group(rows: DataFrame, edges) -> DataFrame:
    """(a, b) from `edges`, called with the columns (as arrays) of whole groups `g` of rows,
    as many groups at once as an Arrow batch holds."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = len(cols[0]) and int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            rest = [x[cut:] for x in cols]
            if cut:
                yield made([x[:cut] for x in cols])
        if rest is not None and len(rest[0]):
            yield made(rest)

    def made(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = edges(cols)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge with the smallest node that it reaches.

    Alternates the large-star and small-star steps until nothing changes: every node hands
    its larger neighbours, then its smaller ones, over to its smallest neighbour. Each round
    is written to the shared folder; aggregates combine before the shuffle and the joins are
    plain ones, so that a node with very many neighbours is split.
    """
    edge = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = materialize(edges.where("a <> b").select(*edge).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("x"), F.col("b").alias("y")).union(now.select("b", "a"))
        # written first, so that the join of a node with very many neighbours can be split
        least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "least")
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(df: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` long, fingerprint string (16 hex digits), component_id long: the smallest id
    that the document reaches over links, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other. A row without an
    id belongs to the component of its fingerprint (null if no row with an id is there) and
    adds no links. Repeated rows are kept one by one, and rows that share an id but not a
    text are linked only if their fingerprints are. Ids must be integral. Very long texts
    are hashed whole, 4096 hashes at a time are counted. Other columns are not read.
    """
    prints = materialize(fingerprints(df, width, id_col, text_col), "prints")
    nodes = materialize(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = connected(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    linked = roots.union(roots.select("root", "root").distinct())
    smallest = linked.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("id").alias("component_id"))
    named = linked.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    # written first: both sides of the last join are then plain shuffles, whose hot key can be split
    of = materialize(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")), "components")
    found = prints.join(of, "fp", "left")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
