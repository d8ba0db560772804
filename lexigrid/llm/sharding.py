"""Sharding into contiguous key ranges of nearly equal bytes by histogram sort.

The key is (hash of the text, hash of id and text, row number), so equal texts lie side by
side and no two rows have one key. Each round counts the exact bytes between candidate boundaries (probes) in all partitions at
once, keeps for each splitter the gap that holds its target, and probes that gap more
finely, until the gap is within the tolerance. Only then the rows are exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOP = (1 << 63) - 1
#: Probes for each gap and round; rows of a partition of the final order, about.
PROBES, ORDER_ROWS = 256, 262144
KEYS = ("k1", "k2", "k3")


@dataclass
class Gap:
    """Keys low..high (inclusive) hold `bytes`, `below` bytes lie before them."""

    low: int
    high: int
    below: int
    bytes: int
    single: bool = False


def _refine(keys: DataFrame, key: str, aims: list[int], start: Gap, tolerance: float) -> list[Gap]:
    """For each aim (bytes from the left) the gap of at most `tolerance` bytes, or of a
    single key, that holds it."""
    gaps = [start for _ in aims]
    while True:
        open_ = sorted({(g.low, g.high) for g in gaps if g.bytes > tolerance and not g.single})
        if not open_:
            return gaps
        cases = []
        for i, (low, high) in enumerate(open_):
            step = max(1, -(-(high - low + 1) // PROBES))
            cases.append(f"WHEN {key} BETWEEN {low} AND {high} THEN {i * PROBES} + ({key} - {low}) DIV {step}")
        counted = keys.select(F.expr(f"CASE {' '.join(cases)} END").alias("probe"), F.col(key).alias("key"), "size").where("probe IS NOT NULL")
        # at most PROBES rows for each open gap come to the driver
        rows = counted.groupBy("probe").agg(F.sum("size"), F.min("key"), F.max("key")).orderBy("probe").collect()
        for at, (aim, gap) in enumerate(zip(aims, gaps, strict=True)):
            if (gap.low, gap.high) not in open_ or gap.bytes <= tolerance or gap.single:
                continue
            i, below, chosen = open_.index((gap.low, gap.high)), gap.below, None
            for probe, size, least, most in rows:
                if probe // PROBES != i:
                    continue
                chosen = Gap(least, most, below, size, least == most)
                if below + size >= aim:
                    break
                below += size
            gaps[at] = chosen


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """shards - 1 boundaries (k1, k2, k3): a row is behind a boundary that is not above its key.

    A boundary between texts is taken where it is within `tolerance` of the shard's even
    share, or as near as any row allows; else the copies of one text are split by k2, and
    the copies of one row (which are alike) by k3, at the copy nearest to the even share.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(0, 0, 0)] * (shards - 1)
    aims = [total * i // shards for i in range(1, shards)]
    near = tolerance * total / shards

    def cut(rows: DataFrame, level: int, aim: int, gap: Gap) -> tuple[float, tuple[int, ...]]:
        """How far the boundary is from the aim, and the boundary from this key on."""
        rest = (0,) * (len(KEYS) - level - 1)
        before, after = aim - gap.below, gap.below + gap.bytes - aim
        best = min((abs(before), (gap.low, *rest)), (abs(after), (gap.high + 1, *rest)))
        if best[0] <= near or not gap.single or not rest:
            return best
        own = rows.where(F.col(KEYS[level]) == gap.low)
        # copies of one row are told apart to the last one, so that every run cuts alike
        fine = 0 if level + 2 == len(KEYS) else near
        inner = _refine(own, KEYS[level + 1], [before], Gap(0, TOP, 0, gap.bytes), fine)[0]
        away, inside = cut(own, level + 1, before, inner)
        return min(best, (away, (gap.low, *inside)))

    gaps = _refine(keys, "k1", aims, Gap(0, TOP, 0, total), near)
    return sorted(cut(keys, 0, aim, gap)[1] for aim, gap in zip(aims, gaps, strict=True))


def behind(cut: tuple[int, ...]) -> Column:
    """1 for a row that is not before the boundary."""
    found = F.lit(True)
    for key, at in reversed(list(zip(KEYS, cut, strict=True))):
        if at > TOP:
            found = F.lit(False)
        else:
            found = (F.col(key) > at) | ((F.col(key) == at) & found)
    return found.cast("int")


def assign(df: DataFrame, shards: int = 16, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, size long (UTF-8 bytes of the text, null none, plus 1), text_crc32 long,
    shard int and slot long (gapless from 0 in each shard, by the key) of every row.

    Shards are ranges of the key with nearly equal bytes: each boundary is within
    `tolerance` of a shard's share, or one row of it. Copies of a text stay together unless
    a boundary could not come that near otherwise (a text whose copies fill more than a
    shard has to be split); copies lie side by side in any case. Rows equal in id and text
    are split like other copies. Null ids and texts have a hash like any other, a very
    long text is one row; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = lambda *cols: F.shiftrightunsigned(F.xxhash64(*cols), 1)
    keys = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), half(text_col).alias("k1"), half(id_col, text_col).alias("k2"))
    keys = materialize(keys.withColumn("k3", F.monotonically_increasing_id()), "shard-keys")
    shard = F.lit(0)
    for boundary in splitters(keys, shards, tolerance):
        shard = shard + behind(boundary)
    # one exchange by ranges of the whole key, which no two rows share
    order = ["shard", *KEYS]
    parts = max(1, -(-keys.count() // ORDER_ROWS), shards)
    ranged = keys.withColumn("shard", shard.cast("int")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number holds the partition in its upper bits and the place in it in the lower ones
    ranged = materialize(ranged.select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "shard-order")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row for each partition and each shard
    offsets = F.broadcast(counts.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    placed = ranged.withColumn("part", part).join(offsets, ["shard", "part"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("at") - F.col("first")).cast("long").alias("slot"))
