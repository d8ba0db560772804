"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

The words of the mix are dealt in blocks of equal size. Blocks go to sources, and within a
source to its shards, by highest quotients (votes / (2 * seats + 1)), so that every shard
has an integer quota before anything is selected. Within a shard the documents lie in a
seeded order on one line of words that is cut into blocks; a seeded permutation of the
block numbers picks the blocks that fill the quota, whole passes first, and the last block
that is picked gives only the words that are still due. The last block of a line may be
short, so quotas are filled in words; what rounding to blocks left of a source's target is
added to one of its shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLANK_PATTERN, WORD_PATTERN, quoted, word_count

BLOCK_WORDS, SHARD_ROWS, SEED = 16, 256, "mix-1"
#: Quota and source tables up to this many rows are broadcast (under 100 bytes a row).
BROADCAST_ROWS = 100_000
PRIMES = (1000000007, 1500000001, 1900000043, 2147483647)
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_runs")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def seeded(*parts: str | Column) -> Column:
    """A 60-bit number from the seed and the given values (null counts as empty)."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(units: DataFrame, group: Sequence[str], votes: str, seats: str, tie: str, out: str) -> DataFrame:
    """units with column `out`: the seats of each unit, `seats` (a column, the same within a
    group) dealt by highest quotients, ties to the smaller `tie` (unique in its group).

    Each unit surely gets the seats below its share by the widest possible divisor, so only
    a few quotients for each unit are ranked, not one for each seat.
    """
    within = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    share = F.when(F.col("__votes") > 0, F.col(votes) / F.col("__votes")).otherwise(0.0)
    units = units.withColumn("__units", F.count("*").over(within)).withColumn("__votes", F.sum(votes).over(within))
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("__units") / 2) + 0.5) - 1).cast("long")
    high = F.when(F.col(votes) > 0, F.ceil(share * (F.col(seats) + F.col("__units") / 2) + 0.5) + 1).otherwise(-1).cast("long")
    units = units.withColumn("__low", low).withColumn("__high", high).withColumn("__left", F.col(seats) - F.sum("__low").over(within))
    tries = F.when(F.col("__high") >= F.col("__low"), F.sequence("__low", "__high")).otherwise(F.array().cast("array<bigint>"))
    rows = units.select(*group, tie, F.col(votes).alias("__v"), "__left", F.explode(tries).alias("__k"))
    best = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    best = best.orderBy(F.desc(F.col("__v") / (2 * F.col("__k") + 1)), F.asc(tie), F.asc("__k"))
    won = rows.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= F.col("__left"))
    won = won.groupBy(*group, tie).agg(F.count("*").alias("__won"))
    joined = units.join(won, [*group, tie], "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0)))
    return joined.drop("__units", "__votes", "__low", "__high", "__left", "__won")


def targets(sources: DataFrame, weights: Sequence[int], total: float, cap: float) -> DataFrame:
    """sources (source, words, ...) with s (number by code point, null last), weight and
    target: `total` times all words shared by weight, none above `cap` times its words.

    By rising cap / weight a source is capped while the level that the rest would share is
    above its own; the first level that is not is the level of all others.
    """
    everything = Window.partitionBy(F.lit(0))
    numbered = sources.withColumn("s", (F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    ordered = everything.orderBy("__ratio", "s")
    found = numbered.withColumn("weight", weight.cast("long")).withColumn("__cap", cap * F.col("words"))
    found = found.withColumn("__ratio", F.col("__cap") / F.col("weight")).withColumn("__all", total * F.sum("words").over(everything))
    before = F.coalesce(F.sum("__cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    found = found.withColumn("__level", (F.col("__all") - before) / rest)
    level = F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything)
    found = found.withColumn("__at", F.coalesce(level, F.lit(float("inf"))))
    return found.withColumn("target", F.least(F.col("__cap"), F.col("__at") * F.col("weight"))).drop("__cap", "__ratio", "__all", "__level", "__at")


def power_of_two(rows: Column) -> Column:
    """The least power of two that makes shards of at most SHARD_ROWS of `rows` on average."""
    wanted = F.greatest(F.ceil(rows / SHARD_ROWS), F.lit(1)).cast("long")
    return F.when(wanted == 1, 1).otherwise(F.pow(F.lit(2), F.length(F.bin(wanted - 1)))).cast("long")


def hashed(df: DataFrame) -> Column:
    """A hash of all columns that have one (maps do not)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def mixed(df: DataFrame, weights: Sequence[int], total: float, cap: float, id_col: str, source_col: str, size: str | Column | None) -> DataFrame:
    """row (a struct of df's columns) and the columns that `mix` adds."""
    words = word_count("text") if size is None else (F.col(size) if isinstance(size, str) else size).cast("long")
    sized = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("origin"), words.alias("mix_size"), hashed(df).alias("tie"))
    sized = sized.withColumn("__h", seeded("id", "mix_size"))
    # shards are powers of two, so those of every source divide the number of fine ones
    fine = 1 << max(0, -(-df.count() // SHARD_ROWS) - 1).bit_length()
    parts = sized.groupBy(F.col("origin").alias("source"), (F.col("__h") % fine).alias("fine")).agg(F.count("*").alias("rows"), F.sum("mix_size").alias("words"))
    parts = materialize(parts, "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    sources = targets(sources, weights, total, cap).withColumn("shards", power_of_two(F.col("rows")))
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS + 0.5).cast("long")
    sources = apportion(sources.withColumn("__seats", seats), [], "target", "__seats", "s", "blocks").drop("__seats")
    sources = materialize(sources.withColumn("due", F.floor(F.col("target") + 0.5).cast("long")), "mix-sources")
    known = small(sources.select("source", "s", "shards", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target")))
    by_shard = parts.join(small(sources.select(F.col("source").alias("__source"), "s", "shards", "blocks", "due")), F.col("source").eqNullSafe(F.col("__source")))
    by_shard = by_shard.groupBy("s", (F.col("fine") % F.col("shards")).alias("shard")).agg(F.sum("words").alias("n"), F.first("blocks").alias("blocks"), F.first("due").alias("due"))
    quotas = materialize(apportion(by_shard, ["s"], "n", "blocks", "shard", "quota").where("n > 0"), "mix-shards")
    # the shard of the highest quota, ties to the smaller number, takes what rounding left
    most = quotas.groupBy("s").agg(F.min_by("shard", F.struct(-F.col("quota"), "shard")).alias("most"))
    quotas = quotas.join(small(most), "s")
    rest = F.when(F.col("shard") == F.col("most"), F.col("due") - BLOCK_WORDS * F.col("blocks")).otherwise(0)
    quotas = quotas.withColumn("quota", F.least(F.greatest(BLOCK_WORDS * F.col("quota") + rest, F.lit(0)), F.floor(F.lit(float(cap)) * F.col("n"))).cast("long"))
    draw, m = seeded("s", "shard"), F.ceil(F.col("n") / BLOCK_WORDS).cast("long")
    quotas = quotas.withColumn("m", m).withColumn("draw", draw).withColumn("c", F.col("draw") % F.col("m"))
    quotas = quotas.withColumn("p", F.element_at(F.array(*map(F.lit, PRIMES)), (F.col("draw") % len(PRIMES) + 1).cast("int")).cast("long"))
    # the place of the short last block among the picked ones, and the words that it lacks
    quotas = quotas.withColumn("last", ((F.col("m") - 1) * F.col("p") + F.col("c")) % F.col("m")).withColumn("lacks", F.col("m") * BLOCK_WORDS - F.col("n"))
    quotas = quotas.select("s", "shard", "m", "c", "p", "last", "lacks", F.expr("quota DIV n").alias("base"), (F.col("quota") % F.col("n")).alias("extra"))
    quotas = small(materialize(quotas, "mix-quotas"))

    known = known.withColumnRenamed("source", "__source")
    found = sized.join(known, F.col("origin").eqNullSafe(F.col("__source")))
    found = found.withColumn("shard", F.col("__h") % F.col("shards"))
    line = Window.partitionBy("s", "shard").orderBy("__h", "id", "mix_size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("__o", F.sum("mix_size").over(line) - F.col("mix_size"))
    found = found.join(quotas, ["s", "shard"], "left")
    # block j has place k in the seeded order; once more than `base` it gives its words up to number `upto`
    b = BLOCK_WORDS
    runs = f"""CASE WHEN mix_size > 0 AND m IS NOT NULL THEN flatten(transform(transform(
        sequence(__o DIV {b}, (__o + mix_size - 1) DIV {b}), j -> named_struct('j', j, 'k', (j * p + c) % m)),
      x -> transform(array(greatest(0L, least({b}L, extra - {b} * x.k + CASE WHEN last < x.k THEN lacks ELSE 0L END))), upto -> array(
        named_struct('start', greatest(x.j * {b}, __o) - __o, 'stop', least(x.j * {b} + upto, __o + mix_size) - __o, 'times', base + 1),
        named_struct('start', greatest(x.j * {b} + upto, __o) - __o, 'stop', least((x.j + 1) * {b}, __o + mix_size) - __o, 'times', base)))))
      ELSE CAST(array() AS array<array<struct<start:bigint,stop:bigint,times:bigint>>>) END"""
    found = found.withColumn("mix_runs", F.expr(f"filter(flatten({runs}), r -> r.start < r.stop)"))
    found = found.withColumn("mix_taken", F.expr("aggregate(mix_runs, 0L, (acc, r) -> acc + (r.stop - r.start) * r.times)"))
    return found.select("row", *ADDED)


def mix(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    total: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: str | Column | None = None,
) -> DataFrame:
    """df and the columns mix_size, mix_source_size, mix_target, mix_taken (words that the
    mix takes of the document, repeats counted) and mix_runs, the runs of words behind
    mix_taken: array of (start, stop, times), word numbers of the document. Columns of df
    with these names are replaced.

    Documents are dealt to the shards of their source by a seeded hash and cut into blocks of
    BLOCK_WORDS; a source has a shard for about SHARD_ROWS rows. A source takes at most `cap`
    times its words, a document at most `cap` rounded up times its words. A null source
    is a source of its own, a null text has no words and is never taken; a very long text is
    blocks like any other, repeated rows are mixed one by one. Equal input gives equal
    output, however it is partitioned. Sources (one row each) are ordered in one task.
    """
    found = mixed(df, weights, total, cap, id_col, source_col, size)
    return found.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ADDED], *ADDED)


def take(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixed documents with the columns of df: a row for each pass that takes words of
    the document, as many as the mix makes, whose text is what the pass takes (the whole
    text, or its taken runs with the blanks behind each word); `length_col` follows the text."""
    found = mixed(df, weights, total, cap, id_col, source_col, word_count(text_col))
    words = f"regexp_extract_all(text, {quoted(f'({WORD_PATTERN}{BLANK_PATTERN}*)')}, 1)"
    passes = F.coalesce(F.array_max(F.transform("mix_runs", lambda r: r["times"])), F.lit(0))
    found = found.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), passes))).withColumn("text", F.col(f"row.`{text_col}`"))
    # the words are bound once for all runs of the text
    part = f"""element_at(transform(array({words}), w -> array_join(flatten(transform(filter(mix_runs, r -> r.times >= pass),
      r -> slice(w, CAST(r.start + 1 AS INT), CAST(r.stop - r.start AS INT)))), '')), 1)"""
    text = F.when(F.forall("mix_runs", lambda r: r["times"] >= F.col("pass")), F.col("text")).otherwise(F.expr(part))
    found = found.select("row", text.alias("text"))
    changed = {text_col: F.col("text").cast(dict(df.dtypes)[text_col])}
    if length_col in df.columns:
        changed[length_col] = F.length("text").cast(dict(df.dtypes)[length_col])
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])
