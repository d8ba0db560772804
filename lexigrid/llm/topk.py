"""Exact top-k search by inner product with block-at-a-time pruning.

Candidates are dealt once into ranges of similar vectors, a range is cut into blocks. Every
range and every block has an upper bound for a query, the sum over the dimensions (terms) of
the largest product that its extreme values allow. A query first searches the range that it
lies in itself, which gives it a k-th score; it is sent on only to the ranges whose bound
reaches that score. In a range it visits the blocks by falling bound, scores each through
the block's own rows (its forward index), and stops when the next bound is below its k-th
score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Candidates of a range (about), queries that meet one in a task, candidates of a block,
#: ranges whose bounds are computed in one task, and sampled vectors that the ranges gather around.
GROUP_ROWS, QUERY_ROWS, BLOCK_ROWS, BOUND_ROWS, PIVOTS = 16384, 4096, 256, 4096, 64
RANGE = ("dims", "cell", "part")
MOST = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """row (its number), id, v array<double> = floor(scale * component), an integer of any
    size, and dims. Rows that are null, or hold a null or non-finite component (before or after
    scaling), take no part."""
    vec = F.col(vec_col)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(scaled(x)) & (F.abs(scaled(x)) < float("inf")))
    # from 2^53 on a double is an integer
    ints = F.transform(vec, lambda x: F.when(F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return df.where(vec.isNotNull() & sound).select(F.col(id_col).alias("id"), ints.alias("v"), F.size(vec).alias("dims")).withColumn("row", F.monotonically_increasing_id())


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def blocks_of(vectors: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers by block: neighbours of a few pivots side by side, then ranges."""
    pivots = vectors[:: max(1, len(vectors) // 32)]
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.argmax(vectors @ pivots.T, axis=1)
    order = np.argsort(near, kind="stable")
    return [order[i : i + rows] for i in range(0, len(order), rows)]


def bounds_of(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, a line for each query, a column for each (top, low); a
    little above where doubles are not exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)).T
    found = np.where(size < 1 << 52, found, found + size * 1e-9)
    return np.where(np.isnan(found), np.inf, found)


def search(ids: list, numbers: np.ndarray, vectors: np.ndarray, query_numbers: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None, block_rows: int = 0) -> tuple[list, int]:
    """For each query its at most k best (score, id, number) of these candidates, best first,
    ties to the smaller id (null last); and the number of (query, block) scorings.

    The row of the query's own number is left out. Candidates below `floor` (a score for
    each query) may be left out. Scores beyond the range of a long are its ends.
    """
    dims = vectors.shape[1]
    high = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    parts = blocks_of(vectors, block_rows or BLOCK_ROWS)
    top = np.array([vectors[p].max(axis=0) for p in parts]).reshape(len(parts), dims)
    low = np.array([vectors[p].min(axis=0) for p in parts]).reshape(len(parts), dims)
    bounds = bounds_of(queries, top, low)
    if high < 1 << 52:
        q, data = queries, vectors
    elif high < 1 << 62:
        q, data = queries.astype(np.int64), vectors.astype(np.int64)
    else:  # exact integers of any size
        whole = np.vectorize(int, otypes=[object])
        q, data = (whole(x) if x.size else x.astype(object) for x in (queries, vectors))
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple]] = [[] for _ in range(len(q))]
    kth = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    active, scored = np.arange(len(q)), 0
    for step in range(len(parts)):
        turn = visit[active, step]
        going = np.minimum(bounds[active, turn], float(MOST)) >= kth[active]  # a block at the k-th score may hold a smaller id
        active, turn = active[going], turn[going]
        if not len(active):
            break
        scored += len(active)
        for block in np.unique(turn):
            rows, own = parts[block], active[turn == block]
            scores = q[own] @ data[rows].T
            if scores.dtype == object:
                scores = np.clip(scores, -MOST - 1, MOST)
            for i, line in zip(own, scores, strict=True):
                few = np.flatnonzero(line.astype(np.float64) >= kth[i])
                if len(few) > 2 * k + 2:  # one more than k: the query itself may be there
                    few = few[line[few] >= np.sort(line[few])[len(few) - k - 1]]
                found = [(int(line[j]), ids[rows[j]], int(numbers[rows[j]])) for j in few if numbers[rows[j]] != query_numbers[i]]
                best[i] = sorted(best[i] + found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]
                if len(best[i]) >= k:
                    kth[i] = max(kth[i], float(best[i][k - 1][0]))
    return best, scored


def ranged(vectors: DataFrame) -> DataFrame:
    """vectors with cell (the sampled vector of highest inner product, of equal length) and
    part: cells of over GROUP_ROWS rows are split by hash."""
    sample = vectors.orderBy(F.xxhash64("v"), "row").limit(PIVOTS).select("v").collect()  # PIVOTS vectors at most
    by_dims: dict[int, list] = {}
    for row in sample:
        by_dims.setdefault(len(row.v), []).append(row.v)
    pivots = {dims: np.array(v, dtype=np.float64).reshape(len(v), dims).T for dims, v in by_dims.items()}

    def run(batches):
        for batch in batches:
            dims, cells = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for n in np.unique(dims):
                if int(n) in pivots:
                    at = np.flatnonzero(dims == n)
                    with np.errstate(over="ignore", invalid="ignore"):
                        cells[at] = np.argmax(_matrix(batch.column("v").take(pa.array(at)), int(n)) @ pivots[int(n)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    celled = vectors.select("row", "id", "v", "dims").mapInArrow(run, f"row long, id {vectors.schema['id'].dataType.simpleString()}, v array<double>, dims int, cell int")
    celled = materialize(celled, "cells")
    sizes = celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))  # PIVOTS rows for each length at most
    return celled.join(sizes, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")


def extremes(ranges: DataFrame) -> DataFrame:
    """RANGE, top and low: the largest and smallest value of each dimension."""

    def run(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in RANGE], axis=1)
            unique, of = np.unique(keys, axis=0, return_inverse=True)
            out: list[list] = [[], []]
            for i, (dims, _, _) in enumerate(unique):
                values = _matrix(batch.column("v").take(pa.array(np.flatnonzero(of.ravel() == i))), int(dims))
                out[0].append(values.max(axis=0).tolist())
                out[1].append(values.min(axis=0).tolist())
            columns = [pa.array(unique[:, i], pa.int32()) for i in range(3)] + [pa.array(x, pa.list_(pa.float64())) for x in out]
            yield pa.RecordBatch.from_arrays(columns, [*RANGE, "top", "low"])

    parts = ranges.select(*RANGE, "v").mapInArrow(run, "dims int, cell int, part int, top array<double>, low array<double>")
    each = parts.select(*RANGE, F.posexplode_outer(F.arrays_zip("top", "low")).alias("pos", "x"))
    each = each.groupBy(*RANGE, "pos").agg(F.max("x.top").alias("top"), F.min("x.low").alias("low"))
    line = F.array_sort(F.collect_list(F.struct("pos", "top", "low")))
    whole = each.groupBy(*RANGE).agg(line.alias("line")).withColumn("line", F.filter("line", lambda x: x["pos"].isNotNull()))
    return whole.select(*RANGE, F.col("line.top").alias("top"), F.col("line.low").alias("low"))


def top_k(df: DataFrame, is_query: str | Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank int (from 1), the candidate's id, score long.

    Queries are the rows for which `is_query` (over `id_col`) holds; candidates of each are
    all other rows, repeated rows and rows without an id (last among ties) included. Vectors
    meet only those of equal length. Scores are exact; one beyond the range of a long is its
    end, and ties there go to the smaller id as well. A query that has repeated ids is
    answered once for each row. A range meets its queries in chunks of QUERY_ROWS, and k
    rows of each (query, range) meet in the final ranking. The id must be integral. Extra
    columns are not read; an empty table gives no rows.
    """
    vectors = materialize(integer_vectors(df, id_col, vec_col, scale), "vectors")
    ranges = materialize(ranged(vectors), "ranges")
    queries = ranges.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    schema = "query long, query_id long, row long, id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            numbers, asked, asked_ids = left.column("row").to_numpy(), right.column("row").to_numpy(), right.column("id").to_pylist()
            floor = right.column("floor").to_numpy(zero_copy_only=False).astype(np.float64) if "floor" in right.column_names else None
            floor = None if floor is None else np.where(np.isnan(floor), -np.inf, floor)
            best, _ = search(left.column("id").to_pylist(), numbers, _matrix(left.column("v"), dims), asked, _matrix(right.column("v"), dims), k, floor)
            for i, rows in enumerate(best):
                for score, found, number in rows:
                    for column, value in zip(out, (int(asked[i]), asked_ids[i], number, found, score), strict=True):
                        column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query", "query_id", "row", "id", "score"])

    # a range holds its own queries, so these are as many as its rows at most
    home = materialize(ranges.groupBy(*RANGE).cogroup(queries.groupBy(*RANGE)).applyInArrow(meet, schema), "home")
    reached = home.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    asking = materialize(queries.join(reached, "row", "left"), "asking")

    # bounds of ranges and queries in blocks of both; only what reaches the k-th score goes on
    limits = materialize(extremes(ranges), "extremes")
    n_limits, n_asking = max(1, -(-limits.count() // BOUND_ROWS)), max(1, -(-asking.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = limits.withColumn("x", F.pmod(F.xxhash64(*RANGE), F.lit(n_limits)).cast("int")).withColumn("y", every(n_asking))
    right = asking.withColumn("y", F.pmod(F.xxhash64("row"), F.lit(n_asking)).cast("int")).withColumn("x", every(n_limits))

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "id", "v", "floor", *RANGE]
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in types], names=names)
        dims = left.column("dims")[0].as_py()
        bounds = np.minimum(bounds_of(_matrix(right.column("v"), dims), _matrix(left.column("top"), dims), _matrix(left.column("low"), dims)), float(MOST))
        floor = right.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        home = (right.column("cell").to_numpy()[:, None] == left.column("cell").to_numpy()[None]) & (right.column("part").to_numpy()[:, None] == left.column("part").to_numpy()[None])
        i, j = np.nonzero((bounds >= np.where(np.isnan(floor), -np.inf, floor)[:, None]) & ~home)
        i, j = pa.array(i), pa.array(j)
        return pa.table([right.column(c).take(i).cast(t) for c, t in zip(names[:4], types, strict=False)] + [left.column(c).take(j).cast(pa.int32()) for c in RANGE], names=names)

    types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), *[pa.int32()] * 3]
    sent = left.groupBy("dims", "x", "y").cogroup(right.groupBy("dims", "x", "y")).applyInArrow(route, "row long, id long, v array<double>, floor long, dims int, cell int, part int")
    sent = materialize(sent, "sent")
    chunks = sent.groupBy(*RANGE).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    visited = ranges.join(chunks, list(RANGE)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    visiting = sent.join(chunks, list(RANGE)).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
    keys = [*RANGE, "chunk"]
    away = visited.groupBy(*keys).cogroup(visiting.groupBy(*keys)).applyInArrow(meet, schema)

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    ranking = home.union(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranking.select("query_id", "rank", F.col("id").alias(id_col), "score")
