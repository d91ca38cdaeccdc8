"""Nearest neighbours by inner product: a block matrix join of int8 tiles with error bounds.

Queries and candidates are dealt to blocks, and every query block meets every candidate block in one tile. A tile
multiplies the vectors rounded to int8. The rounding error of each product is bounded, so a candidate whose upper bound
stays below the k-th best lower bound of its query cannot be among the nearest. What is left is computed again from the
original numbers in double precision and merged by heaps, first in the tile, then over all tiles of a query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, table

STRIP, QUERY_STRIP = 2048, 1024  # candidates and queries multiplied at a time
EXACT_PAIRS = 1 << 20  # numbers of vectors multiplied again at a time
LARGE = 1e100  # vectors with a largest component beyond this, or below its inverse, are never rounded


def usable_vectors(df: DataFrame, key: str, vector: str, row: str) -> DataFrame:
    """``(row, key, vector)``: finite vectors without null components that are not all zero, of rows with a key."""
    v = F.col("vector")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return out.where(F.col("key").isNotNull() & fit)


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values held as floats that multiply exactly, the scale of each row, and its sum of absolute values."""
    scale = np.abs(x).max(axis=1) / 127.0
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return np.rint(x / scale[:, None]).astype(exact), scale, np.abs(x).sum(axis=1)


def _odd(x: np.ndarray) -> np.ndarray:
    """Rows whose products could leave the range of doubles, or whose steps could leave that of normal ones."""
    most = np.abs(x).max(axis=1)
    return (most > LARGE) | (most < 1 / LARGE)


def _products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision; what has no value, because it runs to both infinities, is minus infinity."""
    out, step = np.empty(len(rows)), max(1, EXACT_PAIRS // q.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(rows), step):
            out[at : at + step] = np.einsum("ij,ij->i", q[rows[at : at + step]], x[cols[at : at + step]])
    return np.where(np.isnan(out), -np.inf, out)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return t["row"].to_numpy(), t["key"].to_numpy(), values.reshape(t.num_rows, -1)


def nearest_in_tile(q_own: np.ndarray, q: np.ndarray, c_own: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int, int]]]:
    """For each query of a tile the ``k`` best ``(score, -id, -row)``, in no order; what has the query's own mark takes no part."""
    best: list[list[tuple[float, int, int]]] = [[] for _ in q_own]
    strips = []
    for at in range(0, len(c_rows), STRIP):
        x = c[at : at + STRIP]
        odd = _odd(x)
        strips.append((at, x, odd, _rounded(np.where(odd[:, None], 1.0, x))))
    dim = q.shape[1]
    for here in range(0, len(q_own), QUERY_STRIP):
        marks, y = q_own[here : here + QUERY_STRIP], q[here : here + QUERY_STRIP]
        odd_q = _odd(y)
        q8, qs, q1 = _rounded(np.where(odd_q[:, None], 1.0, y))
        floor = np.full(len(marks), -np.inf)  # k-th best score found so far
        for at, x, odd, (x8, xs, x1) in strips:
            rows_at, ids = c_rows[at : at + STRIP], c_ids[at : at + STRIP]
            rough = (q8 @ x8.T).astype(np.float64) * qs[:, None] * xs[None, :]
            # |qx - rough| <= |q| e_x + |x| e_q + dim e_q e_x, where a component is off by half a step at most
            slack = (q1[:, None] * xs[None, :] + qs[:, None] * x1[None, :]) / 2 + (dim / 4) * qs[:, None] * xs[None, :]
            slack += 1e-9 * (q1[:, None] * x1[None, :])
            own = marks[:, None] == c_own[at : at + STRIP][None, :]
            unknown = odd_q[:, None] | odd[None, :]
            low = np.where(own | unknown, -np.inf, rough - slack)
            if len(ids) > k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            rows, cols = np.nonzero(((rough + slack >= floor[:, None]) | unknown) & ~own)
            exact = _products(y, x, rows, cols)
            for r, s, i, j in zip((here + rows).tolist(), exact.tolist(), ids[cols].tolist(), rows_at[cols].tolist()):
                heap = best[r]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i, -j))
                elif (s, -i, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -i, -j))
            floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in best[here : here + len(marks)]])
    return best


def _tile(k: int, by_key: bool):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if queries.num_rows and candidates.num_rows:
            (q_rows, q_ids, q), (c_rows, c_ids, c) = _matrix(queries), _matrix(candidates)
            q_own, c_own = (q_ids, c_ids) if by_key else (q_rows, c_rows)
            for row, i, heap in zip(q_rows.tolist(), q_ids.tolist(), nearest_in_tile(q_own, q, c_own, c_ids, c_rows, c, k)):
                for s, j, at in heap:
                    for column, value in zip(out, (row, i, -j, -at, s)):
                        column.append(value)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], ["query_row", "query_id", "vec_id", "vec_row", "score"])

    return run


def nearest_neighbours(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    row: str | None = None,
    query_block: int = 16_384,
    candidate_block: int = 16_384,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` candidates with the largest inner product, exact, ties to the smaller id.

    Every row is a query or candidate of its own, also those that share a key. ``row`` names a column with a distinct
    long for every row, the same on both sides; then only a query's own row is no candidate of it. Without it no row
    with the query's key is.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a key;
    vectors of different lengths are never compared. A product beyond the range of doubles is an infinity, one that runs
    to both infinities counts as minus infinity. All candidates come back if there are fewer than ``k``. Other columns
    are ignored, empty tables give no rows. A candidate is copied once for each ``query_block`` queries.
    """
    if by_key := row is None:
        (queries, q_row), (candidates, c_row) = (numbered(df.select(F.col(f"`{key}`"), F.col(f"`{vector}`"))) for df in (queries, candidates))
    else:
        q_row = c_row = row
    q, c = usable_vectors(queries, key, vector, q_row), usable_vectors(candidates, key, vector, c_row)
    q_blocks = max(1, math.ceil(queries.count() / query_block))
    c_blocks = max(1, math.ceil(candidates.count() / candidate_block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """A block of its own for each row, and a copy for each block of the other side."""
        return df.select(
            F.size("vector").alias("dim"),
            F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
            "row",
            "key",
            "vector",
        )

    tile = ["dim", "qb", "cb"]
    tiles = dealt(q, "qb", q_blocks, "cb", c_blocks).groupBy(*tile).cogroup(dealt(c, "cb", c_blocks, "qb", q_blocks).groupBy(*tile))
    best = tiles.applyInArrow(_tile(k, by_key), "query_row long, query_id long, vec_id long, vec_row long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20; of rows with one id each is a row of its own."""
    vectors, row = numbered(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return nearest_neighbours(vectors.where("vec_id % 20 = 0"), vectors, row=row)
