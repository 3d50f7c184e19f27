"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on ``n_lines`` random lines. In each block of rows, each line's
projections form one sorted array. A query opens a window around its own projection
in every array and widens all windows step by step (virtual rehashing: the same
arrays serve every radius). Rows that fall into the windows of at least
``min_collisions`` lines are candidates; a query stops widening once a block has given
``candidates`` of them, or all its rows. Candidates are verified by their inner product
in double precision.

For inner products that need not agree with distances, every vector gets a further
component that makes all norms equal (zero for queries), so the nearest in distance
has the largest inner product.

Rows are dealt into blocks and queries into blocks by id; each pair of blocks is a
group of bounded size, so a task's memory doesn't follow the table. Only the best
``k`` of each pair leave it. A vector that many rows repeat is spread with its rows.

Defined results: rows whose id or vector is null, or whose vector is zero, holds null
or non-finite components or has another length than most, take no part; rows of
equal id each take part, and a query leaves out the rows of its own id; fewer
candidates than ``k`` give them all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promospark.llm.common import ship_package

RESULT = "query_id long, vec_id long, score double"


def _lines(dim: int, n_lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n_lines))


def search_block(queries: np.ndarray, rows: np.ndarray, largest_norm: float, n_lines: int, min_collisions: int,
                 candidates: int, first_width: float, growth: float, seed: int) -> list[np.ndarray]:
    """For each query, the places in ``rows`` that are candidates."""
    if n_lines > 255:
        raise ValueError("collisions are counted in one byte")
    lines = _lines(rows.shape[1] + 1, n_lines, seed)
    rest = np.sqrt(np.maximum(largest_norm ** 2 - (rows ** 2).sum(1), 0))
    projected = (rows @ lines[:-1] + rest[:, None] * lines[-1]).T
    n = len(rows)
    order = np.argsort(projected, axis=1, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=1)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    places = np.empty((n_lines, n), kind)  # of each row in each sorted array
    np.put_along_axis(places, order, np.arange(n, dtype=kind)[None], axis=1)
    # Queries are scaled to the rows' common norm, which fixes what a width means.
    centres = (queries @ lines[:-1]) * (largest_norm / np.linalg.norm(queries, axis=1))[:, None]
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    wanted, width, open_queries = min(candidates, n), first_width * largest_norm, np.arange(len(queries))
    while len(open_queries):
        at = centres[open_queries]
        low = np.stack([np.searchsorted(a, at[:, j] - width) for j, a in enumerate(arrays)], 1).astype(kind)
        high = np.stack([np.searchsorted(a, at[:, j] + width, "right") for j, a in enumerate(arrays)], 1).astype(kind)
        still = []
        for i, (lo, hi) in enumerate(zip(low, high)):
            inside = (places - lo[:, None]) < (hi - lo)[:, None]  # places below the window wrap round to large
            hits = np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= min_collisions)
            if len(hits) >= wanted or (not lo.any() and (hi == n).all()):
                found[open_queries[i]] = hits
            else:
                still.append(open_queries[i])
        open_queries, width = np.array(still, np.int64), width * growth
    return found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _searcher(k: int, largest_norm: float, options: dict) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = np.stack(queries["vector"].to_numpy()), np.stack(rows["vector"].to_numpy())
        q_ids, x_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        out = []
        for i, hits in enumerate(search_block(q, x, largest_norm, **options)):
            hits = hits[x_ids[hits] != q_ids[i]]
            scores = (x[hits] * q[i]).sum(axis=1)
            best = _best(x_ids[hits], scores, k)
            out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": x_ids[hits][best], "score": scores[best]}))
        return pd.concat(out)
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>) and its norm, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return rows.where(finite).withColumn("norm", norm).where(F.col("norm") > 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            n_lines: int = 64, min_collisions: int = 36, candidates: int = 800, first_width: float = 1.0,
            growth: float = 1.1, rows_at_once: int = 4096, queries_at_once: int = 1024, seed: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, by inner product.

    ``is_query`` is a condition on ``vec_id``.
    """
    ship_package(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    facts = rows.groupBy(F.size("vector").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"),
        F.sum(is_query.cast("long")).alias("n_queries")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == facts["dim"])
    row_blocks = -(-facts["n"] // rows_at_once)
    query_blocks = max(1, -(-(facts["n_queries"] or 0) // queries_at_once))
    dealt = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(row_blocks)).cast("int")
    dealt_queries = F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.lit(query_blocks)).cast("int")
    blocks = rows.select("vec_id", "vector", dealt.alias("row_block"),
                         F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = rows.where(is_query).select("vec_id", "vector", dealt_queries.alias("query_block"),
                                        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"))
    options = {"n_lines": n_lines, "min_collisions": min_collisions, "candidates": candidates,
               "first_width": first_width, "growth": growth, "seed": seed}
    found = (asked.groupBy("query_block", "row_block").cogroup(blocks.groupBy("query_block", "row_block"))
             .applyInPandas(_searcher(k, facts["norm"], options), RESULT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
