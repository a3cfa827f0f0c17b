"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into equal segments; each has a mean and a deviation.  For one segment of
length L the squared distance of two vectors is at least L ((mean a - mean b)^2 + (dev a -
dev b)^2), so their inner product is at most L (mean a mean b + dev a dev b); finer cuts
give tighter bounds.  From coarse to fine, candidates whose bound cannot reach the k-th best
score known so far are left out; survivors get their exact score.

Queries and candidates come in blocks of bounded size, and a task compares one block of
queries with one block of candidates; the best k of each block pair meet in a last ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.sources.stage import stage

SEGMENTS = (1, 4, 16)
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the segment length."""
    cut = np.array_split(np.arange(x.shape[1]), segments)
    means = np.stack([x[:, c].mean(axis=1) for c in cut], axis=1)
    spread = np.stack([x[:, c].std(axis=1) for c in cut], axis=1)
    root = np.sqrt([len(c) for c in cut])
    return means * root, spread * root


class Level:
    """The statistics of a block of vectors at one cut."""

    def __init__(self, x: np.ndarray, segments: int) -> None:
        self.values = np.concatenate(statistics(x, segments), axis=1)
        self.squares = (self.values * self.values).sum(axis=1)

    def lower_bounds(self, of: np.ndarray, square: float, rows: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of one vector, given by its statistics, to the
        rows; with the norms they bound inner products."""
        return self.squares[rows] + square - 2 * self.values[rows] @ of


def best_of_block(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int):
    """``place of the query, place of the candidate, score`` of the k best candidates of each
    query, ties to smaller ids; a row is no candidate of its own.  Vectors are integers held as
    float64.

    Statistics are made once for the block.  A query starts with all candidates; each level,
    coarse to fine, is evaluated on those that the levels before have left, and its best-looking
    ones are scored to raise the k-th best score known."""
    segments = sorted({min(s, x.shape[1]) for s in SEGMENTS})
    qn, xn = (q * q).sum(1), (x * x).sum(1)
    levels = [(Level(q, s), Level(x, s)) for s in segments]
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(x_rows != q_rows[i])
        least = -np.inf
        for mine, theirs in levels:
            upper = (qn[i] + xn[alive] - theirs.lower_bounds(mine.values[i], mine.squares[i], alive)) / 2
            upper += 1e-6 * (1 + np.abs(upper))  # rounding never cuts off an exact score
            looks = alive[np.argpartition(-upper, k)[:k]] if len(alive) > k else alive
            known = np.sort(x[looks] @ q[i])[::-1]
            if len(known) >= k:
                least = max(least, known[k - 1])
            alive = alive[upper >= least]
        scores = x[alive] @ q[i]
        order = np.lexsort((x_rows[alive], x_ids[alive], -scores))[:k]
        out.append((np.full(len(order), i), alive[order], scores[order].astype(np.int64)))
    return [np.concatenate([o[j] for o in out]) for j in range(3)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, row``: vectors without null or non-finite component, as integers floor(1024 x),
    with a number of their own.  Arrow passes them on as they are; null ids take no part."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c * 1024).cast("double"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("v"), F.monotonically_increasing_id().alias("row"))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows for each query row.

    Fewer than k others give fewer rows; a lone row gives none, and vectors of another length
    than the query's are not compared.  Repeated ids are rows of their own: each is a query and
    a candidate of the others.  The number of blocks grows with the table, never their size.
    """
    base = stage(usable(vectors, id_col, vector_col).withColumn("q", queries), "vectors")
    counts = base.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    n_query = max(1, -(-counts[1] // QUERY_BLOCK))
    n_candidate = max(1, -(-counts[0] // CANDIDATE_BLOCK))
    spread = F.xxhash64("row")

    query_block = F.pmod(spread, F.lit(n_query)).cast("int")
    candidate_block = F.pmod(spread, F.lit(n_candidate)).cast("int")
    q_side = base.filter("q").withColumn("qb", query_block).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(n_candidate - 1))))
    c_side = base.withColumn("cb", candidate_block).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    both = [s.select("qb", "cb", F.size("v").alias("dim"), "id", "row", "v") for s in (q_side, c_side)]
    both[1] = both[1].toDF(*both[1].columns)  # columns of its own, as both sides come from one table

    def dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("row").to_numpy(), table.column("id").to_numpy(), flat.reshape(table.num_rows, -1)

    names = "query", "query_id", "row", "vec_id", "score"

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows or not left.column("dim")[0].as_py():
            found = [np.zeros(0, np.int64)] * len(names)
        else:
            (q_rows, q_ids, q), (x_rows, x_ids, x) = dense(left), dense(right)
            i, j, scores = best_of_block(q, q_rows, x, x_rows, x_ids, k)
            found = [q_rows[i], q_ids[i], x_rows[j], x_ids[j], scores]
        return pa.table([pa.array(f, pa.int64()) for f in found], list(names))

    keys = "qb", "cb", "dim"
    found = both[0].groupBy(*keys).cogroup(both[1].groupBy(*keys)).applyInArrow(compare, ", ".join(f"{n} long" for n in names))
    ranked = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
