"""Hard-negative mining with Kronecker-packed products.

For an anchor, its best rows of the same label are positives; a hard negative of a positive is
a row of another label whose score lies in a band below the positive's.  Scores are integer
inner products.

One component of many candidates is packed into one wide integer: components are biased so
that none is negative, and each candidate has a field wide enough for a whole inner product.
Multiplying this integer by one component of the anchor multiplies every field at once, and
the sum over the components holds one exact inner product per field, since no field can carry
into the next one.  The biases are taken off after the fields are unpacked.

Anchors and candidates come in blocks of bounded size, each pair of blocks in a task.  A first
pass compares blocks of one label and ranks the positives; a second one, which knows the bands,
compares with blocks of all labels.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.sources.stage import stage

ANCHOR_BLOCK = 256
CANDIDATE_BLOCK = 8192
LONG = np.iinfo(np.int64)


class Packed:
    """The components of a block of vectors, one wide integer per component.

    ``reach`` is the largest biased component that an anchor may have.
    """

    def __init__(self, vectors: np.ndarray, reach: int) -> None:
        self.n, self.dim = vectors.shape
        self.bias = max(0, -int(vectors.min()))
        biased = vectors.view(np.uint64) + np.uint64(self.bias)  # at most 64 bits, also where a long would overflow
        self.sums = biased.sum(axis=1) if int(biased.max()) < 2**40 else biased.astype(object).sum(axis=1)
        # a field holds the inner product of any anchor and any candidate of the block
        self.field = max(1, -(-(self.dim * int(biased.max()) * reach).bit_length() // 8))
        fields = np.zeros((self.dim, self.n, max(8, self.field)), np.uint8)
        fields[:, :, :8] = np.ascontiguousarray(biased.T).astype("<u8").view(np.uint8).reshape(self.dim, self.n, 8)
        self.wide = [int.from_bytes(np.ascontiguousarray(f[:, : self.field]).tobytes(), "little") for f in fields]

    def scores(self, anchor: list[int], bias: int) -> np.ndarray:
        """Inner products of all vectors with an anchor whose components have had ``bias`` added."""
        product = sum(map(operator.mul, self.wide, anchor))
        raw = product.to_bytes(self.n * self.field, "little")
        off = self.dim * bias * self.bias - self.bias * sum(anchor)
        if self.field < 8:
            cells = np.zeros((self.n, 8), np.uint8)
            cells[:, : self.field] = np.frombuffer(raw, np.uint8).reshape(self.n, self.field)
            return cells.view("<u8").ravel().astype(np.int64) - bias * self.sums.astype(np.int64) + off
        exact = (int.from_bytes(raw[i : i + self.field], "little") for i in range(0, len(raw), self.field))
        held = [min(max(x - bias * int(s) + off, LONG.min), LONG.max) for x, s in zip(exact, self.sums)]
        return np.array(held, np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The places, out of ``among``, of the k greatest scores; ties to smaller ids."""
    if len(among) > k:
        least = np.partition(scores[among], -k)[-k]
        among = among[scores[among] >= least]
    return among[np.lexsort((rows[among], ids[among], -scores[among]))][:k]


def dense(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1), np.int64)


def compared(anchors: pa.Table, candidates: pa.Table):
    """For each anchor its place and the exact scores of all candidates."""
    a = dense(anchors)
    bias = max(0, -int(a.min()))
    packed = Packed(dense(candidates), int(a.max()) + bias)
    for i, row in enumerate(a.tolist()):
        yield i, packed.scores([x + bias for x in row], bias)


def usable(vectors: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``row, id, label, dim, v, anchor``: the rows that take part, with a number of their own
    and components floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    there = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    kept = vectors.filter(there & (F.size(vector_col) > 0)).filter(sound).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.size(vector_col).alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return kept.withColumn("row", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(anchors, F.lit(False)))


def positives_of(base: DataFrame, k: int) -> DataFrame:
    """``row, positives``: per anchor its k best other rows of the same label."""
    blocks = base.groupBy("label", "dim").agg(
        F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("n"),
        F.ceil(F.sum(F.col("anchor").cast("long")) / ANCHOR_BLOCK).cast("int").alias("m")).filter("m > 0")
    placed = base.join(blocks, ["label", "dim"]).withColumn("h", F.xxhash64("row"))
    left = placed.filter("anchor").select(
        "label", "dim", "row", "v", F.expr("cast(pmod(h, m) as int)").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cb"))
    right = placed.select(
        "label", "dim", "id", "row", "v", F.expr("cast(pmod(h, n) as int)").alias("cb"),
        F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("qb"))
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def pick(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            own = anchors.column("row").to_numpy()
            ids, rows = candidates.column("id").to_numpy(), candidates.column("row").to_numpy()
            for i, scores in compared(anchors, candidates):
                found = best(scores, ids, rows, np.flatnonzero(rows != own[i]), k)
                out += zip([int(own[i])] * len(found), ids[found].tolist(), rows[found].tolist(), scores[found].tolist())
        return pa.table({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(("row", "id", "other", "score"))})

    keys = "label", "dim", "qb", "cb"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pick, "row long, id long, other long, score long")
    ranked = W.partitionBy("row").orderBy(F.desc("score"), "id", "other")
    return (
        found.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= k)
        .groupBy("row").agg(F.collect_list(F.struct("id", "other", "score")).alias("positives"))
    )


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10, least: int = 30,
                   most: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows are anchors (a column over ``id, label, dim, v``).  A positive
    is one of the anchor's ``positives`` best other rows of its label; for each, the
    ``negatives`` best rows of other labels with ``least * p <= 100 * score <= most * p``,
    where ``p`` is the positive's score.  Components are floor(scale * x).  Equal scores are
    ordered by smaller id.

    Null ids, labels, vectors, and vectors that are empty or hold a null or non-finite
    component take no part; vectors of another length are not compared.  Rows are told apart
    by row and not by id: repeated ids are rows of their own and may be each other's positives.
    An anchor without positive or negative gives no row, nor does an empty table.  Components
    and scores beyond a long are held at its ends.
    """
    base = stage(usable(vectors, anchors, id_col, vector_col, label_col, scale), "vectors")
    n_rows, n_anchors = base.agg(F.count("*"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0))).first()
    n, m = max(1, -(-n_rows // CANDIDATE_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    h = F.xxhash64("row")
    left = base.filter("anchor").join(positives_of(base, positives), "row").select(
        "dim", "label", "row", F.col("id").alias("anchor_id"), "v", "positives",
        F.pmod(h, F.lit(m)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cb"))
    right = base.select(
        "dim", "label", "row", "id", "v",
        F.pmod(h, F.lit(n)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb"))
    right = right.toDF(*right.columns)
    names = ("row", "anchor_id", "other", "positive_id", "positive_score", "negative_id", "negative_score", "negative")

    def pick(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            ids, rows = candidates.column("id").to_numpy(), candidates.column("row").to_numpy()
            coded = candidates.column("label").combine_chunks().dictionary_encode()
            code = {x: j for j, x in enumerate(coded.dictionary.to_pylist())}
            labels = coded.indices.to_numpy()
            own = queries.select(["row", "anchor_id", "label", "positives"]).to_pylist()
            for i, scores in compared(queries, candidates):
                q = own[i]
                bands = [(p, -(-least * p["score"] // 100), most * p["score"] // 100) for p in q["positives"]]
                bands = [b for b in bands if b[1] <= b[2]]
                if not bands:
                    continue
                inside = (scores >= min(b[1] for b in bands)) & (scores <= max(b[2] for b in bands))
                near = np.flatnonzero(inside & (labels != code.get(q["label"], -1)))
                for p, low, high in bands:
                    among = near[(scores[near] >= low) & (scores[near] <= high)]
                    found = best(scores, ids, rows, among, negatives)
                    head = q["row"], q["anchor_id"], p["other"], p["id"], p["score"]
                    out += [(*head, *r) for r in zip(ids[found].tolist(), scores[found].tolist(), rows[found].tolist())]
        return pa.table({name: pa.array([r[j] for r in out], pa.int64()) for j, name in enumerate(names)})

    keys = "dim", "qb", "cb"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pick, ", ".join(f"{n} long" for n in names))
    ranked = W.partitionBy("row", "other").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
