"""Exact top-k search by inner product, with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks; a block holds, for each dimension, its vectors in the order of that component. A query reads
the lists from the side its sign prefers, in steps of growing depth, scores every vector it meets, and stops once the score
bound of all unmet vectors, the sum of its weights times the components at the present depth, is below its k-th score. A
bound equal to it goes on, as an unmet vector with that score could have a smaller id. Queries come in blocks too, so a
task holds one block of each. The best of all blocks are merged.

Components become floor(256 * x), x as double; scores are whole numbers. Vectors that are null, empty, or hold a null or
non-finite component take no part, nor do rows without an id. Of several rows with one id the lowest vector counts.
Vectors of different lengths don't meet. Scores beyond a long are cut to its range.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .store import written

SCALE, VECTORS, QUERIES, FIRST = 256, 8192, 512, 32


class Lists:
    """A block of vectors and its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.down = self.up[:, ::-1]

    def best(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best vectors for query q; vectors with the id `own` are left out."""
        n = len(self.ids)
        dims = np.flatnonzero(q != 0)
        lists = [self.down[i] if q[i] > 0 else self.up[i] for i in dims]
        seen = self.ids == own
        top: list[tuple[int, int]] = []  # (-score, id)
        depth = 0 if lists else n
        if not lists:  # every score is 0
            return [(0, int(i)) for i in np.sort(self.ids[~seen])[:k]]
        while depth < n:
            more = min(n, max(2 * depth, FIRST))
            met = np.zeros(n, dtype=bool)
            for x in lists:
                met[x[depth:more]] = True
            rows = np.flatnonzero(met & ~seen)
            seen[rows] = True
            depth = more
            score = self.vectors[rows] @ q
            if len(top) == k:
                able = score >= -top[-1][0]
                rows, score = rows[able], score[able]
            if len(rows) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= cut], score[score >= cut]
            top = sorted([*top, *zip((-score).tolist(), self.ids[rows].tolist())])[:k]
            bound = sum(q[i] * self.vectors[x[depth - 1], i] for i, x in zip(dims, lists))
            if len(top) == k and bound < -top[-1][0]:
                break
        return [(int(-s), i) for s, i in top]


def _matrix(rows: pd.Series) -> np.ndarray:
    """floor(256 * x) of the components; as Python's whole numbers where a product of doubles could round."""
    m = np.floor(np.stack(rows.to_list()).astype(np.float64) * SCALE)
    with np.errstate(over="ignore"):
        exact = m.shape[1] * np.abs(m).max(initial=0) ** 2 < 2.0 ** 53
    return m if exact else np.array([[int(x) for x in r] for r in m], dtype=object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, n_vectors: int = VECTORS, n_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (vec_id, embedding) for each row of queries (same columns)."""
    def usable(df):
        x = F.col("embedding")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        one = df.select("vec_id", x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine)
        # Written, so that a row stays in its block when a task runs again.
        return written(one.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")

    def blocked(df, size):
        return df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-df.count() // size)))).cast("int"))

    v, q = usable(vectors), usable(queries)
    left, right = blocked(v, n_vectors), blocked(q, n_queries).withColumnRenamed("block", "q_block")
    # The number of blocks is known, so each side meets all blocks of the other one by a key.
    left = left.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-q.count() // n_queries) - 1)))))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-v.count() // n_vectors) - 1)))))
    key = ["dim", "block", "q_block"]

    def search(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(one) and len(two):
            both = _matrix(pd.concat([one["embedding"], two["embedding"]]))
            lists = Lists(one["vec_id"].to_numpy(), both[:len(one)])
            for own, w in zip(two["vec_id"].tolist(), both[len(one):]):
                rows += [(own, i, min(max(s, -2 ** 63), 2 ** 63 - 1)) for s, i in lists.best(own, w, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS bigint) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS int) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
