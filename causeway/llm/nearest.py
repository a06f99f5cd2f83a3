"""Approximate nearest neighbours by collision-counting hashing, for inner products.

A shard of vectors keeps one sorted array for each random projection. Around a query's own
projection a window of each array is opened; virtual rehashing widens all windows by one
factor a round and counts only what is new in them. A vector that lies in enough windows
is verified by its exact inner product. The search of a shard ends when the k-th best
verified vector is as near as the radius that the windows stand for, or when the windows
hold the whole shard.

Largest inner product becomes nearest point by one more component, ``sqrt(M^2 - |x|^2)``
for a vector (M: the largest norm) and 0 for a query, which is scaled to norm M.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 1 << 16  # vectors in a shard, about
BLOCK = 512  # queries that are sent to a shard at once, about
PROJECTIONS = 32
SHARE = 0.57  # of the windows that must hold a vector
WIDTH = 2.0  # of a window, in radii
GROWTH = 1.3  # of the radius in each round
START = 0.2  # the first radius, in units of M


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors that take part, once each, as ``vec_id, vector, size``."""
    vector = F.col("vector")
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
        .where(F.col("vec_id").isNotNull() & vector.isNotNull())
        .where(~broken & F.exists(vector, lambda x: x != 0))
        .withColumn("size", F.size("vector"))
        .dropDuplicates(["vec_id", "vector"])
    )


class Shard:
    """Sorted projections of some vectors, whose norms are at most ``largest``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
        self.rest = rest
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        projected = vectors @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        self.order = np.argsort(projected, axis=0).T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, 0).T.copy()

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
        """Query ids, vector ids and inner products of the best ``k`` found for each query."""
        norms = np.sqrt((queries**2).sum(axis=1))
        centres = (queries * (self.largest / norms)[:, None]) @ self.lines[:-1]
        n, need = len(self.ids), math.ceil(SHARE * PROJECTIONS)
        radius = START * self.largest
        live = np.arange(len(queries))
        left = np.stack([np.searchsorted(s, centres[:, i]) for i, s in enumerate(self.sorted)], axis=1)
        right = left.copy()
        counts = np.zeros((len(queries), n), np.uint8)
        checked = np.zeros((len(queries), n), bool)
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        while len(live):
            half = WIDTH * radius / 2
            low = np.stack([np.searchsorted(s, centres[live, i] - half) for i, s in enumerate(self.sorted)], axis=1)
            high = np.stack([np.searchsorted(s, centres[live, i] + half, "right") for i, s in enumerate(self.sorted)], axis=1)
            going = []
            for row, q in enumerate(live):
                fresh = [self.order[i, a:b] for i, (a, b) in enumerate(zip(low[row], left[q], strict=True)) if a < b]
                fresh += [self.order[i, a:b] for i, (a, b) in enumerate(zip(right[q], high[row], strict=True)) if a < b]
                left[q], right[q] = np.minimum(left[q], low[row]), np.maximum(right[q], high[row])
                if fresh:
                    counts[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.uint8)
                    found = np.flatnonzero((counts[q] >= need) & ~checked[q])
                    if len(found):
                        checked[q, found] = True
                        found = found[self.ids[found] != query_ids[q]]
                        score = np.concatenate([best[q][0], self.vectors[found] @ queries[q]])
                        which = np.concatenate([best[q][1], found])
                        keep = np.lexsort((self.ids[which], -score))[:k]
                        best[q] = score[keep], which[keep]
                everything = bool((right[q] - left[q]).min() == n)
                if not everything:
                    # squared distance to the k-th best, from its inner product
                    if len(best[q][0]) >= k:
                        near = 2 * self.largest**2 - 2 * best[q][0][k - 1] * self.largest / norms[q]
                        if near <= radius**2:
                            continue
                    going.append(q)
            live = np.array(going, np.int64)
            radius *= GROWTH
        of, ids, scores = [], [], []
        for q, (score, which) in enumerate(best):
            of += [query_ids[q]] * len(which)
            ids += self.ids[which].tolist()
            scores += score.tolist()
        return of, ids, scores


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD,
    block_rows: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """The ``k`` vectors with the largest inner products that are found for each query.

    Returned are ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id; a
    query with fewer candidates has them all. Both tables have the columns ``id_col`` and
    ``vector_col``; others are not read. Null ids, and vectors that are null, zero, empty or
    hold null or non-finite components, take no part. A row that repeats an id and its
    vector counts once; a query's own id is never its neighbour; vectors of different
    length are not compared. Empty tables give no rows.

    Every shard of ``vectors`` is searched by all queries, in blocks: a task holds one shard
    and one block, and hands on at most ``k`` rows a query.
    """
    rows, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    total, largest = rows.agg(
        F.count("*"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))),
    ).first()
    shards = max(1, math.ceil(total / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    spread = F.xxhash64("vec_id", "vector")
    dealt = rows.withColumn("shard", F.pmod(spread, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    sent = asked.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )

    def search(table: pa.Table) -> pa.Table:
        is_query = table["asks"].to_numpy()
        ids = table["vec_id"].to_numpy()
        flat = table["vector"].combine_chunks().flatten().to_numpy()
        matrix = flat.reshape(len(ids), -1).astype(np.float64)
        found: tuple[list, list, list] = ([], [], [])
        if is_query.any() and not is_query.all():
            shard = Shard(ids[~is_query], matrix[~is_query], largest, seed)
            at = np.flatnonzero(is_query)
            for part in np.array_split(at, max(1, len(at) // 128)):
                for total_column, column in zip(found, shard.search(ids[part], matrix[part], k), strict=True):
                    total_column.extend(column)
        return pa.table(
            {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())}
        )

    columns = ["size", "shard", "block", "vec_id", "vector"]
    together = dealt.select(*columns, F.lit(False).alias("asks")).unionByName(sent.select(*columns, F.lit(True).alias("asks")))
    found = together.groupBy("size", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
