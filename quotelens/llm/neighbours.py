"""Approximate nearest neighbours by a forest of sorted hash strings.

Every tree hashes a vector to a long string of bits (the sides of random planes it lies on) and keeps
the strings in a sorted array, where vectors that share a prefix stand together. A query finds in all
trees the stretch that shares its longest prefixes, and all trees ascend together, one bit shorter at
a time, until the union of their stretches holds enough candidates; a level is always taken whole.
Candidates are measured exactly on the original vectors.

The index is cut into segments of bounded size by a hash of the row's id, each with its own forest;
every query visits every segment, in blocks of queries, and the nearest of all segments are merged.
Vectors of different lengths have no distance, so each length has segments and blocks of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import read

TREES, BITS = 64, 32
SEGMENT_ROWS, QUERY_ROWS = 100_000, 20_000
#: The ascent ends with this share of the segment as candidates, and this many at least. The vectors
#: at hand are spread evenly in 64 dimensions, so near ones share only short prefixes; ``recall`` measures it.
SHARE, LEAST = 0.4, 2000
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 5):
        self.vectors = vectors
        self.middle = vectors.mean(0)
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], BITS))
        keys = [self.keys(vectors, t) for t in range(trees)]
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.sorted = [k[o] for k, o in zip(keys, self.order)]

    def keys(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        sides = (vectors - self.middle) @ self.planes[tree] > 0
        return sides @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, wanted: int):
        """Rows of each query's candidates: at least ``wanted``, or all."""
        keys = np.stack([self.keys(queries, t) for t in range(len(self.order))], 1)
        for own in keys:
            marked = np.zeros(len(self.vectors), bool)
            spans = [(0, 0)] * len(own)
            for level in range(BITS, -1, -1):
                shift = np.uint64(BITS - level)
                for t, key in enumerate(own):
                    low = key >> shift << shift
                    a = np.searchsorted(self.sorted[t], low)
                    b = np.searchsorted(self.sorted[t], low + (np.uint64(1) << shift))
                    was = spans[t]
                    if (b - a) != (was[1] - was[0]):
                        marked[self.order[t][a:b]] = True
                        spans[t] = (a, b)
                # The stretches' sizes bound the union from below by the largest and from above by the sum.
                if sum(b - a for a, b in spans) >= wanted and np.count_nonzero(marked) >= wanted:
                    break
            yield np.flatnonzero(marked)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _search(k: int, share: float, least: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        if index.num_rows and queries.num_rows:
            ids, vectors = index.column("vec_id").to_numpy(), _matrix(index, "vector")
            asked, points = queries.column("query_id").to_numpy(), _matrix(queries, "vector")
            forest = Forest(vectors)
            wanted = min(len(ids), max(least, int(share * len(ids))))
            for q, point, rows in zip(asked, points, forest.candidates(points, wanted)):
                rows = rows[ids[rows] != q]
                distance = np.sqrt(np.square(vectors[rows] - point).sum(1))
                if len(rows) > k:
                    # All ties with the k-th stay until ids decide.
                    near = distance <= np.partition(distance, k - 1)[k - 1]
                    rows, distance = rows[near], distance[near]
                best = np.lexsort((ids[rows], distance))[:k]
                out["query_id"] += [q] * len(best)
                out["vec_id"] += ids[rows[best]].tolist()
                out["score"] += distance[best].tolist()
        return pa.table({f.name: pa.array(out[f.name], pa.float64() if f.name == "score" else pa.int64()) for f in FOUND})

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out are rows whose id or vector is null, and vectors that are all zero or empty or hold null
    or non-finite numbers.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.where("vec_id is not null and vector is not null").where(~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by ``every`` their k nearest others of the same length.

    Other columns are ignored. Rows that share a vec_id are each candidates for other queries and one
    query (of the smallest vector); a query never finds its own id. Equal distances go by vec_id. An
    empty table, or one of unusable vectors, gives an empty result, and so does a query that is alone
    with its length.
    """
    rows = usable(vectors).withColumn("n", F.size("vector"))
    # One row per length, so few; without the broadcast all rows of one length would meet in one task.
    lengths = rows.groupBy("n").agg(F.count("*").alias("rows"))
    lengths = lengths.select(
        "n", F.ceil(F.col("rows") / SEGMENT_ROWS).alias("segments"), F.greatest(F.lit(1), F.ceil(F.floor(F.col("rows") / every) / QUERY_ROWS)).alias("parts")
    )
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("n", F.size("vector"))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    index = rows.join(F.broadcast(lengths), "n").withColumn("segment", dealt("segments", "vec_id", "vector")).withColumn("part", number("parts")).drop("segments", "parts")
    queries = asked.join(F.broadcast(lengths), "n").select(
        F.col("vec_id").alias("query_id"), "vector", "n", dealt("parts", "vec_id", F.lit(1)).alias("part"), number("segments").alias("segment")
    )
    groups = ["n", "segment", "part"]
    found = index.groupBy(*groups).cogroup(queries.groupBy(*groups)).applyInArrow(_search(k, share, least), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
