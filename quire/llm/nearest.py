"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots.  The vectors are
dealt to blocks of bounded size, and a block posts each of its vectors, with the
pivot's place in its order, in the inverted files of its first pivots.  A query
reads the files of its own first pivots in a block and so adds up the footrule
distance to every posted vector (a pivot that only one of the two orders has counts
as lying after the other's kept part); the nearest by footrule are reranked by the
exact measure and the block's best go on.  Blocks meet blocks of queries, so no task
holds more than one of each.  Equal vectors are indexed once, with the ids that can
be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, table
from quire.llm.vectors import matrix, usable

K = 20
#: Pivots (vectors of smallest hash), and how many of a vector's order are kept.
PIVOTS = 256
PREFIX = 64
#: Of a block's vectors, the share and the least number that are reranked.  The share is above a
#: third, as a group of near copies may hold a third of all rows and its orders are nearly the same.
SHARE = 0.4
LEAST = 400
BLOCK = 8192
QUERIES = 1024


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (by cosine; ties to the smaller number)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(unit), min(prefix, len(pivots))), np.int16)
    for lo in range(0, len(unit), 2048):
        near = unit[lo : lo + 2048] @ pivots.T
        out[lo : lo + 2048] = np.argsort(-near, axis=1, kind="stable")[:, : out.shape[1]]
    return out


class Files:
    """Inverted files of a block: for each pivot what the place of each vector posted there lacks to the end, 0 for the others.

    A vector is posted under a good part of all pivots, so a file has a cell for each.
    """

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.size = order.shape
        # A sum of shared places is size * (size + 1) / 2 at most.
        self.files = np.zeros((pivots, n), np.uint16 if self.size < 256 else np.uint32)
        self.files[order, np.arange(n)[:, None]] = lacks = self.size - np.arange(self.size)
        self.lacks = np.repeat(lacks.astype(self.files.dtype), n).reshape(-1, n)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of a query's order to each vector's.

        Both orders alone cost ``size * (size + 1)``; a shared pivot takes off what
        either place lacks to the end and adds the difference of the places.
        """
        shared, one = np.zeros((2, self.files.shape[1]), self.files.dtype)
        for place, pivot in enumerate(order.tolist()):
            shared += np.minimum(self.files[pivot], self.lacks[place], out=one)
        return self.size * (self.size + 1) - 2 * shared.astype(np.int32)


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties to the smaller id."""
    if k < len(score) and np.isfinite(score).all():
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _ordered(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            out: list = []
            sizes = np.array([len(v) for v in batch.column(at)], np.int64)
            found: dict[int, np.ndarray] = {}
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                if dims in pivots:
                    order = orders(matrix(batch.column(at).take(pa.array(own))), pivots[dims], prefix)
                    found |= dict(zip(own.tolist(), order, strict=True))
            out = [found.get(i) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int16()))], [*batch.schema.names, "order"])

    return run


def _meet(pivots: dict[int, int], k: int, share: float, least: int):
    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        ids_, scores, lists = [], [], []
        for dims in {len(v) for v in asked["embedding"]}:
            some, mine = asked[asked["embedding"].map(len) == dims], rows[rows["embedding"].map(len) == dims]
            if not len(mine):
                continue
            q, v = np.stack(some["embedding"].to_numpy()), np.stack(mine["embedding"].to_numpy())
            first = mine["vid"].to_numpy()
            ids = mine["ids"].to_numpy()
            take = max(least, int(share * len(v)))
            files = Files(np.stack(mine["order"].to_numpy()), pivots[dims]) if dims in pivots else None
            room = np.empty((min(take, len(v)), dims))  # reranked vectors; a new array for each query costs more than the copy
            for i, query_id in enumerate(some["query_id"].tolist()):
                near, some_v = np.arange(len(v)), v
                if files is not None and take < len(v):
                    near = np.argpartition(files.footrule(np.asarray(some["order"].iloc[i])), take - 1)[:take]
                    near.sort()
                    some_v = np.take(v, near, axis=0, out=room, mode="clip")
                score = np.einsum("ij,j->i", some_v, q[i])
                best = top(score, first[near], k + 1)
                ids_ += [query_id] * len(best)
                scores += score[best].tolist()
                lists += [ids[j] for j in near[best]]
        return pd.DataFrame({"query_id": pd.Series(ids_, dtype="int64"), "score": pd.Series(scores, dtype="float64"), "ids": lists})

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each of ``queries`` among ``vectors``.

    Both have (vec_id, embedding).  Vectors that are null, zero or hold null or
    non-finite components take no part, nor does a null id; vectors of other lengths
    are no candidates; a query's own id is no candidate; ties go to the smaller id.
    Rows that repeat an id are one vector, the smallest usable of theirs.  A block that
    is smaller than ``least`` is searched whole, so ``k`` are returned wherever there are
    as many.  An empty table gives no rows; no other column is read.
    """
    both = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    ranked = both(vectors).withColumn("h", F.xxhash64("embedding"))
    first = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = ranked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = cut(few.groupBy("h", "embedding").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = cut(both(queries).select(F.col("vec_id").alias("query_id"), "embedding"))
    sample = distinct.orderBy(F.xxhash64("h", "vid"), "vid").limit(pivots).select("embedding").collect()
    by: dict[int, list] = {}
    for row in sample:
        by.setdefault(len(row[0]), []).append(np.array(row[0]))
    points = {dims: np.stack(v) for dims, v in by.items()}
    points = {dims: v / np.linalg.norm(v, axis=1, keepdims=True) for dims, v in points.items()}
    shards, parts = max(1, -(-distinct.count() // block)), max(1, -(-asked.count() // QUERIES))
    index = distinct.select("vid", "ids", "embedding").mapInArrow(_ordered(points, prefix), "vid long, ids array<long>, embedding array<double>, order array<short>")
    posts = index.withColumn("shard", F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    reads = asked.mapInArrow(_ordered(points, prefix), "query_id long, embedding array<double>, order array<short>")
    reads = reads.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    meet = _meet({dims: len(v) for dims, v in points.items()}, k, share, least)
    met = reads.groupBy("part", "shard").cogroup(posts.groupBy("part", "shard")).applyInPandas(meet, "query_id long, score double, ids array<long>")
    each = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
