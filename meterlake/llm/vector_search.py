"""Approximate nearest neighbours by inner product, with an adaptive scan of dimensions.

Rows lie in lists around centroids, rotated at random. A query scans its nearest lists. There, squared
distances grow block of columns by block; after each block a hypothesis test asks whether the full
distance can still be within the query's threshold: after t of D rotated columns the distance scaled by
D / t strays from the true one by at most a factor 1 + EPSILON / sqrt(t) with high confidence. Pairs
that fail are abandoned, the rest get the exact inner product in double precision.

Inner products become distances by one more column that lifts all rows to the longest row's length.

The centroids come from a bounded sample; every row is placed. The number of lists a query scans is the
smallest that finds `RECALL` of the sample's true neighbours for a sample of queries, so it follows the
data. A query's first threshold is its k-th best inner product among the sample's rows in its lists.
A query that ends with fewer than k rows scans all lists without a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.texts import hash_share
from meterlake.llm.vectors import dimensions, matrix, of_dimension, rotation
from meterlake.storage import Scratch

SAMPLE = 16_384
LISTS = 512
ROWS_PER_LIST = 256
RECALL = 0.97
EPSILON = 2.1
COLUMNS = 16
BLOCK = 2048
QUERY_BLOCK = 512


@dataclass(frozen=True)
class ListIndex:
    """Longest length, rotation, centroids (rotated and lifted), lists to scan, the sample and its lists."""

    longest: float
    turn: np.ndarray
    centroids: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray
    home: np.ndarray

    def lift(self, rows: np.ndarray) -> np.ndarray:
        """Rotated rows of equal length, by one more column."""
        extra = np.sqrt(np.maximum(self.longest**2 - (rows**2).sum(axis=1), 0))
        return np.column_stack([rows, extra]) @ self.turn

    def lift_queries(self, queries: np.ndarray) -> np.ndarray:
        return np.column_stack([queries, np.zeros(len(queries))]) @ self.turn

    def nearest_lists(self, points: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(axis=1) - 2 * points @ self.centroids.T
        return np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.argsort(d, axis=1)

    def thresholds(self, ids: np.ndarray, queries: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best inner product among the sample's rows in its lists, itself left out."""
        if len(self.sample) <= k:
            return np.full(len(queries), -np.inf)
        inside = np.zeros((len(queries), len(self.centroids)), bool)
        np.put_along_axis(inside, lists, True, axis=1)
        scores = np.where(inside[:, self.home], queries @ self.sample.T, -np.inf)
        scores[ids[:, None] == self.sample_ids[None, :]] = -np.inf
        return np.partition(scores, -k, axis=1)[:, -k]


def _centroids(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    c = points[np.random.default_rng(5).permutation(len(points))[:n]]
    for _ in range(rounds):
        near = ((c**2).sum(axis=1) - 2 * points @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, points)
        size = np.bincount(near, minlength=len(c))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def fit(rows: DataFrame, d: int, k: int, seed: int = 3) -> ListIndex:
    """Fit on about `SAMPLE` different rows by hash of id and vector (the bound of what reaches the driver)."""
    n, longest, different = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))),
                                     F.count_distinct(F.xxhash64("vec_id", "vector"))).first()
    chosen = rows.filter(hash_share(F.struct("vec_id", "vector"), min(1.0, SAMPLE / max(different, 1))))
    got = chosen.select("vec_id", "vector", F.xxhash64("vector").alias("tie")).dropDuplicates(["vec_id", "tie"]).toPandas()
    got = got.sort_values(["vec_id", "tie"], kind="stable")
    ids, sample = got["vec_id"].to_numpy(np.int64), matrix(got["vector"]).reshape(len(got), d)
    bare = ListIndex(longest or 0.0, rotation(d + 1, seed), np.zeros((1, d + 1)), 1, ids, sample, np.zeros(len(ids), np.int64))
    points = bare.lift(sample)
    lists = int(np.clip(n // ROWS_PER_LIST, 1, min(LISTS, max(len(sample) // 16, 1))))
    if lists == 1 or len(sample) <= k:
        return bare
    index = replace(bare, centroids=_centroids(points, lists))
    index = replace(index, home=index.nearest_lists(points, 1)[:, 0])
    asked = sample[np.random.default_rng(6).permutation(len(sample))[:128]]
    best = np.argpartition(-(asked @ sample.T), k, axis=1)[:, : k + 1]
    order = np.argsort((index.centroids**2).sum(axis=1) - 2 * index.lift_queries(asked) @ index.centroids.T, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, index.home[best], axis=1).ravel())
    return replace(index, probes=int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1)


def scan_block(index: ListIndex, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
               least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the pairs that survive all tests, best k of each query."""
    points, asked = index.lift(rows), index.lift_queries(queries)
    width = points.shape[1]
    # |q - x|^2 = |q|^2 + longest^2 - 2 <q, x>: the threshold on inner products as a squared distance.
    limit = (queries**2).sum(axis=1) + index.longest**2 - 2 * least
    limit = np.where(np.isfinite(limit), np.maximum(limit, 0) * (1 + 1e-9) + 1e-12, np.inf)
    edges = [*range(COLUMNS, width, COLUMNS), width]
    a, x = asked[:, : edges[0]], points[:, : edges[0]]
    part = (a**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * a @ x.T
    slack = (1 + EPSILON / np.sqrt(edges[0])) ** 2 if edges[0] < width else 1.0
    q, r = np.nonzero(part <= (limit * slack * edges[0] / width)[:, None])
    part = part[q, r]
    own = query_ids[q] != ids[r]
    q, r, part = q[own], r[own], part[own]
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = part + ((asked[q, lo:hi] - points[r, lo:hi]) ** 2).sum(axis=1)
        slack = (1 + EPSILON / np.sqrt(hi)) ** 2 if hi < width else 1.0
        on = part <= limit[q] * slack * hi / width
        q, r, part = q[on], r[on], part[on]
    score = (queries[q] * rows[r]).sum(axis=1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    top = place < k
    return q[top], r[top], score[top]


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, best first.

    Candidates are all rows of the query's dimension with another id; ties go to the smaller id. Vectors
    that are null, zero or hold null or non-finite components, and rows with a null id take no part, nor
    do such queries. Repeated rows are candidates of their own; a query row repeated in a dimension counts
    once. An id that asks in several dimensions has its ranks from all of these. With k candidates or fewer
    in all, each query gets them all.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL")
    out = None
    for d in dimensions(rows, "vector"):
        found = _nearest(of_dimension(rows, "vector", d), d, k, scratch)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return scratch.release(out)


def _nearest(rows: DataFrame, d: int, k: int, scratch: Scratch) -> DataFrame:
    """The result of `search` among usable vectors of one dimension."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(fit(rows, d, k))
    kind = rows.schema["vector"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if len(batch):
                points = shared.value.lift(matrix(batch["vector"]))
                yield batch.assign(list=shared.value.nearest_lists(points, 1)[:, 0].astype(np.int32))

    def route(batches):
        index = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at: at + 256]
                m = matrix(part["vector"])
                lists = index.nearest_lists(index.lift_queries(m), min(index.probes, len(index.centroids)))
                least = index.thresholds(part["vec_id"].to_numpy(), m, lists, k)
                yield part.assign(least=least, lists=list(lists.astype(np.int32)))

    placed = scratch.store(rows.select("vec_id", "vector").mapInPandas(place, f"vec_id long, vector {kind}, list int"), "lists")
    asked = scratch.store(rows.filter("asks").select("vec_id", "vector").dropDuplicates(["vec_id"])
                          .mapInPandas(route, f"vec_id long, vector {kind}, least double, lists array<int>"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(queries: DataFrame) -> DataFrame:
        found = _scan(placed, queries, shared, k)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = scratch.store(best(asked), "found")
    # Who has fewer than k rows, and fewer than there are, asks again everywhere.
    enough = first.groupBy("query_id").count().filter(F.col("count") >= min(k, placed.count() - 1))
    again = scratch.store(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti")
                          .withColumn("least", F.lit(float("-inf")))
                          .withColumn("lists", F.sequence(F.lit(0), F.lit(len(shared.value.centroids) - 1))), "again")
    if not again.isEmpty():
        first = first.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(best(again))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(placed: DataFrame, asked: DataFrame, shared, k: int) -> DataFrame:
    """The best k rows of each query in each block. Long lists, and lists that many queries scan, are
    cut into blocks of bounded size."""
    size = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("row_blocks"))
    asks = asked.select("vec_id", "vector", "least", F.explode("lists").alias("list"))
    asking = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    both = size.join(asking, "list")
    left = (placed.join(both, "list").withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int"))
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
            .select("list", "row_block", "query_block", "vec_id", "vector"))
    right = (asks.join(both, "list").withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int"))
             .withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
             .select("list", "row_block", "query_block", "vec_id", "vector", "least"))
    keys = ["list", "row_block", "query_block"]

    def scan(some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, query_ids = some["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        q, r, score = scan_block(shared.value, ids, matrix(some["vector"]), query_ids, matrix(queries["vector"]),
                                 queries["least"].to_numpy(), k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": score})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
