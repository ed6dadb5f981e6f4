"""Embedding near-duplicates by spherical-cap filters.

Filters are directions of a structured random product code: after a random rotation the dimensions are
cut into parts, each part has its own random codewords, and a filter is one codeword per part. A vector
passes all filters whose inner product with it exceeds a height. These are listed part by part, leaving
branches whose best completion stays below the height, so the code is never enumerated. Codes have two
parts at least, whatever the number of vectors (one dimension cannot be cut and has one).

The height follows the number of vectors: a filter is passed by about `PER_FILTER` of random vectors,
whatever the table's size. Codes with rotations of their own are added until all but `MISSED` of
simulated random pairs at the least cosine share a filter, so recall does not depend on the size. Where
the codes allowed do not suffice (low cosines), filters are made wider, up to one that all vectors pass.

Each shared filter is joined in blocks of bounded size, so a filter that many vectors pass is spread
over many tasks. First only ids go there, with `BITS` signs of random projections: vectors that have no
other one of their block within as many differing signs as the least cosine allows (but for a chance of
`TAIL`) are done with that block. The others meet their vectors and filters and come back. A pair is
counted in the smallest filter that it shares, and only there; what leaves a task is per vector, not per
pair. Every link is verified by its cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, comb, pi
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.components import components
from meterlake.llm.vectors import dimensions, matrix, of_dimension, rotation, usable
from meterlake.storage import Scratch

FILTERS = 24
PER_FILTER = 256
MISSED = 0.0005
BLOCK = 512
BITS = 128
TAIL = 1e-9


@dataclass(frozen=True)
class CapCode:
    """Rotation, codewords of each part, and the height a vector must exceed."""

    turn: np.ndarray
    words: list[np.ndarray]
    height: float

    @staticmethod
    def draw(share: float, d: int, seed: int) -> CapCode:
        """A code whose filters are each passed by `share` of random unit vectors of d dimensions."""
        filters = FILTERS / share / 4
        parts = min(d, max(2, round(np.log(filters) / np.log(1024))))
        size = int(np.ceil(filters ** (1 / parts)))
        random = np.random.default_rng(seed + 1)
        edges = np.linspace(0, d, parts + 1).astype(int)
        words = []
        for a, b in zip(edges[:-1], edges[1:]):
            w = random.standard_normal((size, b - a))
            words.append((w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt((b - a) / d)).astype(np.float32))
        return CapCode(rotation(d, seed).astype(np.float32), words, NormalDist().inv_cdf(1 - share) / np.sqrt(d))

    @staticmethod
    def whole(d: int) -> CapCode:
        """One filter that every vector passes."""
        return CapCode(np.eye(d, dtype=np.float32), [np.zeros((1, d), np.float32)], -1.0)

    @property
    def size(self) -> int:
        return int(np.prod([len(w) for w in self.words]))

    def filters(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a unit vector passes."""
        turned = vectors.astype(np.float32) @ self.turn
        scores, at = [], 0
        for w in self.words:
            scores.append(turned[:, at: at + w.shape[1]] @ w.T)
            at += w.shape[1]
        best = np.array([s.max(axis=1) for s in scores])
        rest = np.cumsum(best[::-1], axis=0)[::-1]  # rest[i]: the most that parts i.. can give
        row, name, so_far = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for i, s in enumerate(scores):
            after = rest[i + 1][row] if i + 1 < len(scores) else 0.0
            reach = s[row] >= (self.height - so_far - after)[:, None]
            k, word = np.nonzero(reach)
            row, name, so_far = row[k], name[k] * len(self.words[i]) + word, so_far[k] + s[row[k], word]
        return row, name


def fit(n: int, d: int, least: float, seed: int = 11, most_codes: int = 64) -> list[CapCode]:
    """Codes for n vectors of d dimensions, as many as `MISSED` asks for at cosine `least`.

    If `most_codes` codes miss more, their filters are passed by four times as many vectors, and so on;
    when even a quarter of all vectors is not enough, one filter holds them all.
    """
    random = np.random.default_rng(seed)
    a = random.standard_normal((2000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = random.standard_normal((2000, d))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    b = least * a + np.sqrt(1 - least**2) * np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9)
    share = min(PER_FILTER / max(n, 1), 0.25)
    while True:
        missed, codes = np.ones(len(a), bool), []
        while missed.mean() > MISSED and len(codes) < most_codes:
            code = CapCode.draw(share, d, seed + 100 * (len(codes) + 1))
            codes.append(code)
            for at in range(0, len(a), 250):
                pairs = [r * code.size + f for r, f in (code.filters(a[at: at + 250]), code.filters(b[at: at + 250]))]
                missed[at + np.unique(np.intersect1d(*pairs) // code.size)] = False
            # Codes are independent: where even that many more of the same would miss too much, no more are drawn.
            if len(codes) >= 4 and missed.mean() ** (most_codes / len(codes)) > MISSED:
                break
        if missed.mean() <= MISSED:
            return codes
        if share >= 0.25:
            return [CapCode.whole(d)]
        share = min(4 * share, 0.25)


def all_filters(codes: list[CapCode], vectors: np.ndarray) -> list[np.ndarray]:
    """Each unit vector's filters of all codes, ascending."""
    rows, names, first = [], [], 0
    for code in codes:
        row, name = code.filters(vectors)
        rows.append(row)
        names.append(name + first)
        first += code.size
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return np.split(name[order], np.searchsorted(row[order], np.arange(1, len(vectors))))


def most_differing(least: float) -> int:
    """Signs in which vectors at the least cosine differ at most, but for a chance of `TAIL`."""
    p = acos(min(max(least, -1.0), 1.0)) / pi
    beyond, k = 0.0, BITS
    while k > 0 and beyond + comb(BITS, k) * p**k * (1 - p) ** (BITS - k) <= TAIL:
        beyond += comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        k -= 1
    return k


def signs(vectors: np.ndarray, seed: int = 23) -> np.ndarray:
    """Signs of `BITS` random projections of each vector, 64 to a number."""
    over = vectors @ np.random.default_rng(seed).standard_normal((vectors.shape[1], BITS)) > 0
    return np.packbits(over, axis=1).view(np.int64)


def _near(left: pd.DataFrame, right: pd.DataFrame, most: int) -> pd.DataFrame:
    """Rows of two blocks that have another one of the other block within `most` differing signs."""
    a, b = (df[["sign_0", "sign_1"]].to_numpy().view(np.uint64) for df in (left, right))
    close = (np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])) <= most
    if left is right:
        np.fill_diagonal(close, False)
        return left[close.any(axis=1)]
    return pd.concat([left[close.any(axis=1)], right[close.any(axis=0)]])


def _links(left: pd.DataFrame, right: pd.DataFrame, name: int, least: float) -> pd.DataFrame:
    """Links between two blocks of one filter, as counts and a spanning forest."""
    same = left is right
    a = matrix(left["vector"])
    b = a if same else matrix(right["vector"])
    cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    hit = cos >= least
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    if not len(i):
        return pd.DataFrame({"vec_id": [], "root": [], "n": []}).astype("int64")
    # A pair belongs to the smallest filter that both pass: drop those that share a smaller one.
    rows, cols = np.unique(i), np.unique(j)
    lower_a = [set(f[f < name].tolist()) for f in left["filters"].iloc[rows]]
    lower_b = [set(f[f < name].tolist()) for f in right["filters"].iloc[cols]]
    names = {f: k for k, f in enumerate(sorted(set().union(*lower_a)))}
    if names:
        inside = np.zeros((len(rows), len(names)), np.float32)
        other = np.zeros((len(cols), len(names)), np.float32)
        for marks, sets in ((inside, lower_a), (other, lower_b)):
            for r, s in enumerate(sets):
                marks[r, [names[f] for f in s if f in names]] = 1
        own = (inside @ other.T)[np.searchsorted(rows, i), np.searchsorted(cols, j)] == 0
        i, j = i[own], j[own]
    u, v = left["vec_id"].to_numpy()[i], right["vec_id"].to_numpy()[j]
    wu, wv = left["copies"].to_numpy()[i], right["copies"].to_numpy()[j]
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = inverse[: len(u)], inverse[len(u):]
    count = np.bincount(x, wv, len(nodes)) + np.bincount(y, wu, len(nodes))
    root = np.arange(len(nodes))
    while True:  # smallest node reachable within this block pair
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"vec_id": nodes, "root": nodes[root], "n": count.astype(np.int64)})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; others link
    with those of their own dimension. Rows with equal vectors are linked; repeated rows count as other
    vectors of the same id. A null id takes no part: no links, null component, kept is null.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    named = rows.filter("vec_id IS NOT NULL")
    out = rows.filter(F.col("vec_id").isNull() | ~usable("vector")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # An id may have vectors of several dimensions; its rows keep the links of their own.
    for d in dimensions(named, "vector"):
        out = out.unionByName(_linked(of_dimension(named, "vector", d), d, least, scratch))
    return scratch.release(out.withColumn("kept", F.col("vec_id") == F.col("component_id")))


def _linked(named: DataFrame, d: int, least: float, scratch: Scratch) -> DataFrame:
    """(vec_id, n_links, component_id) of usable vectors of one dimension."""
    spark = named.sparkSession
    classes = scratch.store(
        named.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "classes")
    members = scratch.store(named
                            .join(classes.select(F.col("vector").alias("same"), "first", "copies"), F.col("vector") == F.col("same"))
                            .select("vec_id", "first", "copies"), "members")
    codes = spark.sparkContext.broadcast(fit(classes.count(), d, least))

    def passed(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at: at + 256]
                m = matrix(part["vector"])
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                s = signs(m)
                yield part.assign(filters=all_filters(codes.value, m), sign_0=s[:, 0], sign_1=s[:, 1])

    caps = classes.select(F.col("first").alias("vec_id"), "copies", "vector").mapInPandas(
        passed, f"vec_id long, copies long, vector {classes.schema['vector'].dataType.simpleString()}, filters array<long>, sign_0 long, sign_1 long")
    caps = scratch.store(caps, "caps")
    rows_of = caps.select("vec_id", "sign_0", "sign_1", F.explode("filters").alias("filter"))
    sizes = caps.select(F.explode("filters").alias("filter")).groupBy("filter").count().filter("count > 1")
    # A filter of many vectors is cut into blocks; each pair of its blocks is a group of its own.
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = (rows_of.join(sizes, "filter").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "filter", "vec_id", "sign_0", "sign_1", "block",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    most = most_differing(least)

    def halves(group: pd.DataFrame, lo: int, hi: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        return (group, group) if lo == hi else (group[group["block"] == lo], group[group["block"] == hi])

    def near(key, group: pd.DataFrame) -> pd.DataFrame:
        return _near(*halves(group, key[1], key[2]), most)[["filter", "lo", "hi", "block", "vec_id"]]

    def within(key, group: pd.DataFrame) -> pd.DataFrame:
        return _links(*halves(group, key[1], key[2]), int(key[0]), least)

    meet = ["filter", "lo", "hi"]
    close = paired.groupBy(*meet).applyInPandas(near, "filter long, lo int, hi int, block int, vec_id long")
    paired = close.join(caps.drop("sign_0", "sign_1"), "vec_id")
    found = scratch.store(paired.groupBy(*meet).applyInPandas(within, "vec_id long, root long, n long"), "found")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "first")
    groups = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch).withColumnRenamed("node", "first")
    return (members.join(counts, "first", "left").join(groups, "first", "left")
            .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "first").alias("component_id")))
