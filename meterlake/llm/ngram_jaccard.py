"""Exact Jaccard join of word n-grams by parity sketches.

Sets whose similarity is at least T per cent differ in at most (a + b)(100 - T) / (100 + T) members.
Within a band of sizes, hashes deal the members of every set to the same blocks, and a block keeps the
XOR of its members' hashes (its parity sketch). A differing member changes one block, so the number of
differing blocks, like the Hamming distance of any parity sketch, never exceeds the number of
differing members. By the pigeonhole principle two similar sets agree in a block.

* Bands overlap by the factor T, so that each similar pair lies within a band.
* A set emits its first d + 1 + s filled blocks, d being its greatest possible difference to a partner.
  Both sets of a similar pair then emit s + 1 blocks that agree, s being the smaller set's: up to the
  k-th of them, each set has at most d filled blocks that differ.
* Small sets have a block per member and emit all, so s is all but what a similar set may lack, and one. There, what stands before
  the first sketch that two sets agree in differs, which bounds their difference from below.
* Sketches of passages that many texts share come from many sets. Of its sketches that others share, a
  set leaves out the s most common (the order is the same for all sets, so the rarest block that two
  similar sets agree in stays in both). A set with no more than s shared sketches has no partner.
* Sets that agree in a block are not all compared: they are tested against pivots of their block, and
  what is then connected is not tested again. Pairs that remain between different components are compared
  within blocks of few sets.
* Blocks of many sets that are still not connected hold texts with a long template in common. Their sets
  meet by their rarest members instead: of two similar sets, the smaller's members that the larger lacks
  are so few that one of its first rarest members is among the first ones of the larger. What all have in
  common is then never a reason to compare two sets. Members and blocks of one member go this way alike,
  and a member of many sets is dealt into parts.
* A test first compares 1,024-bit parity sketches, whose Hamming distance must not exceed the bound,
  then counts the members in common.

Equal sets are one set with several documents throughout. Members are 64-bit hashes of word n-grams.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from meterlake.llm.components import components, join_components
from meterlake.llm.texts import free_name, map_texts, mix, word_hashes, words
from meterlake.storage import Scratch

PIVOT_ROUNDS = 2
#: Sets of a block that are compared with each other; those of larger blocks meet by their rarest members.
CROWDED = 64
#: Sets that a task meets at a time for one member.
PART = 1024
#: Parts into which the documents of a class of equal sets are dealt.
SALTS = 256
#: Widest size ratio within a band, overlap included; bands up to the second size have a block per member.
BAND_RATIO = 2.5
SMALL = 384
#: Up to this number of ids, copies to leave out and texts to read again are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """Words of an n-gram and the least similarity in per cent."""

    words: int = 3
    percent: int = 90

    def greatest_difference(self, n: int) -> int:
        """Most members by which a set of n and a larger similar one can differ."""
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def lacking(self, n: Column) -> Column:
        """Most members of a set of n that any similar set lacks."""
        return F.floor(n * (100 - self.percent) / 100)

    def lacking_in_larger(self, n: Column) -> Column:
        """Most members of a set of n that a similar set of the same size or more lacks."""
        return F.floor(n * (100 - self.percent) / (100 + self.percent))

    def spare(self, n: int) -> int:
        return 4 + n // 50

    def bands(self) -> list[tuple[int, int]]:
        """Sizes (from, to) of the overlapping bands; any similar pair fits in one."""
        out, low = [], 1
        while low < 1 << 40:
            high = max(int(low * BAND_RATIO), low + 1)
            out.append((low, high))
            low = max(high * self.percent // 100, low + 1)
        return out

    def blocks(self, high: int) -> int:
        """Blocks of a band: somewhat more than its largest sets emit, or none for small sets.

        Small sets have a block per member instead. Beyond them, a set fills too few blocks for the
        guarantee with a chance far below one in a thousand million.
        """
        return 0 if high < SMALL else int(1.35 * (self.greatest_difference(high) + 1 + self.spare(high)))

    def within(self, a: Column, b: Column, difference: Column) -> Column:
        return (100 + self.percent) * difference <= (a + b) * (100 - self.percent)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words, A-Z lowered."""
    low = _LOWER[data]
    start, end, of = words(low, offsets)
    h = word_hashes(low, start, end)
    edges = np.searchsorted(of, np.arange(len(offsets)))
    out = []
    total = np.zeros(len(h), np.uint64)
    for i in range(size):
        total[: max(len(h) - size + 1, 0)] += mix(h[i: max(len(h) - size + 1, 0) + i] + np.uint64(i + 1)) * np.uint64(2 * i + 1)
    runs = mix(total)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a: b - size + 1]))
        elif b > a:
            steps = np.arange(1, b - a + 1, dtype=np.uint64)
            out.append(mix(np.array([(mix(h[a:b] + steps) * (2 * steps - 1)).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _keys(members: np.ndarray, rule: Rule, bands: list[tuple[int, int]], lows: list[int]) -> np.ndarray:
    """The sketches of the blocks that a set emits in each of its bands (band and block hashed in).

    A set has one band or two neighbouring ones. A key's lowest bit is that of the band's number, the
    next one tells whether its blocks hold several members.
    """
    n = len(members)
    out = []
    b = bisect_left(lows, n + 1) - 1
    while b >= 0 and bands[b][1] >= n:
        blocks = rule.blocks(bands[b][1])
        if blocks:
            # Members are sorted and dealt by their leading bits: a block is a run of them.
            block = ((members >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sketch = np.bitwise_xor.reduceat(mix(members), first) ^ mix(block[first] + np.uint64(1))
            sketch = sketch[: rule.greatest_difference(n) + 1 + rule.spare(n)]
        else:
            sketch = mix(members)
        out.append(mix(sketch + np.uint64(b)) & ~np.uint64(3) | np.uint64(b % 2 + 2 * bool(blocks)))
        b -= 1
    return np.concatenate(out)


def _digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b): size and 128-bit digest of each set."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        sets = shingles(data, offsets, rule.words)
        a = [np.bitwise_xor.reduce(mix(m + np.uint64(7))) if len(m) else np.uint64(0) for m in sets]
        b = [mix(m).sum(dtype=np.uint64) for m in sets]
        return [np.array([len(m) for m in sets], np.int64), np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)]

    return map_texts(docs, work, [StructField(c, LongType()) for c in ("n_shingles", "set_a", "set_b")], ["doc_id"])


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, keys): size of each text's set and its block sketches."""
    bands = rule.bands()
    lows = [low for low, _ in bands]

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        sets = shingles(data, offsets, rule.words)
        made = [_keys(m, rule, bands, lows) if len(m) else np.zeros(0, np.uint64) for m in sets]
        at = np.concatenate([[0], np.cumsum([len(k) for k in made])]).astype(np.int32)
        return [np.array([len(m) for m in sets], np.int32), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(made).view(np.int64)))]

    return map_texts(docs, work, [StructField("n", IntegerType()), StructField("keys", ArrayType(LongType(), False))], ["doc_id"])


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, parity, members) of each text: its whole set and a 1,024-bit parity sketch."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        sets = shingles(data, offsets, rule.words)
        parity = np.zeros((len(sets), 16), np.uint64)
        for row, m in zip(parity, sets):
            h = mix(m + np.uint64(11))
            np.bitwise_xor.at(row, (h >> np.uint64(60)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        at = np.concatenate([[0], np.cumsum([len(m) for m in sets])]).astype(np.int32)
        members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return [np.array([len(m) for m in sets], np.int64),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(sets) + 1, 16, dtype=np.int32)), pa.array(parity.ravel().view(np.int64))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(members.view(np.int64)))]

    longs = ArrayType(LongType(), False)
    return map_texts(docs, work, [StructField("n", LongType()), StructField("parity", longs), StructField("members", longs)], ["doc_id"])


def _possible(rule: Rule) -> Column:
    """Whether sizes, and the members before the agreeing sketch, allow two sets to be similar."""
    a, b = F.col("n").cast("long"), F.col("other_n").cast("long")
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent
    return sizes & rule.within(a, b, F.col("before") + F.col("other_before"))


def _hamming(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(16)]
    return sum(words[1:], words[0])


def _both(a: DataFrame, b: DataFrame, on: list[str], smaller_first: bool, rule: Rule) -> DataFrame:
    """(doc_id, other) and both components of different components that agree in `on`, by sizes, places and parity sketches."""
    other = b.select(*on, *[F.col(c).alias(f"other_{c}") for c in ("component", "n", "before", "parity")], F.col("doc_id").alias("other"))
    if smaller_first:
        order = (F.col("component") != F.col("other_component")) & (F.struct("n", "doc_id") < F.struct(F.col("other_n").alias("n"), F.col("other").alias("doc_id")))
    else:
        order = F.col("component") < F.col("other_component")
    met = a.alias("a").join(other.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [
        order, _possible(rule), rule.within(F.col("n").cast("long"), F.col("other_n").cast("long"), _hamming("parity", "other_parity"))])
    return met.select("doc_id", "component", "other", "other_component")


def _rarest(ids: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(key, doc_id, component, n, before) of each set's rarest members, as many as may lack in a partner and one.

    Rare are members that few of the sets `ids` (doc_id, component) hold; members that one set holds
    count as places before, not as rows.
    """
    members = sets.join(ids, "doc_id").select("doc_id", "component", "n", F.explode("members").alias("key"))
    shared = members.groupBy("key").count().filter("count > 1")
    own = Window.partitionBy("doc_id")
    return (members.join(shared, "key").withColumn("before", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("count", "key")) - 1)
            .filter(F.col("before") <= rule.lacking(F.col("n"))).select("key", "doc_id", "component", "n", "before"))


def _rare_pairs(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, other) and both components of different components that meet in a rare member of the smaller set.

    The smaller set comes with the fewer members that a larger partner may lack, the larger one with
    all its rows. A member's rows are dealt into parts of some `PART`, and the smaller sets go to each.
    """
    first = F.col("before") <= rule.lacking_in_larger(F.col("n"))
    parts = rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(first).alias("smaller")).filter("rows > 1 AND smaller > 0")
    dealt = (rows.join(parts.select("key", F.ceil(F.col("rows") / PART).alias("parts")), "key")
             .join(sets.select("doc_id", "parity"), "doc_id"))
    smaller = dealt.filter(first).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    larger = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    return _both(smaller, larger, ["key", "part"], True, rule)


def _remaining_pairs(placed: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(doc_id, other) and both components still to be verified of the rows (key, doc_id, component, n, before, sets) of open blocks.

    The rows of rare members are stored: they are read three times, and whole plans would fill the driver's memory.
    """
    several = F.col("key").bitwiseAND(2) != 0
    slim = ["key", "doc_id", "component", "n", "before"]
    few = placed.filter(several & (F.col("sets") <= CROWDED)).join(sets.select("doc_id", "parity"), "doc_id")
    crowded = placed.filter(several & (F.col("sets") > CROWDED)).select("doc_id", "component").distinct()
    rare = scratch.store(placed.filter(~several).select(*slim).unionByName(_rarest(crowded, sets, rule)), "rare")
    return _both(few, few, ["key"], False, rule).unionByName(_rare_pairs(rare, sets, rule))


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The rows of pairs (u, v) whose sets are similar, by size, parity sketch and members in common."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * rule.percent
    close = (pairs.join(a, "u").join(b, "v").filter(sizes).filter(rule.within(F.col("na"), F.col("nb"), _hamming("pa", "pb")))
             .select(*pairs.columns, "na", "nb"))
    common = F.size(F.array_intersect("ma", "mb"))
    return (close.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("ma")), "u")
            .join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("mb")), "v")
            .filter(100 * common >= rule.percent * (F.col("na") + F.col("nb") - common)).select(*pairs.columns))


def similar_groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id reachable over similar texts.

    Texts of fewer words than an n-gram have one member, the whole sequence. A null text or one
    without words has no member and links with nothing. Rows with equal ids count as one document,
    linked by any of their texts; rows with a null id take no part and get a null component. Equal
    texts are linked. No partner, block or group is capped.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_rows = scratch.store(_digests(texts, rule), "digests")
    named = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_a", "set_b"]
    # A class of equal sets may hold much of the rows, so its rows are salted by id: a class has one row
    # per salt that occurs, and the documents meet that one.
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    whole = Window.partitionBy(*same)
    classes = (salted.groupBy(*same, "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
               .select(*same, "salt", F.min("least").over(whole).alias("first"), F.sum("rows").over(whole).alias("size")))
    # Copies link to the first of their class and are left out of what follows.
    copies = scratch.store(salted.join(classes.filter("size > 1").drop("size"), [*same, "salt"]).filter("doc_id <> first")
                           .select(F.col("first").alias("u"), F.col("doc_id").alias("v")).distinct(), "copies")
    known = copies.select(F.col("v").alias("doc_id")).distinct()
    if copies.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    single = texts.filter("doc_id IS NOT NULL").join(known, "doc_id", "left_anti")
    # Sketches are cheaper to make twice than to store.
    keys = sketches(single, rule).select("doc_id", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1")
    rows = keys.join(shared, "key").withColumn("one_each", F.col("key").bitwiseAND(2) == 0)
    # The smallest partner's spare; one less, as it may fill a block too few.
    drop = F.when(F.col("one_each"), F.col("n") - rule.lacking(F.col("n")) - 1).otherwise(3 + F.expr(f"(n * {rule.percent} div 100) div 50"))
    band = Window.partitionBy("doc_id", F.col("key").bitwiseAND(1))
    rows = (rows.withColumn("place", F.row_number().over(band.orderBy("count", "key")))
            .withColumn("all", F.count("*").over(band)).filter(F.col("place") <= F.col("all") - drop)
            # Members known to come before this one in the common order, the rarest first.
            .withColumn("before", F.when(F.col("one_each"), F.col("n") - F.col("all") + F.col("place") - 1).otherwise(0)))
    rows = scratch.store(rows.select("key", "doc_id", "n", "before"), "blocks")
    wanted = scratch.store(rows.select("doc_id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = scratch.store(_sets(texts.join(wanted, "doc_id", "left_semi"), rule), "sets")

    groups = None
    for turn in range(PIVOT_ROUNDS + 1):
        if groups is None:
            placed = rows.withColumn("component", F.col("doc_id"))
        else:
            placed = (rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                      .withColumn("component", F.coalesce("component", "doc_id")))
        # Only blocks whose sets are not all connected yet.
        spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets"),
                                           F.min(F.struct((F.col("before") if turn == 0 else F.lit(0)).alias("first"), F.xxhash64("doc_id", F.lit(turn)).alias("second"), "doc_id", "component", "n", "before")).alias("pivot")).filter("lo < hi")
        placed = scratch.store(placed.join(spread.select("key", "pivot", "sets"), "key"), "open")
        if placed.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            pairs = placed.filter(F.col("component") != F.col("pivot.component")).select(
                "doc_id", "component", "n", "before", F.col("pivot.doc_id").alias("other"), F.col("pivot.component").alias("other_component"),
                F.col("pivot.n").alias("other_n"), F.col("pivot.before").alias("other_before")).filter(_possible(rule))
        else:
            pairs = _remaining_pairs(placed, sets, rule, scratch)
        ends = [F.struct(F.col(i).alias("id"), F.col(c).alias("component")) for i, c in (("doc_id", "component"), ("other", "other_component"))]
        pairs = (pairs.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
                 .select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.component").alias("u_in"), F.col("b.component").alias("v_in")).distinct())
        if turn == PIVOT_ROUNDS:
            pairs = scratch.store(pairs, "pairs")
        found = scratch.store(_verify(pairs, sets, rule).select(F.col("u_in").alias("u"), F.col("v_in").alias("v")).distinct(), "links")
        if groups is None:
            groups = components(copies.unionByName(found), scratch)
        elif not found.isEmpty():
            # What earlier turns found stays as it is: components are joined, not links from the start.
            groups = join_components(groups, found, scratch)
    groups = components(copies, scratch) if groups is None else groups
    out = (all_rows.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
           .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    return scratch.release(out)


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is its group's smallest; of rows with equal ids, all stay.

    Rows with a null id stay. The columns are those of `docs`.
    """
    groups = similar_groups(docs, rule, doc_id, text)
    own = free_name(docs.columns, "gone_id")
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(own), "left_anti")
