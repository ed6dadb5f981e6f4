"""Mixing sources to target weights with exact word budgets, in DataFrame functions only.

Every document gets a key from a hash of its id, or of its text if it has no id. Within each source,
keys are cut into equal ranges (chunks); each chunk is sorted and summed on its own, and one row per
chunk carries the totals of the chunks before it. A hot source is thus spread over as many tasks as it
has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """`target` words per row of `sizes` (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share the total of all sizes. A
    target stops at `most` times its source's size; the excess goes to the others by weight. With
    sources in the order of size over weight, those that stop are a prefix, so the level at which the
    rest share (words per unit of weight) is that of the first source that stays below its limit.
    These windows run over one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights)))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("turn_rank"))
    all_rows = Window.partitionBy()
    ranked = (sizes.withColumn("turn_rank", F.row_number().over(rank))
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)))
    levels = (ranked
              .withColumn("before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("total", F.sum("source_size").over(all_rows))
              .withColumn("level", (F.col("total") - most * F.col("before")) / F.col("open_weight"))
              .withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size")))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "turn_rank", "level"))).over(all_rows)
    return (levels.withColumn("share_level", F.coalesce(first["level"], F.col("level")))
            .select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"),
                                                     F.col("weight") * F.col("share_level")).alias("target")))


def mix(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[int, ...] = (5, 2, 1), most: int = 3, chunks: int = 1024) -> DataFrame:
    """The columns `carry` of every row, with `size`, `source_size`, `target`, `epochs`, `rest` and `taken`.

    A source's budget is its target's whole words. It is filled by `epochs` full passes over the
    source; the last pass goes in key order and takes `rest` words of each document: all words until
    the budget ends, then part of one document, then none. `taken` is the total, repeats counted.
    Ties in the key go by id and size; rows equal in all three share their places in some order.
    A null text has size 0 and takes 0; a null source is a source of its own; rows without an
    id are ordered by their texts instead, so that they spread over chunks, while rows of one id share a
    chunk. Each source may hold any part of the rows. No random numbers: reruns agree. Carried columns with the name of a result give way to it.
    """
    carry = [c for c in carry if c not in ("size", "source_size", "target", "epochs", "rest", "taken")]
    named = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit(""))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    inner = [f"carry_{i}" for i in range(len(carry))]
    sized = docs.select(
        *[docs[f"`{c}`"].alias(a) for c, a in zip(carry, inner)],
        F.col(source).alias("source"), F.col(doc_id).alias("order_id"), word_count(F.col(text)).alias("size"), key.alias("key"),
    ).withColumn("chunk", F.shiftright("key", _KEY_BITS - (chunks.bit_length() - 1))).withColumn(
        # One key without nulls, so that joins and windows share their partitioning.
        "place", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    parts = sized.groupBy("place", "source", "chunk").agg(F.sum("size").alias("chunk_size"))
    # The same plan as above it, so that Spark reads the documents' sizes once.
    sizes = parts.groupBy("place", "source").agg(F.sum("chunk_size").alias("source_size")).drop("place")
    budget = targets(sizes, weights, most).withColumn("words", F.floor("target").cast("long"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.withColumn("start", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)))
              .join(budget.withColumnRenamed("source", "budget_source"), F.col("source").eqNullSafe(F.col("budget_source")))
              .select("place", "chunk", "start", "source_size", "target", "words"))
    within = Window.partitionBy("place", "chunk").orderBy("key", "order_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    last = F.col("words") - F.col("epochs") * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), last - (F.col("start") + F.col("running") - F.col("size"))))
    return (sized.withColumn("running", F.sum("size").over(within))
            .join(starts, ["place", "chunk"])
            .withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", rest.cast("long"))
            .select(*[F.col(a).alias(c) for a, c in zip(inner, carry)], "size", "source_size", "target", "epochs", "rest",
                    (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word and the white space behind it."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.concat_ws("", F.slice(pieces, F.lit(1), (n + lead).cast("int")))


def copies(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself: a row of `docs` per copy taken, with its columns.

    The one document per source that its budget cuts appears once more with its first words only, so
    that the source has exactly its budget of words.
    """
    inner = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in inner.items()])
    names = {k: inner[options.pop(k, k)] for k in ("source", "doc_id")}
    mixed = mix(renamed, list(inner.values()), text=inner[text], **names, **options)
    full = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("rest") == F.col("size")), 1).otherwise(0)
    part = F.when((F.col("rest") > 0) & (F.col("rest") < F.col("size")), 1).otherwise(0)
    rows = (mixed.withColumn("full", full).withColumn("all", full + part).filter("all > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("all").cast("long")))))
    cut = F.col("copy") > F.col("full")
    body = F.when(cut, first_words(F.col(inner[text]), F.col("rest"))).otherwise(F.col(inner[text]))
    made = {text: body}
    if n_chars in docs.columns:
        made[n_chars] = F.when(cut, F.length(body)).otherwise(F.col(inner[n_chars])).cast(docs.schema[n_chars].dataType)
    return rows.select(*[made.get(c, F.col(a)).alias(c) for c, a in inner.items()])
