"""Line de-duplication over levelled sorted runs of line hashes.

What is known of the lines seen so far is kept in runs: tables bucketed by line hash and sorted within each
bucket, all with the same number of buckets. A new batch of documents is reduced to one row per line hash and merge-anti-joined
against the runs: hashes that no run holds are new and name their holder, the greatest document id of the batch that has the
line; the others add to the number of documents only. The batch then becomes a run of level 0 itself. Every `FAN` runs of a
level are merged into one of the next, so a hash lies in a number of runs that grows with the logarithm of
the batches, and every row is rewritten once a level. Joins and merges read buckets in order: only the batch is shuffled.

A line may stand in a third of all documents, so hashes carry a salt made from the document id: a run has a row per
(hash, salt), and the salts of a hash come together in a last step on the rows of the merged run.

Batches come by falling document id, so the first batch that knows a hash also knows its holder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from meterlake.llm.texts import map_texts, mix, word_hashes
from meterlake.storage import Scratch

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
#: Batches of one call, runs of a level before they are merged, and salts of a hash.
BATCHES = 4
FAN = 2
SALTS = 256
WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TRUST_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
KEY = ["line_a", "line_b", "salt"]
LINE = StructType([StructField("line_a", LongType(), False), StructField("line_b", LongType(), False)])


def _keys(raw: bytes) -> list[bytes]:
    """The key of every line of a text: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return [line.strip(WHITE) for line in raw.translate(_LOWER).split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode(errors="replace")) >= least)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each key, in two halves."""
    data = np.frombuffer(b"".join(keys), np.uint8)
    end = np.cumsum([len(k) for k in keys])
    start = end - [len(k) for k in keys]
    a = word_hashes(data, start, end)
    b = word_hashes(data[::-1], len(data) - end, len(data) - start)
    return a.view(np.int64), mix(b + np.uint64(1)).view(np.int64)


def line_hashes(docs: DataFrame, keep: list[str], least_length: int = LEAST_LENGTH) -> DataFrame:
    """The columns `keep` and `lines`: the distinct hashes of the lines of `least_length` code points of every row's `text`."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        raw = data.tobytes()
        own = [{k for k in _keys(raw[a:b]) if _long_enough(k, least_length)} for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        at = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int32)
        keys = [k for o in own for k in o]
        a, b = _hashes(keys) if keys else (np.zeros(0, np.int64),) * 2
        return [pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["line_a", "line_b"]))]

    return map_texts(docs, work, [StructField("lines", ArrayType(LINE, False))], keep)


@dataclass
class LineRuns:
    """The runs of a session: (line_a, line_b, salt, documents, holder), a table a run."""

    scratch: Scratch
    buckets: int
    fan: int = FAN
    levels: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # A bucket is one file, so Spark may trust its order and merge without sorting.
        self.before = self.spark.conf.get(TRUST_ORDER)
        self.spark.conf.set(TRUST_ORDER, "true")

    @property
    def spark(self) -> SparkSession:
        return self.scratch.spark

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", self.scratch.path(f"run-{level}")).saveAsTable(name))
        self.levels.setdefault(level, []).append(name)
        if len(self.levels[level]) >= self.fan:
            merged = self.levels.pop(level)
            self._write(self._merged(merged), level + 1)
            self._forget(merged)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key of several runs, merged in order two by two."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"documents": "more", "holder": "other"})
            return a.join(b, KEY, "full").select(
                *KEY, (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"), F.greatest("holder", "other").alias("holder"))

        return reduce(both, map(self.spark.table, names))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, lines: DataFrame) -> None:
        """Take in a batch's (doc_id, line_a, line_b, salt); ids must not be above those of earlier batches."""
        # One shuffle serves all three: equal rows meet, are counted, and lie in the bucket of the run.
        rows = lines.repartition(self.buckets, *KEY).distinct()
        batch = self.scratch.store(rows.groupBy(*KEY).agg(F.count("*").alias("documents"), F.max("doc_id").alias("top")), "batch")
        new = batch
        for name in [n for names in self.levels.values() for n in names]:
            new = new.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        known = new.select(*KEY, F.col("top").alias("holder"))
        self._write(batch.drop("top").join(known, KEY, "left"), 0)

    def all(self) -> DataFrame:
        """The rows of all runs, merged."""
        return self._merged([n for names in self.levels.values() for n in names])

    def clear(self) -> None:
        self._forget([n for names in self.levels.values() for n in names])
        self.levels.clear()
        self.spark.conf.set(TRUST_ORDER, self.before)


def _batch(docs: DataFrame, count: int) -> Column:
    """Number of a row's batch, by falling id; the bounds are approximate quantiles, null ids come last."""
    bounds = docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.01) if count > 1 else []
    return sum((F.when(F.col("doc_id") >= b, 0).otherwise(1) for b in sorted(set(bounds))), F.lit(0))


def repeated_lines(docs: DataFrame, scratch: Scratch, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS,
                   batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, lines): the hashes of the lines that each text of `docs` (doc_id, text, text_hash) loses."""
    spark = docs.sparkSession
    rows = line_hashes(docs, ["doc_id", "text_hash"], least_length)
    rows = rows.select("doc_id", "text_hash", F.explode("lines").alias("line")).select(
        "doc_id", "text_hash", "line.*", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    every = scratch.store(rows.withColumn("batch", _batch(docs.select("doc_id"), batches)), "lines", ["batch"])
    runs = LineRuns(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in range(batches):
        # Rows of one id count once.
        runs.add(every.filter(F.col("batch") == batch).select("doc_id", *KEY))
    whole = Window.partitionBy("line_a", "line_b")
    common = (runs.all().select(*KEY, F.sum("documents").over(whole).alias("documents"), F.max("holder").over(whole).alias("holder"))
              .filter(F.col("documents") >= least_documents).select(*KEY, "holder"))
    lost = every.join(common, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    # A group is one text, however many rows have its id or none.
    out = scratch.store(lost.select("doc_id", "text_hash", "line_a", "line_b").distinct()
                        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_a", "line_b")).alias("lines")), "lost")
    runs.clear()
    return out


def drop_repeated_lines(docs: DataFrame, keep: list[str], scratch: Scratch, doc_id: str = "doc_id", text: str = "text",
                        least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """The columns `keep` of every row, and n_lines, n_dropped and kept_text; it reads tables of `scratch`.

    Lines are split at \\n; a null or empty text is one empty line. A line's key is the line without ASCII white space at
    both ends, A-Z lower-cased. Keys of at least `least_length` code points found in at least `least_documents` documents lose all
    their lines except in the greatest id that has them. Other lines stay, unchanged and joined by \\n (`kept_text` is empty if
    none stays). Rows with equal ids count as one document, and so do all rows with a null id, which is below every other id.
    A kept column named like a result gives way to it. An empty table gives no row.
    """
    names = ["n_lines", "n_dropped", "kept_text"]
    kept = [c for c in keep if c not in names]
    inner = [f"kept_{i}" for i in range(len(kept))]
    own_id, own_text = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    slim = docs.select(own_id.alias("doc_id"), own_text.alias("text"), F.xxhash64(own_text).alias("text_hash"))
    lost = repeated_lines(slim, scratch, least_length, least_documents, batches)
    rows = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in zip(kept, inner)], own_id.alias("own_id"), own_text.alias("own_text"), F.xxhash64(own_text).alias("own_hash"))
    # The lists are the smaller side by far; texts need not be sorted.
    rows = rows.join(lost.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    schema = StructType([StructField(a, rows.schema[a].dataType) for a in inner]
                        + [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, texts = [], [], []
            for value, lines in zip(batch.column(len(inner)), batch.column(len(inner) + 1)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                own = raw.split(b"\n")
                drop = _dropped(raw, {(x["line_a"], x["line_b"]) for x in lines.as_py()}, least_length) if lines.is_valid else set()
                counts.append(len(own))
                gone.append(len(drop))
                texts.append(b"\n".join(line for i, line in enumerate(own) if i not in drop) if drop else raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(texts, pa.binary()).view(pa.string())], [*inner, *names])

    out = rows.select(*inner, "own_text", "lines").mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], *names)


def _dropped(raw: bytes, lost: set[tuple[int, int]], least_length: int) -> set[int]:
    """Numbers of a text's lines whose key is among the lost ones."""
    keys = _keys(raw)
    judged = [i for i, k in enumerate(keys) if _long_enough(k, least_length)]
    a, b = _hashes([keys[i] for i in judged])
    return {i for i, x, y in zip(judged, a.tolist(), b.tolist()) if (x, y) in lost}
