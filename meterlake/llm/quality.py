"""Quality classifier with supervised subword embeddings.

Each word, pair of neighbouring words and run of 3 or 5 bytes is hashed to a learned vector. A
document is the mean of its vectors, and a softmax layer over it gives the label's probability. The
vectors and the layer are trained by stochastic gradient descent in numpy on a bounded sample.

The layer is linear, so for scoring each hashed vector shrinks to one number (its part of the
difference of the two labels' logits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from meterlake.llm.texts import WHITE, hash_share, map_texts, mix, utf8, word_hashes, words

BUCKET_BITS = 18
GRAMS = (3, 5)
THRESHOLD = 0.7
_LEAD = np.uint64(64 - BUCKET_BITS)


@dataclass(frozen=True)
class QualityModel:
    """Per bucket, the part of the logit difference between label 1 and label 0."""

    weights: np.ndarray
    bias: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for bucket, text in _features(data, offsets):
            total += np.bincount(text, self.weights[bucket], n)
            count += np.bincount(text, minlength=n)
        logit = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _features(data: np.ndarray, offsets: np.ndarray):
    """(buckets, text numbers) of byte runs, words and pairs of neighbouring words."""
    flat = np.where(WHITE[data], np.uint8(0x20), data).astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][text]
    for size in GRAMS:
        if len(flat) < size:
            continue
        code = flat[: len(flat) - size + 1].copy()
        for i in range(1, size):
            code |= flat[i: len(flat) - size + 1 + i] << np.uint64(8 * i)
        whole = np.arange(len(code)) + size <= ends[: len(code)]
        code = (code + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        yield (code[whole] >> _LEAD).astype(np.int64), text[: len(code)][whole]
    start, end, of = words(data, offsets)
    h = word_hashes(data, start, end)
    yield (h >> _LEAD).astype(np.int64), of
    same = of[1:] == of[:-1]
    # The difference of the hashes: ordered pairs differ, and every repeated word is one and the same pair.
    pair = mix((h[:-1] - h[1:])[same] + np.uint64(1))
    yield (pair >> _LEAD).astype(np.int64), of[1:][same]


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  label: str = "quality", docs_per_label: int = 1500) -> DataFrame | None:
    """(mark_id, text, mark, text_hash) of about `docs_per_label` different rows of each label, or none without labels.

    Rows are chosen by a hash of id and text, so an id with many texts counts with as many rows; a repeated
    row counts once. A document with both labels, a null label or a null text is not used.
    """
    marks = (labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("mark_id"))
             .agg(F.min(label).alias("low"), F.max(label).alias("high")).filter("low = high AND low IN (0, 1)")
             .select("mark_id", F.col("low").cast("int").alias("mark")))
    if marks.isEmpty():
        return None
    rows = docs.select(F.col(doc_id).alias("mark_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).filter("text is not null")
    keys = rows.select("mark_id", "text_hash").join(marks, "mark_id").distinct()
    sizes = {r["mark"]: r["count"] for r in keys.groupBy("mark").count().collect()}
    share = F.when(F.col("mark") == 1, min(1.0, docs_per_label / sizes.get(1, 1))).otherwise(min(1.0, docs_per_label / sizes.get(0, 1)))
    # About twice `docs_per_label` rows of three numbers: a fixed bound, whatever the tables' size.
    chosen = keys.filter(hash_share(F.struct("mark_id", "text_hash"), share))
    return rows.join(F.broadcast(chosen), ["mark_id", "text_hash"]).dropDuplicates(["mark_id", "text_hash"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          label: str = "quality", docs_per_label: int = 1500, width: int = 16, epochs: int = 8,
          rate: float = 0.4, seed: int = 7) -> QualityModel:
    """Learn from about `docs_per_label` whole documents of each label, see `training_rows`.

    That number is the bound of the sample, which one task learns from. With only one label present, or
    none, the model knows only the labels' share.
    """
    chosen = training_rows(docs, labels, text, doc_id, label, docs_per_label)
    if chosen is None:
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)

    def gather(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, shares = [], []
            for i in range(batch.num_rows):
                one = data[offsets[i]: offsets[i + 1]]
                bucket = np.concatenate([b for b, _ in _features(one, np.array([0, len(one)]))])
                unique, n = np.unique(bucket, return_counts=True)
                ids.append(unique.astype(np.int32))
                shares.append((n / max(n.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(shares, pa.list_(pa.float32()))], ["mark_id", "mark", "text_hash", "ids", "shares"])

    features = (chosen.select("mark_id", "text", "mark", "text_hash")
                .mapInArrow(gather, chosen.select("mark_id", "mark", "text_hash").schema.simpleString()[7:-1].replace(":", " ")
                            + ", ids array<int>, shares array<float>"))

    def learn(batches):
        rows = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        ids, shares, marks, keys, ties = [], [], [], [], []
        for part in rows:
            marks.append(part["mark"].to_numpy())
            keys.append(part["mark_id"].to_numpy())
            ties.append(part["text_hash"].to_numpy())
            ids += [x.values.to_numpy() for x in part["ids"]]
            shares += [x.values.to_numpy() for x in part["shares"]]
        order = np.lexsort((np.concatenate(ties), np.concatenate(keys))) if ids else np.zeros(0, np.int64)
        mark = np.concatenate(marks)[order] if ids else np.zeros(0, np.int64)
        model = _descend([ids[i] for i in order], [shares[i] for i in order], mark, width, epochs, rate, seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    # The bounded sample is learned from in one task, so that the driver only gets the model.
    made = features.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return QualityModel(np.frombuffer(made["weights"], np.float32), made["bias"])


def _descend(ids: list[np.ndarray], shares: list[np.ndarray], marks: np.ndarray, width: int, epochs: int,
             rate: float, seed: int) -> QualityModel:
    """Plain stochastic gradient descent, one document a step, with a rate that falls to zero.

    A step on the vectors is divided by the sum of squared shares: a long document moves its mean as
    far as a short one.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / width, 1 / width, (1 << BUCKET_BITS, width)).astype(np.float32)
    layer = np.zeros((width, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weight = len(marks) / (2 * np.maximum(np.bincount(marks, minlength=2), 1)) if len(marks) else np.ones(2)
    steps, done = max(epochs * len(ids), 1), 0
    for _ in range(epochs):
        for i in random.permutation(len(ids)):
            step = rate * (1 - done / steps)
            done += 1
            hidden = shares[i] @ vectors[ids[i]] if len(ids[i]) else np.zeros(width, np.float32)
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[marks[i]] -= 1
            p *= step * weight[marks[i]]
            back = layer @ p
            layer -= np.outer(hidden, p)
            bias -= 0.1 * p
            if len(ids[i]):
                vectors[ids[i]] -= (shares[i] / (shares[i] @ shares[i]))[:, None] * back[None, :].astype(np.float32)
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, `score` (probability of label 1) and `predicted` (score of 0.7 or more).

    A null or empty text has no features and gets the score of the bias alone. Repeated rows are
    scored alike; kept columns called `score` or `predicted` give way to the results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        p = shared.value.probabilities(data, offsets)
        return [p, (p >= THRESHOLD).astype(np.int32)]

    return map_texts(docs, work, [StructField("score", DoubleType()), StructField("predicted", IntegerType())],
                     keep, text)
