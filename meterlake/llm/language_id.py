"""Language identification by prediction by partial matching (PPM).

Per language, a variable-order tree of byte contexts is counted once and then frozen. The code
length of a byte is that of its longest known context, or an escape plus its code length in the next
shorter context (escape method C, without exclusion, down to a uniform order -1). A text belongs to
the language that codes it in the fewest bits.

With frozen counts, the code length of a byte is a sum of parts: per order, the escape from its context
and, where the context knows the byte, what it gains over that escape and the next shorter context.
Parts that a language lacks are 0, so only counted contexts and counted bytes are kept, each with its
languages. The distinct runs of a block of texts are looked up, then added up by text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from meterlake.llm.texts import chunks, hash_share, map_texts, utf8

UNKNOWN = "und"
ORDER = 3
_BITS = 8


@dataclass(frozen=True)
class Parts:
    """Sparse bits of contexts or of runs: sorted `keys`, and for each from `start` on, languages and bits."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(code: np.ndarray, lang: np.ndarray, bits: np.ndarray) -> Parts:
        order = np.lexsort((lang, code))
        keys, first = np.unique(code[order], return_index=True)
        return Parts(keys.astype(np.uint32), np.append(first, len(code)), lang[order].astype(np.int32), bits[order].astype(np.float32))

    def add(self, out: np.ndarray, wanted: np.ndarray) -> None:
        """Add the bits of each of the keys `wanted` to its row of `out`."""
        if not len(self.keys):
            return
        wanted = wanted.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == wanted)
        first, n = self.start[at[row]], self.start[at[row] + 1] - self.start[at[row]]
        place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        out[np.repeat(row, n), self.lang[place]] += self.bits[place]


@dataclass(frozen=True)
class LanguageModel:
    """Frozen statistics: `symbol` maps bytes, `escapes` and `gains` have one entry per order.

    `block_bytes` bounds the values that are worked on at once; results do not depend on it.
    """

    langs: list[str]
    symbol: np.ndarray
    width: int
    escapes: list[Parts]
    gains: list[Parts]
    block_bytes: int

    def values(self, runs: np.ndarray) -> np.ndarray:
        """Bits each language needs for the last symbol of each run of four."""
        out = np.full((len(runs), len(self.langs)), np.log2(self.width))
        for order, (escape, gain) in enumerate(zip(self.escapes, self.gains)):
            escape.add(out, (runs >> _BITS) & ((1 << _BITS * order) - 1))
            gain.add(out, runs & ((1 << _BITS * (order + 1)) - 1))
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits each language needs for each text."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        runs = _runs(self.symbol, data, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        step = max(self.block_bytes // (16 * max(len(self.langs), 1)), 1)
        for lo in range(0, len(runs), step):
            seen, at = np.unique(runs[lo: lo + step], return_inverse=True)
            of = text[lo: lo + step]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[first]] += np.add.reduceat(self.values(seen)[at], first, axis=0)
        return out


def _runs(symbol: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte: its three predecessors and itself as one number. Texts start after zeros."""
    s = symbol[data].astype(np.int64)
    runs = s.copy()
    place = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        shifted = np.zeros(len(s), np.int64)
        shifted[back:] = s[:-back]
        shifted[place < back] = 0
        runs |= shifted << (_BITS * back)
    return runs


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          docs_per_lang: int = 4000, table_mb: int = 32) -> LanguageModel:
    """Count context trees on labelled documents.

    The one bound is about `docs_per_lang` whole documents of each language (by hash of id and text; a
    repeated row counts once). Every
    language is learned, and all contexts of its sample count. `table_mb` bounds memory when scoring,
    not the model. Rows with a null or empty text or language are not used.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = labelled.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], np.zeros(256, np.uint8), 1, [], [], table_mb << 20)
    # A row per language, so broadcast.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_lang / r["count"])) for r in sizes], "lang string, share double")
    sample = labelled.join(F.broadcast(shares), "lang").filter(hash_share(F.struct("id", "text"), F.col("share"))).select("id", "lang", "text").distinct()

    # Every byte of the sample gets a symbol of its own; others share symbol 0 with text starts. As A-Z are
    # folded, there are 230 at most.
    def count_bytes(batches):
        seen = np.zeros(256, np.int64)
        for batch in batches:
            seen += np.bincount(utf8(batch.column(2))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(seen)], ["byte", "n"])

    rows = (sample.mapInArrow(count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
            .filter("n > 0").collect())
    folded = np.zeros(256, np.int64)
    np.add.at(folded, _lower()[[r["byte"] for r in rows]], [r["n"] for r in rows])
    own = np.flatnonzero(folded)
    symbol = np.zeros(256, np.uint8)
    symbol[own] = np.arange(1, len(own) + 1)
    symbol = symbol[_lower()]
    number = {x: i for i, x in enumerate(langs)}

    def count_grams(batches):
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            who = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in chunks(offsets):
                runs = _runs(symbol, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                key = np.repeat(who[a:b], np.diff(offsets[a: b + 1])) << 32 | runs
                made = np.unique(key, return_counts=True)
                old = totals.get(0)
                if old is not None:
                    made = _merge(np.concatenate([old[0], made[0]]), np.concatenate([old[1], made[1]]))
                totals[0] = made
        for keys, counts in totals.values():
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    grams = sample.mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return _freeze(langs, symbol, len(own) + 1, grams["gram"].to_numpy(), grams["n"].to_numpy(), table_mb << 20, _BITS)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts).astype(np.int64)


def _freeze(langs: list[str], symbol: np.ndarray, width: int, grams: np.ndarray, counts: np.ndarray,
            block_bytes: int, bits: int = 7) -> LanguageModel:
    """Turn counts into bits, from the shortest contexts to the longest.

    A gram is a language's number above 32 bits, and below them four symbols of `bits` bits each.
    """
    who, run = grams >> 32, np.zeros(len(grams), np.int64)
    for back in range(ORDER + 1):
        run |= ((grams >> (bits * back)) & ((1 << bits) - 1)) << (_BITS * back)
    escapes, gains = [], []
    shorter, least = np.zeros(0, np.int64), np.zeros(0)
    for order in range(ORDER + 1):
        key, n = _merge(who << 32 | run & ((1 << _BITS * (order + 1)) - 1), counts)
        lang, code = key >> 32, key & 0xFFFFFFFF
        there, at, distinct = np.unique(lang << 32 | code >> _BITS, return_inverse=True, return_counts=True)
        total = np.bincount(at, n, len(there))
        escape = np.log2((total + distinct) / distinct)
        own = np.log2((total + distinct)[at] / n)
        # What is known after a context is known after the next shorter one.
        below = (least[np.searchsorted(shorter, lang << 32 | code & ((1 << _BITS * order) - 1))] if order
                 else np.log2(width))
        escapes.append(Parts.of(there & 0xFFFFFFFF, there >> 32, escape))
        gains.append(Parts.of(code, lang, own - escape[at] - below))
        shorter, least = key, own
    return LanguageModel(langs, symbol, width, escapes, gains, block_bytes)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, `lang_pred` and `score` (0 to 1, the language's share given the code lengths).

    A null text, an empty one and one without any letter get `und` and score 0. Every other text gets
    a learned language, the first in order of names on a tie; without any learned language, `und`.
    Repeated rows are scored alike; columns outside `keep` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(data: np.ndarray, offsets: np.ndarray) -> list:
        m = shared.value
        if not m.langs:
            n = len(offsets) - 1
            return [pa.array([UNKNOWN] * n, pa.string()), np.zeros(n)]
        bits = m.code_lengths(data, offsets)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
        return [pa.array(np.array(m.langs, object)[best], pa.string()), share]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    flag = "has_letters"
    while flag in keep:
        flag += "_"
    out = map_texts(docs.withColumn(flag, letters), work, fields, [*keep, flag], text)
    return out.select(
        *[c for c in keep if c not in ("lang_pred", "score")],
        F.when(F.col(flag), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col(flag) & (F.col("lang_pred") != UNKNOWN), F.col("score")).otherwise(0.0).alias("score"))
