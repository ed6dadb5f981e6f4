"""Secret scanning: fixed patterns, and two character Markov models for what the patterns miss.

The patterns' own matches in all texts are the labelled examples of random strings; all other tokens
are the examples of ordinary strings. Both models are first-order chains over the token alphabet,
smoothed by one count per cell and mixed with the uniform chain. A token of `SHORTEST` characters or
more is a finding when its log-likelihood ratio passes a threshold both in all and per character. The
threshold in all is calibrated: no more than a stated share of the ordinary tokens reaches it.
What fixed patterns leave of a token that they cover in part is judged as a token of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from meterlake.llm.texts import chunks, free_name, hash_share, utf8
from meterlake.storage import Scratch

KINDS = ("assign", "access", "hex", "random")

# The patterns of the three base kinds and their shortest findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Runs of this length cannot be missed by looking at every n-th character only.
_HEX_LONG = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Number of each code point in the alphabet, -1 for those outside; the last one stands for all beyond ASCII.
_CODE = np.full(129, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    # A maximal run of 32 or more is found whole: nothing shorter before it can overlap it.
    found += [(m.start(), m.end(), "hex") for m in _HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(text: str, taken: list[tuple[int, int, str]]) -> np.ndarray:
    """The alphabet's number of each code point; -1 outside it and within the spans in `taken`."""
    out = _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
    for a, b, _ in taken:
        out[a:b] = -1
    return out


def tokens(code: np.ndarray, least: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `least` or more characters of the alphabet."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], code >= 0, [False]]).view(np.int8)))
    a, b = edges[::2], edges[1::2]
    return a[b - a >= least], b[b - a >= least]


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratios (random over ordinary, bits) of first characters and of transitions."""

    first: np.ndarray
    step: np.ndarray
    total_bits: float
    bits_per_char: float

    def ratios(self, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ratio of each token from a to b."""
        total = np.concatenate([[0.0], np.cumsum(self.step[code[:-1], code[1:]])])
        return self.first[code[a]] + total[b - 1] - total[a]

    def random(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of the tokens outside of `taken` that are random strings."""
        code = codes(text, taken)
        a, b = tokens(code)
        if not len(a):
            return []
        hit = self.ratios(code, a, b) >= np.maximum(self.total_bits, self.bits_per_char * (b - a))
        return [(int(x), int(y), "random") for x, y in zip(a[hit], b[hit])]


def spans(text: str, models: MarkovModels) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    extra = models.random(text, base)
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]))) if extra else base


def _rows(docs: DataFrame, text: str, doc_id: str, sample_docs: int | None) -> DataFrame:
    """Ids and whole texts of all rows, or of about `sample_docs` at most, by hash of both."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if sample_docs is None:
        return rows
    return rows.filter(hash_share(F.struct("id", "text"), min(1.0, sample_docs / max(docs.count(), 1))))


def sample_texts(docs: DataFrame, text: str, doc_id: str, sample_docs: int) -> DataFrame:
    """About `sample_docs` whole texts at most; a repeated row counts once."""
    return _rows(docs, text, doc_id, sample_docs).distinct().select("text")


def _learnt(text: str) -> tuple[str, str]:
    """The ordinary tokens of a text and the values of its base spans, a space behind each."""
    base = base_spans(text)
    values = [re.split(r"[^A-Za-z0-9+/_=-]", text[a:b])[-1] for a, b, _ in base]
    a, b = tokens(codes(text, base))
    return "".join(f"{text[x:y]} " for x, y in zip(a.tolist(), b.tolist())), "".join(f"{v} " for v in values if v)


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The numbers of some texts of `_learnt` at a time, with starts and ends of their tokens or values."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        code = _CODE[np.minimum(data[offsets[lo]: offsets[hi]], 128)]
        if len(code):
            yield code, *tokens(code, 1)


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int | None = None, false_rate: float = 1e-5,
          least_bits: int = 12, most_bits: int = 32, bits_per_char: float = 1.0) -> MarkovModels:
    """Count transitions of both kinds of tokens in every document; a repeated row counts once.

    Tokens and values of every row are stored once and read twice: for the transitions, and for the
    threshold. Rows are told apart by id and SHA-256 of the text, so no text is shuffled whole. Spark sums
    the counts; what reaches the driver is a row per transition, and a row per bit of ratio.
    `false_rate` is the share of all ordinary tokens that may reach the threshold in all, which
    stays from `least_bits` to `most_bits`: random strings that no pattern finds count as ordinary here, and
    must not lift it beyond themselves. Without any token of a kind its model is the uniform chain. A caller
    may bound the rows learnt from by `sample_docs`.
    """
    rows = _rows(docs, text, doc_id, sample_docs).filter("text != ''").withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    learnt = _per_text(rows, ["id", "digest"], "text", _learnt, [StructField(n, StringType()) for n in ("ordinary", "random")])
    scratch = Scratch(docs.sparkSession, "secrets")
    try:
        stored = scratch.store(learnt.filter("ordinary != '' OR random != ''").distinct().select("ordinary", "random"), "learnt")
        return _fit(stored, false_rate, least_bits, most_bits, bits_per_char)
    finally:
        scratch.clear()


def _fit(learnt: DataFrame, false_rate: float, least_bits: int, most_bits: int, bits_per_char: float) -> MarkovModels:
    size = len(ALPHABET)

    def count(batches):
        n = np.zeros((2, size + 1, size), np.int64)  # the last row: first characters
        for batch in batches:
            for label in (0, 1):
                for code, a, _ in _runs(batch.column(label)):
                    at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0)) + 1
                    cells = np.concatenate([size * size + code[a], code[at - 1] * size + code[at]])
                    n[label] += np.bincount(cells, minlength=(size + 1) * size).reshape(size + 1, size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["cell", "n"])

    rows = learnt.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(2 * (size + 1) * size)
    n[[r["cell"] for r in rows]] = [r["n"] for r in rows]
    n = n.reshape(2, size + 1, size) + 1
    seen = n / n.sum(axis=2, keepdims=True)
    # Random strings use any alphabet, so their chain leans half on the uniform one.
    lean = np.array([0.05, 0.5])[:, None, None]
    p = np.log2((1 - lean) * seen + lean / size)
    bits = p[1] - p[0]
    models = MarkovModels(bits[size], bits[:size], 0.0, bits_per_char)

    def reach(batches):
        n = np.zeros(most_bits + 1, np.int64)
        for batch in batches:
            for code, a, b in _runs(batch.column(0)):
                n += np.bincount(np.clip(np.ceil(models.ratios(code, a, b)), 0, most_bits).astype(int), minlength=most_bits + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(most_bits + 1)), pa.array(n)], ["bit", "n"])

    rows = learnt.select("ordinary").mapInArrow(reach, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(most_bits + 1)
    n[[r["bit"] for r in rows]] = [r["n"] for r in rows]
    # Tokens of a ratio above each whole number of bits.
    above = n[::-1].cumsum()[::-1] - n
    total = int(np.argmax(above <= false_rate * n.sum()))
    return MarkovModels(models.first, models.step, float(min(max(total, least_bits), most_bits)), bits_per_char)


def _labels(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def _per_text(df: DataFrame, keep: list[str], text: str, work, fields: list[StructField]) -> DataFrame:
    kept = [c for c in keep if c not in [f.name for f in fields]]
    inner = [f"kept_{i}" for i in range(len(kept))]
    slim = df.select(*[df[f"`{c}`"].alias(a) for c, a in zip(kept, inner)], F.col(text).alias("whole_text"))
    schema = slim.drop("whole_text").schema
    for f in fields:
        schema = schema.add(f)

    def run(batches):
        for batch in batches:
            made = [work(t) for t in batch.column(len(kept)).to_pylist()]
            arrays = [pa.array([m[i] for m in made], pa.string() if f.dataType == StringType() else pa.int64())
                      for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema.names)

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], *[f.name for f in fields])


def scan(docs: DataFrame, models: MarkovModels, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, counts per kind, `base_sha256` and `spans` of every row.

    Positions are code points with the end excluded. A null text counts as empty: no spans, and the
    digest of the empty string. Kept columns with the name of a result give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(t: str | None) -> tuple:
        found = spans(t, shared.value) if t else []
        base = [s for s in found if s[2] != "random"]
        count = {k: sum(s[2] == k for s in found) for k in KINDS}
        return (count["assign"], count["access"], count["hex"], count["random"],
                hashlib.sha256(_labels(base).encode()).hexdigest(), _labels(found))

    fields = [StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex", "n_random")]
    fields += [StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return _per_text(docs, keep, text, work, fields)


def redact(docs: DataFrame, models: MarkovModels, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of `text` replaced by `mask`; a null text stays null.

    Overlapping spans are replaced as one. A column `n_chars` gets the new length where spans were found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(t: str | None) -> tuple:
        if not t:
            return (t,)
        parts, done = [], 0
        for a, b, _ in spans(t, shared.value):
            if a >= done:
                parts += [t[done:a], mask]
            done = max(done, b)
        return ("".join(parts) + t[done:],)

    before = free_name(docs.columns, "masked_before")
    out = _per_text(docs.withColumn(before, F.length(f"`{text}`")), [*docs.columns, before], text, work,
                    [StructField(text, StringType())])
    made = {}
    if "n_chars" in docs.columns:
        changed = F.length(text) != F.col(before)
        made["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
