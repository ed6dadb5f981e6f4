"""Whole texts as UTF-8 byte arrays inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Texts are worked on in runs of about this many bytes, so that a task's arrays stay small.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Odd factor of word hashes, its inverse modulo 2^64, and one random value per byte.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0]: at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def map_texts(df: DataFrame, work: Callable[[np.ndarray, np.ndarray], list], fields: list[StructField],
              keep: list[str], text: str | Column = "text") -> DataFrame:
    """The columns `keep` of every row, and `fields` computed from its whole text.

    `work` gets the bytes and offsets of some texts and returns one array per field. A kept column
    with the name of a field gives way to the field.
    """
    names = [f.name for f in fields]
    kept = [c for c in keep if c not in names]
    inner = [f"kept_{i}" for i in range(len(kept))]
    slim = df.select(*[df[f"`{c}`"].alias(a) for c, a in zip(kept, inner)],
                     (F.col(text) if isinstance(text, str) else text).alias("whole_text"))
    schema = StructType([StructField(a, slim.schema[a].dataType) for a in inner] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(len(kept)))
            parts = [work(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]) for a, b in chunks(offsets)]
            made = [pa.chunked_array([p if isinstance(p, pa.Array) else pa.array(p) for p in column]).combine_chunks()
                    for column in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*inner, *names])

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], *names)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser with full avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that are not ASCII white space."""
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from prefix sums modulo 2^64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    up = np.full(n, _FACTOR, np.uint64)
    up[0] = 1
    down = np.full(n, _INVERSE, np.uint64)
    down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * np.cumprod(up), out=total[1:])
    return mix((total[end] - total[start]) * np.cumprod(down)[start] + (end - start).astype(np.uint64))


def free_name(taken: list[str], name: str) -> str:
    """The name, or one like it that no column has, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether a document belongs to the part kept out of training; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def hash_share(key: Column, share: Column | float) -> Column:
    """A stable sample: whether the key's hash falls into the given share of all hashes."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < share * F.lit(float(1 << 40))
