"""Periodic runs of words, located by block convolution.

A run of smallest period q holds at least four periods. At the scale B = 2^k with B <= q < 2B it therefore
contains a whole block of B words, on the grid of multiples of B, together with that block's next
occurrence q words on. So, scale by scale,

* words are numbered and folded into codes small enough that the squared differences of two blocks
  sum to less than the prime 7·2^20 + 1; the sum is then zero modulo the prime only if it is zero;
* the sums of each block against the window that follows it, at all distances from B to 2B - 1, come
  from one number-theoretic transform of 2B points: sum x^2 + sum y^2 - 2 sum xy;
* distances of sum zero are seeds. A seed is extended to both sides by binary search over prefix
  hashes, and the words of what remains are compared one by one, so folding and hashing never decide.

Transforms are matrix products of residues between -P/2 and P/2, at most 64 terms each, so every
intermediate number is an integer below 2^53 and floating point is exact. Blocks stop growing at 2^19
words; longer distances are covered by several windows. Texts are worked on in chunks inside
Arrow tasks: no shuffle, no state between rows, and a lost task is simply run again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from meterlake.llm.texts import map_texts

LEAST_WORDS = 6
LEAST_EXPONENT = 4
#: 7·2^20 + 1 has roots of unity of every order up to 2^20; 3 is a primitive root.
PRIME = 7 * (1 << 20) + 1
ROOT = 3
RADIX = 64
GREATEST_BLOCK = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues nearest to zero, in place; a multiple of the prime becomes exactly 0."""
    turns = x * (1.0 / PRIME)
    np.rint(turns, out=turns)
    turns *= PRIME
    x -= turns
    return x


def _powers(root: int, exponents: np.ndarray, order: int) -> np.ndarray:
    """root^exponents as residues; the root's order is a power of two."""
    table = np.ones(1, np.int64)
    while len(table) < order:
        # The next half of the powers is the first half times root^len.
        table = np.concatenate([table, table * pow(root, len(table), PRIME) % PRIME])
    return _reduced(table[exponents % order].astype(np.float64))


@lru_cache(maxsize=64)
def _matrix(size: int, inverse: bool) -> np.ndarray:
    at = np.arange(size)
    return _powers(_root(size, inverse), np.outer(at, at), size)


@lru_cache(maxsize=32)
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    return _powers(_root(size, inverse), np.outer(np.arange(RADIX), np.arange(size // RADIX)), size)


def _root(size: int, inverse: bool) -> int:
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    return pow(w, -1, PRIME) if inverse else w


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each column; the length is a power of two up to 2^20.

    The inverse is not divided by the length. Lengths above 64 split into 64 interleaved parts.
    """
    size, columns = x.shape
    if size <= RADIX:
        return _reduced(_matrix(size, inverse) @ x)
    part = size // RADIX
    y = _reduced(_matrix(RADIX, inverse) @ x.reshape(RADIX, part * columns)).reshape(RADIX, part, columns)
    y *= _twiddles(size, inverse)[:, :, None]
    y = _reduced(y).transpose(1, 0, 2).reshape(part, RADIX * columns)
    return transform(y, inverse).reshape(size, columns)


def zero_mismatches(words: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, distance) of blocks on the grid of `scale` that occur again `scale` to `2 scale - 1` words on.

    Blocks have `scale` words, at most 2^19. Word numbers are folded, so that a few of the places may differ in truth.
    """
    block = min(scale, GREATEST_BLOCK)
    fold = int(((PRIME - 1) // block) ** 0.5)
    grid = -(-len(words) // scale)
    # The windows of the last blocks end up to three blocks behind the last word.
    codes = np.zeros((grid + 3) * scale, np.float64)
    codes[: len(words)] = words % fold
    squares = np.concatenate([[0.0], np.cumsum(codes * codes)])
    in_block = squares[block:] - squares[:-block]
    starts = np.arange(grid) * scale
    padded = np.zeros((2 * block, grid))
    padded[:block] = codes[: grid * scale].reshape(grid, scale)[:, :block].T
    spectrum = transform(padded)
    # Correlation needs the block's transform at the negative frequencies.
    backward = np.roll(spectrum[::-1], 1, axis=0)
    own = in_block[starts]
    for first in range(scale, 2 * scale, block):
        if block == scale:
            # The window is the next two blocks; moving by half the length changes the sign of odd frequencies.
            window = np.zeros_like(spectrum)
            window[:, :-1] = spectrum[:, 1:]
            window[::2, :-2] += spectrum[::2, 2:]
            window[1::2, :-2] -= spectrum[1::2, 2:]
        else:
            window = transform(codes[starts + first + np.arange(2 * block)[:, None]])
        window = _reduced(window)
        window *= backward
        apart = transform(_reduced(window), inverse=True)[:block]
        # The inverse transform lacks the factor 1 / length, so the squares get the length instead.
        apart *= -1.0 / block
        apart += in_block[first: first + grid * scale].reshape(grid, scale)[:, :block].T
        apart += own
        apart *= 2 * block
        distance, column = np.nonzero(_reduced(apart) == 0)
        yield starts[column], first + distance


class _Extension:
    """Stretches around seeds, from prefix hashes of the word numbers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, _FACTOR, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        values = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        values = values * np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(32)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:n])])

    def equal(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        here = (self.total[end] - self.total[start]) * self.power[distance]
        return here == self.total[end + distance] - self.total[start + distance]

    def reach(self, at: np.ndarray, distance: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words from `at` on (or before it) equal those `distance` further, up to `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(at, at + mid, distance) if way > 0 else self.equal(at - mid, at, distance)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _exact(words: np.ndarray, first: int, last: int, period: int) -> Iterator[tuple[int, int]]:
    """Parts of [first, last) in which words a period apart are the same: the whole, unless hashes lied."""
    differ = np.flatnonzero(words[first: last - period] != words[first + period: last])
    begin = first
    for place in (*(first + differ), last - period):
        if place > begin:
            yield begin, int(place) + period
        begin = int(place) + 1


def runs_of(words: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, smallest period) of every run of the texts `words[edges[i]: edges[i + 1]]`, longest texts first."""
    lengths = np.diff(edges)
    text = np.repeat(np.arange(len(lengths)), lengths)
    extension = _Extension(words)
    # The run, if any, in which each word was last seen.
    in_end, in_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    found: dict[tuple[int, int], int] = {}
    scale = 1
    while len(lengths) and lengths[0] >= max(LEAST_WORDS, LEAST_EXPONENT * scale):
        n = int(edges[np.searchsorted(-lengths, -max(LEAST_WORDS, LEAST_EXPONENT * scale), "right")])
        block = min(scale, GREATEST_BLOCK)
        for start, distance in zero_mismatches(words[:n], scale):
            end = start + distance + block
            inside = end <= n
            start, distance, end = start[inside], distance[inside], end[inside]
            new = (text[start] == text[end - 1]) & ((end > in_end[start]) | (distance % in_period[start] != 0))
            start, distance = start[new], distance[new]
            order = np.lexsort((start, distance))
            start, distance = start[order], distance[order]
            # Neighbouring blocks that repeat at the same distance lie in one stretch.
            follows = np.zeros(len(start), bool)
            follows[1:] = (distance[1:] == distance[:-1]) & (start[1:] == start[:-1] + scale) & (block == scale) & (text[start[1:]] == text[start[:-1]])
            start, distance = start[~follows], distance[~follows]
            true = extension.equal(start, start + block, distance)
            start, distance = start[true], distance[true]
            low, high = edges[text[start]], edges[text[start] + 1]
            last = start + extension.reach(start, distance, high - start - distance, 1) + distance
            first = start - extension.reach(start, distance, start - low, -1)
            long = last - first >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * distance)
            for a, b, d in {*zip(first[long].tolist(), last[long].tolist(), distance[long].tolist())}:
                for x, y in _exact(words, a, b, d):
                    if y - x >= max(LEAST_WORDS, LEAST_EXPONENT * d):
                        found[x, y] = min(d, found.get((x, y), d))
                        in_end[x:y], in_period[x:y] = y, found[x, y]
        scale *= 2
    return [(a, b, d) for (a, b), d in found.items()]


def _work(data: np.ndarray, offsets: np.ndarray) -> list:
    raw = data.tobytes()
    texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    number = defaultdict(count().__next__)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    edges = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order])]).astype(np.int64)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts[i] for i in order)), np.int64, int(edges[-1]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b, d in runs_of(words, edges):
        place = int(np.searchsorted(edges, a, "right")) - 1
        runs[order[place]].append((a - int(edges[place]), b - a, d))
    collapsed = []
    for mine, text in zip(runs, texts):
        mine.sort(key=lambda r: (r[0], r[2]))
        if mine:
            kept = np.ones(len(text), bool)
            for start, length, period in mine:
                kept[start + period: start + length] = False
            text = [text[i] for i in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(text))
    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.array([r for mine in runs for r in mine], np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    return [pa.ListArray.from_arrays(pa.array(at), structs), pa.array(collapsed, pa.binary()).view(pa.string())]


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row, its `runs` by start, then period, and its `collapsed` text.

    A run is a stretch of consecutive words (anything but ASCII white space, numbered from 0) of smallest
    period q and at least max(6, 4 q) words that no neighbouring word extends. `collapsed` holds, joined
    by single spaces, the words that no run holds after its first q words. A null or empty text, or one
    without words, has no run and an empty collapsed text. Every row is judged on its own, so repeated rows
    and null ids change nothing; a kept column named like a result gives way to it. No length is capped.
    """
    fields = [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())]
    return map_texts(docs, _work, fields, keep, text)
