"""Groups of spelling variants: words of a corpus and the near words they are most likely misspelt from.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Near words are
found with a bit-sliced position index: for every (position, letter) a bitset over the words of a vocabulary
part, bit w set if word w has that letter there. For a word q, three sets of words are carried along its letters:

* none: words that begin with the letters read so far;
* replaced: words of the same length so far, all letters but one the same;
* longer: words with exactly one further letter among those read so far.

A step is a handful of AND and OR over whole bitsets, with the index row of the position, or of the next
one for the words that are a letter ahead; so 64 words, with zero errors and with one, advance per machine
word, and many q at once. A word that lacks a letter of q is found when roles are exchanged.

Vocabulary parts come from the pigeonhole principle: one edit leaves one half of the word alone. For
pairs whose shorter word has m letters, the words sharing the first m // 2 letters, or the last m - m // 2, form
a cell; every word lies in four. Cells are packed into parts of some thousand words; a cell of more is dealt into
pieces which are paired off, so a common ending like "ation" is many parts. The work is thus
proportional to the vocabulary, except within single common halves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.storage import Scratch

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Words of a part of the vocabulary, and distinct words that a task counts before it passes them on.
PART_WORDS = 4096
COUNTED_AT_ONCE = 200_000
#: Queries whose bitsets are carried along together.
QUERIES_AT_ONCE = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _typo(doc_id: bytes, word: str, one_in: int) -> str:
    h = zlib.crc32(word.encode(), zlib.crc32(doc_id + b":"))
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typos_one_in: int | None = None,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least `least_length` code points that occur `least_count` times.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased. With `typos_one_in`, the words of
    a document whose CRC-32 of `<doc_id>:<word>` that number divides lose a letter first. A null text has no word, a null
    id counts as empty; every row counts, repeated or not.
    """
    slim = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(LETTERS)
        total: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for own_id, own_text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not own_text:
                    continue
                mine = Counter(letters.findall(own_text.encode().translate(_LOWER).decode()))
                key = (own_id or "").encode()
                for word, n in mine.items():
                    if typos_one_in:
                        word = _typo(key, word, typos_one_in)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > COUNTED_AT_ONCE:
                    yield batch()
                    total.clear()
        yield batch()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def position_index(words: list[str], positions: int) -> tuple[np.ndarray, dict[str, int]]:
    """bits[position, letter]: bitset over the words that have the letter at the position, and the letters' numbers.

    Letter 0 is none of them; nothing stands behind the end of a word.
    """
    letter = {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
    bits = np.zeros((positions, len(letter) + 1, -(-len(words) // 64)), np.uint64)
    lengths = np.array([len(w) for w in words])
    word = np.repeat(np.arange(len(words)), lengths)
    position = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = np.array([letter[c] for w in words for c in w])
    np.bitwise_or.at(bits, (position, code, word // 64), np.uint64(1) << (word % 64).astype(np.uint64))
    return bits, letter


def near_words(words: list[str], others: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of words[i] and others[j] that differ by a replaced letter, or where others[j] has one letter more.

    All `words` have one length, and `others` that length or one letter more.
    """
    n = len(words[0])
    bits, letter = position_index(others, n + 1)
    same_length = np.zeros(bits.shape[2], np.uint64)
    own = np.array([i for i, w in enumerate(others) if len(w) == n], np.int64)
    np.bitwise_or.at(same_length, own // 64, np.uint64(1) << (own % 64).astype(np.uint64))
    every = np.bitwise_or.reduce(bits[0], axis=0)
    for lo in range(0, len(words), QUERIES_AT_ONCE):
        asked = np.array([[letter.get(c, 0) for c in w] for w in words[lo: lo + QUERIES_AT_ONCE]])
        none = np.tile(every, (len(asked), 1))
        replaced = np.zeros_like(none)
        longer = none.copy()
        for i in range(n):
            here = bits[i][asked[:, i]]
            replaced &= here
            replaced |= none & ~here
            none &= here
            longer &= bits[i + 1][asked[:, i]]
            longer |= none
        replaced &= same_length
        longer &= every & ~same_length
        replaced |= longer
        row, block = np.nonzero(replaced)
        found = np.unpackbits(replaced[row, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(found)
        yield lo + row[hit], block[hit] * 64 + bit


def _near_in_parts(entries: DataFrame) -> DataFrame:
    """(word, near) of each part's words, in both directions; a part holds words of `shorter` letters and of one more."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        others = sorted(set(part["word"]))
        words = [w for w in others if len(w) == part["shorter"].iloc[0]]
        pairs = list(near_words(words, others)) if words else []
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        a, b = np.array(words, object)[i], np.array(others, object)[j]
        return pd.DataFrame({"word": np.concatenate([a, b]), "near": np.concatenate([b, a])}).drop_duplicates()

    return entries.groupBy("shorter", "part").applyInPandas(find, "word string, near string")


def _halves(word: Column, length: Column, shorter: Column) -> Column:
    """The two cells of a word in pairs whose shorter word has `shorter` letters."""
    half = F.floor(shorter / 2)
    rest = shorter - half
    return F.array(F.concat(F.lit("<"), F.substring(word, F.lit(1), half)), F.concat(F.lit(">"), F.substring(word, length - rest + 1, rest)))


def near_pairs(vocabulary: DataFrame, scratch: Scratch, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near): all ordered pairs of distinct words of the vocabulary at edit distance one."""
    sized = vocabulary.select("word", F.length("word").alias("length"))
    # A word is the shorter one of a pair, or one of two equal ones, or the longer one.
    roles = sized.select("word", "length", F.explode(F.array("length", F.col("length") - 1)).alias("shorter"))
    entries = roles.select("word", "shorter", F.explode(_halves(F.col("word"), F.col("length"), F.col("shorter"))).alias("cell"))
    sizes = scratch.store(entries.groupBy("shorter", "cell").agg(F.count("*").alias("size")).filter("size > 1"), "cells")
    whole = sizes.groupBy("shorter").agg(F.ceil(F.sum("size") / part_words).alias("parts"))
    # Cells are packed whole, by hash; of a large cell, every two pieces meet in a part of their own.
    packed = F.concat(F.lit("#"), F.pmod(F.xxhash64("cell"), F.col("parts")).cast("string"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1),
                       lambda other: F.concat_ws("|", "cell", F.least(F.col("piece"), other), F.greatest(F.col("piece"), other)))
    cells = sizes.join(whole, "shorter").withColumn("pieces", F.ceil(F.col("size") / part_words))
    placed = (entries.join(cells, ["shorter", "cell"]).withColumn("piece", F.pmod(F.xxhash64("word", F.lit("piece")), F.col("pieces")))
              .select("word", "shorter", F.explode(F.when(F.col("pieces") == 1, F.array(packed)).otherwise(pair)).alias("part")))
    return _near_in_parts(placed.distinct()).distinct()


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the last word when forms are followed, by doubling the steps until nothing moves.

    `forms` has word and form (null for a word without one) and no circle, as a form is more frequent than its word.
    """
    roots = scratch.store(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = roots.join(further, "root").select("word", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved"))
        step = scratch.store(moved, "roots")
        scratch.drop(roots)
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, typos_one_in: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, form, form_n, root, n_near) of each word of at least 5 code points and 3 occurrences.

    `form` is the most frequent near word (ties: the smallest in code-point order) if at least twice as frequent as the
    word, else null, and `form_n` its count; `root` is where forms lead in the end, the word itself without one.
    `n_near` counts near words among those listed. No near word is capped or sampled. An empty table,
    or one of null texts, gives no row; columns besides the two named do not matter.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.store(counted_words(docs, typos_one_in=typos_one_in, doc_id=doc_id, text=text), "vocabulary")
    pairs = scratch.store(near_pairs(vocabulary, scratch), "pairs")
    near = pairs.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    frequent = -F.col("best.minus") >= 2 * F.col("n")
    forms = scratch.store(vocabulary.join(best, "word", "left").select(
        "word", "n", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "forms")
    return scratch.release(forms.join(follow(forms, scratch), "word").select("word", "n", "form", "form_n", "root", "n_near"))
