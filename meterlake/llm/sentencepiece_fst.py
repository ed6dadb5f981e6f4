"""SentencePiece encoding and decoding by shortest paths in a weighted finite-state machine.

Three machines are composed with each text:

* the normaliser (space to the piece alphabet's space mark, a mark put in front),
* the pieces, one arc each from its first to past its last character, and byte fallback: a character
  that no piece has becomes one arc of byte pieces,
* for models built by merging, an acceptor of neighbouring pieces: weight 0 if merging their joined
  characters alone gives these two pieces again, infinite if not. A sequence is the model's result
  exactly when all its neighbours are accepted, so one path of finite weight remains. For models with
  piece probabilities the weights are their negative logarithms and every neighbour is accepted.

In the tropical semiring (min, +) the result is the shortest path. A state is a position with the last
piece; in the first kind of model each position keeps one. No arc crosses a point before a space mark
or beside a character without piece, so all paths pass through these states: the path splits there and
the parts' results, words mostly, are kept and reused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from meterlake.llm.texts import mix

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose results each Python worker keeps; when full it starts afresh.
CACHE_WORDS = 300_000


@dataclass
class PieceMachine:
    """The compiled machine. `merged`: whether the model was built by merging (else by probabilities)."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[bytes]
    merged: bool
    prefix: bool = True
    unknown_id: int = 0
    unknown_weight: float = 0.0
    longest: int = 0
    accepted: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        inside = sorted({c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in self.pieces)})
        cut = "".join(map(re.escape, inside))
        # A part: space marks and what follows up to the next mark, or one character that no piece has.
        self.parts = re.compile(f" *[^ {cut}]+| +" + (f"|[{cut}]" if cut else ""))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            self.parts = re.compile(r"(?s).+")  # some piece crosses a mark: no point to split at

    # -- the merge rule, on the joined characters of two pieces
    def merge(self, text: str) -> list[str]:
        """Join neighbours by best score, leftmost first, until no neighbours make a piece."""
        seq = list(text)
        while True:
            best = None
            for i in range(len(seq) - 1):
                score = self.scores.get(seq[i] + seq[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return seq
            seq[best[1]: best[1] + 2] = [seq[best[1]] + seq[best[1] + 1]]

    def accepts(self, left: str, right: str) -> bool:
        known = self.accepted.get((left, right))
        if known is None:
            if len(self.accepted) > 2 * CACHE_WORDS:
                self.accepted.clear()
            known = self.accepted[left, right] = self.merge(left + right) == [left, right]
        return known

    def shortest_path(self, text: str) -> list[str]:
        """The best sequence of pieces (a character without piece stands for itself)."""
        return self._merged_path(text) if self.merged else self._weighted_path(text)

    def _merged_path(self, text: str) -> list[str]:
        # last[e]: the last piece of the one finite path to position e; None if e is not reached.
        last: list[str | None] = [None] * (len(text) + 1)
        get, accepted = self.pieces.get, self.accepted
        for end in range(1, len(text) + 1):
            for start in range(max(end - self.longest, 0), end):
                piece = text[start:end]
                if get(piece) is None and end - start > 1:
                    continue
                before = last[start]
                if start == 0:
                    if len(piece) == 1 or self._whole(piece):
                        last[end] = piece
                        break
                elif before is not None:
                    ok = accepted.get((before, piece))
                    if ok or ok is None and self.accepts(before, piece):
                        last[end] = piece
                        break
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _whole(self, piece: str) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        known = self.accepted.get(("", piece))
        if known is None:
            known = self.accepted["", piece] = self.merge(piece) == [piece]
        return known

    def _weighted_path(self, text: str) -> list[str]:
        cost = [0.0] + [float("inf")] * len(text)
        back = [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(end - self.longest, 0), end):
                score = self.scores.get(text[start:end])
                if score is None and end - start > 1:
                    continue
                c = cost[start] + (-score if score is not None else self.unknown_weight)
                if c < cost[end]:
                    cost[end], back[end] = c, start
        out, at = [], len(text)
        while at:
            out.append(text[back[at]: at])
            at = back[at]
        return out[::-1]

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for piece in self.shortest_path(part.replace(" ", MARK)):
            known = self.pieces.get(piece)
            if known is not None:
                ids.append(known)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            elif ids[-1:] != [self.unknown_id]:
                ids.append(self.unknown_id)
        return ids

    def normalise(self, text: str) -> str:
        # A mark in the text itself is read as a space, as the pieces cannot tell them apart.
        text = text.replace(MARK, " ")
        return " " + text if self.prefix and text else text

    def decode(self, ids: list[int]) -> str:
        """Text of piece numbers; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_PAIR_SLOTS = 1 << 20
_FILTER_BITS = 20


def _range_hashes(points: np.ndarray):
    """A function (starts, ends) → hashes of code point ranges, from prefix sums modulo 2^64."""
    n = len(points)
    up, down = np.full(n, _ODD, np.uint64), np.full(n, _ODD_INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    down = np.cumprod(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * np.cumprod(up), out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * down[a])


class Encoder(dict):
    """Piece numbers of parts as int32 bytes.

    The parts of a batch that are not known yet are composed with the machine together: arcs are
    found by hashes of all their character ranges, and paths grow one end position at a time.
    """

    def __init__(self, machine: PieceMachine):
        super().__init__()
        self.machine = machine
        m = machine
        self.names = list(m.pieces)
        self.numbers = np.array([m.pieces[p] for p in self.names], np.int32)
        self.lengths = np.array([len(p) for p in self.names] + [1, 1], np.int64)
        self.none, self.start = len(self.names), len(self.names) + 1  # a character without piece; a part's start
        ends = np.cumsum(self.lengths[:-2])
        hashes = _range_hashes(_points("".join(self.names)))(ends - self.lengths[:-2], ends)
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], order.astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        # A direct-mapped cache of accepted pairs in front of the machine's own.
        self.pair_keys = np.full(_PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(_PAIR_SLOTS, bool)

    def _accepts(self, left: int, right: int) -> bool:
        if left == self.start:
            return self.machine._whole(self.names[right])
        return self.machine.accepts(self.names[left], self.names[right])

    def _arcs(self, points: np.ndarray, first: np.ndarray, last_of: np.ndarray):
        """(start, end, piece) of all pieces within the parts, and of characters without piece."""
        hashes = _range_hashes(points)
        place = np.arange(len(points))
        starts, ends, pieces = [], [], []
        for size in range(1, self.machine.longest + 1):
            a = place[place + size <= last_of]
            if not len(a):
                break
            h = hashes(a, a + size)
            maybe = self.filter[h >> np.uint64(64 - _FILTER_BITS)]
            a, h = a[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            a, piece = a[hit], self.by_hash[at[hit]]
            if size == 1:
                bare = np.ones(len(points), bool)
                bare[a] = False
                a, piece = np.concatenate([a, place[bare]]), np.concatenate([piece, np.full(bare.sum(), self.none)])
            starts.append(a)
            ends.append(a + size)
            pieces.append(piece)
        a, b, piece = map(np.concatenate, (starts, ends, pieces))
        order = np.argsort((b - first[a]) * 64 - (b - a), kind="stable")  # by end within the part, longest first
        return a[order], b[order], piece[order]

    def add(self, parts: list[str]) -> None:
        """Work out the shortest paths of all given parts."""
        sizes = np.array([len(p) for p in parts])
        stop = np.cumsum(sizes)
        points = _points("".join(parts).replace(" ", MARK))
        first, last_of = np.repeat(stop - sizes, sizes), np.repeat(stop, sizes)
        a, b, piece = self._arcs(points, first, last_of)
        depth = b - first[a]
        # last[i]: the piece of the one finite path up to position i of its part (ends only).
        last = np.full(len(points) + 1, -1, np.int64)
        cuts = np.searchsorted(depth, np.arange(1, depth[-1] + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            s, e, right = a[lo:hi], b[lo:hi], piece[lo:hi]
            left = np.where(s == first[s], self.start, last[s])
            left = np.where(left == self.none, self.start, left)  # nothing merges across such a character
            key = left * (self.start + 1) + right
            slot = (key * 0x9E3779B1 >> 7) & (_PAIR_SLOTS - 1)
            known = (self.pair_keys[slot] == key) | (right == self.none)
            ok = (self.pair_ok[slot] | (right == self.none)) & known & (left >= 0)
            last[e[ok]] = right[ok]
            open_ = np.flatnonzero(~known & (left >= 0) & (last[e] < 0))
            for i in open_.tolist():
                if last[e[i]] < 0:
                    fine = self._accepts(int(left[i]), int(right[i]))
                    self.pair_keys[slot[i]], self.pair_ok[slot[i]] = key[i], fine
                    if fine:
                        last[e[i]] = right[i]
        at, owner = stop.copy(), np.arange(len(parts))
        begin = stop - sizes
        found_at, found, found_in = [], [], []
        while len(owner):
            p = last[at]
            at = at - self.lengths[p]
            found_at.append(at)
            found.append(p)
            found_in.append(owner)
            more = at > begin[owner]
            at, owner = at[more], owner[more]
        where, got, of = map(np.concatenate, (found_at, found, found_in))
        got = got[np.argsort(where, kind="stable")]
        bare = np.zeros(len(parts), bool)
        bare[of[np.concatenate(found) == self.none]] = True
        edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(parts)))]) * 4
        flat = np.append(self.numbers, np.int32(0))[got].tobytes()
        for i, part in enumerate(parts):
            self[part] = flat[edges[i]: edges[i + 1]]
        for i in np.flatnonzero(bare).tolist():
            self[parts[i]] = self._bytes(parts[i])

    def _bytes(self, part: str) -> bytes:
        return np.array(self.machine.part_ids(part), np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        m = self.machine
        split = [m.parts.findall(m.normalise(t)) for t in texts]
        if len(self) >= CACHE_WORDS:
            self.clear()
        new = list({p for parts in split for p in parts if p not in self})
        if m.merged and m.longest < 64:
            for at in range(0, len(new), 20_000):
                self.add(new[at: at + 20_000])
        else:
            for part in new:
                self[part] = self._bytes(part)
        return [np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32) for parts in split]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def load(path: str = MODEL_PATH) -> PieceMachine:
    """Compile a model file; its piece list and settings are read, its encoder is not used."""
    from sentencepiece import sentencepiece_model_pb2 as messages

    proto = messages.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("Only models with the identity normaliser and unigram or merged pieces can be compiled.")
    kinds = proto.SentencePiece.Type
    pieces, scores, byte_ids, texts, unknown = {}, {}, [0] * 256, [], 0
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            texts.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == kinds.UNKNOWN:
            unknown = i
            texts.append(proto.trainer_spec.unk_surface.encode())
        elif p.type == kinds.NORMAL or p.type == kinds.USER_DEFINED:
            pieces[p.piece], scores[p.piece] = i, p.score
            texts.append(p.piece.replace(MARK, " ").encode())
        else:
            texts.append(b"")
    return PieceMachine(pieces, scores, byte_ids if proto.trainer_spec.byte_fallback else [], texts,
                        proto.trainer_spec.model_type == 2, spec.add_dummy_prefix, unknown,
                        10 - min(scores.values(), default=0.0))


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder; workers serve many tasks, so results are kept between them."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(load(path))
    return _LOADED[path]


def encode(docs: DataFrame, keep: list[str], text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """The columns `keep`, `n_pieces`, `ids` and `round_trip` (decoding gives the text again).

    A null text has null results; an empty one has no pieces. A text with the mark character itself
    does not come back, since decoding makes it a space. The model file must be readable by every
    executor; `keep` columns with a result's name give way to it.
    """
    names = ["n_pieces", "ids", "round_trip"]
    kept = [c for c in keep if c not in names]
    inner = [f"kept_{i}" for i in range(len(kept))]
    slim = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in zip(kept, inner)], F.col(text).alias("whole_text"))
    schema: StructType = slim.drop("whole_text").schema
    for line in ("n_pieces", "long"), ("ids", ArrayType(IntegerType())), ("round_trip", "boolean"):
        schema = schema.add(*line)

    def run(batches):
        e = _encoder(model_path)
        for big in batches:
            for at in range(0, big.num_rows, 250):
                batch = big.slice(at, 250)
                texts = batch.column(len(kept)).to_pylist()
                coded = iter(e.encode_all([t for t in texts if t is not None]))
                ids = [None if t is None else next(coded) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([x is None for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)
                sizes = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                same = pa.array([None if x is None else e.machine.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, lists, same], schema.names)

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], *names)


def decode(rows: DataFrame, keep: list[str], ids: str = "ids", name: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """The columns `keep` and the text of each row's piece numbers; null for null."""
    kept = [c for c in keep if c != name]
    inner = [f"kept_{i}" for i in range(len(kept))]
    slim = rows.select(*[rows[f"`{c}`"].alias(a) for c, a in zip(kept, inner)], F.col(ids).alias("piece_ids"))
    schema = slim.drop("piece_ids").schema.add("whole_text", "string")

    def run(batches):
        machine = _encoder(model_path).machine
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for a, c in zip(inner, kept)], F.col("whole_text").alias(name))
