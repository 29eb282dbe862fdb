"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a word with the spaces before it, or a character no
longer piece holds) are concatenated and their suffixes sorted. Each piece of the
vocabulary is looked up by binary search, which gives the range of all its
occurrences; these are the edges. Sorted by position, they are relaxed in the order
that the model prescribes: of the edges that join two neighbouring symbols the
best-scored, leftmost one first, until none is left. Characters without a piece
become bytes. Results equal those of the SentencePiece library for models of kind
BPE with byte fallback, the identity normalizer and a space in front.

Null and empty texts have no ids; a null text decodes to the empty text. U+2581 is
the same as a space, as in the library. Repeated rows are encoded each; further
columns are ignored. Vocabularies of another kind raise ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hearthline.llm import tokens

#: Bytes of text whose units are looked up together; a task needs some 60 times as much memory.
BATCH = 1 << 19
#: Units whose ids a task keeps; it starts afresh above that.
KEPT_UNITS = 1 << 19
#: Units above this many bytes are relaxed with a queue each instead of side by side.
SIDE_BY_SIDE = 256

_BREAK = 0xFF  # in no UTF-8 text
_NORMAL = 1


@dataclass
class Vocabulary:
    """Pieces by id as bytes, with a space for U+2581."""

    names: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    alone: np.ndarray
    pool: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @property
    def width(self) -> int:
        return self.names.dtype.itemsize

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of all pieces; numbers of the short ones, and the least and greatest eight bytes that begin with each."""
        sizes = np.char.str_len(self.names)
        short = np.flatnonzero(sizes <= 8)
        low, high = (np.frombuffer(b"".join(x.ljust(8, end) for x in self.names[short].tolist()), ">u8").astype(np.uint64) for end in (b"\0", b"\xff"))
        return sizes, short, low, high


def load(path: str) -> Vocabulary:
    """Read a model file on the driver; tasks get the vocabulary, whose size the model bounds."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, plain = model.normalizer_spec, model.trainer_spec
    if plain.model_type != 2 or not plain.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("not a BPE model with byte fallback, identity normalizer and a space in front")
    shown, matched, byte_ids = [], [], np.zeros(256, np.int32)
    for i, piece in enumerate(model.pieces):
        text = piece.piece.replace("▁", " ").encode()
        if piece.type == piece.BYTE:
            byte_ids[int(piece.piece[3:5], 16)] = i
            text = bytes([int(piece.piece[3:5], 16)])
        elif piece.type == _NORMAL:
            if b" " in text.lstrip(b" "):
                raise ValueError("a piece has a space after other characters")
            matched.append((text, i, piece.score))
        elif piece.type == piece.CONTROL:
            text = b""
        shown.append(text)
    alone = np.ones(256, bool)
    for text, _, _ in matched:
        if len(text.decode()) > 1:
            alone[np.frombuffer(text, np.uint8)] = False
    alone[128:] = False
    if len(matched) >= 1 << 20 or max(len(x[0]) for x in matched) > 255:
        raise ValueError("over a million pieces, or a piece of over 255 bytes")
    sizes = np.array([len(x) for x in shown])
    return Vocabulary(
        np.array([x[0] for x in matched], bytes), np.array([x[1] for x in matched], np.int32), np.array([x[2] for x in matched]),
        byte_ids, alone, np.frombuffer(b"".join(shown), np.uint8), np.cumsum(sizes) - sizes, sizes,
    )


def ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return pool[np.repeat(shift, sizes) + np.arange(sizes.sum())]


def _packed(data: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as one number, breaks after the end."""
    padded = np.concatenate([data, np.full(8, _BREAK, np.uint8)]).astype(np.uint64)
    key = np.zeros(data.size, np.uint64)
    for k in range(8):
        key |= padded[k : k + data.size] << np.uint64(56 - 8 * k)
    return key


def _ranges(ranked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: first suffix of each piece, and how many have it in front."""
    first = np.searchsorted(ranked, low, "left")
    return first, np.maximum(np.searchsorted(ranked, high, "right") - first, 0)


def edges(v: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, piece number, end) of all occurrences of pieces, by position and length.

    Suffixes are sorted by eight bytes; those that start like a longer piece are
    sorted once more by as many bytes as the longest piece has. A break is in no
    piece, so no occurrence reaches past a unit.
    """
    sizes, short, low, high = v.bounds
    key = _packed(data)
    order = np.argsort(key)
    ranked = key[order]
    first, count = _ranges(ranked, low, high)
    at, piece = [ragged(order, first, count)], [np.repeat(short, count)]

    long = np.flatnonzero(sizes > 8)
    if long.size:
        fronts = np.unique(np.frombuffer(b"".join(x[:8] for x in v.names[long].tolist()), ">u8").astype(np.uint64))
        place = ragged(order, *_ranges(ranked, fronts, fronts))
        padded = np.concatenate([data, np.full(v.width, _BREAK, np.uint8)])
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, v.width)[place]
        suffixes = np.ascontiguousarray(suffixes).view(f"S{v.width}").ravel()
        deeper = np.argsort(suffixes)
        beyond = np.frombuffer(b"".join(x.ljust(v.width, b"\xff") for x in v.names[long].tolist()), f"S{v.width}")
        first, count = _ranges(suffixes[deeper], v.names[long], beyond)
        at.append(ragged(place[deeper], first, count))
        piece.append(np.repeat(long, count))
    at, piece = np.concatenate(at), np.concatenate(piece)
    # Sorted as one number: position, length, piece.
    packed = np.sort((at << 28) | (sizes[piece] << 20) | piece)
    at, piece = packed >> 28, packed & 0xFFFFF
    return at, piece, at + (packed >> 20 & 0xFF)


def _relax(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, offsets) of units laid out in ``data``, each followed by a break."""
    at, piece, end = edges(v, data)
    border = (data & 0xC0) != 0x80  # where a symbol starts
    border = np.append(border, True)
    named = np.full(data.size, -1, np.int32)
    heads = np.flatnonzero(border)
    upto = np.append(heads[1:], border.size)
    size_of = np.zeros(data.size, np.int64)
    size_of[heads[:-1]] = (upto - heads)[:-1]
    single = size_of[at] == end - at
    named[at[single]] = v.ids[piece[single]]
    at, piece, end = at[~single], piece[~single], end[~single]
    # Best score first, then leftmost: one number to take the greatest of.
    _, rank = np.unique(v.scores, return_inverse=True)
    worth = (rank[piece].astype(np.int64) << 32) + (data.size - at)
    unit = np.searchsorted(starts, at, "right") - 1
    long = (ends - starts > SIDE_BY_SIDE)[unit]
    for u in np.unique(unit[long]).tolist():
        own = unit == u
        _queue(border, named, at[own], end[own], worth[own], v.ids[piece[own]], starts[u], ends[u])
    at, piece, end, worth, unit = (x[~long] for x in (at, piece, end, worth, unit))
    while at.size:
        whole = border[at] & border[end]
        at, piece, end, worth, unit = (x[whole] for x in (at, piece, end, worth, unit))
        before = np.cumsum(border)
        ready = np.flatnonzero(before[end] - before[at] == 2)
        if not ready.size:
            break
        groups = np.flatnonzero(np.append(True, np.diff(unit[ready]) != 0))
        best = np.maximum.reduceat(worth[ready], groups)
        chosen = ready[np.flatnonzero(worth[ready] == np.repeat(best, np.diff(np.append(groups, ready.size))))]
        middle = np.searchsorted(before, before[at[chosen]] + 1, "left")
        border[middle] = False
        named[at[chosen]] = v.ids[piece[chosen]]
        going = np.zeros(starts.size, bool)
        going[unit[ready]] = True
        going = going[unit]
        at, piece, end, worth, unit = (x[going] for x in (at, piece, end, worth, unit))
    inside = np.flatnonzero(border[:-1] & (data != _BREAK))
    ids = named[inside]
    bare = ids < 0
    size = np.where(bare, size_of[inside], 1)
    first = np.cumsum(size) - size
    out = np.repeat(ids, size)
    spread = np.repeat(bare, size)
    byte_at = np.repeat(inside - first, size) + np.arange(out.size)
    out[spread] = v.byte_ids[data[byte_at[spread]]]
    return out, np.append(first, out.size)[np.searchsorted(inside, np.append(starts, data.size))]


def _queue(border, named, at, end, worth, ids, start, stop) -> None:
    """The same relaxation for one long unit."""
    known = {(a, e): (w, i) for a, e, w, i in zip(at.tolist(), end.tolist(), worth.tolist(), ids.tolist(), strict=True)}
    cuts = [*(np.flatnonzero(border[start:stop]) + start).tolist(), int(stop)]
    after = dict(zip(cuts[:-1], cuts[1:], strict=True))
    before = dict(zip(cuts[1:], cuts[:-1], strict=True))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after.get(a)
        c = after.get(b) if b is not None else None
        if c is not None and (a, c) in known:
            heapq.heappush(heap, (-known[a, c][0], a, b, c))

    for a in cuts[:-1]:
        offer(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if after.get(a) != b or after.get(b) != c:
            continue
        border[b] = False
        named[a] = known[a, c][1]
        after[a], before[c] = c, a
        del after[b], before[b]
        offer(a)
        if a in before:
            offer(before[a])


class Encoder:
    """Encodes batches, keeping the ids of units seen before."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        rows = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[:-1][rows], 32)
        extra = np.zeros(offsets.size, np.int64)
        extra[rows + 1] = 1
        offsets = offsets + np.cumsum(extra)
        if not data.size:
            return np.zeros(0, np.int32), np.zeros(offsets.size, np.int64)
        alone, space = self.v.alone[data], data == 32
        begin = alone & ~space | space
        begin[1:] &= ~(space[1:] & space[:-1])
        begin[1:] |= (alone & ~space)[:-1]
        begin[offsets[:-1][rows]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], data.size)
        hashes = tokens.span_hashes(data, starts, ends)
        names, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known.size > KEPT_UNITS:
            self._forget()
        new = np.ones(names.size, bool)
        if self.known.size:
            place = np.minimum(np.searchsorted(self.known, names), self.known.size - 1)
            new = self.known[place] != names
        if new.any():
            self._learn(data, names[new], starts[first[new]], ends[first[new]])
        place = np.searchsorted(self.known, names)[of]
        sizes = self.sizes[place]
        border = np.append(0, np.cumsum(sizes))
        return ragged(self.pool, self.starts[place], sizes), border[np.searchsorted(starts, offsets)]

    def _learn(self, data: np.ndarray, names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes = ends - starts
        laid = ragged(data, starts, sizes)
        own = np.cumsum(sizes) - sizes + np.arange(sizes.size)
        joined = np.full(laid.size + sizes.size, _BREAK, np.uint8)
        joined[np.repeat(own - (np.cumsum(sizes) - sizes), sizes) + np.arange(laid.size)] = laid
        ids, offsets = _relax(self.v, joined, own, own + sizes)
        known = np.concatenate([self.known, names])
        order = np.argsort(known)
        self.starts = np.concatenate([self.starts, offsets[:-1] + self.pool.size])[order]
        self.sizes = np.concatenate([self.sizes, np.diff(offsets)])[order]
        self.known, self.pool = known[order], np.concatenate([self.pool, ids])


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids; the space in front goes."""
    starts, sizes = v.starts[ids], v.sizes[ids]
    first = offsets[:-1][np.diff(offsets) > 0]
    led = first[(sizes[first] > 0) & (v.pool[np.minimum(starts[first], v.pool.size - 1)] == 32)]
    starts[led] += 1
    sizes[led] -= 1
    return ragged(v.pool, starts, sizes), np.append(0, np.cumsum(sizes))[offsets]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a text column, with spaces for U+2581; only one block is copied at a time."""
    for first, last, _, _ in tokens.blocks(column, BATCH):
        yield first, last, *tokens.buffers(pc.replace_substring(column.slice(first, last - first), "▁", " "))


def encode_texts(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, ids of every text of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for first, last, data, offsets in _blocks(batch.column("text")):
                ids, border = encoder.encode(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            data, border = decode(shared.value, lists.flatten().to_numpy(), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _texts(data, border)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _texts(data: np.ndarray, border: np.ndarray) -> pa.Array:
    raw = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), border.size - 1, [None, pa.py_buffer(border.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    )
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes of foreign ids need not be a text
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()])


def round_trip(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            # The mark itself comes back as a space.
            marked = pc.fill_null(pc.match_substring(batch.column("text"), "▁"), False).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in _blocks(batch.column("text")):
                ids, border = encoder.encode(data, offsets)
                back, ends = decode(shared.value, ids, border)
                same = np.diff(ends) == np.diff(offsets)
                if same.all():
                    wrong = np.append(0, np.cumsum(back != data))
                    same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same &= [np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)]
                same = same & ~marked[first:last]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids, pa.int32())),
                        pa.array(np.diff(border)), pa.array(same),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
