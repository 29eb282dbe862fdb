"""Repeated byte strings by prefix-free parsing.

Every place where a string of ``LENGTH`` bytes starts is a window. A rolling hash over
``GRAM`` bytes marks triggers, and the trigger with the least hash among those early
enough in a window is the window's anchor. Maximal stretches of windows with one anchor
are the phrases of a text; neighbours overlap by one byte less than a window, so each
window lies in just one phrase. Phrases are moved as fingerprints, filed under a seed,
the bytes at their anchor that all their windows contain; equal windows have equal seeds.

* The parse: how often a phrase comes is counted across the corpus. All windows of a
  phrase that comes twice are repeated, however long the repeated passage; a seed that
  comes once rules its windows out. Copies stop here.
* The dictionary: what is left are phrases that come once and share a seed with others,
  at the ends of repeated passages. Their bytes are gathered by seed and parsed again
  with short phrases: the suffix array of the distinct ones and the suffix array of
  their sequence combine into the order of all windows, in which equal ones are
  neighbours with a common prefix of ``LENGTH`` bytes.

A seed with more than ``GROUP`` distinct phrases is not gathered: its windows are
counted one by one, each under its own fingerprint, which spreads them. Both ways are
exact, but for chance equality of 64-bit fingerprints below one seed.

Texts are UTF-8 bytes and whole; null is empty. Equal texts are judged once and answered
for every row, so repeated rows lose all bytes if long enough. Texts shorter than a
window keep everything. Ids may be null or repeated; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens
from hearthline.session import cut_lineage

LENGTH = 200
#: Bytes that all windows of a phrase share; a longer one rules out more, but makes phrases short.
SEED = 56
GRAM = 8
#: One in 2**TRIGGER grams is a trigger.
TRIGGER = 4
#: Distinct phrases of one seed that are gathered in one task, some 300 bytes each.
GROUP = 500
#: Bytes of gathered phrases put in order at once.
BLOCK = 1 << 21

#: How places are packed in lists.
PLACE = np.dtype(">i4")

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["t1", "t2"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tokens)


class Rolling:
    """Karp-Rabin hashes of any span of ``data`` from prefix sums."""

    BASE = 0xD6E8FEB86659FD93
    BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
    powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, data: np.ndarray):
        if self.powers[0].size <= data.size:
            for i, factor in enumerate((self.BASE, pow(self.BASE, -1, 1 << 64))):
                grown = np.full(data.size + 1, factor, np.uint64)
                grown[0] = 1
                self.powers[i] = np.multiply.accumulate(grown)
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self.BYTE[data] * self.powers[0][: data.size], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[ends] - self.sums[starts]) * self.powers[1][starts])

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where the hash of the next ``GRAM`` bytes is a trigger, and these hashes."""
        n = max(self.sums.size - GRAM, 0)
        rolled = (self.sums[GRAM:] - self.sums[:n]) * self.powers[1][:n] * _SCRAMBLE
        at = np.flatnonzero(rolled < np.uint64(1 << 64 - TRIGGER))
        return at, rolled[at]


def _nearest_less(at: np.ndarray, key: np.ndarray, reach: int, strict: bool) -> np.ndarray:
    """Place of the next trigger to the right, within ``reach``, with a smaller (or equal) key; else far off."""
    found = np.full(at.size, np.iinfo(np.int64).max >> 1)
    still, step = np.arange(at.size), 0
    while still.size:
        step += 1
        still = still[still + step < at.size]
        still = still[at[still + step] - at[still] <= reach]
        less = key[still + step] < key[still] if strict else key[still + step] <= key[still]
        found[still[less]] = at[still[less] + step]
        still = still[~less]
    return found


def phrases_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, phrase, start, windows) of all phrases of the texts in ``data``."""
    rolling = Rolling(data)
    at, key = rolling.triggers()
    reach = LENGTH - SEED
    after = _nearest_less(at, key, reach, strict=True)
    before = -_nearest_less(-at[::-1], key[::-1], reach, strict=False)[::-1]
    # A trigger is the anchor of windows that begin between the last place where one before
    # it is as small and reach before it, and end before one after it is smaller.
    low = np.maximum(before + 1, at - reach)
    high = np.minimum(at, after - reach - 1)
    text = np.searchsorted(offsets, at, "right") - 1
    low = np.maximum(low, offsets[text])
    high = np.minimum(high, offsets[text + 1] - LENGTH)
    own = np.flatnonzero(low <= high)
    text, low, high, at_own = text[own], low[own], high[own], at[own]
    # Windows without a trigger early enough: each is a phrase of its own.
    sizes = np.diff(offsets)
    covered = np.zeros(data.size + 1, np.int64)
    np.add.at(covered, low, 1)
    np.add.at(covered, high + 1, -1)
    whole = np.repeat(sizes, sizes) - (np.arange(data.size) - np.repeat(offsets[:-1], sizes)) >= LENGTH
    bare = np.flatnonzero(whole & (np.cumsum(covered)[:-1] == 0))
    seed = np.concatenate([rolling.spans(at_own, at_own + SEED), rolling.spans(bare, bare + LENGTH)])
    low, high = np.concatenate([low, bare]), np.concatenate([high, bare])
    text = np.concatenate([text, np.searchsorted(offsets, bare, "right") - 1])
    return text, seed, rolling.spans(low, high + LENGTH), low - offsets[text], high - low + 1


def _names(texts: list[bytes]) -> np.ndarray:
    """128-bit names of texts, as two whole numbers each."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, _, data, offsets in tokens.blocks(batch.column(column)):
        yield first, data, offsets


def _own(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each distinct text of a block; ``times`` counts the places and the copies in the block."""
    for batch in batches:
        for _, data, offsets in _blocks(batch, "text"):
            texts = _own(data, offsets)
            names = _names(texts)
            _, first, copies = np.unique(names, axis=0, return_index=True, return_counts=True)
            if first.size < len(texts):
                chosen = [texts[i] for i in first.tolist()]
                data = np.frombuffer(b"".join(chosen), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in chosen])]).astype(np.int64)
                names = names[first]
            else:
                copies = np.ones(len(texts), np.int64)
            text, seed, phrase, start, windows = phrases_of(data, offsets)
            if not text.size:
                continue
            order = np.lexsort((start, phrase, seed, text))
            text, seed, phrase, start, windows = (x[order] for x in (text, seed, phrase, start, windows))
            new = np.ones(text.size, bool)
            new[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1]) | (phrase[1:] != phrase[:-1])
            head = np.flatnonzero(new)
            ends = np.append(head[1:], text.size)
            places = pa.Array.from_buffers(
                pa.binary(), head.size, [None, pa.py_buffer(np.append(head, text.size).astype(np.int32) * 4), pa.py_buffer(start.astype(PLACE))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.signed(seed[head])), pa.array(tokens.signed(phrase[head])), pa.array(names[text[head], 0]), pa.array(names[text[head], 1]),
                 pa.array(windows[head]), pa.array((ends - head) * copies[text[head]]), places],
                ["seed", "phrase", *_KEY, "windows", "times", "places"])


def phrases(docs: DataFrame) -> DataFrame:
    """(seed, phrase, t1, t2, windows, times, places): distinct phrases of texts, which t1 and t2 name."""
    return docs.select("text").mapInArrow(_phrase_rows, "seed bigint, phrase bigint, t1 bigint, t2 bigint, windows bigint, times bigint, places binary")


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text once per task, so that a group of copies does not meet in one place."""
    seen: set[bytes] = set()
    for batch in batches:
        for first, data, offsets in _blocks(batch, "text"):
            names = _names(_own(data, offsets))
            new = []
            for i, name in enumerate(names):
                if offsets[i + 1] - offsets[i] >= LENGTH and (key := name.tobytes()) not in seen:
                    seen.add(key)
                    new.append(i)
            if new:
                rows = batch.column("text").take(pa.array(np.array(new) + first))
                yield pa.RecordBatch.from_arrays([pa.array(names[new, 0]), pa.array(names[new, 1]), rows], [*_KEY, "text"])


def texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, text) of all texts of at least a window, once per task."""
    return docs.select("text").mapInArrow(_text_rows, "t1 bigint, t2 bigint, text string")


def judged(docs: DataFrame) -> DataFrame:
    """Phrases whose seed comes twice: whether they come twice themselves, and what their seed has.

    ``chosen`` marks a text that stands for a phrase which comes more than once;
    ``members`` counts the distinct phrases of the seed and ``alone`` those that come once.
    """
    rows = phrases(docs)
    often = rows.groupBy("seed").agg(F.sum("times").alias("n")).where("n > 1").select("seed")
    again = rows.join(often, "seed").groupBy("seed", "phrase", *_KEY, "windows", "places").agg(F.sum("times").alias("times"))
    again = cut_lineage(again, "phrases")
    known = again.groupBy("seed", "phrase").agg(F.sum("times").alias("all"), F.min("t1").alias("least"))
    seeds = known.groupBy("seed").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("all") == 1).alias("alone"))
    found = again.join(known.join(seeds, "seed"), ["seed", "phrase"])
    return cut_lineage(found.select(
        "seed", *_KEY, "windows", "places", (F.col("all") > 1).alias("repeated"), (F.col("t1") == F.col("least")).alias("chosen"), "members", "alone"), "judged")


_PIECE = "seed bigint, t1 bigint, t2 bigint, start bigint, windows bigint, own boolean, piece binary"


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed phrases; of a large group the fingerprint of each window instead."""
    names = [f.split()[0] for f in _PIECE.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    for batch in batches:
        for t1, t2, text, listed in zip(*(batch.column(c) for c in (*_KEY, "text", "listed")), strict=True):
            raw, t1, t2 = text.as_py().encode(), t1.as_py(), t2.as_py()
            rolling, out = None, []
            for p in listed.as_py():
                start, n = int.from_bytes(p["places"][:4], "big"), p["windows"]
                if p["large"]:
                    rolling = rolling or Rolling(np.frombuffer(raw, np.uint8))
                    at = np.arange(start, start + n)
                    keys = tokens.signed(rolling.spans(at, at + LENGTH)).tolist()
                    out += [(k, t1, t2, i, 1, p["own"], None) for k, i in zip(keys, at.tolist(), strict=True)]
                else:
                    out.append((p["seed"], t1, t2, start, n, p["own"], raw[start : start + n + LENGTH - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _suffix_ranks(symbols: np.ndarray, ends: np.ndarray, packed: int) -> np.ndarray:
    """Rank of each suffix of sequences that lie end to end, from 1; equal suffixes share one.

    ``ends`` has the end of each symbol's own sequence, ``symbols`` are from 1 up. The
    first ``packed`` symbols are compared at once, then twice as many in each round.
    """
    n, places = symbols.size, np.arange(symbols.size)
    base, first = int(symbols.max(initial=0)) + 1, np.zeros(symbols.size, np.int64)
    for k in range(packed):
        inside = places + k < ends
        first *= base
        first[inside] += symbols[places[inside] + k]
    values, rank = np.unique(first, return_inverse=True)
    span, count, longest = packed, values.size, int((ends - places).max(initial=0))
    while span < longest and count < n:
        after = np.zeros(n, np.int64)
        inside = places + span < ends
        after[inside] = rank[places[inside] + span] + 1
        values, rank = np.unique(rank * (count + 1) + after, return_inverse=True)
        if values.size == count:
            break
        span, count = span * 2, values.size
    return rank.astype(np.int64) + 1


def window_order(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the pieces in ``data`` in the order of the suffixes that begin
    there, and whether each equals the one before it in that order."""
    rolling = Rolling(data)
    at, _ = rolling.triggers()
    piece = np.searchsorted(offsets, at, "right") - 1
    starts = np.unique(np.concatenate([offsets[:-1], at[at + GRAM <= offsets[piece + 1]]]))
    piece = np.searchsorted(offsets, starts, "right") - 1
    last = np.append(piece[1:] != piece[:-1], True)
    ends = np.where(last, offsets[piece + 1], np.append(starts[1:], 0) + GRAM)
    # Dictionary: distinct phrases and the order of their suffixes.
    _, chosen, entry = np.unique(rolling.spans(starts, ends) ^ (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
    sizes = (ends - starts)[chosen]
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(begin, sizes)
    letters = data[np.repeat(starts[chosen], sizes) + inside].astype(np.int64) + 1
    in_dictionary = _suffix_ranks(letters, np.repeat(begin + sizes, sizes), 7)
    # Parse: phrases as symbols by their order, and the order of the suffixes of their sequence.
    symbols = np.unique(in_dictionary[begin], return_inverse=True)[1][entry].astype(np.int64) + 1
    per_piece = np.bincount(piece, minlength=offsets.size - 1)
    in_parse = _suffix_ranks(symbols, np.repeat(np.cumsum(per_piece), per_piece), 1)
    following = np.where(last, 0, np.append(in_parse[1:], 0))
    # A suffix is ordered by the rest of its phrase, then by the parse after it.
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    phrase = np.searchsorted(starts, place, "right") - 1
    rest = in_dictionary[begin[entry[phrase]] + place - starts[phrase]]
    place = place[np.argsort(rest * (int(in_parse.max(initial=0)) + 1) + following[phrase], kind="stable")]
    prints = rolling.spans(place, place + LENGTH)
    return place, np.append(False, prints[1:] == prints[:-1])[: place.size]


def _twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that equal another one, from pieces sorted by seed."""

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces = table.column("piece").to_pylist()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        place, same = window_order(data, offsets)
        twin = np.zeros(data.size + 1, bool)
        twin[place[same]] = True
        twin[place[np.flatnonzero(same) - 1]] = True
        begin, end = tokens.spans(twin[:-1], offsets)
        row = np.searchsorted(offsets, begin, "right") - 1
        keep = table.column("own").to_numpy()[row]
        begin, end, row = begin[keep], end[keep], row[keep]
        start = table.column("start").to_numpy()[row] + begin - offsets[row]
        if row.size:
            yield pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[row]) for c in _KEY), pa.array(start), pa.array(end - begin)], [*_KEY, "start", "windows"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("piece").nbytes
        if size > BLOCK:
            table = pa.Table.from_batches(held)
            seeds = table.column("seed").to_numpy()
            cut = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
            if cut:
                yield from judge(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column("piece").nbytes for b in held)
    if held:
        yield from judge(pa.Table.from_batches(held))


def twins(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(t1, t2, start, windows): stretches of repeated windows in phrases that come once."""
    needed = found.where((F.col("alone") > 0) & (~F.col("repeated") | F.col("chosen")))
    entry = F.struct("seed", "windows", "places", (~F.col("repeated")).alias("own"), (F.col("members") > GROUP).alias("large"))
    lists = needed.groupBy(*_KEY).agg(F.collect_list(entry).alias("listed"))
    pieces = cut_lineage(texts(docs).join(lists, _KEY).select(*_KEY, "text", "listed").mapInArrow(_cut_pieces, _PIECE), "pieces")
    gathered = pieces.where(F.col("piece").isNotNull()).repartition("seed").sortWithinPartitions("seed")
    single = pieces.where(F.col("piece").isNull())
    often = single.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    spread = single.where("own").join(often, "seed").select(*_KEY, "start", "windows")
    return gathered.mapInArrow(_twins, "t1 bigint, t2 bigint, start bigint, windows bigint").unionByName(spread)


def _remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t1, t2, text, listed in zip(*(batch.column(c) for c in (*_KEY, "text", "listed")), strict=True):
            raw = text.as_py().encode()
            edges = np.zeros(len(raw) + 1, np.int64)
            for p in listed.as_py():
                at = np.frombuffer(p["places"], PLACE)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + (p["windows"] + LENGTH - 1), -1)
            gone = np.cumsum(edges)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((t1.as_py(), t2.as_py(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        if out:
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*_KEY, "n_removed", "n_spans", "kept_sha256"])


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in _blocks(batch, "text"):
            own = _own(data, offsets)
            names = _names(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(own)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(np.diff(offsets)),
                 pa.array([hashlib.sha256(t).hexdigest() for t in own])],
                ["doc_id", *_KEY, "n_bytes", "whole_sha256"])


def repeated(docs: DataFrame) -> DataFrame:
    """(t1, t2, windows, places): stretches of repeated windows by text, each place in four bytes."""
    found = judged(docs)
    single = twins(docs, found).select(*_KEY, "windows", F.unhex(F.lpad(F.hex("start"), 8, "0")).alias("places"))
    return found.where("repeated").select(*_KEY, "windows", "places").unionByName(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document how much of it also stands elsewhere, and a digest of the rest."""
    lists = repeated(docs).groupBy(*_KEY).agg(F.collect_list(F.struct("windows", "places")).alias("listed"))
    lists = cut_lineage(lists, "repeats")
    left = texts(docs).join(lists, _KEY).mapInArrow(_remainders, "t1 bigint, t2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    left = left.dropDuplicates(_KEY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_whole_rows, f"doc_id {kind}, t1 bigint, t2 bigint, n_bytes bigint, whole_sha256 string")
    return rows.join(left, _KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
