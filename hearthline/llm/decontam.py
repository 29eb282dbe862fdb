"""Benchmark passages inside texts, found by greedy string tiling.

Words are runs of ASCII letters and digits and of all other non-ASCII characters,
lower-cased. Texts and benchmark items
are joined on seeds, windows of SEED words. Of a text only the stretches made of
seeds matter, because every match of SEED words or more lies inside one. Per text
and item, the longest non-overlapping common stretches are marked again and again,
found by Karp-Rabin hashes, and the share of the item that ends up covered decides;
so the order of the passages does not matter.

Null, empty and short texts match nothing. Items of fewer than SEED words are no
evidence and never match. Repeated rows are taken as one; of rows that share id and text or item id, the one that covers most counts.
Rows are told apart by id and text. Further columns are ignored.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens
from hearthline.session import cut_lineage

SEED = 5
#: Share of an item's words that a text must cover.
COVERAGE = 0.5
#: Bits of the filter that seeds of texts pass before they are joined: 2 MB, whatever the size of the benchmark.
FILTER_BITS = 24

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Odd base of the window hashes, and its inverse modulo 2 ** 64.
_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _scan(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, first word per text, seeds, first word per seed)."""
    for first, last, data, offsets in tokens.blocks(pc.utf8_lower(column)):
        starts, ends = tokens.spans(_LETTER[data], offsets)
        hashes = tokens.span_hashes(data, starts, ends)
        firsts = np.searchsorted(starts, offsets)
        yield first, last, hashes, firsts, *tokens.windows(hashes, firsts, SEED)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, firsts, seeds, at in _scan(batch.column("text")):
            border = np.searchsorted(at, firsts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(tokens.signed(hashes))),
                    pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(tokens.signed(seeds))),
                ],
                names=["item_id", "words", "seeds"],
            )


def _stretches(bitmap):
    """Per text with seeds in the filter: its stretches, parted by words that match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            for first, _, hashes, firsts, seeds, at in _scan(batch.column("text")):
                hit = np.flatnonzero(passes[seeds & mask])
                if not hit.size:
                    continue
                begin = at[hit]
                text = np.searchsorted(firsts, begin, "right") - 1
                rows, border = np.unique(text, return_index=True)
                border = np.append(border, hit.size)
                words = [_joined(hashes, begin[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
                sizes = np.cumsum([0, *map(len, words)])
                take = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("row_key").take(take),
                        pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(tokens.signed(np.concatenate(words)))),
                        pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(tokens.signed(seeds[hit]))),
                    ],
                    names=["doc_id", "row_key", "words", "seeds"],
                )

    return run


def _joined(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words of the stretches that start at the given seeds, a 0 between stretches."""
    cut = np.flatnonzero(np.diff(begin) >= SEED)
    parts = []
    for a, b in zip(np.append(0, cut + 1), np.append(cut, begin.size - 1), strict=True):
        parts += [hashes[begin[a] : begin[b] + SEED], np.zeros(1, np.uint64)]
    return np.concatenate(parts[:-1])


class _Line:
    """Words with Karp-Rabin hashes of all windows of any width, from prefix sums."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.sums = np.zeros(words.size + 1, np.uint64)
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(words.size, _BACK, np.uint64)]))
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(words.size, _BASE, np.uint64)]))
        np.cumsum(words * powers[:-1], out=self.sums[1:])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a marked word, and their hashes."""
        count = self.words.size - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(marked[width:] == marked[:count])
        return starts, (self.sums[starts + width] - self.sums[starts]) * self.back[starts]


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in the text, start in the item, length) of the greedy tiling; a word 0 of the text matches nothing.

    Each round finds the greatest width with a common unmarked window, by halving, and
    marks its matches by start in the text, then in the item. No match of this width is
    left then, so widths fall, and what a longer match cut is found at its new width.
    """
    text, item = text.astype(np.uint64), item.astype(np.uint64)
    of_text, of_item = _Line(text, text != 0), _Line(item, np.ones(item.size, bool))
    marked: list[tuple[int, int, int]] = []
    most = min(text.size, item.size)
    while most >= least:
        low, high = least - 1, most
        while low < high:
            width = (low + high + 1) // 2
            if np.isin(of_text.windows(width)[1], of_item.windows(width)[1]).any():
                low = width
            else:
                high = width - 1
        if low < least:
            break
        marked += _marked(of_text, of_item, low)
        most = low - 1
    return marked


def _marked(text: _Line, item: _Line, width: int) -> list[tuple[int, int, int]]:
    """Marks the matches of ``width`` that do not overlap, the first in the text with the first in the item."""
    starts, hashes = text.windows(width)
    of_item: dict[int, collections.deque[int]] = {}
    for j, code in zip(*(x.tolist() for x in item.windows(width)), strict=True):
        of_item.setdefault(code, collections.deque()).append(j)
    common = np.isin(hashes, np.fromiter(of_item, np.uint64, len(of_item)))
    done, end = [], 0
    for i, code in zip(starts[common].tolist(), hashes[common].tolist(), strict=True):
        if i < end:
            continue
        places = of_item[code]
        # Tiles of this round are as wide as the window, so one that overlaps it holds an end of it.
        while places and not (item.free[places[0]] and item.free[places[0] + width - 1]):
            places.popleft()
        if places and np.array_equal(text.words[i : i + width], item.words[places[0] : places[0] + width]):
            j, end = places.popleft(), i + width
            text.free[i:end] = item.free[j : j + width] = False
            done.append((i, j, width))
    return done


def _tilings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, longest, covered = [], [], []
        words, items = batch.column("words"), batch.column("item_words")
        for k in range(batch.num_rows):
            marks = tiles(words[k].values.to_numpy().view(np.uint64), items[k].values.to_numpy().view(np.uint64))
            sizes = [size for _, _, size in marks]
            counts.append(len(sizes))
            longest.append(max(sizes, default=0))
            covered.append(sum(sizes))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("row_key"), batch.column("item_id"), pa.array(counts, pa.int64()),
                pa.array(longest, pa.int64()), pa.array(covered, pa.int64()), batch.column("n_words"),
            ],
            names=["doc_id", "row_key", "item_id", "n_tiles", "longest", "covered", "item_words"],
        )


def row_key() -> Column:
    """Names a row by its id and text, so rows that share an id are told apart."""
    return F.xxhash64("doc_id", "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row_key, item_id, n_tiles, longest, covered, item_words, coverage of every pair found."""
    spark = docs.sparkSession
    index = cut_lineage(
        benchmark.select("item_id", "text").where("text is not null")
        .mapInArrow(_items, "item_id long, words array<long>, seeds array<long>").where("size(seeds) > 0"),
        "items",
    )
    seeds = index.select("item_id", F.explode("seeds").alias("seed")).distinct()
    place = F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1)
    rows = (
        seeds.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    )
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for row in rows:
        at = (row.bucket - 1) * len(row.bits)
        bitmap[at : at + len(row.bits)] = row.bits
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    stretches = cut_lineage(
        texts.mapInArrow(_stretches(spark.sparkContext.broadcast(bytes(bitmap))), "doc_id long, row_key long, words array<long>, seeds array<long>"),
        "stretches",
    )
    pairs = (
        stretches.select("row_key", F.explode(F.array_distinct("seeds")).alias("seed"))
        .join(seeds, "seed").select("row_key", "item_id").distinct()
    )
    return (
        pairs.join(stretches.drop("seeds"), "row_key")
        .join(index.select("item_id", F.col("words").alias("item_words"), F.size("words").cast("long").alias("n_words")), "item_id")
        .select("doc_id", "row_key", "item_id", "words", "item_words", "n_words")
        .mapInArrow(_tilings, "doc_id long, row_key long, item_id long, n_tiles long, longest long, covered long, item_words long")
        .withColumn("coverage", F.col("covered") / F.col("item_words"))
        .where(F.col("coverage") >= coverage)
        .groupBy("row_key", "item_id")
        .agg(F.max_by(F.struct("doc_id", "n_tiles", "longest", "covered", "item_words", "coverage"), "coverage").alias("best"))
        .select("row_key", "item_id", "best.*")
    )
