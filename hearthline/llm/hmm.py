"""A hidden Markov language model over words, trained by Baum-Welch.

Words are ASCII lower-cased; every text ends with one end token. Counts of all words
of all training texts are one distributed table. Hidden states emit symbols: the
HEAD most frequent words, the end, and classes of the other words by ending and
length; inside its class a word has its share of the class's count. The expected
counts of each Baum-Welch round are summed across partitions over every training
text, and the scaled forward recursion gives the exact likelihood of each text. Long
texts run in pieces whose state-to-state matrices are computed side by side and then
chained, which is the same recursion.

Null and empty text: only the end token. A null id is in no fold, so it is training
text. Repeated rows count and score each. Further columns are ignored. An empty
training set leaves every count 0 and uniform emissions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens
from hearthline.session import cut_lineage

STATES = 4
ROUNDS = 3
#: Words with emissions of their own.
HEAD = 4096
#: Words whose counts every task gets; counts of all others are joined.
LOOKUP = 1 << 17
CLASSES = 128
PIECE = 64
PRIOR = 0.1
_END = HEAD + CLASSES
_SYMBOLS = _END + 1
#: Words that a task counts before it hands partial counts on.
_HELD = 1 << 19


def _words(column: pa.Array, limit: int = tokens.BLOCK):
    """(first row, last row + 1, word hashes, word classes, first word per text)."""
    for first, last, data, offsets in tokens.blocks(column, limit):
        data = tokens.LOWER[data]
        starts, ends, firsts = tokens.words(data, offsets)
        size = np.minimum(ends - starts, 15).astype(np.uint64) // np.uint64(4)
        ending = data[np.maximum(ends - 1, 0)].astype(np.uint64) << np.uint64(8)
        ending |= data[np.maximum(ends - 2, starts)].astype(np.uint64)
        kind = (tokens.mix(ending << np.uint64(4) | size) % np.uint64(CLASSES)).astype(np.int32)
        yield first, last, tokens.span_hashes(data, starts, ends), kind, firsts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        hashes, kinds, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        names, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens.signed(names)), pa.array(kinds[at]), pa.array(np.bincount(of, counts).astype(np.int64))],
            names=["word", "kind", "n"],
        )

    for batch in batches:
        for _, _, hashes, kinds, _ in _words(batch.column("text")):
            names, at, counts = np.unique(hashes, return_index=True, return_counts=True)
            held.append((names, kinds[at], counts))
            size += names.size
            if size > _HELD:
                done = merged()
                if done.num_rows > _HELD // 2:
                    yield done
                    held, size = [], 0
                else:
                    held = [(done.column(0).to_numpy().view(np.uint64), done.column(1).to_numpy(), done.column(2).to_numpy())]
                    size = done.num_rows
    if held:
        yield merged()


@dataclass
class Vocabulary:
    """Frequent words with their counts, and totals per class of the words without emissions."""

    words: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    heads: np.ndarray
    kind_total: np.ndarray
    kind_size: np.ndarray
    ends: int
    total: int
    distinct: int

    def symbol_counts(self) -> np.ndarray:
        own = np.zeros(_SYMBOLS)
        is_head = self.heads >= 0
        own[self.heads[is_head]] = self.counts[is_head]
        own[HEAD:_END] = self.kind_total
        own[_END] = self.ends
        return own


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The bounded part of the counts: at most LOOKUP words, the most frequent ones."""
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, taken = math.inf, 0
    for row in steps:
        taken += row["count"]
        if taken > LOOKUP:
            break
        least = row["step"]
    frequent = counts.where(step >= (least if least < math.inf else 1 << 30)).toArrow()
    words = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, n = words[order], frequent.column("n").to_numpy()[order]
    kinds = frequent.column("kind").to_numpy()[order]
    heads = np.full(words.size, -1, np.int32)
    top = np.lexsort((words, -n))[:HEAD]
    heads[top] = np.arange(top.size)
    kind_total, kind_size = np.zeros(CLASSES), np.zeros(CLASSES)
    total = distinct = 0
    for row in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        kind_total[row.kind], kind_size[row.kind] = row.n, row.words
        total, distinct = total + row.n, distinct + row.words
    np.subtract.at(kind_total, kinds[top], n[top])
    np.subtract.at(kind_size, kinds[top], 1)
    return Vocabulary(words, n, kinds, heads, kind_total, kind_size, texts, total + texts, distinct + (texts > 0))


def _encode(shared):
    """Symbols of each text, what the frequent words add to the scores, and the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        log_count = np.log10(v.counts + PRIOR)
        log_kind = np.log10(v.kind_total + PRIOR * (v.kind_size + 1))
        for batch in batches:
            for first, last, hashes, kinds, firsts in _words(batch.column("text")):
                rows = last - first
                text = np.repeat(np.arange(rows), np.diff(firsts))
                if v.words.size:
                    at = np.minimum(np.searchsorted(v.words, hashes), v.words.size - 1)
                    known = v.words[at] == hashes
                    head = np.where(known, v.heads[at], -1)
                    gain = np.where(known, log_count[at], 0)
                else:
                    known, head, gain = np.zeros(hashes.size, bool), np.full(hashes.size, -1), np.zeros(hashes.size)
                symbol = np.where(head >= 0, head, HEAD + kinds)
                # Inside its class a word has (count + prior) / (class total + prior * (class size + 1)).
                inside = np.where(head >= 0, 0, gain - log_kind[kinds])
                stream = np.insert(symbol, firsts[1:], _END).astype(np.uint16)
                borders = (firsts + np.arange(rows + 1)) * 2
                other = np.flatnonzero(~known)
                names, at, tf = np.unique(hashes[other] ^ tokens.mix(text[other].astype(np.uint64)), return_index=True, return_counts=True)
                at = other[at]
                order = np.argsort(text[at], kind="stable")
                at, tf = at[order], tf[order]
                border = pa.array(np.searchsorted(text[at], np.arange(rows + 1)).astype(np.int32))
                own = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("rid"), own.column("doc_id"), own.column("held_out"),
                        pa.array(np.diff(firsts) + 1),
                        pa.array(np.bincount(text, known, rows).astype(np.int64) + (v.ends > 0)),
                        pa.array(np.bincount(text, gain, rows) + math.log10(v.ends + PRIOR)),
                        pa.array(np.bincount(text, inside, rows)),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), rows, [None, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(stream.tobytes())]
                        ).cast(pa.binary()),
                        pa.ListArray.from_arrays(border, pa.array(tokens.signed(hashes[at]))),
                        pa.ListArray.from_arrays(border, pa.array(tf.astype(np.int64))),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "gain", "inside", "symbols", "others", "others_tf"],
                )

    return run


_ENCODED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, gain double, inside double, "
    "symbols binary, others array<long>, others_tf array<long>"
)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def first(counts: np.ndarray) -> Model:
        """States that differ slightly, so that the rounds can part them."""
        chance = np.random.default_rng(3)
        emit = (counts + PRIOR)[:, None] * chance.uniform(0.5, 1.5, (counts.size, STATES))
        move = chance.uniform(0.5, 1.5, (STATES, STATES)) + np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Pieces:
    """Texts of symbols cut into pieces, longest first, with the order they chain in."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.per_text = -(-sizes // PIECE)
        text = np.repeat(np.arange(sizes.size), self.per_text)
        number = np.arange(text.size) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)
        length = np.minimum(PIECE, sizes[text] - number * PIECE)
        order = np.argsort(-length, kind="stable")
        self.at, self.length, self.text = (offsets[text] + number * PIECE)[order], length[order], text[order]
        self.active = np.searchsorted(-self.length, -np.arange(PIECE), "left")
        self.place = np.empty(text.size, np.int64)
        self.place[order] = np.arange(text.size)
        self.first = np.cumsum(self.per_text) - self.per_text
        self.by_count = np.argsort(-self.per_text, kind="stable")
        most = int(self.per_text.max()) if sizes.size else 0
        self.texts_at = np.searchsorted(-self.per_text[self.by_count], -np.arange(most), "left")

    def chain(self):
        """(texts, their pieces) for the first pieces, then the second ones, and so on."""
        for k, n in enumerate(self.texts_at):
            texts = self.by_count[:n]
            yield texts, self.place[self.first[texts] + k]


def _matrices(model: Model, seen: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state-to-state likelihoods of each piece, and the log of the scale."""
    whole = np.tile(np.eye(STATES), (pieces.at.size, 1, 1))
    logs = np.zeros(pieces.at.size)
    for t, n in enumerate(pieces.active):
        if not n:
            break
        part = (whole[:n].reshape(-1, STATES) @ model.move).reshape(n, STATES, STATES)
        part *= seen[pieces.at[:n] + t][:, None, :]
        scale = part.sum((1, 2))
        whole[:n] = part / scale[:, None, None]
        logs[:n] += np.log(scale)
    return whole, logs


def log_likelihood(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's symbols."""
    pieces = Pieces(symbols, offsets)
    whole, logs = _matrices(model, model.emit[symbols], pieces)
    ahead = np.tile(model.start, (offsets.size - 1, 1))
    total = np.zeros(offsets.size - 1)
    for texts, at in pieces.chain():
        ahead[texts] = (ahead[texts][:, None, :] @ whole[at])[:, 0, :]
        scale = ahead[texts].sum(1)
        ahead[texts] /= scale[:, None]
        total[texts] += logs[at] + np.log(scale)
    return total


def expected(model: Model, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions: the forward and backward recursions."""
    pieces = Pieces(symbols, offsets)
    seen = model.emit[symbols]
    whole, _ = _matrices(model, seen, pieces)
    n_texts = offsets.size - 1
    enter, leave = np.empty((pieces.at.size, STATES)), np.empty((pieces.at.size, STATES))
    ahead, behind = np.tile(model.start, (n_texts, 1)), np.ones((n_texts, STATES))
    steps = list(pieces.chain())
    for texts, at in steps:
        enter[at] = ahead[texts]
        after = (ahead[texts][:, None, :] @ whole[at])[:, 0, :]
        ahead[texts] = after / after.sum(1, keepdims=True)
    for texts, at in reversed(steps):
        leave[at] = behind[texts]
        before = (whole[at] @ behind[texts][:, :, None])[:, :, 0]
        behind[texts] = before / before.sum(1, keepdims=True)
    share = model.start * behind
    starts = (share / share.sum(1, keepdims=True)).sum(0)

    forward = np.empty((symbols.size, STATES))
    state = enter
    for t, n in enumerate(pieces.active):
        if not n:
            break
        state = (state[:n] @ model.move) * seen[pieces.at[:n] + t]
        state /= state.sum(1, keepdims=True)
        forward[pieces.at[:n] + t] = state
    moves, weight = np.zeros((STATES, STATES)), np.empty((symbols.size, STATES))
    state = leave.copy()
    for t in range(PIECE - 1, -1, -1):
        n = pieces.active[t]
        if not n:
            continue
        at = pieces.at[:n] + t
        both = forward[at] * state[:n]
        weight[at] = both / both.sum(1, keepdims=True)
        after = seen[at] * state[:n]
        before = forward[at - 1] if t else enter[:n]
        mass = ((before @ model.move) * after).sum(1, keepdims=True)
        moves += model.move * ((before / mass).T @ after)
        back = after @ model.move.T
        state[:n] = back / back.sum(1, keepdims=True)
    emits = np.stack([np.bincount(symbols, weight[:, s], _SYMBOLS) for s in range(STATES)], axis=1)
    return starts, moves, emits


def _symbol_rows(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of about ``limit`` symbols."""
    column = batch.column("symbols").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    data = np.frombuffer(data, np.uint16)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first, rows = 0, len(column)
    while first < rows:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1), rows)
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]].astype(np.int64), own - own[0]
        first = last


def baum_welch(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds of expected counts over all rows of ``encoded`` (symbols)."""
    spark = encoded.sparkSession
    model = Model.first(counts)
    base = (counts + PRIOR) / (counts + PRIOR).sum()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + STATES + _SYMBOLS, STATES))
            for batch in batches:
                for _, _, symbols, offsets in _symbol_rows(batch) if batch.num_rows else ():
                    starts, moves, emits = expected(shared.value, symbols, offsets)
                    total[0] += starts
                    total[1 : 1 + STATES] += moves
                    total[1 + STATES :] += emits
            at = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *(pa.array(total[at, s]) for s in range(STATES))], names=["at", *(f"s{s}" for s in range(STATES))]
            )

        states = [f"s{s}" for s in range(STATES)]
        summed = (
            encoded.select("symbols").mapInArrow(run, "at long, " + ", ".join(f"{s} double" for s in states))
            .groupBy("at").agg(*(F.sum(s).alias(s) for s in states)).toArrow()
        )
        if not summed.num_rows:
            break
        total = np.zeros((1 + STATES + _SYMBOLS, STATES))
        total[summed.column("at").to_numpy()] = np.stack([summed.column(s).to_numpy() for s in states], axis=1)
        start, move = total[0] + PRIOR, total[1 : 1 + STATES] + PRIOR
        emit = total[1 + STATES :] + base[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = texts.where(~F.col("held_out"))
    counts = cut_lineage(
        training.select("text").mapInArrow(_count, "word long, kind int, n long")
        .groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")),
        "counts",
    )
    v = vocabulary(counts, training.count())
    encoded = cut_lineage(
        texts.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_encode(spark.sparkContext.broadcast(v)), _ENCODED), "encoded"
    )
    model = baum_welch(encoded.where(~F.col("held_out")), v.symbol_counts())
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [log_likelihood(shared.value, s, o) for _, _, s, o in _symbol_rows(batch)] if batch.num_rows else [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "symbols"), pa.array(np.concatenate(scores) / math.log(10))],
                names=[*(c for c in batch.schema.names if c != "symbols"), "path_score"],
            )

    plain = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "gain", "inside", "symbols")
    scored = plain.mapInArrow(
        run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, gain double, inside double, path_score double"
    )
    other = encoded.select("rid", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("others_tf").alias("tf"))).alias("x")).select(
        "rid", "x.word", "x.tf"
    )
    rest = other.join(counts.select("word", "n"), "word", "left").groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + PRIOR)).alias("more_gain"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"),
    )
    floor = math.log10(v.total + PRIOR * (v.distinct + 1))
    more = F.coalesce("more_gain", F.lit(0.0))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("gain") + more - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("path_score") + F.col("inside") + more).alias("score"),
    )
