"""Quality rules and line labelling with a linear-chain conditional random field.

Each line with a word is content or boilerplate. The field's weights are learned
from documents with a quality label, whose lines take the document's label; Viterbi
decoding labels the lines of every text, and the share of words in content lines
decides. Plain counts per text come along.

Null or empty text: all counts 0, base_failed. Repeated rows give repeated results.
Without labels of both kinds nothing is learned, and every line is content.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Share of words in content lines that a text needs.
CONTENT_SHARE = 0.5
#: Labelled texts per label that the field is fitted on.
SAMPLE_PER_LABEL = 1500
STEPS = 80
CONTENT, BOILERPLATE = 0, 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False
FEATURES = 11


@dataclass
class Scan:
    """Counts per text, and features, words and text of each line that has a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    firsts: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key came before, and whether it comes twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(keys.size + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    earlier, often = np.zeros(keys.size, bool), np.zeros(keys.size, bool)
    earlier[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return earlier, often


def scan(data: np.ndarray, offsets: np.ndarray) -> Scan:
    rows = offsets.size - 1
    inside = ~tokens.SPACE[data]
    starts, ends = tokens.spans(inside, offsets)
    firsts = np.searchsorted(starts, offsets)
    n_words = np.diff(firsts)
    hashes = tokens.span_hashes(data, starts, ends)
    text_of_word = np.repeat(np.arange(rows), n_words)

    joined, at = tokens.windows(hashes, firsts, 3)
    salt = tokens.mix(text_of_word.astype(np.uint64) + np.uint64(1))
    repeated = np.zeros(starts.size + 3, bool)
    if joined.size:
        _, often = _again(tokens.mix(joined) ^ salt[at])
        for k in range(3):
            repeated[at[often] + k] = True
    repeated = repeated[: starts.size]

    line_start, line_end = tokens.spans(data != 10, offsets)
    word_in = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    real = word_in[1] > word_in[0]
    line_start, line_end = line_start[real], line_end[real]
    low, high = word_in[0][real], word_in[1][real]
    text_of_line = np.searchsorted(offsets, line_start, "right") - 1
    line_salt = tokens.mix(text_of_line.astype(np.uint64) + np.uint64(1))
    earlier, often = _again(tokens.span_hashes(data, line_start, line_end) ^ line_salt)

    symbol, chars = _SYMBOL[data], _CHAR[data]
    words = (high - low).astype(np.float64)
    length = np.maximum(_sums(chars, line_start, line_end), 1).astype(np.float64)
    solid = np.maximum(_sums(chars & inside, line_start, line_end), 1).astype(np.float64)
    last = ends[np.maximum(high - 1, 0)] - 1 if high.size else high
    features = np.empty((line_start.size, FEATURES))
    features[:, 0] = 1
    features[:, 1] = np.log1p(words) / 4
    features[:, 2] = np.minimum(_sums(symbol, line_start, line_end) / words, 3)
    features[:, 3] = _sums(_DIGIT[data], line_start, line_end) / length
    features[:, 4] = _sums(_UPPER[data], line_start, line_end) / solid
    features[:, 5] = np.minimum(solid / words / 10, 3)
    features[:, 6] = _sums(repeated, low, high) / words
    features[:, 7] = often
    features[:, 8] = _STOP[data[last]] if last.size else 0
    features[:, 9] = words <= 3
    features[:, 10] = _sums(data == 33, line_start, line_end) / words
    return Scan(
        n_words,
        _sums(chars & inside, offsets[:-1], offsets[1:]),
        _sums(symbol, offsets[:-1], offsets[1:]),
        np.bincount(text_of_line, earlier, rows).astype(np.int64),
        _sums(repeated, firsts[:-1], firsts[1:]),
        features,
        (high - low).astype(np.int64),
        np.searchsorted(text_of_line, np.arange(rows + 1)),
    )


def _by_length(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from most to fewest lines, and how many have more than t lines."""
    counts = np.diff(firsts)
    order = np.argsort(-counts, kind="stable")
    return order, np.searchsorted(-counts[order], -np.arange(1, (counts.max() if counts.size else 0) + 1), "right")


def viterbi(emit: np.ndarray, firsts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each line, all texts at once, line by line."""
    order, active = _by_length(firsts)
    best, back = emit.copy(), np.zeros(emit.shape, np.int8)
    for t in range(1, active.size):
        at = firsts[order[: active[t]]] + t
        scores = best[at - 1][:, :, None] + move
        back[at] = scores.argmax(1)
        best[at] = emit[at] + scores.max(1)
    labels = np.zeros(emit.shape[0], np.int8)
    counts = np.diff(firsts)
    for t in range(active.size - 1, -1, -1):
        own = order[: active[t]]
        at = firsts[own] + t
        ending = counts[own] == t + 1
        labels[at[ending]] = best[at[ending]].argmax(1)
        going = at[~ending]
        labels[going] = back[going + 1, labels[going + 1]]
    return labels


def _gradient(weights: np.ndarray, move: np.ndarray, features: np.ndarray, firsts: np.ndarray, gold: np.ndarray, rate: np.ndarray):
    """Weighted log-likelihood gradient by the forward and backward recursions."""
    emit = features @ weights
    order, active = _by_length(firsts)
    counts = np.diff(firsts)
    ahead, behind = emit.copy(), np.zeros(emit.shape)
    for t in range(1, active.size):
        at = firsts[order[: active[t]]] + t
        ahead[at] = emit[at] + np.logaddexp.reduce(ahead[at - 1][:, :, None] + move, axis=1)
    for t in range(active.size - 2, -1, -1):
        own = order[: active[t]]
        at = firsts[own] + t
        at = at[counts[own] > t + 1]
        behind[at] = np.logaddexp.reduce((emit[at + 1] + behind[at + 1])[:, None, :] + move, axis=2)
    whole = np.logaddexp.reduce(ahead + behind, axis=1)
    share = np.exp(ahead + behind - whole[:, None])
    wanted = np.zeros(emit.shape)
    wanted[np.arange(emit.shape[0]), gold] = 1
    of_weights = features.T @ ((wanted - share) * rate[:, None])
    later = np.ones(emit.shape[0], bool)
    later[firsts[:-1][counts > 0]] = False
    later = np.flatnonzero(later)
    of_move = np.zeros((2, 2))
    if later.size:
        both = np.exp((ahead[later - 1])[:, :, None] + move + (emit[later] + behind[later] - whole[later][:, None])[:, None, :])
        of_move -= (both * rate[later][:, None, None]).sum(0)
        np.add.at(of_move, (gold[later - 1], gold[later]), rate[later])
    return of_weights, of_move


def fit(features: np.ndarray, firsts: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam; texts count alike, whatever their length."""
    weights, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    counts = np.diff(firsts)
    rate = np.repeat(1 / np.maximum(counts, 1), counts) / max((counts > 0).sum(), 1)
    flat = np.zeros(FEATURES * 2 + 4)
    first, second = np.zeros(flat.size), np.zeros(flat.size)
    for step in range(1, STEPS + 1):
        grads = np.concatenate([g.ravel() for g in _gradient(weights, move, features, firsts, gold, rate)]) - 1e-4 * flat
        first, second = 0.9 * first + 0.1 * grads, 0.99 * second + 0.01 * grads**2
        flat += 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, move = flat[: FEATURES * 2].reshape(FEATURES, 2), flat[FEATURES * 2 :].reshape(2, 2)
    return weights, move


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts, gold = [], [], []
    for batch in batches:
        quality = batch.column("quality").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in tokens.blocks(batch.column("text")):
            found = scan(data, offsets)
            features.append(found.features)
            counts.append(np.diff(found.firsts))
            gold.append(np.repeat(np.where(quality[first:last] > 0, CONTENT, BOILERPLATE), counts[-1]))
    if not features:
        return
    labels = np.concatenate(gold)
    if np.unique(labels).size < 2:
        return
    weights, move = fit(np.concatenate(features), np.append(0, np.cumsum(np.concatenate(counts))), labels)
    yield pa.RecordBatch.from_arrays([pa.array([weights.ravel().tolist()]), pa.array([move.ravel().tolist()])], names=["weights", "move"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, fitted on at most ``per_label`` labelled texts of either label."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    picked = [
        known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for side in (F.col("quality") > 0, F.col("quality") <= 0)
    ]
    sample = F.broadcast(picked[0].union(picked[1]).dropDuplicates(["doc_id"]))  # 2 * per_label ids at most
    rows = (
        docs.select("doc_id", "text").join(sample, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label)
        .mapInArrow(_fit_rows, "weights array<double>, move array<double>").collect()
    )
    if not rows:
        return np.zeros((FEATURES, 2)), np.zeros((2, 2))
    return np.array(rows[0].weights).reshape(FEATURES, 2), np.array(rows[0].move).reshape(2, 2)


def rate_lines(docs: DataFrame, weights: np.ndarray, move: np.ndarray) -> DataFrame:
    """Counts, verdict and content share of every text of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tokens.blocks(batch.column("text")):
                found = scan(data, offsets)
                labels = viterbi(found.features @ weights, found.firsts, move)
                content = _sums(np.where(labels == CONTENT, found.line_words, 0), found.firsts[:-1], found.firsts[1:])
                share = content / np.maximum(found.n_words, 1)
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > REPEAT_PERCENT * found.n_words)
                columns = {
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "n_words": found.n_words, "word_chars": found.word_chars, "n_symbols": found.n_symbols,
                    "n_dup_lines": found.n_dup_lines, "n_repeat_words": found.n_repeat_words,
                    "base_failed": failed, "kept": ~failed & (share >= CONTENT_SHARE), "content_share": share,
                }
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double",
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rate_lines(docs, *train(docs, labels))
