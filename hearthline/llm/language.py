"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are lower-cased; runs of characters other than letters count as one space.
N-grams of one to three characters are hashed into DIMENSIONS features, weighted by
(1 + log count) times inverse document frequency, and scaled to length one. Document
frequencies are counted over all training texts. The weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample; a part
of it that the weights have not seen sets the temperature of the scores.

Null texts and texts without a letter: ``und`` with score 0. Without any training
text every row is ``und``. Repeated rows get equal answers. A null id is in no fold,
so it is training text. Further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens

UNKNOWN = "und"
DIMENSIONS = 1 << 14
#: Training texts that the weights and the temperature are fitted on, about equally many per language.
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.02, 0.02
#: A stage drops texts whose best language scores less.
MIN_SCORE = 0.3


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, feature of each n-gram, offsets, whether a text has letters) per block."""
    letters = _letters()
    for first, last, data, offsets in tokens.blocks(pc.utf8_lower(column)):
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        offsets = heads[offsets]
        is_letter = letters[chars] if chars.size else np.zeros(0, bool)
        some = np.append(0, np.cumsum(is_letter))
        has = some[offsets[1:]] > some[offsets[:-1]]
        # Runs of other characters become one space; the first character of a text always stays.
        begin = np.zeros(chars.size, bool)
        begin[offsets[:-1][offsets[:-1] < chars.size]] = True
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep |= begin
        text = np.repeat(np.arange(last - first), np.diff(offsets))[keep]
        chars = np.where(is_letter, chars, np.uint32(32))[keep].astype(np.uint64)
        sizes = np.bincount(text, minlength=last - first)
        ends = np.cumsum(sizes)
        one = tokens.mix(chars)
        two = tokens.mix(one[:-1] + (chars[1:] << np.uint64(21)))
        three = tokens.mix(two[:-1] + (chars[2:] << np.uint64(42))) if two.size else two
        mask = np.uint64(DIMENSIONS - 1)
        parts = np.zeros((3, chars.size), np.int32)
        parts[0] = one & mask
        parts[1, :-1] = two & mask
        if chars.size > 1:
            parts[2, :-2] = three & mask
        # N-grams that would run into the next text repeat the single character.
        for n in (1, 2):
            for back in range(1, n + 1):
                tail = ends[sizes >= back] - back
                parts[n, tail] = parts[0, tail]
        yield first, last, parts, np.append(0, ends), has


def _vectors(parts: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each text and how often each occurs."""
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        counts = np.bincount(parts[:, a:b].ravel(), minlength=DIMENSIONS)
        at = np.flatnonzero(counts)
        yield at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[at]
        return values / max(np.linalg.norm(values), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.unit(at, counts) @ self.weights[at] + self.bias


def _softmax(scores: np.ndarray) -> np.ndarray:
    chances = np.exp(scores - scores.max(-1, keepdims=True))
    return chances / chances.sum(-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for _, _, parts, offsets, _ in _grams(batch.column("text")):
            for at, _ in _vectors(parts, offsets):
                total[at] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "texts"])


def fit(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Follow the regularised leader over ``rows``; every fifth row sets the temperature instead."""
    n_languages = len(model.languages)
    sums = np.zeros((DIMENSIONS + 1, n_languages))
    squares = np.zeros_like(sums)
    told = [(np.append(at, DIMENSIONS), np.append(model.unit(at, counts), 1.0), y) for at, counts, y in rows]
    held = told[::5] if len(told) >= 10 else told
    learned = [x for i, x in enumerate(told) if i % 5] if len(told) >= 10 else told

    def weights(at):
        z, n = sums[at], squares[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + RIDGE
        return np.where(np.abs(z) > LASSO, -(z - np.sign(z) * LASSO) / rate, 0.0)

    chance = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in chance.permutation(len(learned)):
            at, values, y = learned[i]
            now = weights(at)
            error = _softmax(values @ now)
            error[y] -= 1
            slope = values[:, None] * error
            step = (np.sqrt(squares[at] + slope**2) - np.sqrt(squares[at])) / ALPHA
            sums[at] += slope - step * now
            squares[at] += slope**2
    whole = weights(np.arange(DIMENSIONS + 1))
    logits = np.array([values @ whole[at] for at, values, _ in held])
    truth = np.array([y for _, _, y in held])
    steps = np.geomspace(0.02, 10, 120)
    losses = [-np.log(_softmax(logits / t)[np.arange(truth.size), truth] + 1e-12).mean() for t in steps]
    return Model(model.languages, model.idf, whole[:-1], whole[-1], float(steps[int(np.argmin(losses))]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang): frequencies from all rows, weights from ``sample``."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    per_language = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    if not per_language:
        return None
    languages = sorted(per_language)
    rows = known.select("text").mapInArrow(_frequencies, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).toArrow()
    texts = np.zeros(DIMENSIONS)
    texts[rows.column("feature").to_numpy()] = rows.column("texts").to_numpy()
    idf = np.log((1 + sum(per_language.values())) / (1 + texts)) + 1
    blank = Model(languages, idf, np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages)), 1.0)

    share = sample / len(languages)
    # Every row has a place in [0, 1) by its hash; the lowest are the sample.
    place = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).alias("place")
    shares = F.create_map(*(F.lit(x) for k, n in per_language.items() for x in (k, min(1.0, 1.05 * share / n))))
    picked = (
        known.select("text", "lang", place).where(F.col("place") < shares[F.col("lang")])
        .orderBy(F.col("place") / shares[F.col("lang")], "text").limit(sample)
    )
    number = {language: i for i, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = []
        for batch in batches:
            of = batch.column("lang").to_pylist()
            for first, _, parts, offsets, has in _grams(batch.column("text")):
                told += [(at, counts, number[of[first + i]]) for i, (at, counts) in enumerate(_vectors(parts, offsets)) if has[i]]
        if told:
            model = fit(blank, told)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights.ravel().tolist()]), pa.array([model.bias.tolist()]), pa.array([model.temperature])],
                names=["weights", "bias", "temperature"],
            )

    fitted = picked.mapInArrow(run, "weights array<double>, bias array<double>, temperature double").toArrow()
    if not fitted.num_rows:
        return None
    weights = fitted.column("weights").combine_chunks().flatten().to_numpy().reshape(DIMENSIONS, len(languages))
    return Model(languages, idf, weights, fitted.column("bias").combine_chunks().flatten().to_numpy(), fitted.column("temperature")[0].as_py())


def predict(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' columns named in ``extra`` with lang_pred and score; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, last, parts, offsets, has in _grams(batch.column("text")):
                names, scores = [UNKNOWN] * (last - first), np.zeros(last - first)
                if model is not None:
                    for i, (at, counts) in enumerate(_vectors(parts, offsets)):
                        if has[i]:
                            chances = _softmax(model.logits(at, counts) / model.temperature)
                            best = int(chances.argmax())
                            names[i], scores[i] = model.languages[best], chances[best]
                own = batch.slice(first, last - first)
                kept = [c for c in batch.schema.names if c in extra]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"]
                )

    kept = [f"`{name}` {kind}" for name, kind in docs.dtypes if name in extra]
    return docs.mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double"]))


def in_fold(folds: int):
    """True for the held-out rows."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text, lang)."""
    model = train(docs.where(~in_fold(folds)))
    rows = docs.select("doc_id", in_fold(folds).alias("held_out"), "text")
    return predict(rows, model, ("doc_id", "held_out"))
