"""Secret scans with grammar inference.

Fixed patterns find assignments, access keys and long hexadecimal runs. Their
values are the labelled credentials: per kind a prefix tree of a bounded sample is
built and its statistically compatible states are merged (Hoeffding bound) into a
probabilistic automaton. Every other run of at least six credential characters in
every text is then scored: under the best automaton its mean log-likelihood per
character must reach what most labelled values reach, and exceed that of an automaton
of ordinary runs. That one is inferred from ``SAMPLE`` distinct runs outside the fixed
patterns, those with the lowest hashes of all texts, each as often as it occurs: a
credential among them occurs seldom and weighs little.

Positions count code points. Null text is empty. Without labelled values only the
fixed patterns find anything. Repeated rows give repeated results; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens

KINDS = ("assign", "access", "hex")
LEARNED = "format"
PLAIN = "plain"
#: Distinct values per kind, and ordinary runs, that the automata are inferred from.
SAMPLE = 1000
#: Significance of the test that keeps two states apart.
APART = 0.05
#: Shortest candidate, as in the fixed patterns, and the share of labelled values that may score below the threshold.
LEAST_CANDIDATE = 6
MISSED = 0.02
#: Log-likelihood per character by which a candidate must beat ordinary words.
MARGIN = 0.3

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True

def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, start, kind, end, start of the value) in bytes of the block."""
    found = []
    raw = data.tobytes()
    busy = np.append(0, np.cumsum((data == 61) | (data == 58)))
    for i in np.flatnonzero(busy[offsets[1:]] > busy[offsets[:-1]]).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        for m in _ASSIGN.finditer(raw[a:b].lower()):
            if m.end(2) - m.start(2) >= 6:
                found.append((i, a + m.start(), 0, a + m.end(), a + m.start(2)))
    if b"AKIA" in raw:
        for i in range(offsets.size - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            at = raw.find(b"AKIA", a, b)
            for m in _ACCESS.finditer(raw, at, b) if at >= 0 else ():
                if m.end() - m.start() >= 20:
                    found.append((i, m.start(), 1, m.end(), m.start()))
    starts, ends = tokens.spans(_HEX[data], offsets)
    for k in np.flatnonzero(ends - starts >= 24).tolist():
        text = int(np.searchsorted(offsets, starts[k], "right")) - 1
        found.append((text, int(starts[k]), 2, int(ends[k]), int(starts[k])))
    return sorted(found)


def candidates(data: np.ndarray, offsets: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of credential characters, with or without letters and digits, that touch no span found so far."""
    starts, ends = tokens.spans(_RUN[data], offsets)
    good = ends - starts >= LEAST_CANDIDATE
    starts, ends = starts[good], ends[good]
    if found and starts.size:
        taken = np.zeros(data.size + 1, np.int64)
        for _, a, _, b, _ in found:
            taken[a] += 1
            taken[b] -= 1
        covered = np.append(0, np.cumsum(np.cumsum(taken)[:-1] > 0))
        free = covered[ends] == covered[starts]
        starts, ends = starts[free], ends[free]
    return starts, ends


@dataclass
class Automaton:
    """next state and log-likelihood by state and byte; the last column ends."""

    following: np.ndarray
    gain: np.ndarray

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log-likelihood per character, the end included."""
        state, total = np.zeros(starts.size, np.int64), np.zeros(starts.size)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        for t in range(int(size.max()) if size.size else 0):
            own = order[: np.searchsorted(-size[order], -t, "left")]
            char = data[starts[own] + t]
            total[own] += self.gain[state[own], char]
            state[own] = self.following[state[own], char]
        return (total + self.gain[state, 256]) / (size + 1)


def infer(values: list[bytes], apart: float = APART, times: dict[bytes, int] | None = None) -> Automaton:
    """Merge compatible states of the values' prefix tree, in order of discovery.

    With ``times``, values weigh as often as they occur, their mean weight being 1.
    """
    mean = sum(times.values()) / len(times) if times else 1
    nexts: list[dict[int, int]] = [{}]
    visits, ends = [0], [0]
    for value in sorted(values):
        state, weight = 0, times[value] / mean if times else 1
        visits[0] += weight
        for char in value:
            if char not in nexts[state]:
                nexts[state][char] = len(nexts)
                nexts.append({})
                visits.append(0)
                ends.append(0)
            state = nexts[state][char]
            visits[state] += weight
        ends[state] += weight
    flows = [{char: visits[to] for char, to in own.items()} for own in nexts]
    bound = math.sqrt(0.5 * math.log(2 / apart))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = visits[a], visits[b]
            if not n or not m:
                continue
            if differ(ends[a], n, ends[b], m):
                return False
            for char in flows[a].keys() | flows[b].keys():
                if differ(flows[a].get(char, 0), n, flows[b].get(char, 0), m):
                    return False
                if char in nexts[a] and char in nexts[b]:
                    stack.append((nexts[a][char], nexts[b][char]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            for char, to in nexts[b].items():
                flows[a][char] = flows[a].get(char, 0) + flows[b][char]
                if char in nexts[a]:
                    stack.append((nexts[a][char], to))
                else:
                    nexts[a][char] = to

    red = [0]
    while True:
        red_set = set(red)
        blue = [(a, char, to) for a in red for char, to in nexts[a].items() if to not in red_set]
        if not blue:
            break
        a, char, to = max(blue, key=lambda x: (visits[x[2]], -x[0], -x[1]))
        for r in red:
            if compatible(r, to):
                nexts[a][char] = r
                fold(r, to)
                break
        else:
            red.append(to)
    number = {state: i for i, state in enumerate(red)}
    alphabet = sorted({c for own in flows for c in own} or {0})
    following = np.zeros((len(red), 256), np.int64)
    gain = np.full((len(red), 257), math.log(1e-6))
    for state, i in number.items():
        whole = visits[state] + 0.1 * (len(alphabet) + 1)
        gain[i, alphabet] = math.log(0.1 / whole)
        gain[i, 256] = math.log((ends[state] + 0.1) / whole)
        for char, to in nexts[state].items():
            following[i, char] = number[to]
            gain[i, char] = math.log((flows[state][char] + 0.1) / whole)
    return Automaton(following, gain)


@dataclass
class Grammar:
    formats: dict[str, tuple[Automaton, float]]
    plain: Automaton | None

    def accepts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        good = np.zeros(starts.size, bool)
        if not starts.size:
            return good
        ordinary = self.plain.score(data, starts, ends) if self.plain else np.full(starts.size, -np.inf)
        for automaton, least in self.formats.values():
            score = automaton.score(data, starts, ends)
            good |= (score >= least) & (score >= ordinary + MARGIN)
        return good


def _laid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in values])
    return np.frombuffer(b"".join(values), np.uint8), ends - [len(x) for x in values], ends


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the fixed patterns, and of all other runs those with the lowest hashes."""
    for batch in batches:
        for _, _, data, offsets in tokens.blocks(batch.column("text")):
            kinds, values, hashes, times = [], [], [], []
            found = base_spans(data, offsets)
            for _, _, kind, end, value in found:
                kinds.append(KINDS[kind])
                values.append(data[value:end].tobytes())
                hashes.append(0)
                times.append(1)
            starts, ends = candidates(data, offsets, found)
            # The lowest hashes of all blocks are among the lowest of each.
            least, at, often = np.unique(tokens.span_hashes(data, starts, ends), return_index=True, return_counts=True)
            at = at[:SAMPLE]
            kinds += [PLAIN] * at.size
            values += [data[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)]
            hashes += tokens.signed(least[:SAMPLE] ^ np.uint64(1 << 63)).tolist()
            times += often[:SAMPLE].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary()), pa.array(hashes, pa.int64()), pa.array(times, pa.int64())], names=["kind", "value", "place", "times"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Automata of at most ``sample`` distinct labelled values per kind, inferred on the driver."""
    known = docs.select("text").mapInArrow(_labelled, "kind string, value binary, place long, times long").groupBy("kind", "value", "place").agg(F.sum("times").alias("times"))
    picked: dict[str, list[bytes]] = {}
    often: dict[bytes, int] = {}
    parts = [
        known.where(F.col("kind") == kind).orderBy("place", F.xxhash64("value"), "value").limit(sample).select("kind", "value", "times")
        for kind in (*KINDS, PLAIN)
    ]
    for row in parts[0].union(parts[1]).union(parts[2]).union(parts[3]).collect():
        picked.setdefault(row.kind, []).append(bytes(row.value))
        if row.kind == PLAIN:
            often[bytes(row.value)] = row.times
    formats = {}
    for kind in KINDS:
        values = sorted(picked.get(kind, []))
        if len(values) >= 2:
            automaton = infer(values)
            formats[kind] = (automaton, float(np.quantile(automaton.score(*_laid(values)), MISSED)))
    return Grammar(formats, infer(picked[PLAIN], times=often) if PLAIN in picked else None)


def _in_chars(data: np.ndarray, start: int, places: list[int]) -> list[int]:
    """Code points from ``start`` to each place."""
    stop = max(places)
    heads = np.append(0, np.cumsum((data[start:stop] & 0xC0) != 0x80))
    return heads[np.array(places) - start].tolist()


def find(docs: DataFrame, grammar: Grammar, extra: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """Columns in ``extra``, counts and spans per row of ``docs`` (text); ``redact`` adds the text without them."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    order = (*KINDS, LEARNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for first, last, data, offsets in tokens.blocks(batch.column("text")):
                rows = last - first
                found = base_spans(data, offsets)
                starts, ends = candidates(data, offsets, found)
                good = grammar.accepts(data, starts, ends)
                starts, ends = starts[good], ends[good]
                text = np.searchsorted(offsets, starts, "right") - 1
                found += zip(text.tolist(), starts.tolist(), [len(KINDS)] * starts.size, ends.tolist(), starts.tolist(), strict=True)
                counts = np.zeros((len(order), rows), np.int64)
                digests, listed = [empty] * rows, [""] * rows
                own: dict[int, list[tuple[int, int, int]]] = {}
                for i, a, kind, b, _ in sorted(found):
                    counts[kind, i] += 1
                    own.setdefault(i, []).append((a, kind, b))
                clean = {}
                for i, spans in own.items():
                    flat = _in_chars(data, int(offsets[i]), [x for a, _, b in spans for x in (a, b)])
                    names = [(k, f"{order[k]}:{a}:{b}") for (_, k, _), a, b in zip(spans, flat[::2], flat[1::2], strict=True)]
                    digests[i] = hashlib.sha256(",".join(x for k, x in names if k < len(KINDS)).encode()).hexdigest()
                    listed[i] = ",".join(x for _, x in names)
                    if redact:
                        clean[i] = _redacted(data[offsets[i] : offsets[i + 1]].tobytes(), [(a - int(offsets[i]), k, b - int(offsets[i])) for a, k, b in spans])
                part = batch.slice(first, rows)
                columns = {c: part.column(c) for c in batch.schema.names if c in extra}
                columns |= {f"n_{kind}": pa.array(counts[k]) for k, kind in enumerate(order)}
                columns |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(listed, pa.string())}
                if redact:
                    texts = part.column("text")
                    if clean:
                        texts = texts.to_pylist()
                        for i, x in clean.items():
                            texts[i] = x
                        texts = pa.array(texts, pa.string())
                    columns["redacted"] = texts.cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kept = [f"`{name}` {kind}" for name, kind in docs.dtypes if name in extra]
    fields = [*kept, *(f"n_{kind} long" for kind in order), "base_sha256 string", "spans string", *["redacted string"] * redact]
    return docs.mapInArrow(run, ", ".join(fields))


def _redacted(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by the kind of the first of those that overlap."""
    out, done, order = [], 0, (*KINDS, LEARNED)
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{order[kind]}]".encode()]
        done = max(done, b)
    return b"".join([*out, text[done:]]).decode()


def scan(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"), train(docs), ("doc_id",))
