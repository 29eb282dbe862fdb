"""Periodic runs against a loop over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from hearthline.llm import word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest, hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_runs_equal_a_loop_over_periods():
    rng, some = random.Random(1), 0
    for _ in range(1500):
        letters, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 10, 23, 24, 30, 60, 120, 200])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 5 else 0):
            a, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(a + p, min(n, a + rng.randrange(1, n))):
                words[i] = words[i - p]
        want = plain_runs(words)
        some += bool(want)
        assert word_runs.find_runs(np.array(words, np.int64)) == want
    assert some > 300


def test_long_periodic_texts():
    for period in (1, 7, 6000):
        assert word_runs.find_runs(np.arange(20000) % period) == [(0, 20000, period)]


def test_rows_equal_a_plain_version(spark, sf_dir):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    periodic = " ".join(["a b c"] * 9 + ["x"] + ["a b c"] * 9)
    hard = [None, "", " \n\t", "one", periodic, "é " * 30, "a\x0bb\x0cc d " * 10]
    rows = base + [(10**6 + i, t) for i, t in enumerate(hard)] + [base[0], (None, periodic), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, period string, start int").repartition(3)
    got = [tuple(r) for r in word_runs.runs(docs).collect()]
    want = [plain_row(i, t) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10
    assert word_runs.runs(docs.limit(0)).count() == 0
