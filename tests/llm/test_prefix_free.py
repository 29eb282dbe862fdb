"""Repeated byte strings against a plain count of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import prefix_free

SCHEMA = "doc_id long, text string, seed long, phrase string, t1 string"


def plain(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(c for c, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    """Passages of various lengths in other text, edited copies, periodic text and hard rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [prose(rng.randrange(5, 300)) for _ in range(40)]
    passages = [prose(60) for _ in range(4)] + ["a" * 450, "ab" * 300, "x" * 199, "y" * 200, "z" * 201]
    for _ in range(90):
        text = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(1, 4)):
            passage, a, k = rng.choice(passages), rng.randrange(0, 60), rng.randrange(0, len(text) + 1)
            text = text[:k] + passage[a : a + rng.choice([150, 199, 200, 201, 230, 1000])] + text[k:]
        texts.append(text)
    for _ in range(20):
        edited = list(texts[rng.randrange(40)])
        for _ in range(3):
            edited[rng.randrange(len(edited))] = "Q"
        texts.append("".join(edited))
    long = " ".join(f"w{i % 977}q{i % 13}" for i in range(15000))
    return texts + [None, "", "a", "q" * 200, "q" * 199, texts[0], texts[0], texts[3], long, prose(5) + long]


@pytest.mark.parametrize("group", [prefix_free.GROUP, 3])
def test_equals_a_plain_count(spark, texts, monkeypatch, group):
    """With a group of 3 most seeds are counted window by window."""
    monkeypatch.setattr(prefix_free, "GROUP", group)
    docs = spark.createDataFrame([(i, t, 1, "p", "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = [tuple(r)[1:] for r in prefix_free.remove_repeats(docs).orderBy("doc_id").collect()]
    assert got == plain(texts)


def test_null_and_repeated_ids_and_empty_tables(spark, texts):
    some = texts[:12] + texts[-10:]
    docs = spark.createDataFrame([(None if i % 2 else 7, t, 1, "p", "x") for i, t in enumerate(some)], SCHEMA)
    got = prefix_free.remove_repeats(docs).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(plain(some))
    empty = prefix_free.remove_repeats(docs.limit(0))
    assert empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert empty.count() == 0


def test_order_of_windows_is_the_order_of_suffixes():
    """Dictionary and parse together sort the suffixes of every piece as their bytes do."""
    rng = random.Random(3)
    for letters in (b"a", b"ab", b"abcdefgh"):
        base = bytes(rng.choice(letters) for _ in range(600))
        pieces = [base[i : i + rng.randrange(200, 320)] for i in (0, 0, 50, 51, 200)] + [bytes(rng.choice(letters) for _ in range(260))]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        place, same = prefix_free.window_order(np.frombuffer(b"".join(pieces), np.uint8), offsets)
        suffix = []
        for i in place.tolist():
            k = int(np.searchsorted(offsets, i, "right")) - 1
            suffix.append(pieces[k][i - offsets[k] :])
        assert suffix == sorted(suffix)
        assert len(suffix) == sum(max(len(p) - 199, 0) for p in pieces)
        assert same.tolist() == [False] + [a[:200] == b[:200] for a, b in zip(suffix, suffix[1:], strict=False)]
