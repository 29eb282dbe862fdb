"""Isolated pairs at the threshold inside a large group that is similar but not linked."""

import numpy as np

from hearthline.llm import near_dup


def hard_group(pairs, common=200, seed=5):
    """Two texts of a pair have 0.754 of their shingles in common, any other two 0.681."""
    rows, chance = [], np.random.default_rng(seed)
    body = [f"c{i}" for i in range(common)]
    for p in range(pairs):
        shared = [f"p{p}w{i}" for i in range(12)]
        for side in (0, 1):
            own = [f"p{p}s{side}w{i}" for i in range(34)]
            rows.append((2 * p + side + 1, " ".join(body + shared + own)))
    chance.shuffle(rows)
    return [(int(i), t) for i, t in rows]


def test_isolated_pairs_of_a_large_unlinked_group_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rows = hard_group(400)
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    jaccard = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(1, 801, 2)]
    assert 0.75 <= min(jaccard) and max(jaccard) < 0.76
    assert len(sets[1] & sets[3]) / len(sets[1] | sets[3]) < 0.69
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = [r.doc_id for r in found if r.component_id != r.doc_id - (r.doc_id % 2 == 0)]
    assert lost == []


def test_lists_longer_than_a_block_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 16, raising=False)
    # The words of a pair's own come last in the order of rarity here, so common ones lie in every prefix.
    body = [f"c{i}" for i in range(150)]
    rows = [(2 * p + s + 1, " ".join(body + [f"p{p}w{i}" for i in range(24)] + [f"p{p}s{s}"] * 1)) for p in range(40) for s in (0, 1)]
    rows = [(i, t + " " + " ".join(f"p{(i - 1) // 2}v{k}" for k in range(20))) for i, t in rows]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    assert all(100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1]) for i in range(1, 81, 2))
    assert 100 * len(sets[1] & sets[3]) < 75 * len(sets[1] | sets[3])
    assert got == {i: i - (i % 2 == 0) for i, _ in rows}
