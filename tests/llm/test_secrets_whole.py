"""Short values, values of letters only and of digits only outside an assignment."""

import numpy as np
import pytest

from hearthline.llm import secret_grammar

WORDS = "several ordinary sentences about weather, gardens, kitchens and travelling through mountains with friends before dinner".split()


@pytest.mark.parametrize("head, alphabet, size", [("kd-", "0123456789abcdef", 6), ("", "qxzjkv", 20), ("77", "0123456789", 18)])
def test_formats_of_any_length_and_alphabet_are_found(spark, head, alphabet, size):
    chance = np.random.default_rng(3)
    make = lambda: head + "".join(chance.choice(list(alphabet), size))
    plain = lambda: " ".join(chance.choice(WORDS, 12))
    rows = [(i, f"{plain()} password: {make()} {plain()}") for i in range(300)]
    bare = {1000 + i: make() for i in range(20)}
    rows += [(i, f"{plain()} {value} {plain()}") for i, value in bare.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    grammar = secret_grammar.train(docs)
    found = secret_grammar.find(docs, grammar, ("doc_id", "text"), redact=True).collect()
    got = {r.doc_id: r for r in found}
    assert sum(bare[i] not in got[i].redacted for i in bare) >= 18
    assert all(r.n_format == 0 for r in found if r.doc_id < 1000)
    assert all(r.n_format <= 1 for r in found)


def test_ordinary_runs_do_not_depend_on_partitions(spark):
    rows = [(i, " ".join(f"wordnumber{(i * 37 + k) % 3000}" for k in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (secret_grammar.train(docs.repartition(n)).plain for n in (1, 7))
    assert np.array_equal(one.gain, many.gain)
