"""Texts that hold the space mark of the pieces."""

from hearthline.llm import pieces, queries


def test_a_text_with_the_space_mark_does_not_come_back(spark):
    rows = [(1, "a\u2581b"), (2, "a b"), (3, None), (4, ""), (5, "\u2581")]
    out = pieces.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), queries.piece_vocabulary()).collect()
    assert {r.doc_id: r.round_trip for r in out} == {1: False, 2: True, 3: True, 4: True, 5: False}
