"""Memory of a task that encodes large batches."""

import tracemalloc

import pyarrow as pa

from hearthline.llm import pieces, queries


def test_memory_does_not_follow_the_batch():
    """Eight million bytes in one Arrow batch; a block of them is in memory at a time."""
    v = queries.piece_vocabulary(queries.PIECE_MODEL)
    column = pa.array(["a few words ▁ of text, " * 200] * 1800)
    encoder, n = pieces.Encoder(v), 0
    tracemalloc.start()
    for _, _, data, offsets in pieces._blocks(column):
        ids, border = encoder.encode(data, offsets)
        n += pieces.decode(v, ids, border)[0].size
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len(x.replace("▁", " ")) for x in column.to_pylist())
    assert peak < 100 << 20
