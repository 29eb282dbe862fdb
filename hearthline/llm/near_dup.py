"""Near duplicates by a chosen-path similarity join.

The join grows ``TREES`` independent trees. Below its root a set branches into one node
per chosen minwise token, ``FAN`` of them per tree. A large node chooses ``BRANCH``
coordinates of its own, seeded by its path, and its members branch again by the minwise
tokens they have there, so that sets which are alike stay together and others part.
Small nodes are compared exhaustively. Pairs are settled where they lie: first by
sketches, which leaves clusters of sets that may be linked, each handled once whatever
number of nodes shows it, then on the full sets. Only links leave a task, never more
than the members of a cluster.

Sets known to be in one component need no comparison. Members of a node are therefore
compared with one leader first, and a node whose members outside the leader's component
are few is small too: these are compared with all of its members, in blocks. What is
still large after ``DEPTH`` levels is compared whole, in pairs of blocks; no member, pair
or node is dropped for its size.

A pair at the threshold shares a first node but for 0.25 ** 12 = 6e-8. At any depth below,
one of its nodes is alive in a tree with 0.96 at least, in one of the trees but for 2e-6.

Null or empty text, or text without words: no shingles, a component of its own.
Repeated rows share a component. A null id never names a component that also has
an id. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import tokens
from hearthline.session import cut_lineage

SHINGLE = 5
PERCENT = 75
#: Independent trees, and nodes of a set below each root.
TREES = 4
FAN = 3
NODES = TREES * FAN
#: Coordinates a large node chooses, out of ``COORDINATES`` minwise tokens of a set.
BRANCH = 2
COORDINATES = 64
DEPTH = 8
#: Members of a node that are compared with each other; of larger ones, members outside the leader's component.
SMALL = 2000
#: Members of a node up to which it is known, before the leaders are compared, who may be linked.
FEW = 40
#: Members of one block of a node with more than ``SMALL``.
BLOCK = 2000
#: Shingles of one block of a cluster; every pair of blocks is compared in a task of its own.
HELD = 1 << 21
#: Minwise tokens per set; each gives a bit of the sketch, the first also name nodes.
TOKENS = 128
#: Of 128 bits a pair at the threshold differs in 16 on average; 40 is 6.4 deviations more.
BITS_APART = 40

_PATHS = TOKENS // 2
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, _PATHS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HALF = np.uint64(32)
_CHOICES = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct sorted shingles, offsets) per block."""
    for first, last, data, offsets in tokens.blocks(column):
        data = tokens.LOWER[data]
        starts, ends, firsts = tokens.words(data, offsets)
        hashes = tokens.span_hashes(data, starts, ends)
        joined, at = tokens.windows(hashes, firsts, width)
        counts = np.diff(firsts)
        text = np.searchsorted(firsts, at, "right") - 1
        few = np.flatnonzero((counts > 0) & (counts < width))
        if few.size:
            whole = np.array([_short(hashes[firsts[i] : firsts[i + 1]]) for i in few], np.uint64)
            joined, text = np.concatenate([joined, whole]), np.concatenate([text, few])
        order = np.lexsort((joined, text))
        joined, text = joined[order], text[order]
        new = np.ones(joined.size, bool)
        new[1:] = (joined[1:] != joined[:-1]) | (text[1:] != text[:-1])
        joined, text = joined[new], text[new]
        yield first, last, joined, np.searchsorted(text, np.arange(last - first + 1))


def _short(hashes: np.ndarray) -> np.uint64:
    """The whole sequence of a text with fewer words than a shingle has."""
    total = np.array([hashes.size], np.uint64)
    for i in range(hashes.size):
        total = tokens.mix(total * np.uint64(31) + hashes[i : i + 1])
    return total[0]


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, joined, offsets in _sets(batch.column("text"), width):
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                at = offsets[:-1][full]
                names = np.zeros(last - first, np.uint64)
                bits = np.zeros((2, last - first), np.uint64)
                paths = np.zeros((last - first, NODES), np.uint32)
                if full.size:
                    names[full] = tokens.mix(np.add.reduceat(tokens.mix(joined), at) + sizes[full].astype(np.uint64))
                    for i in range(_PATHS):
                        scrambled = joined * _FACTORS[i]
                        scrambled ^= scrambled >> _HALF
                        scrambled *= np.uint64(0xBF58476D1CE4E5B9)
                        low = np.minimum.reduceat(scrambled.astype(np.uint32), at)
                        high = np.minimum.reduceat((scrambled >> _HALF).astype(np.uint32), at)
                        if i < NODES:
                            paths[full, i] = high
                        for side, least in enumerate((low, high)):
                            bits[side, full] |= _bit(least) << np.uint64(i)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"),
                        own.column("row_key"),
                        own.column("text_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(tokens.signed(names), pa.int64(), mask=sizes == 0),
                        pa.array(tokens.signed(bits[0])),
                        pa.array(tokens.signed(bits[1])),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(NODES * 4), last - first, [None, pa.py_buffer(paths.tobytes())]
                        ).cast(pa.binary()),
                    ],
                    names=["doc_id", "row_key", "text_key", "n_shingles", "sid", "bits_a", "bits_b", "paths"],
                )

    return run


def _bit(values: np.ndarray) -> np.ndarray:
    """One well mixed bit of a minwise token."""
    return (tokens.mix(values.astype(np.uint64)) >> np.uint64(40)) & np.uint64(1)


def _shingle_rows(width: int):
    """Sets by name. Repeated rows come one after the other here and give their set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None)
        for batch in batches:
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for first, _, joined, offsets in _sets(batch.column("text"), width):
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                if not full.size:
                    continue
                names = tokens.mix(np.add.reduceat(tokens.mix(joined), offsets[:-1][full]) + sizes[full].astype(np.uint64))
                own = keys[first + full]
                new = np.ones(full.size, bool)
                new[1:] = (own[1:] != own[:-1]) | (names[1:] != names[:-1])
                new[0] = (own[0], names[0]) != before
                before = (own[-1], names[-1])
                if not new.all():
                    picked = full[new]
                    joined = np.concatenate([joined[offsets[i] : offsets[i + 1]] for i in picked] or [joined[:0]])
                    names, sizes = names[new], sizes[picked]
                else:
                    sizes = sizes[full]
                at = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tokens.signed(names)),
                        pa.ListArray.from_arrays(pa.array(np.append(at, joined.size).astype(np.int32)), pa.array(tokens.signed(joined))),
                    ],
                    names=["sid", "shingles"],
                )

    return run


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per set and minwise token that names a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = np.frombuffer(b"".join(batch.column("paths").to_pylist()), np.uint32).reshape(-1, NODES)
            for i in range(NODES):
                key = tokens.mix((np.uint64(i + 1) << np.uint64(48)) ^ paths[:, i].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.signed(key)), *(batch.column(c) for c in ("sid", "n_shingles", "bits_a", "bits_b"))],
                    names=["node", "sid", "n_shingles", "bits_a", "bits_b"],
                )

    return rows.mapInArrow(run, "node long, sid long, n_shingles long, bits_a long, bits_b long")


def _led(rows: DataFrame) -> DataFrame:
    """Members of nodes that have company, with the number of members and a leader."""
    of_node = rows.groupBy("node").agg(
        F.count("*").alias("members"),
        F.max_by(F.struct("sid", "n_shingles", "bits_a", "bits_b"), F.xxhash64("node", "sid")).alias("lead"),
    )
    return cut_lineage(rows.join(of_node.where("members > 1"), "node"), "led")


def _plausible(a: str, b: str):
    """Neither sizes nor sketches rule a link out."""
    apart = F.bit_count(F.col(f"{a}.bits_a").bitwiseXOR(F.col(f"{b}.bits_a"))) + F.bit_count(
        F.col(f"{a}.bits_b").bitwiseXOR(F.col(f"{b}.bits_b"))
    )
    small, large = (f(f"{a}.n_shingles", f"{b}.n_shingles") for f in (F.least, F.greatest))
    return (apart <= BITS_APART) & (small * 100 >= large * PERCENT)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs confirmed on the full sets."""
    a = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - F.col("common")
    return (
        pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b", common.alias("common"))
        .where(F.col("common") * 100 >= whole * PERCENT).select("a", "b")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the stored pairs."""
    return cut_lineage(_linked(pairs, sets), "links")


def _components(links: DataFrame) -> DataFrame:
    """(sid, label): the smallest sid reachable, by min labels with pointer jumps."""
    edges = cut_lineage(links.union(links.select("b", "a")).distinct(), "edges")
    labels = cut_lineage(edges.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("near")).select("sid", F.least("sid", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("sid").alias("b"), "label"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "sid").select("sid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("sid").alias("label"), F.col("label").alias("further"))
        stepped = cut_lineage(
            lower.join(jump, "label", "left").select("sid", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        labels = stepped.select("sid", "label")
        if stepped.where("old != label").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: only components that these join are solved anew."""
    ends = _with_label(_with_label(links, labels, "a", "of_a"), labels, "b", "of_b").where("of_a != of_b")
    between = cut_lineage(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    joined = _components(between)
    further = joined.select(F.col("sid").alias("label"), F.col("label").alias("further"))
    known = labels.join(further, "label", "left").select("sid", F.coalesce("further", "label").alias("label"))
    return cut_lineage(known.union(joined.join(labels.select("sid"), "sid", "left_anti").select("sid", "label")), "labels")


def classes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, group, component_id, one row per row of ``docs`` (doc_id, text).

    ``text_key`` is the hash of the text; ``group`` names the component, whatever the ids,
    and is null without shingles.
    """
    texts = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("row_key"), F.xxhash64("text").alias("text_key"), "text")
    features = cut_lineage(
        texts.mapInArrow(
            _features(width), "doc_id long, row_key long, text_key long, n_shingles long, sid long, bits_a long, bits_b long, paths binary"
        ),
        "features",
    )
    sets_of = cut_lineage(
        features.where("sid is not null").groupBy("sid").agg(
            F.min("doc_id").alias("first_id"),
            F.min("row_key").alias("row_key"),
            *(F.min(c).alias(c) for c in ("n_shingles", "bits_a", "bits_b", "paths")),
        ),
        "sets",
    )
    led = _led(_nodes(sets_of.select("sid", "n_shingles", "bits_a", "bits_b", "paths")))
    wanted = sets_of.select("sid", "row_key").join(_with_prospects(led), "sid").select("row_key").distinct()
    shingles = cut_lineage(
        texts.join(wanted, "row_key", "left_semi").select("row_key", "text").mapInArrow(_shingle_rows(width), "sid long, shingles array<long>"),
        "shingles",
    )
    star = (
        led.alias("m").where((F.col("lead.sid") != F.col("m.sid")) & _plausible("m", "lead"))
        .select(F.col("lead.sid").alias("a"), F.col("m.sid").alias("b")).distinct()
    )
    labels = _components(_confirmed(cut_lineage(star, "pairs"), shingles))
    labels = _merged(labels, _tree_links(led, labels, shingles))
    linked = labels.join(sets_of.select("sid", "first_id"), "sid")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    in_group = linked.join(least, "label").select("sid", "label", "component_id")
    of_set = sets_of.select("sid", "first_id").join(in_group, "sid", "left").select(
        "sid", F.coalesce("label", "sid").alias("group"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return features.select("doc_id", "text_key", "n_shingles", "sid").join(of_set, "sid", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        "group",
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs`` (doc_id, text)."""
    found = classes(docs, width).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, copies: the row that stays of every component with shingles.

    It is the one with the smallest id, then the smallest hash of the text; rows without
    an id come last. ``copies`` counts the rows with this very id and text.
    """
    of_row = classes(docs, width).where("group is not null").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    best = F.min_by(F.struct("doc_id", "text_key", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")
    return of_row.groupBy("group").agg(best).select("best.*")


def _with_prospects(members: DataFrame) -> DataFrame:
    """Sets that a link is possible for, and all members of nodes with more than ``FEW``."""
    small, large = members.where(F.col("members") <= FEW), members.where(F.col("members") > FEW)
    a, b = small.alias("a"), small.alias("b")
    near = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.sid") != F.col("b.sid")) & _plausible("a", "b"), "left_semi")
    return near.select("sid").union(large.select("sid")).distinct()


def _with_label(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the component, so far, of the set in column ``of``."""
    own = labels.select(F.col("sid").alias("labelled"), F.col("label").alias("so_far"))
    joined = rows.join(own, F.col(of) == F.col("labelled"), "left")
    return joined.withColumn(name, F.coalesce("so_far", of)).drop("labelled", "so_far")


def _tree_links(led: DataFrame, labels: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links between components so far, from all nodes of all trees."""
    rows = _with_label(led.select("node", "sid", "n_shingles", "bits_a", "bits_b"), labels, "sid", "label")
    found, coordinates = [], None
    for depth in range(1, DEPTH + 1):
        mixed = _mixed(rows)
        small, large = mixed.where(F.col("members") <= SMALL), mixed.where(F.col("members") > SMALL)
        found.append(_clusters(_placed(small, F.lit(0), F.array(F.lit(0)))))
        if large.isEmpty():
            break
        outside = large.groupBy("node").agg(F.count_if(F.col("label") != F.col("lead")).alias("outside"))
        large = large.join(outside, "node")
        found.append(_clusters(_beside_leader(large.where(F.col("outside") <= SMALL))))
        large = large.where(F.col("outside") > SMALL)
        if depth == DEPTH:
            found.append(_clusters(_block_pairs(large, F.ceil(F.col("members") / BLOCK).cast("int"))))
            break
        if coordinates is None:
            coordinates = cut_lineage(shingles.join(large.select("sid").distinct(), "sid", "left_semi").mapInArrow(_coordinates, "sid long, least binary"), "coordinates")
        rows = _branches(large.drop("members", "lead", "outside").join(coordinates, "sid"))
    clusters = found[0]
    for further in found[1:]:
        clusters = clusters.union(further)
    return _settled(cut_lineage(clusters.distinct(), "clusters"), shingles)


def _mixed(rows: DataFrame) -> DataFrame:
    """Members of nodes with several components, the number of members and the leader's component."""
    of_node = rows.groupBy("node").agg(
        F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.max_by("label", F.xxhash64("node", "sid")).alias("lead"),
    ).where("low < high").drop("low", "high")
    return cut_lineage(rows.join(of_node, "node"), "mixed")


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minwise tokens that large nodes choose from."""
    for batch in batches:
        lists = batch.column("shingles")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not sizes.size:
            continue
        joined, at = lists.flatten().to_numpy().view(np.uint64), np.cumsum(sizes) - sizes
        least = np.zeros((sizes.size, COORDINATES), np.uint32)
        for i in range(COORDINATES):
            scrambled = joined * _CHOICES[i]
            scrambled ^= scrambled >> _HALF
            scrambled *= np.uint64(0x94D049BB133111EB)
            least[:, i] = np.minimum.reduceat((scrambled >> _HALF).astype(np.uint32), at)
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES * 4), sizes.size, [None, pa.py_buffer(least.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("sid"), packed.cast(pa.binary())], names=["sid", "least"])


def _branches(rows: DataFrame) -> DataFrame:
    """Every row once per coordinate that its node chooses, in the node named by path and token."""
    carried = ("sid", "n_shingles", "bits_a", "bits_b", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy().view(np.uint64)
            least = np.frombuffer(b"".join(batch.column("least").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            first = tokens.mix(node ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(COORDINATES)
            step = tokens.mix(node + np.uint64(0x14057B7EF767814F)) % np.uint64(COORDINATES // BRANCH)
            for k in range(BRANCH):
                # Steps below COORDINATES / BRANCH, plus one, keep the choices of a node apart.
                at = (first + np.uint64(k) * (step + np.uint64(1))) % np.uint64(COORDINATES)
                token = least[np.arange(at.size), at.astype(np.int64)].astype(np.uint64)
                child = tokens.mix(tokens.mix(node + np.uint64(k + 1)) ^ token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.signed(child)), *(batch.column(c) for c in carried)], names=["node", *carried]
                )

    return rows.mapInArrow(run, "node long, sid long, n_shingles long, bits_a long, bits_b long, label long")


def _placed(rows: DataFrame, own: Column, others: Column) -> DataFrame:
    """Members in the groups that compare block ``own`` with each of ``others``."""
    at = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(others.cast("array<int>")))
    return at.select("node", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), "own", "sid", "label", "n_shingles", "bits_a", "bits_b")


def _beside_leader(rows: DataFrame) -> DataFrame:
    """Members outside the leader's component, block -1, against each other and all blocks of the component."""
    inside = F.col("label") == F.col("lead")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.when(inside, F.pmod(F.xxhash64("sid"), blocks)).otherwise(-1)
    return _placed(rows, own, F.when(inside, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(-1), blocks - 1)))


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    return _placed(rows, F.pmod(F.xxhash64("sid"), blocks), F.sequence(F.lit(0), blocks - 1))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and the first row of each; rows of a group come one after the other."""
    held: list[pa.RecordBatch] = []
    begins: list[np.ndarray] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        starts = np.flatnonzero(new)
        if not starts.size:
            held.append(batch)
            rows += batch.num_rows
            continue
        cut = int(starts[-1])
        if rows + cut:
            yield _joined([*held, batch.slice(0, cut)]), np.concatenate([*begins, rows + starts[:-1]])
        held, begins, rows = [batch.slice(cut)], [np.zeros(1, np.int64)], batch.num_rows - cut
    if held:
        yield _joined(held), np.concatenate(begins)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([b for b in batches if b.num_rows])


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[k] with b[k]; the root of a component is its smallest row."""
    while True:
        one, two = parent[a], parent[b]
        apart = one != two
        if not apart.any():
            return parent
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further


def _clusters(placed: DataFrame) -> DataFrame:
    """(cluster, sid, label, n_shingles): sets of a group that neither sizes nor sketches keep apart.

    Clusters of the same members have the same name, so those of many nodes are one.
    """
    names = ["cluster", "sid", "label", "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, ("node", "i", "j")):
            i, j, own, sid, label, size, bits_a, bits_b = (
                batch.column(c).to_numpy() for c in ("i", "j", "own", "sid", "label", "n_shingles", "bits_a", "bits_b")
            )
            end = np.repeat(np.append(starts[1:], sid.size), np.diff(np.append(starts, sid.size)))
            parent, left, step = np.arange(sid.size), np.arange(sid.size), 0
            while left.size:
                step += 1
                left = left[left + step < end[left]]
                right = left + step
                good = (label[left] != label[right]) & ((i[left] == j[left]) | (own[left] != own[right]))
                a, b = left[good], right[good]
                a_size, b_size = size[a], size[b]
                alike = np.minimum(a_size, b_size) * 100 >= np.maximum(a_size, b_size) * PERCENT
                a, b = a[alike], b[alike]
                apart = np.bitwise_count((bits_a[a] ^ bits_a[b]).view(np.uint64)) + np.bitwise_count((bits_b[a] ^ bits_b[b]).view(np.uint64))
                near = apart <= BITS_APART
                parent = _united(parent, a[near], b[near])
            many = np.bincount(parent, minlength=parent.size)
            picked = np.flatnonzero(many[parent] > 1)
            if not picked.size:
                continue
            named = np.zeros(parent.size, np.uint64)
            np.add.at(named, parent[picked], tokens.mix(sid[picked].view(np.uint64)))
            cluster = tokens.mix(named + many.astype(np.uint64))[parent[picked]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens.signed(cluster), sid[picked], label[picked], size[picked])], names=names)

    dealt = placed.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return dealt.mapInArrow(run, "cluster long, sid long, label long, n_shingles long")


def _settled(clusters: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b): links of the clusters on the full sets, as many as join what they join."""
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / HELD).cast("int").alias("blocks"))
    own = clusters.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    at = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = at.select("cluster", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), "own", "sid", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, ("cluster", "i", "j")):
            found = [np.zeros((2, 0), np.int64)]
            ends = np.append(starts[1:], batch.num_rows)
            for start, end in zip(starts.tolist(), ends.tolist()):
                found += _links_of(batch.slice(start, end - start))
            a, b = np.concatenate(found, axis=1)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = placed.join(shingles, "sid").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return cut_lineage(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def _links_of(group: pa.RecordBatch) -> list[np.ndarray]:
    """Pairs of the group that are linked, at most one fewer than its members."""
    sid, own = group.column("sid").to_numpy(), group.column("own").to_numpy()
    within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    lists = group.column("shingles")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    _, joined = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    _, part = np.unique(group.column("label").to_numpy(), return_inverse=True)
    held, found = np.zeros(joined.max() + 1, np.int32), []
    for k in range(sid.size - 1):
        rest = np.arange(k + 1, sid.size)
        open_ = (part[rest] != part[k]) & (np.minimum(sizes[rest], sizes[k]) * 100 >= np.maximum(sizes[rest], sizes[k]) * PERCENT)
        if not within:
            open_ &= own[rest] != own[k]
        rest = rest[open_]
        if not rest.size:
            continue
        mine = joined[offsets[k] : offsets[k + 1]]
        held[mine] = 1
        first = rest[0]
        common = np.add.reduceat(held[joined[offsets[first] :]], offsets[first:-1] - offsets[first])[rest - first]
        held[mine] = 0
        for at in rest[common * 100 >= (sizes[rest] + sizes[k] - common) * PERCENT]:
            if part[at] != part[k]:
                part[part == part[at]] = part[k]
                found.append(np.array([[sid[k]], [sid[at]]]))
    return found
