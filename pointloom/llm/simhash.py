"""SimHash near-duplicate detection through deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the allowed distance must have a segment that
differs by at most one bit. Every segment is indexed once for each of its bits with that bit wild; equal signatures
meet, and the full fingerprints decide. Only distinct fingerprints are indexed, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, mix64, placed, release_memory, rows_with, segment_sums, slices, utf8
from pointloom.llm.components import connected_components

SEED = 42
#: Byte value -> its eight bits, one in each byte lane of a 64-bit word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of every n-word shingle of the lower-cased words; the whole sequence where there are fewer words."""
    words = text.lower().split()
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= n:
        return [digest(join(words), SEED)]
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(n)))]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit word per run of hashes: a bit is set where it is set in over half of the run.

    Bits are added in byte lanes, at most 255 hashes at a time, so that no lane overflows.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    chunks = (lengths + 254) // 255
    size = np.full(int(chunks.sum()), 255, dtype=np.int64)
    if len(size):
        full = lengths > 0
        size[np.cumsum(chunks)[full] - 1] = lengths[full] - 255 * (chunks[full] - 1)
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    counts = segment_sums(lanes, size).view(np.uint8).reshape(len(size), 64).astype(np.int64)
    over = segment_sums(counts, chunks) * 2 > lengths[:, None]
    return np.packbits(over, axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _fingerprint_words(hashes: np.ndarray, lengths: np.ndarray, words: int) -> list[pa.Array]:
    arrays = []
    for k in range(words):
        with np.errstate(over="ignore"):
            own = hashes if k == 0 else mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        arrays.append(pa.array(majority_bits(own, lengths).view(np.int64)))
    return arrays


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], column: str, n: int, words: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column, 2 << 20):
        runs = [shingle_hashes(t, n) if t else [] for t in utf8(batch.column(column))]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        hashes = np.fromiter((h for run in runs for h in run), np.uint64, int(lengths.sum()))
        arrays = _fingerprint_words(hashes, lengths, words)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *(f"fp{k}" for k in range(words))])


def fingerprints(docs: DataFrame, text: str = "text", *, shingle_words: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp0.. (64 bits each, as long) for every row of ``docs``.

    Shingles are taken over the whole text with repeats. Null or word-less texts have fingerprint zero.
    """
    kept = docs.select(*keep, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"fp{k} bigint" for k in range(words))])
    return kept.mapInArrow(partial(_fingerprint_batches, column=text, n=shingle_words, words=words, keep=list(keep)), schema)


def _local_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, root) of a spanning star forest of the links a-b over nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _link_runs(sig: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal signature whose fingerprints differ by at most ``distance`` bits, folded into forests as they pile up.

    Neighbours at growing offsets are compared all at once; ``sig`` is sorted, so an offset keeps only rows of longer runs.
    """
    live, step = np.arange(len(sig) - 1), 1
    left, right, held = [], [], 0
    while len(live):
        live = live[live + step < len(sig)]
        live = live[sig[live] == sig[live + step]]
        hit = live[np.bitwise_count(fps[live] ^ fps[live + step]).sum(axis=1) <= distance]
        left.append(hit)
        right.append(hit + step)
        held += len(hit)
        if held > 500_000:
            node, root = _local_forest(np.concatenate(left), np.concatenate(right), len(sig))
            left, right, held = [node], [root], len(node)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if held else (np.empty(0, np.int64),) * 2


def _run_forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, root) of a spanning star forest of one run, over all its pairs within ``distance`` bits.

    Breadth first: a row is compared with all that are not reached yet, so a run of near copies costs little more than its rows.
    """
    left, rest, nodes, roots = np.arange(len(fps)), fps, [], []
    while len(left) > 1:
        root, open_rows = int(left[0]), [fps[left[0]]]
        left, rest = left[1:], rest[1:]
        while open_rows and len(left):
            near = np.bitwise_count(rest ^ open_rows.pop()).sum(axis=1) <= distance
            if near.any():
                nodes.append(left[near])
                roots.append(np.full(len(nodes[-1]), root))
                open_rows.extend(rest[near])
                left, rest = left[~near], rest[~near]
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.empty(0, np.int64),) * 2


def _link_batches(batches: Iterator[pa.RecordBatch], fps: int, most_run: int, distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (sig, id, fingerprint words, carried words) in, in the order of sig.

    Out: rows (a, b) of links with a null sig, and the rows of runs longer than ``most_run`` as they came, to be refined.
    Memory holds about ``block`` rows; an overlong run streams through.
    """
    names: list[str] = []

    def table(sig, a, b, rest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([sig, a, b, *rest], names=["sig", "id", "to", *names[2:]])

    def overlong(x: np.ndarray) -> pa.RecordBatch:
        return table(pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64()), [pa.array(x[:, k]) for k in range(2, x.shape[1])])

    def emit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig = x[:, 0]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        if (long := np.repeat(size > most_run, size)).any():
            yield overlong(x[long])
        x = x[np.repeat((size > 1) & (size <= most_run), size)]
        i, j = _link_runs(x[:, 0], np.ascontiguousarray(x[:, 2 : 2 + fps]).view(np.uint64), distance) if len(x) else ((), ())
        if len(i) == 0:
            return
        nodes, ends = np.unique(np.concatenate((x[i, 1], x[j, 1])), return_inverse=True)
        node, root = _local_forest(ends[: len(i)], ends[len(i) :], len(nodes))
        null = pa.nulls(len(node), pa.int64())
        yield table(null, pa.array(nodes[node]), pa.array(nodes[root]), [null] * (len(names) - 2))

    parts: list[np.ndarray] = []
    held, streaming = 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = batch.schema.names
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if streaming is not None:
            n = int(np.searchsorted(x[:, 0], streaming, side="right"))
            if n:
                yield overlong(x[:n])
            if n == len(x):
                continue
            streaming, x = None, x[n:]
        parts.append(x)
        held += len(x)
        if held < block:
            continue
        x = np.concatenate(parts)
        cut = int(np.searchsorted(x[:, 0], x[-1, 0], side="left"))
        if len(x) - cut > most_run:
            streaming, cut = int(x[-1, 0]), len(x)
        if cut:
            yield from emit(x[:cut])
        parts, held = ([x[cut:]], len(x) - cut) if cut < len(x) else ([], 0)
    if parts:
        yield from emit(np.concatenate(parts))
    release_memory()


#: A segment's bits are divided into so many stretches; all stretches but one are the key that rows are dealt by.
STRETCHES = 4


def _index(nodes: DataFrame, words: list[str], segments: int, width: int) -> DataFrame:
    """Rows (own, id, words) of every node: ``own`` is one segment of the fingerprint, under the segment's number and a stretch of it.

    Two segments that differ in one bit agree in all stretches but the one with that bit, so four rows for each segment
    are dealt, in place of one for each bit; the variants are made where the rows arrive.
    """
    per_word = 64 // width
    own = []
    for k in range(segments):
        segment = F.shiftrightunsigned(F.col(words[k // per_word]), width * (k % per_word)).bitwiseAND(F.lit((1 << width) - 1))
        own += [segment + F.lit((STRETCHES * k + q) << width) for q in range(STRETCHES)]
    return nodes.select(F.explode(F.array(*own)).alias("own"), "id", *words)


def _variants(own: Column, width: int) -> Column:
    """The signatures of a row of ``_index``: the segment with one bit of the stretch wild, under segment, stretch and bit."""
    per = width // STRETCHES
    first = F.shiftrightunsigned(own, width).bitwiseAND(F.lit(STRETCHES - 1)) * per
    wild = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), (first + j).cast("int"))
    return F.array(*(own.bitwiseAND(F.bitwise_not(wild(j))) + F.lit(j << 56) for j in range(per)))


def _dealt(rows: DataFrame, words: list[str], width: int) -> DataFrame:
    """Rows (sig, id, words) of all variants of an ``_index``, dealt by what a stretch leaves of its segment."""
    per = width // STRETCHES
    first = F.shiftrightunsigned("own", width).bitwiseAND(F.lit(STRETCHES - 1)) * per
    stretch = F.call_function("shiftleft", F.lit((1 << per) - 1).cast("long"), first.cast("int"))
    rows = rows.repartition(F.col("own").bitwiseAND(F.bitwise_not(stretch)))
    return rows.select(F.explode(_variants(F.col("own"), width)).alias("sig"), "id", *words)


def _meet(dealt: DataFrame, words: list[str], carried: list[str], distance: int, most_run: int, block: int) -> DataFrame:
    """Bring equal signatures together, in partitions that hold each of them whole; the links and overlong runs, written down."""
    rows = dealt.select("sig", "id", *words, *carried).sortWithinPartitions("sig")
    schema = ", ".join(["sig bigint, id bigint, to bigint", *(f"{c} bigint" for c in (*words, *carried))])
    found = rows.mapInArrow(partial(_link_batches, fps=len(words), most_run=most_run, distance=distance, block=block), schema)
    return materialise(found, "simhash-links")


def variants(value: Column, start: int, width: int, tag: int) -> list[Column]:
    """For each bit of a segment of ``value``: the segment with that bit wild, under segment and bit."""
    segment = F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))
    return [segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << p))) + F.lit((tag * width + p) << width) for p in range(width)]


def linked_pairs(nodes: DataFrame, *, distance: int = 3, most_run: int = 4096, block: int = 200_000) -> DataFrame:
    """Links (a, b) that connect distinct 64-bit fingerprints (column fp0) within ``distance`` (1 to 3) bits of each other.

    With two segments of 32 bits one of them differs by at most one bit, so every such pair meets. The result connects
    what all those pairs connect, but is a union of spanning forests: its size follows the rows, not the pairs.
    A run of over ``most_run`` equal signatures is refined exactly: the other 32 bits are halved, and one half again
    differs by at most one bit; then the other 16 bits likewise, after which a run holds at most 2048 fingerprints.
    """
    if not 1 <= distance <= 3:
        raise ValueError("two segments serve distances from 1 to 3")
    if most_run < 2048:
        raise ValueError("runs of up to 2048 can't be refined further")
    fp = F.col("fp0")
    found = _meet(_dealt(_index(nodes.select(fp.alias("id"), "fp0"), ["fp0"], 2, 32), ["fp0"], 32), ["fp0"], [], distance, most_run, block)
    links = found.where("sig is null").select(F.col("id").alias("a"), F.col("to").alias("b"))
    low_segment = F.shiftrightunsigned("sig", 32).bitwiseAND(F.lit(2 * STRETCHES - 1)) < STRETCHES
    hot = found.where("sig is not null").withColumn("rest", F.when(low_segment, F.shiftrightunsigned(fp, 32)).otherwise(fp).bitwiseAND(F.lit(0xFFFFFFFF)))
    for width in (16, 8):
        if hot.isEmpty():
            break
        rest, mask = F.col("rest"), (1 << width) - 1
        other = [F.shiftrightunsigned(rest, width), rest.bitwiseAND(F.lit(mask))]
        finer = F.array(*(F.struct(v.alias("low"), other[tag].alias("rest")) for tag in (0, 1) for v in variants(rest, tag * width, width, tag)))
        rows = hot.select(F.explode(finer).alias("x"), "id", "fp0", "sig").select(F.xxhash64("sig", "x.low").alias("sig"), "id", "fp0", "x.rest")
        found = _meet(rows.repartition("sig"), ["fp0"], ["rest"], distance, most_run, block)
        links = links.union(found.where("sig is null").select(F.col("id").alias("a"), F.col("to").alias("b")))
        hot = found.where("sig is not null")
    return links


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle_words: int = 3, distance: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    component_id is the smallest doc_id among all documents reachable over links of at most ``distance`` differing
    fingerprint bits, itself included. Null or word-less texts share fingerprint zero and are linked like any other.
    Rows with a null doc_id take part and never give a component its name, unless it has no other rows (then null).
    Repeated rows come back as often as they came. An empty table gives an empty result. Other columns are ignored.
    """
    marks = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle_words=shingle_words), "fingerprints")
    nodes = materialise(marks.groupBy("fp0").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = materialise(connected_components(linked_pairs(nodes, distance=distance)), "components")
    label = F.coalesce("component", "fp0")
    members = nodes.join(groups, nodes.fp0 == groups.node, "left").select("fp0", "least", label.alias("component"))
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(members.join(names, "component").select("fp0", "component_id"), "named-fingerprints")
    return marks.join(named, "fp0").select("doc_id", hex64(F.col("fp0")).alias("fingerprint"), "component_id")


def flip_rate(similarity: float) -> float:
    """The share of fingerprint bits in which sets of this Jaccard similarity (and like size) are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _shingle_sets(batches: Iterator[pa.RecordBatch], n: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [np.unique(np.array(shingle_hashes(t, n) if t else [], dtype=np.uint64)).tobytes() for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.binary())], names=[*keep, "shingles"])


def _set_marks(batches: Iterator[pa.RecordBatch], n: int, words: int, most: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Of every text's set of shingles: its fingerprint, its size, its hashes s1 and s2, and the set itself if it has at most ``most`` shingles."""
    for batch in slices(batches, "text", 2 << 20):
        sets = [np.unique(np.array(shingle_hashes(t, n) if t else [], dtype=np.uint64)) for t in utf8(batch.column("text"))]
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        raw = [s.tobytes() for s in sets]
        marks = [np.array([xxhash.xxh64_intdigest(b, k) for b in raw], dtype=np.uint64).view(np.int64) for k in (1, 2)]
        few = [s.view(np.int64) if len(s) <= most else None for s in sets]
        arrays = [*_fingerprint_words(np.concatenate(sets), lengths, words), pa.array(lengths), *map(pa.array, marks), pa.array(few, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *(f"fp{k}" for k in range(words)), "size", "s1", "s2", "few"])


def _few_links(texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of similar sets connect, of rows (id, few) with distinct sets.

    Two sets of this similarity share one of their first n - ceil(similarity * n) + 1 shingles in any common order, n being
    the size of each. Shingles of many sets come last in the order, so that few sets meet in them.
    """
    every = materialise(texts.select("id", F.explode("few").alias("shingle")), "few-shingles")
    common = materialise(every.groupBy("shingle").agg(F.count("*").alias("sets")).where(F.col("sets") > tile), "common-shingles")
    ranked = every.join(common, "shingle", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "shingle"))).alias("ranked"))
    n = F.size("ranked")
    first = F.slice("ranked", F.lit(1), (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1).cast("int"))
    rows = ranked.select("id", F.explode(F.transform(first, lambda x: x["shingle"])).alias("of"), F.col("ranked.shingle").alias("few"))
    return link_groups(materialise(rows, "few-prefixes"), ["few"], partial(_verify_batches, similarity=similarity), tile)


def link_groups(rows: DataFrame, payload: list[str], link: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tile: int) -> DataFrame:
    """Links (a, b) that connect what all linked pairs within a group connect; ``rows`` (of, id, payload) is a written table, ``of`` a long, the group.

    ``link`` gets rows (tile, id, payload) in the order of tile and spans the links within each tile. Groups of up to
    ``tile`` rows are one tile. Larger groups are dealt into tiles at random, twice, which connects most of what belongs together;
    what a group still has outside its largest connected part is then compared with the whole group, tile by tile. So every pair is
    either compared or connected already, and a group of m copies costs about m rows, not m squared.
    """
    sizes = rows.groupBy("of").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes.select("of", F.ceil(F.col("n") / tile).alias("tiles")), "group-sizes")

    def linked(tiled: DataFrame) -> DataFrame:
        return materialise(tiled.select("tile", "id", *payload).repartition("tile").sortWithinPartitions("tile").mapInArrow(link, "a bigint, b bigint"), "tile-links")

    def dealt(groups: DataFrame, turn: int) -> DataFrame:
        return rows.join(groups, "of").withColumn("tile", F.xxhash64("of", F.pmod(F.xxhash64("id", F.lit(turn)), "tiles"), F.lit(turn)))

    links = linked(dealt(sizes, 0))
    large = sizes.where("tiles > 1")
    if large.isEmpty():
        return links
    links = links.union(linked(dealt(large, 1)))
    parts = materialise(connected_components(links).withColumnRenamed("node", "id"), "linked-parts")
    parted = rows.select("of", "id").join(large, "of").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    parted = materialise(parted.select("of", "id", "part"), "parts-of-groups")
    counted = parted.groupBy("of", "part").agg(F.count("*").alias("n"))
    main = materialise(counted.groupBy("of").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n"), "main-parts")
    rest = main.select("of", "main", F.ceil((F.col("n") - F.col("most")) * 2 / tile).alias("rest_tiles"), F.ceil(F.col("n") * 2 / tile).alias("tiles"))
    members = parted.join(rest, "of").withColumn("outside", F.col("part") != F.col("main"))
    every = members.select("of", "id", F.pmod(F.xxhash64("id", F.lit(2)), "tiles").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_tiles") - 1)).alias("i"))
    outside = members.where("outside").select("of", "id", F.pmod(F.xxhash64("id", F.lit(3)), "rest_tiles").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("j"))
    again = every.unionByName(outside).select("of", "id", F.xxhash64("of", "i", "j").alias("tile"))
    known = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return known.union(linked(again.join(rows, ["of", "id"])))


def jaccard_links(sets: list[np.ndarray], similarity: float, columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets whose Jaccard similarity is at least ``similarity``; empty sets have none."""
    sizes = np.array([len(s) for s in sets])
    names, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    both = np.zeros((len(sets), len(sets)))
    for a in range(0, len(names), columns):  # a stretch of the shingles at a time
        lo, hi = np.searchsorted(where, (a, a + columns))
        has = np.zeros((len(sets), columns), dtype=np.float32)
        has[owner[lo:hi], where[lo:hi] - a] = 1
        both += has @ has.T
    least = similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    i, j = np.nonzero((both >= least) & (both > 0))
    return i[i < j], j[i < j]


def _verify_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (tile, id, set of shingles) in the order of their tile; links (a, b) that span what the tile's verified pairs connect."""
    tile, ids, sets = None, [], []

    def as_set(x: pa.Scalar) -> np.ndarray:
        return np.frombuffer(x.as_buffer(), dtype=np.uint64).copy() if pa.types.is_binary(x.type) else x.values.to_numpy(zero_copy_only=False).view(np.uint64)

    def links() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            i, j = jaccard_links(sets, similarity)
            node, root = _local_forest(i, j, len(ids))
            if len(node):
                name = np.array(ids, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name[node]), pa.array(name[root])], names=["a", "b"])

    for batch in batches:
        for t, i, s in zip(batch.column("tile").to_pylist(), batch.column("id").to_pylist(), batch.column(2)):
            if t != tile:
                yield from links()
                tile, ids, sets = t, [], []
            ids.append(i)
            sets.append(as_set(s))
    yield from links()
    release_memory()


def _near_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, id, fingerprint words) in the order of their tile; links (a, b) that span all pairs of a tile within ``distance`` bits."""
    held: list[np.ndarray] = []

    def links(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))
        words = np.ascontiguousarray(x[:, 2:]).view(np.uint64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(x)]):
            node, root = _run_forest(words[a:b], distance)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(x[a + node, 1]), pa.array(x[a + root, 1])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            x = np.concatenate(held)
            cut = int(np.searchsorted(x[:, 0], x[-1, 0], side="left"))
            if cut:
                yield from links(x[:cut])
            held = [x[cut:]]
    if held:
        yield from links(np.concatenate(held))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, stored: bool = False, shingle_words: int = 5, similarity: float = 0.8, segments: int = 12, width: int = 16, tile: int = 128, most_run: int = 4096, block: int = 100_000, few: int = 32) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group linked by texts of shingle similarity ``similarity`` or more, that of the smallest doc_id stays.

    Equal texts are found by hash first (null counts as the empty text, null doc_id as larger than all; of equal doc_ids the first row in
    its file stays) and only distinct texts go on. Texts of equal shingle sets are linked by hash, and one of each goes on. Similar sets of
    which one has at most ``few`` shingles are found exactly by a prefix filter. The fingerprints of larger sets (each shingle once), of
    ``segments`` times ``width`` bits, are cut into segments, and texts meet where a segment differs by at most one bit; runs of
    over ``most_run`` texts are linked by ``link_groups``. Those within the flips to be expected at the similarity, plus three
    deviations, form coarse groups. Within these, Jaccard similarity is computed exactly on the shingle sets of whole texts.
    Texts without words are copies only of equal texts. Other columns are kept, whatever their names. An empty table stays empty.

    Texts stay where they are: everything between is thin tables of row places (``stored``: see ``placed``).
    """
    per_word = 64 // width
    words = -(-segments // per_word)
    names = [f"fp{k}" for k in range(words)]
    rate = flip_rate(similarity)
    distance = int(64 * words * rate + 3 * (64 * words * rate * (1 - rate)) ** 0.5)
    base = placed(docs, stored)
    hashed = base.select("file", "at", F.col("row")[doc_id].alias("doc_id"), F.coalesce(F.col("row")[text], F.lit("")).alias("text"))
    hashed = hashed.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    keep = ["file", "at", "doc_id", "h1", "h2"]
    schema = ", ".join([*(f"{c} {hashed.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in (*names, "size", "s1", "s2")), "few array<bigint>"])
    most = int(few / similarity + 1e-9)
    marks = hashed.select(*keep, "text").mapInArrow(partial(_set_marks, n=shingle_words, words=words, most=most, keep=keep), schema)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "at")).alias("first")
    nodes = marks.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in (*names, "size", "s1", "s2", "few")), first).withColumn("id", F.monotonically_increasing_id())
    nodes = materialise(nodes, "distinct-texts")
    alike = nodes.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("id").alias("b"))
    alike = materialise(nodes.select("id", "s1", "s2", "size").join(alike, ["s1", "s2", "size"]).select(F.col("id").alias("a"), "b").where("a <> b"), "equal-sets")
    sets = materialise(nodes.where("size > 0").join(alike.select(F.col("a").alias("id")), "id", "left_anti").select("id", "size", "few", *names), "distinct-sets")
    close = _few_links(sets.where("few is not null").select("id", "few"), similarity, tile)
    found = _meet(_dealt(_index(sets.where(F.col("size") > few), names, segments, width), names, width), names, [], distance, most_run, block)
    links = found.where("sig is null").select(F.col("id").alias("a"), F.col("to").alias("b"))
    hot = found.where("sig is not null").select(F.col("sig").alias("of"), "id", *names)
    if not hot.isEmpty():  # common segments
        links = links.union(link_groups(hot, names, partial(_near_batches, distance=distance), most_run))
    coarse = materialise(connected_components(links), "coarse-groups").withColumnsRenamed({"node": "id", "component": "of"})
    members = materialise(nodes.select("id", "first.file", "first.at").join(coarse, "id"), "group-members")
    texts = rows_with(base, members.select("file", "at")).select("file", "at", F.col("row")[text].alias("text"))
    texts = texts.hint("merge").join(members, ["file", "at"]).select("id", "of", "text")
    sets = materialise(texts.mapInArrow(partial(_shingle_sets, n=shingle_words, keep=["id", "of"]), "id bigint, of bigint, shingles binary"), "shingle-sets")
    verified = link_groups(sets, ["shingles"], partial(_verify_batches, similarity=similarity), tile)
    groups = materialise(connected_components(verified.union(close).union(alike)), "copy-groups").withColumnRenamed("node", "id")
    named = nodes.select("id", "first").join(groups, "id", "left")
    stay = named.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("first").alias("first")).select("first.file", "first.at")
    return rows_with(base, stay).select("row.*")
