"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label are divided into cells of bounded size. A cell is clustered, every vector goes to its nearest
clusters, and each of these overlapping shards gets a robust-pruned graph, built by batches of greedy searches. The
adjacency lists of a vector are then united over its shards. All vectors search the united graph of every cell that may
hold a partner: a greedy search from the shards' medoids, which goes on over all that is within range. Pairs are
verified in double precision, recall is audited for each label against brute force over all its vectors, for a sample of queries.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, share_hash
from pointloom.llm.components import connected_components
from pointloom.llm.simhash import _local_forest
from pointloom.llm.topk import _matrix, finite_vector


def unit_rows(table: pa.Table, column: str = "embedding") -> np.ndarray:
    x = _matrix(table[column], table.num_rows).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def greedy_search(vectors: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries at once.

    ``vectors`` ends with a row of zeros that stands for missing neighbours (its index) in ``graph``. Returns the ids and
    similarities of the beams, which nodes each query has seen, and the pairs (query, node) that were expanded.
    """
    none, m = len(vectors) - 1, len(queries)
    seen = np.zeros((m, len(vectors)), dtype=bool)
    seen[:, none] = True
    seen[:, starts] = True
    ids = np.full((m, beam), none, dtype=np.int64)
    sims = np.full((m, beam), -np.inf, dtype=np.float32)
    first = starts[:beam]
    ids[:, : len(first)] = first
    sims[:, : len(first)] = queries @ vectors[first].T
    done = np.isinf(sims)
    active, rows, nodes = np.arange(m), [], []
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        best = open_sims.argmax(axis=1)
        going = ~np.isinf(open_sims[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        node = ids[active, best]
        done[active, best] = True
        rows.append(active)
        nodes.append(node)
        near = graph[node]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        s = np.matmul(vectors[near], queries[active][:, :, None])[:, :, 0]
        s = np.where(fresh, s, -np.inf)
        all_sims = np.concatenate((sims[active], s), axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, keep, axis=1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), keep, axis=1)
        new_done = np.concatenate((done[active], ~fresh), axis=1)
        done[active] = np.take_along_axis(new_done, keep, axis=1) | np.isinf(sims[active])
    return ids, sims, seen, np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(nodes) if nodes else np.empty(0, np.int64)


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, block: int = 256) -> np.ndarray:
    """Out-neighbours of ``points`` among their candidates: the nearest is taken, and candidates much nearer to it than to the point go."""
    none = len(vectors) - 1
    out = np.full((len(points), degree), none, dtype=np.int64)
    for a in range(0, len(points), block):
        p, c = points[a : a + block], np.sort(candidates[a : a + block], axis=1)
        alive = (c != none) & (c != p[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        near = vectors[c]
        far = 1 - np.matmul(near, vectors[p][:, :, None])[:, :, 0]  # half the squared distance
        index = np.arange(len(p))
        for r in range(degree):
            pick = np.where(alive, far, np.inf).argmin(axis=1)
            any_left = alive[index, pick]
            if not any_left.any():
                break
            out[a + index[any_left], r] = c[index, pick][any_left]
            between = 1 - np.matmul(near, near[index, pick][:, :, None])[:, :, 0]
            alive &= alpha * alpha * between > far
            alive[index, pick] = False
    return out


def _lists(owner: np.ndarray, value: np.ndarray, width: int, none: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values gathered by owner as padded rows; where an owner has more than ``width``, the most similar ones."""
    order = np.lexsort((-np.einsum("ij,ij->i", vectors[owner], vectors[value]), owner))
    owner, value = owner[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    rows = np.full((len(first), width), none, dtype=np.int64)
    ok = rank < width
    rows[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))[ok], rank[ok]] = value[ok]
    return owner[first], rows


def _reach(graph: np.ndarray, reached: np.ndarray, frontier: np.ndarray) -> None:
    """Mark all that can be reached from the frontier; the last row of ``graph`` leads nowhere."""
    while len(frontier):
        near = np.unique(graph[frontier])
        frontier = near[~reached[near]]
        reached[frontier] = True


def connect(vectors: np.ndarray, graph: np.ndarray, inserted: np.ndarray, medoid: int, degree: int) -> None:
    """Give every inserted point a way from the medoid: an unreachable group of points, such as copies that name only each
    other, gets an edge from the most similar reachable point, in the spare columns after the first ``degree``."""
    none = len(vectors) - 1
    reached = np.zeros(len(vectors), dtype=bool)
    reached[[medoid, none]] = True
    _reach(graph, reached, np.array([medoid]))
    lost = inserted[~reached[inserted]]
    best, source = np.full(len(lost), -np.inf, dtype=np.float32), np.full(len(lost), none)
    fresh = inserted[reached[inserted]]
    while len(lost):
        fresh = fresh[graph[fresh, -1] == none]  # these have a spare place left
        if len(fresh):
            sims = vectors[lost] @ vectors[fresh].T
            top = sims.argmax(axis=1)
            value = sims[np.arange(len(lost)), top]
            better = value > best
            best[better], source[better] = value[better], fresh[top[better]]
        i = int(best.argmax())
        if graph[source[i], -1] != none or not np.isfinite(best[i]):  # filled up meanwhile: look again among all
            best[source == source[i]] = -np.inf
            fresh = inserted[reached[inserted]]
            continue
        spare = degree + int((graph[source[i], degree:] != none).sum())
        graph[source[i], spare] = lost[i]
        before = reached.copy()
        reached[lost[i]] = True
        _reach(graph, reached, lost[i : i + 1])
        fresh = np.flatnonzero(reached & ~before)
        stay = ~reached[lost]
        lost, best, source = lost[stay], best[stay], source[stay]


def build_graph(unit: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 42) -> tuple[np.ndarray, int]:
    """The robust-pruned graph of one shard (missing neighbours are len(unit)) and its medoid; points enter in doubling batches."""
    n = len(unit)
    vectors = np.vstack((unit, np.zeros((1, unit.shape[1])))).astype(np.float32)
    medoid = int((unit @ unit.mean(axis=0)).argmax())
    graph = np.full((n + 1, degree + 8), n, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([medoid], order[order != medoid]))
    at = min(n, degree + 1)
    head = order[:at]
    graph[head, :degree] = robust_prune(vectors, head, np.tile(head, (at, 1)), degree, alpha)
    connect(vectors, graph, head, medoid, degree)
    while at < n:
        batch = order[at : min(n, 2 * at, at + 1024)]
        ids, _, _, rows, nodes = greedy_search(vectors, graph, np.array([medoid]), vectors[batch], beam)
        owner = np.concatenate((np.repeat(batch, beam), batch[rows], np.repeat(batch, len(batch[:64]))))
        value = np.concatenate((ids.ravel(), nodes, np.tile(batch[:64], len(batch))))  # a batch also gets to know a part of itself
        use = (value != n) & (owner != value)
        who, lists = _lists(owner[use], value[use], 2 * beam, n, vectors)
        graph[who, :degree] = robust_prune(vectors, who, lists, degree, alpha)
        source = np.repeat(who, degree)
        target = graph[who, :degree].ravel()
        use = target != n
        source, target = source[use], target[use]
        known = np.unique(target)
        back_owner = np.concatenate((target, np.repeat(known, degree)))
        back_value = np.concatenate((source, graph[known, :degree].ravel()))
        use = back_value != n
        who, lists = _lists(back_owner[use], back_value[use], 2 * beam, n, vectors)
        graph[who, :degree] = robust_prune(vectors, who, lists, degree, alpha)
        at += len(batch)
        connect(vectors, graph, order[:at], medoid, degree)
    return graph[:n], medoid


def search_range(unit: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float, slack: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity ``threshold`` or more that the graph leads to.

    The greedy search ends at the nearest nodes; from all seen within ``slack`` of the threshold it spreads over the
    graph until no new node is within that range.
    """
    vectors = np.vstack((unit, np.zeros((1, unit.shape[1])))).astype(np.float32)
    q = queries.astype(np.float32)
    ids, sims, seen, _, _ = greedy_search(vectors, graph, starts, q, beam)
    rows, cols = np.nonzero(sims >= threshold - slack)
    row, node = rows, ids[rows, cols]
    found = [(row, node)]
    # the beam forgets nodes that it has seen: what counts from here on is what has been compared for the range
    seen[:] = False
    seen[:, -1] = True
    seen[row, node] = True
    while len(row):
        fresh = np.zeros_like(seen)
        for a in range(0, len(row), 50_000):
            fresh[row[a : a + 50_000, None], graph[node[a : a + 50_000]]] = True
        fresh &= ~seen
        seen |= fresh
        row, node = np.nonzero(fresh)
        ok = np.concatenate([np.einsum("ij,ij->i", vectors[node[a : a + 50_000]], q[row[a : a + 50_000]]) for a in range(0, max(1, len(row)), 50_000)]) >= threshold - slack
        row, node = row[ok], node[ok]
        found.append((row, node))
    row, node = (np.concatenate(x) for x in zip(*found))
    exact = np.einsum("ij,ij->i", unit[node], queries[row]) >= threshold
    return row[exact], node[exact]


def _route(left: pa.Table, right: pa.Table, margin: float) -> pa.Table:
    """The cells of a block of vectors: that of the nearest pivot is home, those of pivots nearly as similar are asked too."""
    pivots = unit_rows(right, "at") if right.num_rows else None
    nid, cell, home = [], [], []
    if left.num_rows:
        ids, names = left["nid"].to_numpy(), right["pivot"].to_numpy() if right.num_rows else np.zeros(1, np.int64)
        sims = unit_rows(left) @ pivots.T if right.num_rows else np.zeros((len(ids), 1))
        order = np.argsort(names)  # ties go to the smaller name
        names, sims = names[order], sims[:, order]
        best = sims.argmax(axis=1)
        r, c = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - margin)
        nid, cell, home = ids[r], names[c], best[r] == c
    return pa.table({"nid": pa.array(nid, pa.int64()), "cell": pa.array(cell, pa.int64()), "home": pa.array(home, pa.bool_())})


def _shards(table: pa.Table, size: int, overlap: int) -> pa.Table:
    """Cluster a cell; rows (shard, nid) with each vector in its ``overlap`` nearest clusters."""
    unit, n = unit_rows(table), table.num_rows
    k = max(1, -(-n * overlap // size))
    ids = table["nid"].to_numpy()
    order = np.argsort(ids)
    centres = unit[order[np.random.default_rng(42).choice(n, size=k, replace=False)]]
    for _ in range(5):
        near = (unit @ centres.T).argmax(axis=1)
        total = np.stack([np.bincount(near, weights=unit[:, j], minlength=k) for j in range(unit.shape[1])], axis=1)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    take = min(overlap, k)
    shard = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :take]
    rows = np.repeat(np.arange(n), take)
    return pa.table({"label": table["label"].take(pa.array(rows)), "cell": table["cell"].take(pa.array(rows)), "sub": table["sub"].take(pa.array(rows)), "shard": pa.array(shard.ravel().astype(np.int32)), "nid": pa.array(ids[rows]), "embedding": table["embedding"].take(pa.array(rows))})


def _build(table: pa.Table, degree: int, beam: int, alpha: float) -> pa.Table:
    table = table.sort_by("nid")
    graph, medoid = build_graph(unit_rows(table), degree, beam, alpha)
    ids, n = table["nid"].to_numpy(), table.num_rows
    ok = graph != n
    flat = pa.array(np.append(ids, -1)[graph[ok]])
    ends = np.concatenate(([0], np.cumsum(ok.sum(axis=1)))).astype(np.int32)
    return pa.table({"nid": table["nid"], "near": pa.ListArray.from_arrays(pa.array(ends), flat), "medoid": pa.array(np.arange(n) == medoid)})


def _search(left: pa.Table, right: pa.Table, threshold: float, slack: float, beam: int) -> pa.Table:
    """One block of queries in one cell: links counted for each query, a forest of the links, and how many different vectors audited queries have.

    Where the block is the cell itself, a link that either end's search has found counts for both.
    """
    out = {"nid": [], "to": [], "n": []}

    def emit(nid: np.ndarray, to: np.ndarray | int, n: np.ndarray) -> None:
        out["nid"].append(nid)
        out["to"].append(np.full(len(nid), to) if isinstance(to, int) else to)
        out["n"].append(n)

    if left.num_rows and right.num_rows:
        left, right = left.sort_by("nid"), right.sort_by("nid")
        ids, weight, unit, n = right["nid"].to_numpy(), right["copies"].to_numpy(), unit_rows(right), right.num_rows
        near = right["near"].combine_chunks() if isinstance(right["near"], pa.ChunkedArray) else right["near"]
        lengths = np.diff(near.offsets.to_numpy())
        flat = np.searchsorted(ids, near.flatten().to_numpy(zero_copy_only=False))
        graph = np.full((n + 1, max(1, int(lengths.max(initial=0)))), n, dtype=np.int64)
        graph[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        starts = np.flatnonzero(right["medoid"].to_numpy(zero_copy_only=False))
        qid, queries = left["nid"].to_numpy(), unit_rows(left)
        linked = np.zeros((len(qid), n), dtype=bool)  # a byte for each pair of a block and a cell, both of bounded size
        for a in range(0, len(qid), 512):
            row, node = search_range(unit, graph, starts, queries[a : a + 512], threshold, slack, beam)
            linked[row + a, node] = True
        own = bool(left["own"][0].as_py())
        if own:  # queries are the cell's vectors, in the same order
            linked |= linked.T
            np.fill_diagonal(linked, False)
        count = np.concatenate([linked[a : a + 512] @ weight for a in range(0, len(qid), 512)]).astype(np.int64)
        some = np.flatnonzero(count)
        emit(qid[some], -1, count[some])
        names, place = np.unique(np.concatenate((qid, ids)), return_inverse=True)
        nodes, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(qid), 512):
            row, node = np.nonzero(linked[a : a + 512])
            forest = _local_forest(place[row + a], place[len(qid) + node], len(names))
            nodes.append(forest[0])
            roots.append(forest[1])
        node, root = _local_forest(np.concatenate(nodes), np.concatenate(roots), len(names))
        emit(names[node], names[root], np.zeros(len(node), np.int64))
        some = np.flatnonzero(left["audited"].to_numpy(zero_copy_only=False))
        emit(qid[some], -2, linked[some].sum(axis=1))
    return pa.table({c: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)) for c, x in out.items()})


def _partners(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Brute force: how many vectors of a block each audited query has as partners."""
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("nid", "n")})
    qid, ids = left["nid"].to_numpy(), right["nid"].to_numpy()
    near = (unit_rows(left) @ unit_rows(right).T >= threshold) & (qid[:, None] != ids[None, :])
    return pa.table({"nid": pa.array(qid), "n": pa.array(near.sum(axis=1).astype(np.int64))})


def embedding_links(vectors: DataFrame, *, threshold: float = 0.93, slack: float = 0.05, degree: int = 32, beam: int = 64, alpha: float = 1.2, shard: int = 1024, overlap: int = 2, cell: int = 8192, margin: float = 0.15, block: int = 2048, audit: int = 512, least_recall: float = 0.9) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is ``threshold`` or more. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without label, link with nothing. Equal vectors are
    indexed once and counted as often as they occur. component_id is the smallest vec_id reachable (null if there is none);
    kept tells whether it is the row's own. Vectors of different dimensions do not link.

    A link within a cell counts for both ends if either one's search finds it; across cells each vector counts what its own search finds.
    Nothing depends on the number of rows of a label but the number of cells: a label of more than ``cell`` vectors is
    divided by random pivots, queries also ask the cells of all pivots within ``margin`` of the nearest, and a cell that is still too
    large is dealt into several that are all asked. About ``audit`` queries of each label are compared with all vectors of the label; where their
    recall is below ``least_recall`` for any label, the search is repeated with a wider margin and beam; failing that twice more is an error.
    """
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.when(F.col("label").isNotNull() & finite_vector(F.col("embedding")), norm2 > 0).otherwise(F.lit(False))
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    key = F.when(usable, F.concat_ws("/", F.size("embedding"), "label")).alias("label")
    rows = rows.select("vec_id", "embedding", key, F.when(usable, F.xxhash64("embedding")).alias("h1"), F.when(usable, F.xxhash64(F.lit(1), "embedding")).alias("h2"))
    same = rows.where("label is not null").groupBy("label", "h1", "h2")
    nodes = same.agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "distinct-vectors")

    sizes = materialise(nodes.groupBy("label").agg(F.count("*").alias("in_label")), "label-sizes")
    sized = nodes.select("label", "nid", "embedding", "copies").join(sizes, "label")
    many = F.col("in_label") > cell
    pivots = sized.where(many & (share_hash(F.lit("pivot"), "nid") < F.lit(2.0 / cell))).select("label", F.col("nid").alias("pivot"), F.col("embedding").alias("at"))
    large = sized.where(many).withColumn("part", F.pmod(F.xxhash64("nid"), F.ceil(F.col("in_label") / cell)))
    parts = large.select("label", "part").distinct()
    spread = pivots.join(parts, "label").select(F.col("label").alias("of"), F.col("part").alias("to_part"), "pivot", "at")

    def route(margin: float) -> DataFrame:
        routed = large.groupBy("label", "part").cogroup(spread.groupBy("of", "to_part")).applyInArrow(partial(_route, margin=margin), "nid bigint, cell bigint, home boolean")
        routed = routed.union(sized.where(~many).select("nid", F.lit(0).cast("long"), F.lit(True)))
        return materialise(routed.join(nodes.select("nid", "label"), "nid"), "cells")

    routed = route(margin)
    cells = routed.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / cell).alias("subs"))
    audited = share_hash(F.lit("audit"), "nid") < F.lit(float(audit)) / F.col("in_label")
    full = sized.select("nid", "embedding", "copies", audited.alias("audited"))
    members = routed.where("home").join(cells, ["label", "cell"]).select("label", "cell", F.pmod(F.xxhash64("nid"), "subs").alias("sub"), "nid").join(full.drop("audited"), "nid")
    members = materialise(members, "cell-members")

    where = ["label", "cell", "sub"]
    kind = "label string, cell bigint, sub bigint, shard int, nid bigint, embedding " + nodes.schema["embedding"].dataType.simpleString()

    def cut(table: pa.Table) -> pa.Table:
        return _shards(table, shard, overlap)

    def build(table: pa.Table) -> pa.Table:
        return _build(table, degree, beam, alpha)

    shards = materialise(members.select(*where, "nid", "embedding").groupBy(*where).applyInArrow(cut, kind), "shards")
    edges = shards.groupBy(*where, "shard").applyInArrow(build, "nid bigint, near array<bigint>, medoid boolean")
    united = edges.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    index = materialise(members.join(united, "nid"), "united-graph")

    # the audit: each block of a label meets all audited queries of the label, whatever the cells
    blocks = sized.withColumn("of", F.pmod(F.xxhash64("nid"), F.ceil(F.col("in_label") / cell)))
    sample = sized.where(audited).withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("in_label") / cell) - 1)))
    sample = materialise(sample.select("label", "of", "nid", "embedding"), "audit-sample")
    partners = sample.groupBy("label", "of").cogroup(blocks.select(F.col("label").alias("at_label"), F.col("of").alias("at_of"), "nid", "embedding").groupBy("at_label", "at_of"))
    partners = partners.applyInArrow(partial(_partners, threshold=threshold), "nid bigint, n bigint").groupBy("nid").agg(F.sum("n").alias("partners")).where("partners > 0")
    partners = materialise(partners.join(nodes.select("nid", "label"), "nid"), "audited-queries")

    for wider in (1, 2, 4):
        if wider > 1:
            routed = route(margin + 0.2 * (wider - 1))
        asks = routed.join(cells, ["label", "cell"]).select("label", "cell", "home", "subs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), "nid")
        asks = asks.withColumn("own", F.col("home") & (F.col("sub") == F.pmod(F.xxhash64("nid"), "subs"))).drop("home", "subs")
        # block 0 is the cell's own vectors, the others ask from outside
        load = asks.where("not own").groupBy(*where).agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = F.when(F.col("own"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("nid"), "blocks") + 1)
        asks = asks.join(load, where, "left").withColumn("block", dealt).drop("blocks").join(full.drop("copies"), "nid")
        right = index.join(load, where, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(0)))))
        right = right.select(*(F.col(c).alias(f"at_{c}") for c in (*where, "block")), "nid", "embedding", "copies", "near", "medoid")
        search = partial(_search, threshold=threshold, slack=slack, beam=beam * wider)
        found = asks.groupBy(*where, "block").cogroup(right.groupBy(*(f"at_{c}" for c in (*where, "block")))).applyInArrow(search, "nid bigint, to bigint, n bigint")
        found = materialise(found, "embedding-links")
        got = found.where("to = -2").groupBy("nid").agg(F.sum("n").alias("got"))
        recall = partners.join(got, "nid", "left").groupBy("label").agg(F.sum("partners").alias("partners"), F.coalesce(F.sum("got"), F.lit(0)).alias("got"))
        poor = recall.where(F.col("got") < F.lit(least_recall) * F.col("partners")).first()
        if poor is None:
            break
    else:
        raise RuntimeError(f"the graph finds {poor.got} of {poor.partners} audited links of label {poor.label}")
    counts = found.where("to = -1").groupBy("nid").agg(F.sum("n").alias("n"))
    groups = materialise(connected_components(found.where("to >= 0").select(F.col("nid").alias("a"), F.col("to").alias("b"))), "components")
    named = nodes.select("nid", "label", "h1", "h2", "copies", "least").join(counts, "nid", "left").join(groups.withColumnRenamed("node", "nid"), "nid", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "nid")), "named-vectors")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component_id").alias("reached"))
    out = rows.select("vec_id", "label", "h1", "h2").join(materialise(named, "vector-answers"), ["label", "h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("reached"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x) OR x IS NULL)) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
