"""Pose graphs with plain weights, of any size, eliminated chunk by chunk.

Links pull by weight times the difference of what their ends move, so a system has a number for each link, and for each pose a side of four
numbers and a ground, the weight by which it hangs on the fixed pose. Poses are cut into chunks by their number. A task eliminates those of a chunk
that are linked within it only and leaves to the others sides, grounds and links, by adding products of positive numbers only, so that
no digits of weights are lost on a path of any length. What is left, some poses on both sides of each cut, is cut into larger chunks and so on; then
each chunk is solved once more, between the poses that are known by then. Nothing is joined: a link goes to the chunks of its ends. All of it is
done twice, the second time from the poses found, which leaves errors of some units in the last place.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pointloom.operators import blocks
from pointloom.operators.durable import materialise

DOF = ("x", "y", "z", "yaw")

#: Poses and links of a chunk, about.
ROWS = 100_000

#: Numbers drawn for each chunk to find where to cut.
DRAWN = 32

#: What a row of a chunk is: a pose, a link within the chunk, a link of which p or q is here, a link to the fixed pose, a pose that is known.
POSE, INSIDE, FROM_HERE, TO_HERE, TO_FIXED, KNOWN = range(6)

VALUES = ", ".join(f"{c} double" for c in DOF)
DEALT = f"chunk int, what tinyint, g bigint, p bigint, q bigint, w double, {VALUES}"
LEFT = f"g bigint, p bigint, q bigint, w double, {VALUES}, missing boolean"
SOLVED = f"g bigint, v bigint, part bigint, {VALUES}"


# --- one system in one task -----------------------------------------------------------------------------------------


def _spread(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, v[:, k], n) for k in range(v.shape[1])], axis=1)


def merged(p: np.ndarray, q: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two ends, each pair once, with the sum of its weights."""
    keys, where = np.unique(np.minimum(p, q) * n + np.maximum(p, q), return_inverse=True)
    return keys // n, keys % n, np.bincount(where, w, len(keys))


def parts(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each node the smallest one of its connected part, parts being hooked to smaller ones until all links are within one."""
    part = np.arange(n)
    while (part[p] != part[q]).any():
        np.minimum.at(part, np.maximum(part[p], part[q]), np.minimum(part[p], part[q]))
        while (part[part] != part).any():
            part = part[part]
    return part


def in_rounds(live: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, ground: np.ndarray, side: np.ndarray) -> tuple:
    """Eliminates those of ``live`` with up to two neighbours in rounds, in each a random independent set of them, which leave a share of what
    pulls at them to their neighbours and link these; so the cost is proportional to the rows. Links are merged; ``side`` is changed.

    Returns what is left of live, p, q, w and ground, and the rounds for ``follow``.
    """
    n, random, rounds = len(ground), np.random.default_rng(0), []
    while len(live):
        few = live[(np.bincount(p, minlength=n) + np.bincount(q, minlength=n))[live] <= 2]
        draw = np.full(n, -1)
        draw[few] = random.permutation(len(few))
        rivals = (draw[p] >= 0) & (draw[q] >= 0)
        draw[np.where(draw[p] < draw[q], p, q)[rivals]] = -1
        gone = few[draw[few] >= 0]
        if len(gone) < len(live) / 50:
            break
        out = np.zeros(n, bool)
        out[gone] = True
        mine = out[p] | out[q]
        v, u, pull = np.where(out[p], p, q)[mine], np.where(out[p], q, p)[mine], w[mine]
        order = np.argsort(v, kind="stable")
        v, u, pull = v[order], u[order], pull[order]
        total = ground + np.bincount(v, pull, n)
        share = pull / total[v]
        side += _spread(u, share[:, None] * side[v], n)
        ground = ground + np.bincount(u, share * ground[v], n)
        first = np.flatnonzero(v[1:] == v[:-1])  # the first of two neighbours
        p, q, w = merged(np.concatenate((p[~mine], u[first])), np.concatenate((q[~mine], u[first + 1])), np.concatenate((w[~mine], pull[first] * share[first + 1])), n)
        rounds.append((gone, total[gone], v, u, share))
        live = live[~out[live]]
    return live, p, q, w, ground, rounds


def follow(rounds: list[tuple], side: np.ndarray, x: np.ndarray) -> None:
    """Gives ``x`` the values of nodes that went in rounds, from those of their neighbours."""
    for gone, total, v, u, share in reversed(rounds):
        own = np.where(total > 0, 1 / np.where(total > 0, total, 1.0), 0.0)[:, None] * side[gone]
        x[gone] = own + _spread(np.searchsorted(gone, v), share[:, None] * x[u], len(gone))


def one_by_one(live: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, ground: np.ndarray, side: np.ndarray, most: int) -> tuple:
    """Eliminates nodes one after the other, that of fewest neighbours first, until there are more than ``most`` links. ``ground`` and ``side`` are changed.

    Returns what is left of live, p, q and w, and the steps for ``follow_steps``.
    """
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for i, j, x in zip(p.tolist(), q.tolist(), w.tolist()):
        near[i][j] = near[j][i] = x
    waiting, links, steps = set(live.tolist()), len(p), []
    heap = [(len(near[v]), v) for v in waiting]
    heapq.heapify(heap)
    while heap and links <= most:
        degree, v = heapq.heappop(heap)
        if v not in waiting or degree != len(near[v]):
            continue
        waiting.discard(v)
        us, pull = [*near[v]], [*near.pop(v).values()]
        total = ground[v] + sum(pull)
        share = np.array(pull) / total if us else np.empty(0)
        links -= degree
        for u in us:
            del near[u][v]
        for i, (u, s) in enumerate(zip(us, share.tolist())):
            of = near[u]
            for k in range(i + 1, degree):
                t = us[k]
                if t not in of:
                    of[t], links = 0.0, links + 1
                of[t] = near[t][u] = of[t] + s * pull[k]
        if us:
            ground[us] += share * ground[v]
            side[us] += share[:, None] * side[v]
        for u in us:
            if u in waiting:
                heapq.heappush(heap, (len(near[u]), u))
        steps.append((v, total, us, share))
    rest = [(u, t, x) for u, of in near.items() for t, x in of.items() if u < t]
    p, q, w = (np.array([r[k] for r in rest], kind) for k, kind in enumerate((int, int, float)))
    return np.array(sorted(waiting), int), p, q, w, steps


def follow_steps(steps: list[tuple], side: np.ndarray, x: np.ndarray) -> None:
    """Gives ``x`` the values of nodes that went one by one."""
    for v, total, us, share in reversed(steps):
        x[v] = (side[v] / total if total > 0 else 0.0) + share @ x[us]


# --- rows of chunks -------------------------------------------------------------------------------------------------


def _places(bounds: list[tuple[int, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The chunk of each pose, by its graph and number; ``bounds`` are the first ones of all chunks but the first, in order."""
    graphs, ids = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    def place(g: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v), np.int32)
        for one in np.unique(g):
            mine, low, high = g == one, *np.searchsorted(graphs, [one, one + 1])
            out[mine] = low + np.searchsorted(ids[low:high], v[mine], side="right")
        return out

    return place


def _batch(chunk: np.ndarray, what: int | np.ndarray, g: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    what = np.broadcast_to(np.asarray(what, np.int8), len(p))
    columns = [pa.array(c) for c in (chunk, what, g, p, q, w, *(np.ascontiguousarray(values[:, k]) for k in range(4)))]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "what", "g", "p", "q", "w", *DOF])


def _numpy(rows: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(**({} if isinstance(rows, pa.Table) else {"zero_copy_only": False})) for c in names]


def _deal_poses(place: Callable, what: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, p, q, w, *values = _numpy(batch, "g", "p", "q", "w", *DOF)
                yield _batch(place(g, p), what, g, p, q, w, np.stack(values, axis=1))

    return work


def _deal_links(place: Callable, origins: dict[int, list[float]], halves: bool):
    """Links go to the chunk of both their ends, or, if ``halves``, to the chunks of either; one to the fixed pose, to that of the other, as a place to be at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, p, q, w, *values = _numpy(batch, "g", "p", "q", "w", *DOF)
            used = (p != q) & (w > 0)
            g, p, q, w, values = g[used], p[used], q[used], w[used], np.stack(values, axis=1)[used]
            if not len(g):
                continue
            held = (p == g) | (q == g)
            if held.any():
                forth = (p == g)[held]
                v = np.where(forth, q[held], p[held])
                at = np.array([origins[k] for k in g[held].tolist()]) + np.where(forth, 1.0, -1.0)[:, None] * values[held]
                yield _batch(place(g[held], v), TO_FIXED, g[held], v, v, w[held], at)
                g, p, q, w, values = g[~held], p[~held], q[~held], w[~held], values[~held]
            a, b = place(g, p), place(g, q)
            yield _batch(a[a == b], INSIDE, *(c[a == b] for c in (g, p, q, w, values)))
            if halves and (a != b).any():
                for chunk, what in ((a, FROM_HERE), (b, TO_HERE)):
                    yield _batch(chunk[a != b], what, *(c[a != b] for c in (g, p, q, w, values)))

    return work


def _each_chunk(work: Callable[[pa.Table], dict[str, np.ndarray]], kind: pa.Schema):
    """``work`` for the rows of one chunk after the other; rows come in order of their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if held and chunk[low] != now:
                    yield from pa.table(work(pa.Table.from_batches(held)), schema=kind).to_batches(10_000)
                    held = []
                now = chunk[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from pa.table(work(pa.Table.from_batches(held)), schema=kind).to_batches(10_000)

    return run


class _Chunk:
    """The poses of a chunk in order of their number, and what pulls at them. Poses of the first level have places, later ones sides; links of the
    first level have what was measured, later ones how they pull q, and p the other way."""

    def __init__(self, rows: pa.Table, first: bool):
        what, g, p, q, w, *values = _numpy(rows, "what", "g", "p", "q", "w", *DOF)
        self.rows = {k: (g[m], p[m], q[m], w[m], values[m]) for values in [np.stack(values, axis=1)] for k in range(6) for m in [what == k]}
        g, ids, _, w, values = self.rows[POSE]
        order = np.argsort(ids, kind="stable")
        self.g, self.ids, n = g[order], ids[order], len(ids)
        self.x, self.side = (values[order], np.zeros((n, 4))) if first else (np.zeros((n, 4)), values[order])
        self.ground = np.zeros(n) if first else w[order]
        self.missing = np.unique(np.concatenate([v[~self.has(v)] for v in (self.rows[INSIDE][1], self.rows[INSIDE][2], self.rows[FROM_HERE][1], self.rows[TO_HERE][2], self.rows[TO_FIXED][1])]))
        if len(self.missing):
            return
        _, p, q, w, z = self.rows[INSIDE]
        self.p, self.q, self.w = self.at(p), self.at(q), w
        pull = w[:, None] * (z - (self.x[self.q] - self.x[self.p])) if first else z
        _, v, _, w, z = self.rows[TO_FIXED]
        v = self.at(v)
        self.ground = self.ground + np.bincount(v, w, n)
        self.side = self.side + _spread(self.q, pull, n) - _spread(self.p, pull, n) + _spread(v, w[:, None] * (z - self.x[v]), n)

    def at(self, v: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, v)

    def has(self, v: np.ndarray) -> np.ndarray:
        return self.ids[np.minimum(self.at(v), len(self.ids) - 1)] == v if len(self.ids) else np.zeros(len(v), bool)


def _reduce(first: bool):
    """What a chunk leaves: rows of poses (p = q) with grounds and sides, and of links with weights and pulls; both are to be summed."""

    def work(rows: pa.Table) -> dict[str, np.ndarray]:
        chunk = _Chunk(rows, first)
        out = []  # g, p, q, w, values
        if not len(chunk.missing):
            n = len(chunk.ids)
            kept = np.zeros(n, bool)
            for what in (FROM_HERE, TO_HERE):
                g, p, q, w, z = chunk.rows[what]
                v, sign = chunk.at(p if what == FROM_HERE else q), 1.0 if what == FROM_HERE else -1.0
                kept[v] = True
                if first:  # the share of its pull that is known here goes with the link, for both ends have to feel the very same one
                    pull = w[:, None] * (chunk.x[v] + (z if what == FROM_HERE else 0.0)) * (sign * np.where(p < q, 1.0, -1.0))[:, None]
                else:
                    chunk.side = chunk.side - sign * _spread(v, z, n)
                    pull = np.zeros((len(g), 4))
                out.append((g, np.minimum(p, q), np.maximum(p, q), w * (what == FROM_HERE), pull))
            p, q, w = merged(chunk.p, chunk.q, chunk.w, n)
            live, p, q, w, ground, _ = in_rounds(np.flatnonzero(~kept), p, q, w, chunk.ground, chunk.side)
            live, p, q, w, _ = one_by_one(live, p, q, w, ground, chunk.side, rows.num_rows)
            kept[live] = True
            v = np.flatnonzero(kept)
            out.append((chunk.g[v], chunk.ids[v], chunk.ids[v], ground[v], chunk.side[v]))
            low, high = chunk.ids[np.minimum(p, q)], chunk.ids[np.maximum(p, q)]
            out.append((chunk.g[p], low, high, w, np.zeros((len(p), 4))))
        lost = chunk.missing
        out.append((lost, lost, lost, np.zeros(len(lost)), np.zeros((len(lost), 4))))
        g, p, q, w, values = (np.concatenate(c) for c in zip(*out))
        return {"g": g, "p": p, "q": q, "w": w, **{c: values[:, k] for k, c in enumerate(DOF)}, "missing": np.arange(len(g)) >= len(g) - len(lost)}

    return work


def _finish(first: bool, moves: bool):
    """The poses of a chunk between those that are known: where they are if it is of the first level, else how far they move, and what part they hang on.

    That is the fixed pose, or some pose of a part that hangs on none. Such a part stays where it is as a whole; ``moves`` are asked for if one of them is in several chunks.
    """

    def work(rows: pa.Table) -> dict[str, np.ndarray]:
        chunk = _Chunk(rows, first)
        g, ids, n, x = chunk.g, chunk.ids, len(chunk.ids), np.zeros((len(chunk.ids), 4))
        _, v, hung, _, values = chunk.rows[KNOWN]
        v, known = chunk.at(v), np.zeros(n, bool)
        x[v], known[v] = values, True
        part = parts(chunk.p, chunk.q, n)
        on = ids[part].copy()  # of parts that hang on nothing, the smallest number
        held = (chunk.ground > 0) | (ids == g)
        on[part[held]] = g[held]
        on[part[v]] = hung
        on = on[part]

        p, q, w = chunk.p, chunk.q, chunk.w
        ground, side = chunk.ground, chunk.side
        for here, there in ((p, q), (q, p)):
            ends = known[here] & ~known[there]
            ground = ground + np.bincount(there[ends], w[ends], n)
            side = side + _spread(there[ends], w[ends, None] * x[here[ends]], n)
        free = ~known[p] & ~known[q]
        p, q, w = merged(p[free], q[free], w[free], n)
        live, p, q, w, ground, rounds = in_rounds(np.flatnonzero(~known), p, q, w, ground, side)
        *_, steps = one_by_one(live, p, q, w, ground, side, 1 << 62)  # what would not go before is known by now
        follow_steps(steps, side, x)
        follow(rounds, side, x)

        out = {"g": g, "v": ids}
        if first:
            seen = np.zeros(n, bool)
            seen[part[v]] = True
            loose = ~seen[part] & (on != g)
            x[loose] -= (_spread(part, x, n) / np.maximum(np.bincount(part, minlength=n), 1)[:, None])[part[loose]]
            on = np.where(loose, g, on)
            out |= {"part": on} | {c: chunk.x[:, k] + x[:, k] for k, c in enumerate(DOF)}
            return out | ({f"move_{c}": x[:, k] for k, c in enumerate(DOF)} if moves else {})
        return out | {"part": on} | {c: x[:, k] for k, c in enumerate(DOF)}

    return work


# --- tables ---------------------------------------------------------------------------------------------------------


def _cuts(poses: DataFrame, n: int, chunks: int) -> list[tuple[int, int]]:
    """Where to cut poses (g, p) into about so many chunks: from some numbers for each, drawn by hash."""
    if chunks == 1:
        return []
    drawn = poses.select("g", "p").where(F.pmod(F.xxhash64("p"), F.lit(max(1, n // (DRAWN * chunks)))) == 0).collect()
    drawn = sorted({(r.g, r.p) for r in drawn})
    step = max(1, len(drawn) // chunks)
    return drawn[step::step]


def _schema(spark_kind: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(spark_kind))


def _level(poses: DataFrame, links: DataFrame, n: int, m: int, first: bool, origins: dict[int, list[float]], **options) -> tuple[DataFrame, bool]:
    """Rows ``SOLVED`` of all poses (g, p, q = p, w, values) with links (g, p, q, w, values), n and m of them; and whether by elimination only."""
    place = _places(_cuts(poses, n, -(-(n + m) // ROWS)))
    own = poses.mapInArrow(_deal_poses(place, POSE), DEALT)
    together = lambda rows: rows.repartition("chunk").sortWithinPartitions("chunk")
    dealt = together(own.unionByName(links.mapInArrow(_deal_links(place, origins, True), DEALT)))
    left = dealt.mapInArrow(_each_chunk(_reduce(first), _schema(LEFT)), LEFT)
    left = materialise(left.groupBy("g", "p", "q").agg(F.sum("w").alias("w"), *(F.sum(c).alias(c) for c in DOF), F.max("missing").alias("missing")), "chunk-left")
    nodes, edges, missing = left.agg(F.count_if(F.expr("p = q")), F.count_if(F.expr("p <> q")), F.count_if("missing")).first()
    if missing:
        raise ValueError("a factor names a pose that is not there")
    own = own.unionByName(links.mapInArrow(_deal_links(place, origins, False), DEALT))
    loose, direct = False, True
    if nodes:
        left = left.drop("missing")
        solve = _by_blocks if nodes > n / 2 else _level
        known, direct = solve(left.where("p = q"), left.where("p <> q"), nodes, edges, False, {}, **options)
        known = materialise(known, "chunk-known")
        loose = first and not known.where("part <> g").isEmpty()
        known = known.select("g", F.col("v").alias("p"), F.col("part").alias("q"), F.lit(0.0).alias("w"), *DOF)
        own = own.unionByName(known.mapInArrow(_deal_poses(place, KNOWN), DEALT))
    kind = SOLVED + "".join(f", move_{c} double" for c in DOF if loose)
    done = together(own).mapInArrow(_each_chunk(_finish(first, loose), _schema(kind)), kind)
    if not loose:
        return done, direct
    done = materialise(done, "chunk-loose")
    means = done.where("part <> g").groupBy("part").agg(*(F.avg(f"move_{c}").alias(f"mean_{c}") for c in DOF))
    back = done.join(means.withColumnRenamed("part", "_part"), (F.col("part") == F.col("_part")) & (F.col("part") != F.col("g")), "left")
    return back.select("g", "v", "part", *((F.col(c) - F.coalesce(f"mean_{c}", F.lit(0.0))).alias(c) for c in DOF)), direct


def _by_blocks(poses: DataFrame, links: DataFrame, n: int, m: int, first: bool, origins: dict[int, list[float]], **options) -> tuple[DataFrame, bool]:
    """``_level`` for what has many neighbours everywhere, by ``blocks.solve``."""
    flat = lambda c: F.array(*(c if i % 5 == 0 else F.lit(0.0) for i in range(16)))
    ends = links.select("g", "p", "w", *((-F.col(c)).alias(c) for c in DOF)).unionByName(links.select("g", F.col("q").alias("p"), "w", *DOF))
    ends = ends.groupBy("g", "p").agg(F.sum("w").alias("total"), *(F.sum(c).alias(f"pull_{c}") for c in DOF))
    plus = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0.0))
    side = F.array(*(plus(c, f"pull_{c}") for c in DOF))
    nodes = poses.join(ends, ["g", "p"], "left").select("g", F.col("p").alias("v"), flat(plus("w", "total")).alias("d"), side.alias("b"), (4 * plus("w", "total")).alias("s"))
    x = blocks.solve(nodes, links.select("g", "p", "q", flat(-F.col("w")).alias("h")), 4, **options)
    return x.select("g", "v", F.col("g").alias("part"), *(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(DOF))), False


def solve(poses: DataFrame, factors: DataFrame, n: int, m: int, **options) -> DataFrame:
    """Poses (g, id, x ..) that fit factors (g, a, b, x .., weight) best, g being the number of the fixed pose of their graph; n and m are the numbers of rows.

    Weights are at least zero and numbers finite. ``options`` are those of ``blocks.solve``, to which what has many neighbours everywhere is
    left. All links of one pose to other chunks are held by one task, but for those of the fixed pose. ValueError if a pose is missing.
    """
    number = lambda c: F.col(c).cast("long")
    values = [F.col(c).cast("double").alias(c) for c in DOF]
    rows = poses.select(number("g").alias("g"), number("id").alias("p"), number("id").alias("q"), F.lit(0.0).alias("w"), *values)
    links = factors.select(number("g").alias("g"), number("a").alias("p"), number("b").alias("q"), F.col("weight").cast("double").alias("w"), *values)
    origins = {r.g: [r[c] for c in DOF] for r in rows.where("g = p").collect()}  # one of each large graph
    done, direct = _level(rows, links, n, m, True, origins, **options)
    if direct:  # once more from there: sums of large pulls have left some millions of rounding errors, which add up along a path
        rows = materialise(done.select("g", F.col("v").alias("p"), F.col("v").alias("q"), F.lit(0.0).alias("w"), *DOF), "chunk-poses")
        done, _ = _level(rows, links, n, m, True, origins, **options)
    return done.select(F.col("v").cast(poses.schema["id"].dataType).alias("id"), *DOF)
