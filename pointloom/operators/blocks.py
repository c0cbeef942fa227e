"""Symmetric systems of small blocks over a graph of any size, solved by elimination.

A system has a row for each node (g, v, d, b, s) - its graph, its number, the d x d block and the side as arrays, and a size that its zeros
are measured by - and one for each pair of linked nodes (g, p, q, h) with p < q. Poses of a path have two neighbours, and
loop closures add a few: nodes of up to two neighbours are eliminated in rounds, in each an independent set of them chosen by hash. Their
neighbours inherit a block and a side each and are linked to one another, so the system never grows, and a path of n nodes is gone
after O(log n) rounds. Before that, nodes are cut into stretches by their number: where most are linked within their stretch only, as poses
numbered by time are, all of these are eliminated at once, each stretch densely by itself, and few rounds do for any length. What is left of a
graph is solved by one task if it is small, and by conjugate gradients over the tables if nothing else helps. Then the rounds are gone
through backwards, each node following from its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import scans
from pointloom.operators.durable import materialise

NUMBERS = "array<double>"


def summed(rows: DataFrame, by: tuple[str, ...], arrays: dict[str, int], largest: tuple[str, ...] = ()) -> DataFrame:
    """Sums of arrays, element by element, of so many elements each, and the largest of other columns."""
    sums = [F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(c) for c, n in arrays.items()]
    return rows.groupBy(*by).agg(*sums, *(F.max(c).alias(c) for c in largest))


def _inverse(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inverses of symmetric blocks; directions of nothing but rounding error, by the size of each, stay where they are."""
    values, vectors = np.linalg.eigh((d + d.transpose(0, 2, 1)) / 2)
    good = values > 1e-11 * np.maximum(s, 1e-300)[:, None]
    return (vectors * np.where(good, 1 / np.where(good, values, 1.0), 0.0)[:, None, :]) @ vectors.transpose(0, 2, 1)


def _stack(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), int(np.prod(values.shape[1:])))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def transposed(h: Column, n: int) -> Column:
    return F.array(*(F.get(h, F.lit(n * (i % n) + i // n)) for i in range(n * n)))


def both_ways(edges: DataFrame, n: int) -> DataFrame:
    """Rows (g, v, u, h): every link from both ends, h being the block in the rows of v."""
    return edges.select("g", F.col("p").alias("v"), F.col("q").alias("u"), "h").unionByName(edges.select("g", F.col("q").alias("v"), F.col("p").alias("u"), transposed(F.col("h"), n).alias("h")))


def _stars(nodes: DataFrame, edges: DataFrame, n: int, turn: int) -> DataFrame:
    """An independent set of nodes with up to two neighbours: rows (g, v, d, b, s, near) with the neighbours and their blocks."""
    links = both_ways(edges, n)
    degree = links.groupBy("g", "v").agg(F.count("*").alias("n"))
    few = nodes.join(degree, ["g", "v"], "left").where(F.coalesce("n", F.lit(0)) <= 2).drop("n")
    few = few.withColumn("draw", F.xxhash64(F.lit(turn), "v"))
    rival = few.select("g", F.col("v").alias("u"), F.struct("draw", "v").alias("rival"))
    near = links.join(few.select("g", "v", "draw"), ["g", "v"]).join(rival, ["g", "u"], "left")
    near = near.groupBy("g", "v").agg(F.max("rival").alias("rival"), F.collect_list(F.struct("u", "h")).alias("near"))  # two at most
    chosen = few.join(near, ["g", "v"], "left").where(F.col("rival").isNull() | (F.col("rival") < F.struct("draw", "v")))
    return chosen.select("g", "v", "d", "b", "s", F.coalesce("near", F.expr(f"cast(array() as array<struct<u: bigint, h: {NUMBERS}>>)")).alias("near"))


def _inherited(n: int):
    """What eliminated nodes leave to their neighbours: rows (g, p, q, d, b, h), a block and side of p, or the link of p and q."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy(zero_copy_only=False)
            inverse = _inverse(_stack(batch.column("d"), n, n), batch.column("s").to_numpy())
            side = np.einsum("kij,kj->ki", inverse, _stack(batch.column("b"), n))
            near = batch.column("near")
            count = np.diff(near.offsets.to_numpy())
            flat = near.flatten()
            u, h = flat.field("u").to_numpy(), _stack(flat.field("h"), n, n)
            of = np.repeat(np.arange(batch.num_rows), count)
            left = h.transpose(0, 2, 1)
            out_d = -np.einsum("kij,kjl,klm->kim", left, inverse[of], h)
            out_b = -np.einsum("kij,kj->ki", left, side[of])
            first = np.flatnonzero((np.diff(of, append=-1) == 0)) if len(of) else np.empty(0, int)  # the first of two neighbours
            link = -np.einsum("kij,kjl,klm->kim", left[first], inverse[of[first]], h[first + 1])
            swap = u[first] > u[first + 1]
            link[swap] = link[swap].transpose(0, 2, 1)
            low, high = np.minimum(u[first], u[first + 1]), np.maximum(u[first], u[first + 1])
            empty = lambda k: pa.nulls(k, pa.list_(pa.float64()))
            columns = [
                pa.array(np.concatenate((g[of], g[of[first]])), pa.int64()), pa.array(np.concatenate((u, low)), pa.int64()),
                pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(high, pa.int64())]), pa.concat_arrays([_lists(out_d), empty(len(first))]),
                pa.concat_arrays([_lists(out_b), empty(len(first))]), pa.concat_arrays([empty(len(u)), _lists(link)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "p", "q", "d", "b", "h"])

    return work


def _followed(n: int):
    """The values of eliminated nodes from those of their neighbours."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _stack(batch.column("b"), n).copy()
            near = batch.column("near")
            flat = near.flatten()
            of = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy()))
            if len(of):
                np.subtract.at(b, of, np.einsum("kij,kj->ki", _stack(flat.field("h"), n, n), _stack(flat.field("x"), n)))
            x = np.einsum("kij,kj->ki", _inverse(_stack(batch.column("d"), n, n), batch.column("s").to_numpy()), b)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("v"), _lists(x)], names=["g", "v", "x"])

    return work


def _stretches(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Rows (g, v, part) of the nodes that are linked to nodes of their own stretch only: so many nodes that follow one another by number."""
    numbered = scans.running(nodes.select("g", "v"), [F.col("g"), F.col("v")], {}, "block-numbers")
    cells = materialise(numbered.select("g", "v", F.floor((F.col("position") - 1) / size).alias("part")), "block-parts")
    at = lambda end: cells.select("g", F.col("v").alias(end), F.col("part").alias(f"part_{end}"))
    far = edges.select("g", "p", "q").join(at("p"), ["g", "p"]).join(at("q"), ["g", "q"]).where("part_p <> part_q")
    far = far.select("g", F.explode(F.array("p", "q")).alias("v")).distinct()
    return materialise(cells.join(far, ["g", "v"], "left_anti"), "block-inside")


def _dense_inverse(a: np.ndarray, s: float) -> np.ndarray:
    """``_inverse`` of one matrix, by factors where no pivot comes near to nothing."""
    try:
        lower = np.linalg.cholesky((a + a.T) / 2)
        if (np.diagonal(lower) ** 2).min() > 1e-7 * s:
            half = np.linalg.solve(lower, np.eye(len(a)))
            return half.T @ half
    except np.linalg.LinAlgError:
        pass
    return _inverse(a[None], np.array([s]))[0]


STRETCH = f"g bigint, part bigint, vs array<bigint>, us array<bigint>, x0 {NUMBERS}, k {NUMBERS}, d {NUMBERS}, b {NUMBERS}"


def _stretch(nodes: pd.DataFrame, edges: pd.DataFrame, n: int) -> pd.DataFrame:
    """Eliminates the inner nodes of a stretch: their values are x0 less k times those of the nodes ``us`` around, which inherit the matrix d and the side b."""
    if not len(nodes):
        return pd.DataFrame({c.split()[0]: [] for c in STRETCH.split(", ")})
    nodes = nodes.sort_values("v")
    v = nodes["v"].to_numpy()
    p, q = edges["p"].to_numpy(dtype=v.dtype), edges["q"].to_numpy(dtype=v.dtype)
    h = np.stack(edges["h"].to_list()).reshape(-1, n, n) if len(edges) else np.zeros((0, n, n))
    u = np.setdiff1d(np.concatenate((p, q)), v)
    inside_p, inside_q = np.isin(p, v), np.isin(q, v)
    own, side = np.zeros((len(v), n, len(v), n)), np.zeros((len(v), n, len(u), n))
    own[np.arange(len(v)), :, np.arange(len(v)), :] = np.stack(nodes["d"].to_list()).reshape(-1, n, n)
    both, one, other = inside_p & inside_q, inside_p & ~inside_q, ~inside_p & inside_q
    i, j = np.searchsorted(v, p[both]), np.searchsorted(v, q[both])
    own[i, :, j, :], own[j, :, i, :] = h[both], h[both].transpose(0, 2, 1)
    side[np.searchsorted(v, p[one]), :, np.searchsorted(u, q[one]), :] = h[one]
    side[np.searchsorted(v, q[other]), :, np.searchsorted(u, p[other]), :] = h[other].transpose(0, 2, 1)
    side = side.reshape(len(v) * n, -1)
    inverse = _dense_inverse(own.reshape(len(v) * n, -1), float(nodes["s"].max()))
    x0, k = inverse @ np.concatenate(nodes["b"].to_list()), inverse @ side
    row = [nodes["g"].iloc[0], nodes["part"].iloc[0], v, u, x0, k.ravel(), -(side.T @ k).ravel(), -(side.T @ x0)]
    return pd.DataFrame([row], columns=[c.split()[0] for c in STRETCH.split(", ")])


def _stretch_left(n: int):
    """What stretches leave to the nodes around: rows as of ``_inherited``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for g, us, d, b in zip(frame["g"], frame["us"], frame["d"], frame["b"]):
                m = len(us)
                d = np.asarray(d).reshape(m, n, m, n)
                for i in range(m):
                    rows.append((g, us[i], None, d[i, :, i].ravel(), b[n * i : n * i + n], None))
                    rows.extend((g, us[i], us[j], None, None, d[i, :, j].ravel()) for j in range(i + 1, m) if d[i, :, j].any())
            out = pd.DataFrame(rows, columns=["g", "p", "q", "d", "b", "h"])
            yield out.astype({"g": "int64", "p": "int64", "q": "Int64"})

    return work


def _stretch_values(n: int):
    """The values of the inner nodes of stretches from those of the nodes around."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for g, vs, us, x0, k, near in zip(frame["g"], frame["vs"], frame["us"], frame["x0"], frame["k"], frame["near"]):
                x = np.asarray(x0)
                if len(us):
                    known = {e["u"]: e["x"] for e in near}
                    x = x - np.asarray(k).reshape(len(x), -1) @ np.concatenate([known[u] for u in us])
                parts.append(pd.DataFrame({"g": g, "v": np.asarray(vs), "x": list(x.reshape(-1, n))}))
            if parts:
                yield pd.concat(parts)

    return work


def descend(product, side: np.ndarray, most: int, tolerance: float) -> np.ndarray:
    """Conjugate gradients from zero."""
    x, r = np.zeros_like(side), side.copy()
    p, rr = r.copy(), float((r * r).sum())
    limit = tolerance * tolerance * max(rr, 1e-300)
    for _ in range(most):
        if rr <= limit:
            break
        q = product(p)
        pq = float((p * q).sum())
        if pq <= 0:
            break
        x += rr / pq * p
        r -= rr / pq * q
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return x


def solve_small(nodes: pd.DataFrame, edges: pd.DataFrame, n: int, tolerance: float) -> pd.DataFrame:
    """One system in one task: densely up to 1500 unknowns, else by conjugate gradients with each block scaled to the identity."""
    nodes = nodes.sort_values("v")
    v = nodes["v"].to_numpy()
    d, b = np.stack(nodes["d"].to_list()).reshape(-1, n, n), np.stack(nodes["b"].to_list())
    p, q = (np.searchsorted(v, edges[c].to_numpy(dtype=v.dtype)) for c in "pq")
    h = np.stack(edges["h"].to_list()).reshape(-1, n, n) if len(edges) else np.zeros((0, n, n))
    if len(v) * n <= 1500:
        full = np.zeros((len(v), n, len(v), n))
        full[np.arange(len(v)), :, np.arange(len(v)), :] = d
        full[p, :, q, :] = h
        full[q, :, p, :] = h.transpose(0, 2, 1)
        x = (_inverse(full.reshape(1, len(v) * n, -1), np.array([nodes["s"].max()]))[0] @ b.ravel()).reshape(-1, n)
    else:
        values, vectors = np.linalg.eigh(d)
        root = (vectors * np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)[:, None, :]) @ vectors.transpose(0, 2, 1)
        scaled = np.einsum("kij,kjl,klm->kim", root[p], h, root[q])

        def product(x: np.ndarray) -> np.ndarray:
            out = x.copy()
            np.add.at(out, p, np.einsum("kij,kj->ki", scaled, x[q]))
            np.add.at(out, q, np.einsum("kji,kj->ki", scaled, x[p]))
            return out

        x = np.einsum("kij,kj->ki", root, descend(product, np.einsum("kij,kj->ki", root, b), 2 * b.size + 50, tolerance))
    return pd.DataFrame({"g": nodes["g"].to_numpy(), "v": v, "x": list(x)})


def _descend_far(nodes: DataFrame, edges: DataFrame, n: int, sweeps: int, tolerance: float) -> DataFrame:
    """Systems that are neither small nor have nodes of few neighbours: conjugate gradients whose products are joins and sums over the tables."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    plus = lambda x, a, y: F.zip_with(x, y, lambda s, t: s + a * t)
    times = lambda h, x: F.array(*(dot(F.slice(h, n * i + 1, n), x) for i in range(n)))
    matrix = materialise(both_ways(edges, n).unionByName(nodes.select("g", "v", F.col("v").alias("u"), F.col("d").alias("h"))), "block-matrix")
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    state = nodes.select("g", "v", zero.alias("x"), F.col("b").alias("r"), F.col("b").alias("p"))
    size = lambda rows, name: rows.groupBy("g").agg(F.sum(dot(F.col("r"), F.col("r"))).alias(name))
    state = materialise(state.join(size(state, "rr"), "g").withColumn("first", F.col("rr")), "block-state")
    going = F.col("rr") > F.lit(tolerance * tolerance) * F.greatest("first", F.lit(1e-300))
    for sweep in range(sweeps + 1):
        if sweep % 8 == 0 and state.where(going).isEmpty():
            return state.select("g", "v", "x")
        q = summed(matrix.join(state.select("g", F.col("v").alias("u"), "p"), ["g", "u"]).select("g", "v", times(F.col("h"), F.col("p")).alias("q")), ("g", "v"), {"q": n})
        both = state.join(q, ["g", "v"])
        step = both.groupBy("g").agg(F.sum(dot(F.col("p"), F.col("q"))).alias("pq"))
        both = both.join(step, "g").withColumn("step", F.when(going & (F.col("pq") > 0), F.col("rr") / F.col("pq")).otherwise(0.0))
        moved = materialise(both.select("g", "v", plus(F.col("x"), F.col("step"), F.col("p")).alias("x"), plus(F.col("r"), -F.col("step"), F.col("q")).alias("r"), "p", F.col("rr").alias("before"), "first"), "block-state")
        turn = F.when(F.col("before") > 0, F.col("rr") / F.col("before")).otherwise(0.0)
        state = moved.join(size(moved, "rr"), "g").select("g", "v", "x", "r", plus(F.col("r"), turn, F.col("p")).alias("p"), "rr", "first")
        state = materialise(state, "block-state") if sweep % 8 == 7 else state
    raise RuntimeError(f"a system is not solved after {sweeps} sweeps")


def solve(nodes: DataFrame, edges: DataFrame, n: int, *, small: int = 2000, sweeps: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """Rows (g, v, x) with the solution of every graph's system; see the module.

    Graphs of up to ``small`` nodes and links are solved by one task each. In larger ones nodes are eliminated, by stretches while these take
    half of them, else by independent sets for as long as a round takes a fiftieth of them, else by stretches that take a quarter; what is
    then still larger is left to ``sweeps`` conjugate gradients, and RuntimeError if they don't end. Empty tables give an empty result.
    """
    nodes, edges = materialise(nodes.select("g", "v", "d", "b", "s"), "block-nodes"), materialise(edges.select("g", "p", "q", "h"), "block-edges")
    done, rounds, turn = [], [], 0
    kind = f"g bigint, v bigint, x {NUMBERS}"

    def small_ones(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return nodes.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(lambda a, b: solve_small(a, b, n, tolerance) if len(a) else pd.DataFrame({"g": [], "v": [], "x": []}), kind)

    while True:
        links = edges.groupBy("g").agg(F.count("*").alias("m"))
        sizes = materialise(nodes.groupBy("g").agg(F.count("*").alias("n")).join(links, "g", "left").select("g", "n", ((F.col("n") > small) | (F.col("m") > 2 * small)).alias("large")), "block-sizes")
        left, ready = sizes.agg(F.sum(F.when(F.col("large"), F.col("n"))), F.count(F.when(~F.coalesce("large", F.lit(False)), 1))).first()
        if ready or not done:
            few = sizes.where("not coalesce(large, false)").select("g")
            done.append(small_ones(nodes.join(few, "g", "left_semi"), edges.join(few, "g", "left_semi")))
        if not left:
            break
        if ready:
            many = sizes.where("large").select("g")
            nodes, edges = nodes.join(many, "g", "left_semi"), edges.join(many, "g", "left_semi")
        inner = _stretches(nodes, edges, (32 if left > 50_000 else 256) * 4 // n)
        within = inner.count()
        star = None if within >= left / 2 else materialise(_stars(nodes, edges, n, turn), "block-stars")
        stretches = star is None or star.count() < left / 50
        if stretches and within < left / 4:
            done.append(_descend_far(nodes, edges, n, sweeps, tolerance))
            break
        kind_left = f"g bigint, p bigint, q bigint, d {NUMBERS}, b {NUMBERS}, h {NUMBERS}"
        if stretches:
            at = lambda end: inner.select("g", F.col("v").alias(end), F.col("part").alias(f"part_{end}"))
            links = edges.join(at("p"), ["g", "p"], "left").join(at("q"), ["g", "q"], "left").withColumn("part", F.coalesce("part_p", "part_q")).where("part is not null")
            own = nodes.join(inner, ["g", "v"]).groupBy("g", "part")
            star = materialise(own.cogroup(links.select("g", "part", "p", "q", "h").groupBy("g", "part")).applyInPandas(lambda a, b: _stretch(a, b, n), STRETCH), "block-stretches")
            taken = inner.select("g", "v")
            passed = materialise(star.select("g", "us", "d", "b").mapInPandas(_stretch_left(n), kind_left), "block-inherited")
        else:
            taken = star.select("g", "v")
            passed = materialise(star.mapInArrow(_inherited(n), kind_left), "block-inherited")
        rounds.append((star, stretches))
        gone = taken.select("g", F.col("v").alias("gone"))
        kept = nodes.join(taken, ["g", "v"], "left_anti")
        more = passed.where("q is null").select("g", F.col("p").alias("v"), "d", "b", F.lit(0.0).alias("s"))
        nodes = materialise(summed(kept.unionByName(more), ("g", "v"), {"d": n * n, "b": n}, ("s",)), "block-nodes")
        for end in "pq":
            edges = edges.join(gone.withColumnRenamed("gone", end), ["g", end], "left_anti")
        edges = materialise(summed(edges.select("g", "p", "q", "h").unionByName(passed.where("q is not null").select("g", "p", "q", "h")), ("g", "p", "q"), {"h": n * n}), "block-edges")
        turn += 1
    x = done[0]
    for more in done[1:]:
        x = x.unionByName(more)
    x = materialise(x, "block-solution")
    for star, stretches in reversed(rounds):
        if stretches:
            near = star.select("g", "part", F.explode("us").alias("u")).join(x.select("g", F.col("v").alias("u"), "x"), ["g", "u"])
            near = near.groupBy("g", "part").agg(F.collect_list(F.struct("u", "x")).alias("near"))
            rows = star.select("g", "part", "vs", "us", "x0", "k").join(near, ["g", "part"], "left").mapInPandas(_stretch_values(n), kind)
            x = materialise(x.unionByName(rows), "block-solution")
            continue
        near = star.select("g", "v", F.explode_outer("near").alias("e")).select("g", "v", F.col("e.u").alias("u"), F.col("e.h").alias("h"))
        near = near.where("u is not null").join(x.select("g", F.col("v").alias("u"), "x"), ["g", "u"]).groupBy("g", "v").agg(F.collect_list(F.struct("h", "x")).alias("near"))
        rows = star.drop("near").join(near, ["g", "v"], "left").withColumn("near", F.coalesce("near", F.expr(f"cast(array() as array<struct<h: {NUMBERS}, x: {NUMBERS}>>)")))
        x = materialise(x.unionByName(rows.mapInArrow(_followed(n), kind)), "block-solution")
    return x
