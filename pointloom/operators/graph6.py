"""Pose graphs of six degrees of freedom: nodes are poses, factors the measured transforms between two of them.

Small graphs are dealt to tasks and solved by one each. Larger ones stay tables: every round joins the factors with their poses, makes a
block for each pose and pair, and solves the system by elimination over these tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Pose
from pointloom.operators import blocks
from pointloom.operators.durable import materialise
from pointloom.operators.fit import POSE, _descend
from pointloom.operators.folds import rotations, skew_matrices
from pointloom.operators.mapping import POSE_KIND, chain


def odometry_graph(steps: DataFrame, by: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Poses (by, id, pose) and factors (by, a, b, pose, weight, uncertain) of a path of steps (by, .., step).

    A group's first row is node 0, at its own step; every later row is one node, joined to the one before it by its step.
    """
    numbered = steps.withColumn("id", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    factors = numbered.where("id > 0 and step is not null").select(by, (F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("step").alias("pose"), F.lit(1.0).alias("weight"), F.lit(False).alias("uncertain"))
    return chain(numbered, (by,), ("id",), ("id",)), factors


def _split(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[:, :9].reshape(-1, 3, 3), flat[:, 9:]


def _log(r: np.ndarray) -> np.ndarray:
    cosine = np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1)
    angle = np.arccos(cosine)
    scale = np.where(angle > 1e-9, angle / (2 * np.sin(np.where(angle > 1e-9, angle, 1.0))), 0.5)
    return scale[:, None] * np.stack((r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]), axis=1)


def linearise(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, zr: np.ndarray, zt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each factor (rotation vector, translation) of inverse(Z) inverse(T_a) T_b, and how it changes with small moves of T_a and T_b, on their right."""
    back = r[a].transpose(0, 2, 1)
    rab, tab = back @ r[b], (back @ (t[b] - t[a])[:, :, None])[:, :, 0]
    zb = zr.transpose(0, 2, 1)
    re = zb @ rab
    e = np.concatenate((_log(re), (zb @ (tab - zt)[:, :, None])[:, :, 0]), axis=1)
    m = len(a)
    jb, adjoint = np.zeros((m, 6, 6)), np.zeros((m, 6, 6))
    jb[:, :3, :3], jb[:, 3:, 3:] = np.eye(3), re
    turned = rab.transpose(0, 2, 1)
    adjoint[:, :3, :3] = adjoint[:, 3:, 3:] = turned  # of T_b to T_a
    adjoint[:, 3:, :3] = skew_matrices(-(turned @ tab[:, :, None])[:, :, 0]) @ turned
    return e, -jb @ adjoint, jb


class Graph:
    """Errors and Gauss-Newton steps of one graph; node 0 is fixed. ``weight`` are matrices of 6 by 6."""

    def __init__(self, poses: np.ndarray, a: np.ndarray, b: np.ndarray, measured: np.ndarray, weight: np.ndarray):
        self.r, self.t = _split(poses)
        self.a, self.b, self.weight = a, b, weight
        self.zr, self.zt = _split(measured)

    def linear(self, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return linearise(r, t, self.a, self.b, self.zr, self.zt)

    def weighed(self, e: np.ndarray) -> np.ndarray:
        return np.einsum("mij,mj->mi", self.weight, e)

    def cost(self, e: np.ndarray) -> float:
        return float((self.weighed(e) * e).sum())

    def optimise(self, most: int = 50, tolerance: float = 1e-12) -> None:
        damping = 1e-9
        e, ja, jb = self.linear(self.r, self.t)
        n = len(self.r)
        for _ in range(most):

            def spread(v: np.ndarray, ja=ja, jb=jb) -> np.ndarray:
                out = np.zeros((n, 6))
                np.add.at(out, self.a, np.einsum("mij,mi->mj", ja, v))
                np.add.at(out, self.b, np.einsum("mij,mi->mj", jb, v))
                out[0] = 0
                return out

            def product(p: np.ndarray, ja=ja, jb=jb, spread=spread) -> np.ndarray:
                p = p.reshape(n, 6)
                v = np.einsum("mij,mj->mi", ja, p[self.a]) + np.einsum("mij,mj->mi", jb, p[self.b])
                return (spread(self.weighed(v)) + damping * p).reshape(-1, 1)

            step = _descend(6 * n, product, -spread(self.weighed(e)).reshape(-1, 1), 1e-10).reshape(n, 6)
            r, t = self.r @ rotations(step[:, :3]), self.t + (self.r @ step[:, 3:, None])[:, :, 0]
            new = self.linear(r, t)
            gain = self.cost(e) - self.cost(new[0])
            if gain < 0:
                damping = max(damping * 100, 1e-6)
                if damping > 1e6:
                    break
                continue
            self.r, self.t, damping = r, t, damping / 10
            e, ja, jb = new
            if gain <= tolerance * max(1.0, self.cost(e)):
                break


def line_process(cost: np.ndarray, scale: float) -> np.ndarray:
    """How far an uncertain factor is believed, from its weighted squared error."""
    return (scale / (scale + cost)) ** 2


def _weights(factors: pd.DataFrame) -> np.ndarray:
    """Matrices of 6 by 6: the information, or the identity, times the weight."""
    weight = factors["weight"].to_numpy(dtype=float)[:, None, None]
    if "information" not in factors.columns or not len(factors):
        return weight * np.eye(6)
    return weight * np.stack([np.eye(6).ravel() if x is None else np.asarray(x, dtype=float) for x in factors["information"]]).reshape(-1, 6, 6)


def solve(poses: pd.DataFrame, factors: pd.DataFrame, prune: float, scale: float) -> pd.DataFrame:
    """The optimised poses of one graph. Uncertain factors whose line process (scale / (scale + weighted squared error))^2 is under ``prune`` go, and the rest is solved again."""
    poses = poses.sort_values("id")
    ids, flat = poses["id"].to_numpy(), poses[list(POSE)].to_numpy(dtype=float)
    factors = factors[factors["a"] != factors["b"]]
    a, b = (np.searchsorted(ids, factors[c].to_numpy(dtype=ids.dtype)) for c in "ab")
    if len(ids) > 1 and len(factors):
        measured, weight = factors[list(POSE)].to_numpy(dtype=float), _weights(factors)
        graph = Graph(flat, a, b, measured, weight)
        graph.optimise()
        e = graph.linear(graph.r, graph.t)[0]
        doubt = line_process((graph.weighed(e) * e).sum(axis=1), scale)
        keep = ~factors["uncertain"].to_numpy(dtype=bool) | (doubt >= prune)
        if not keep.all():
            graph = Graph(flat, a[keep], b[keep], measured[keep], weight[keep])
            graph.optimise()
        flat = np.concatenate((graph.r.reshape(-1, 9), graph.t), axis=1)
    return pd.DataFrame({"id": ids, **{c: flat[:, k] for k, c in enumerate(POSE)}})


FLAT = ", ".join(f"{c} double" for c in POSE)


def _linear_rows(frames: Iterator[pd.DataFrame], scale: float | None) -> Iterator[pd.DataFrame]:
    """From factors with the poses of both ends (a_.., b_..): rows of their blocks (g, p, q, d, b, h, cost, f); f is the factor's number.

    With ``scale`` uncertain factors are weighed by their line process as well, and cost is what this minimises: scale * cost / (scale + cost).
    """
    for f in frames:
        if not len(f):
            continue
        m = np.arange(len(f))
        ends = np.concatenate([f[[f"{s}_{c}" for c in POSE]].to_numpy(dtype=float) for s in "ab"])
        e, ja, jb = linearise(*_split(ends), m, m + len(f), *_split(f[list(POSE)].to_numpy(dtype=float)))
        w = _weights(f)
        cost = (np.einsum("mij,mj->mi", w, e) * e).sum(axis=1)
        if scale is not None:
            loose = f["uncertain"].to_numpy(dtype=bool)
            w = w * np.where(loose, line_process(cost, scale), 1.0)[:, None, None]
            cost = np.where(loose, scale * cost / (scale + cost), cost)
        we = np.einsum("mij,mj->mi", w, e)
        block = lambda x, y: np.einsum("mji,mjk,mkl->mil", x, w, y).reshape(len(f), 36)  # noqa: E731, B023
        pull = lambda x: -np.einsum("mji,mj->mi", x, we)  # noqa: E731, B023
        a, b = f["a"].to_numpy(), f["b"].to_numpy()
        h = block(ja, jb)
        h = np.where((a > b)[:, None], h.reshape(-1, 6, 6).transpose(0, 2, 1).reshape(-1, 36), h)
        none = [None] * len(f)
        for p, q, d, side, link in ((a, none, list(block(ja, ja)), list(pull(ja)), none), (b, none, list(block(jb, jb)), list(pull(jb)), none), (np.minimum(a, b), np.maximum(a, b), none, none, list(h))):
            yield pd.DataFrame({"g": f["g"].to_numpy(), "p": p, "q": pd.array(q, dtype="Int64"), "d": d, "b": side, "h": link, "cost": cost if link is not none else np.full(len(f), np.nan), "f": f["f"].to_numpy()})


def _moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        r, t = _split(f[list(POSE)].to_numpy(dtype=float))
        step = np.stack([np.zeros(6) if x is None else np.asarray(x) for x in f["x"]]) if len(f) else np.zeros((0, 6))
        flat = np.concatenate(((r @ rotations(step[:, :3])).reshape(-1, 9), t + (r @ step[:, 3:, None])[:, :, 0]), axis=1)
        yield pd.DataFrame({"g": f["g"], "v": f["v"], **{c: flat[:, k] for k, c in enumerate(POSE)}})


def _linear_table(poses: DataFrame, factors: DataFrame, scale: float | None = None) -> DataFrame:
    for end in "ab":
        own = poses.select("g", F.col("v").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in POSE))
        factors = factors.join(own, ["g", end])
    return factors.mapInPandas(lambda frames: _linear_rows(frames, scale), "g bigint, p bigint, q bigint, d array<double>, b array<double>, h array<double>, cost double, f bigint")


def _optimise_tables(poses: DataFrame, factors: DataFrame, most: int, tolerance: float, small: int, scale: float | None = None) -> DataFrame:
    """Gauss-Newton rounds with damping, and with ``scale`` uncertain factors reweighed in each, over poses (g, v, r00 ..) and factors (g, a, b, f, weight, .., r00 ..) of all graphs at once; v 0 of each is fixed."""
    rows = materialise(_linear_table(poses, factors, scale), "graph6-blocks")
    totals = rows.where("q is not null").groupBy("g").agg(F.sum("cost").alias("cost"))
    state = materialise(totals.select("g", "cost", F.lit(1e-9).alias("damping")), "graph6-state")
    for _ in range(most):
        if state.isEmpty():
            break
        going = state.select("g", "damping")
        nodes = blocks.summed(rows.where("q is null and p <> 0").select("g", F.col("p").alias("v"), "d", "b"), ("g", "v"), {"d": 36, "b": 6}).join(going, "g")
        size = sum((F.get("d", F.lit(7 * i)) for i in range(1, 6)), F.get("d", F.lit(0)))
        damped = F.transform("d", lambda x, i: F.when(i % 7 == 0, x + F.col("damping")).otherwise(x))
        nodes = nodes.select("g", "v", damped.alias("d"), "b", size.alias("s"))
        edges = blocks.summed(rows.where("q is not null and p <> 0").select("g", "p", "q", "h"), ("g", "p", "q"), {"h": 36}).join(going.select("g"), "g", "left_semi")
        steps = blocks.solve(nodes, edges, 6, small=small).withColumnsRenamed({"g": "_g", "v": "_v"})
        tried = poses.join(steps, (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v")), "left").drop("_g", "_v")
        tried = materialise(tried.mapInPandas(_moved, f"g bigint, v bigint, {FLAT}"), "graph6-poses")
        new = materialise(_linear_table(tried, factors, scale), "graph6-blocks")
        after = new.where("q is not null").groupBy("g").agg(F.sum("cost").alias("new"))
        judged = materialise(state.join(after, "g").withColumn("better", F.col("new") <= F.col("cost")), "graph6-state")
        # graphs whose step is no better keep their poses, and try a shorter one
        which = judged.select("g", "better")
        pick = lambda old, fresh: old.join(which.where("better"), "g", "left_anti").unionByName(fresh.join(which.where("better").select("g"), "g", "left_semi"))  # noqa: E731, B023
        poses, rows = materialise(pick(poses, tried), "graph6-poses"), materialise(pick(rows, new), "graph6-blocks")
        gain = F.col("cost") - F.col("new")
        shorter = F.greatest(F.col("damping") * 100, F.lit(1e-6))
        ended = (F.abs(gain) <= tolerance * F.greatest(F.lit(1.0), F.col("new"))) | (~F.col("better") & (shorter > 1e6))
        state = judged.where(~ended).select("g", F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"), F.when(F.col("better"), F.col("damping") / 10).otherwise(shorter).alias("damping"))
        state = materialise(state, "graph6-state")
    return poses


def _solve_tables(poses: DataFrame, factors: DataFrame, prune: float, scale: float, small: int) -> DataFrame:
    """``solve`` for graphs of any size."""
    factors = materialise(factors.where("a <> b").withColumn("f", F.monotonically_increasing_id()), "graph6-factors")
    poses = materialise(poses, "graph6-poses")
    if factors.where("uncertain").isEmpty():
        return _optimise_tables(poses, factors, 50, 1e-12, small)
    # false loops would be slow to fit: reweighed in every round they soon count for nothing, and whom to doubt shows before the last digits
    best = _optimise_tables(poses, factors, 50, 1e-4, small, scale)
    doubted = _linear_table(best, factors.where("uncertain")).where("q is not null").where(F.pow(F.lit(scale) / (F.lit(scale) + F.col("cost")), F.lit(2.0)) < prune).select("f")
    rest = factors.join(materialise(doubted, "graph6-doubted"), "f", "left_anti")
    return _optimise_tables(best, materialise(rest, "graph6-factors"), 50, 1e-12, small)


def optimise(poses: DataFrame, factors: DataFrame, by: str, prune: float = 0.25, scale: float = 1.0, small: int = 5000) -> DataFrame:
    """Rows (by, id, pose): poses (by, id, pose) that fit the factors (by, a, b, pose, weight, uncertain) best, each group's smallest id fixed.

    Factors may have a column information, the 36 numbers, by rows, of the matrix that weighs (rotation vector, translation); null is the identity.
    Uncertain factors that a first solution doubts (see ``solve``) go, and their graphs are solved again; in large graphs the first solution
    weighs them by their line process in every round. Graphs of up to ``small`` poses
    and factors are solved each by one task; larger ones, of any size, as tables in rounds of jobs, to the same poses where both doubt the same factors.
    Factors from a pose to itself are skipped; poses without factors, and groups of fewer than two, stay. IndexError if a factor
    names a pose that is not there.
    """
    for end in "ab":
        if not factors.join(poses.select(by, F.col("id").alias(end)), [by, end], "left_anti").isEmpty():
            raise IndexError("a factor names a pose that is not there")
    kind = poses.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, id {poses.schema['id'].dataType.simpleString()}, {FLAT}"
    extra = [c for c in ("information",) if c in factors.columns]

    def run(some: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame(columns=[by, "id", *POSE])
        out = solve(some, links, prune, scale)
        out.insert(0, by, some[by].iloc[0])
        return out

    links = factors.select(by, "a", "b", "weight", "uncertain", *extra, "pose.*")
    own = F.col(by).eqNullSafe(F.col("_of"))
    counts = factors.groupBy(F.col(by).alias("_of")).agg(F.count("*").alias("m"))
    sizes = poses.groupBy(by).agg(F.count("*").alias("n"), F.min("id").alias("first")).join(counts, own, "left")
    large = materialise(sizes.where((F.col("n") > small) | (F.col("m") > 4 * small)).select(F.col(by).alias("_of"), "first"), "large-graphs")
    few, some_links = poses, links
    if not large.isEmpty():
        few, some_links = poses.join(large, own, "left_anti"), links.join(large, own, "left_anti")
    some_links = some_links.toDF(*some_links.columns)  # columns of its own: links are often made of the poses
    done = few.select(by, "id", "pose.*").groupBy(by).cogroup(some_links.groupBy(by)).applyInPandas(run, schema)
    if large.isEmpty():
        return done.select(by, "id", F.struct(*POSE).alias("pose"))
    # graphs are numbered by a hash of their group, checked to be one of its own, and their poses from the fixed one on
    named = materialise(large.withColumn("_g", F.xxhash64("_of")), "large-graphs")
    if named.count() != named.select("_g").distinct().count():
        raise ValueError("two groups have one hash")
    place = lambda c: (F.col(c) - F.col("first")).cast("long")
    rows = materialise(poses.join(named, own).select("_of", "id", "_g", place("id").alias("_v"), "pose.*"), "large-poses")
    far = links.join(named, own).select(F.col("_g").alias("g"), place("a").alias("a"), place("b").alias("b"), "weight", "uncertain", *extra, *POSE)
    best = _solve_tables(rows.select(F.col("_g").alias("g"), F.col("_v").alias("v"), *POSE), far, prune, scale, 1000)
    best = best.withColumnsRenamed({"g": "_g", "v": "_v"})
    best = rows.select("_of", "id", "_g", "_v").join(best, ["_g", "_v"]).select(F.col("_of").alias(by), "id", *POSE)
    return done.unionByName(best).select(by, "id", F.struct(*POSE).alias("pose"))


def with_loops(poses: DataFrame, loops: DataFrame, by: str, loop_weight: float = 10.0, **options) -> DataFrame:
    """``optimise`` for a path of poses (by, id, pose), whose steps are certain factors of weight 1, with loop closures (by, query, match, pose) as uncertain ones.

    A loop's pose is that of the query in the frame of its match.
    """
    w = Window.partitionBy(by).orderBy("id")
    step = (Pose.from_struct("before").inverse() @ Pose.from_struct("pose")).struct().cast(POSE_KIND)
    path = poses.withColumns({"a": F.lag("id").over(w), "before": F.lag("pose").over(w)}).where("a is not null")
    certain = path.select(by, "a", F.col("id").alias("b"), step.alias("pose"), F.lit(1.0).alias("weight"), F.lit(False).alias("uncertain"))
    closed = loops.select(by, F.col("match").alias("a"), F.col("query").alias("b"), "pose", F.lit(loop_weight).alias("weight"), F.lit(True).alias("uncertain"))
    return optimise(poses, certain.unionByName(closed), by, **options)
