"""Fits: rigid alignment, hand-eye calibration and pose graphs.

Spark reduces the rows to sums of fixed size, or deals small graphs to tasks; only these reach a solver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.functions.geometry import Pose, axis_angle
from pointloom.operators import blocks, chunks
from pointloom.operators.durable import materialise

POSE = (*(f"r{i}{j}" for i in range(3) for j in range(3)), "tx", "ty", "tz")


def pair_moments(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group the centroids (s_x .., d_x ..) and the cross covariance sums (h_xx ..) of pairs (sx, sy, sz, dx, dy, dz), in one pass."""
    sums = [F.avg(f"{a}{c}").alias(f"{a}_{c}") for a in "sd" for c in "xyz"]
    cross = [(F.covar_pop(f"s{a}", f"d{b}") * F.count("*")).alias(f"h_{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *sums, *cross)


def _turn(h: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(h)
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    return vt.T @ d @ u.T


def rigid_fit(pairs: DataFrame) -> np.ndarray:
    """The 4x4 transform that takes (sx, sy, sz) to (dx, dy, dz) with least squares; ValueError with fewer than 3 pairs."""
    m = pair_moments(pairs).first()
    if m["n"] < 3:
        raise ValueError("a rigid fit needs 3 pairs")
    r = _turn(np.array([[m[f"h_{a}{b}"] for b in "xyz"] for a in "xyz"]))
    out = np.eye(4)
    out[:3, :3] = r
    out[:3, 3] = np.array([m[f"d_{c}"] for c in "xyz"]) - r @ np.array([m[f"s_{c}"] for c in "xyz"])
    return out


def hand_eye(motions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, x) with X of A X = X B, as a pose, from rows (by, a, b) of relative motions of two rigidly joined sensors.

    The rotation fits the rotation vectors, the translation (R_A - I) t = R t_B - t_A, both by least squares over sums that Spark
    makes in one pass. Groups of fewer than two motions have no row.
    """
    a, b = Pose.from_struct("a"), Pose.from_struct("b")
    left = tuple(v - (1.0 if i % 4 == 0 else 0.0) for i, v in enumerate(a.r))
    va, vb = axis_angle(a.r), axis_angle(b.r)
    column = lambda j: tuple(left[3 * k + j] for k in range(3))
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    sums = {f"m{i}{j}": vb[i] * va[j] for i in range(3) for j in range(3)}
    sums |= {f"l{i}{j}": dot(column(i), column(j)) for i in range(3) for j in range(i, 3)}
    sums |= {f"a{i}": dot(column(i), a.t) for i in range(3)}
    sums |= {f"b{i}{r}{c}": left[3 * r + i] * b.t[c] for i in range(3) for r in range(3) for c in range(3)}
    rows = motions.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items())).where("n >= 2")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in range(len(frame)):
                x = frame.iloc[k]
                r = _turn(np.array([[x[f"m{i}{j}"] for j in range(3)] for i in range(3)]))
                h = np.array([[x[f"l{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
                g = np.array([sum(r[p, q] * x[f"b{i}{p}{q}"] for p in range(3) for q in range(3)) - x[f"a{i}"] for i in range(3)])
                out.append([*(x[c] for c in by), *r.ravel(), *np.linalg.lstsq(h, g, rcond=None)[0]])
            yield pd.DataFrame(out, columns=[*by, *POSE])

    kinds = [f"{c} {motions.schema[c].dataType.simpleString()}" for c in by] + [f"{c} double" for c in POSE]
    return rows.mapInPandas(solve, ", ".join(kinds)).select(*by, F.struct(*POSE).alias("x"))


# --- pose graphs of x, y, z and yaw ---------------------------------------------------------------------------------

DOF = chunks.DOF


def residuals(poses: DataFrame, factors: DataFrame) -> DataFrame:
    """Factors (a, b, x, y, z, yaw, weight) with e_*: measurement less the difference of the poses; ValueError if a pose is missing."""
    names = poses.select("id")
    for end in "ab":
        if not factors.join(names, factors[end] == names["id"], "left_anti").isEmpty():
            raise ValueError("a factor names a pose that is not there")
    pa_ = poses.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in DOF))
    pb = poses.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in DOF))
    return factors.join(pa_, "a").join(pb, "b").select(*factors.columns, *((F.col(c) - (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(f"e_{c}") for c in DOF))


def residual_norm(poses: DataFrame, factors: DataFrame) -> DataFrame:
    """One row (norm): the root of all squared residuals, unweighted."""
    return residuals(poses, factors).agg(F.sqrt(F.coalesce(sum((F.sum(F.col(f"e_{c}") * F.col(f"e_{c}")) for c in DOF), F.lit(0.0)), F.lit(0.0))).alias("norm"))


def normal_equations(poses: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sparse system of one Gauss-Newton step: H as (i, j, h) blocks of weight times identity, and b as (i, b_x ..).

    Factors with a column information, 16 numbers by rows, are weighed by this matrix times weight: h is then an array of 16.
    """
    e = residuals(poses, factors)
    w = F.col("weight")
    signs = (("a", "a", 1), ("b", "b", 1), ("a", "b", -1), ("b", "a", -1))
    if "information" in factors.columns:
        scaled = F.transform("information", lambda x: x * w)
        error = F.array(*(F.col(f"e_{c}") for c in DOF))
        pulled = {c: F.aggregate(F.zip_with(F.slice(scaled, 4 * i + 1, 4), error, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t) for i, c in enumerate(DOF)}
        blocks_ = e.select(F.explode(F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.zip_with(scaled, F.array_repeat(F.lit(float(s)), 16), lambda x, y: x * y).alias("h")) for i, j, s in signs))).alias("m"))
        h = blocks.summed(blocks_.select("m.*"), ("i", "j"), {"h": 16})
    else:
        pulled = {c: w * F.col(f"e_{c}") for c in DOF}
        blocks_ = e.select(F.explode(F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (s * w).alias("h")) for i, j, s in signs))).alias("m"))
        h = blocks_.select("m.*").groupBy("i", "j").agg(F.sum("h").alias("h"))
    sides = e.select(F.explode(F.array(*(F.struct(F.col(i).alias("i"), *((s * pulled[c]).alias(f"b_{c}") for c in DOF)) for i, s in (("a", -1), ("b", 1))))).alias("m"))
    return h, sides.select("m.*").groupBy("i").agg(*(F.sum(f"b_{c}").alias(f"b_{c}") for c in DOF))


def _descend(size: int, product: Callable[[np.ndarray], np.ndarray], side: np.ndarray, tolerance: float, of: np.ndarray | None = None) -> np.ndarray:
    """Conjugate gradients from zero, for all columns of ``side`` at once, each with its own steps; ``of`` numbers the systems that the rows belong to."""
    of = np.zeros(len(side), int) if of is None else of
    dot = lambda u, v: np.stack([np.bincount(of, u[:, k] * v[:, k]) for k in range(side.shape[1])], axis=1)
    x, r = np.zeros_like(side), side.copy()
    p, rr = r.copy(), dot(r, r)
    limit = tolerance * tolerance * np.maximum(rr, 1e-300)
    for _ in range(2 * size + 50):
        if not (rr > limit).any():
            break
        q = product(p)
        pq = dot(p, q)
        step = np.where((rr > limit) & (pq > 0), rr / np.where(pq > 0, pq, 1.0), 0.0)
        x += step[of] * p
        r -= step[of] * q
        new = dot(r, r)
        p, rr = r + np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0)[of] * p, new
    return x


def solve_graph(poses: pd.DataFrame, factors: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The poses of one graph that fit its factors best, that of the smallest id held fixed."""
    poses = poses.sort_values("id")
    ids, x = poses["id"].to_numpy(), poses[list(DOF)].to_numpy(dtype=float)
    a, b = (np.searchsorted(ids, factors[c].to_numpy(dtype=ids.dtype)) for c in "ab")
    w = factors["weight"].to_numpy(dtype=float)[:, None]

    def spread(v: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(b, weights=v[:, k], minlength=len(ids)) - np.bincount(a, weights=v[:, k], minlength=len(ids)) for k in range(v.shape[1])], axis=1)
        out[0] = 0
        return out

    e = factors[list(DOF)].to_numpy(dtype=float) - (x[b] - x[a])
    moved = x + _descend(len(ids), lambda p: spread(w * (p[b] - p[a])), spread(w * e), tolerance) if len(w) else x
    return pd.DataFrame({"id": ids, **{c: moved[:, k] for k, c in enumerate(DOF)}})


def _eliminate(fixed: np.ndarray, of: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, side: np.ndarray, tolerance: float) -> np.ndarray:
    """Moves of the nodes of many graphs (``of``) whose links pull by weight times the difference of their moves, against the pulls ``side``.

    Nodes of up to two neighbours are eliminated in rounds; what has three neighbours everywhere goes on by conjugate gradients.
    """
    n = len(fixed)
    side, part = side.astype(float), chunks.parts(p, q, n)  # without links sums are whole numbers
    free = ~fixed[p] & ~fixed[q]
    ground = np.bincount(p, w * fixed[q], n) + np.bincount(q, w * fixed[p], n)
    spread = lambda at, v: np.stack([np.bincount(at, v[:, k], n) for k in range(v.shape[1])], axis=1)
    live, p, q, w, ground, rounds = chunks.in_rounds(np.flatnonzero(~fixed), *chunks.merged(p[free], q[free], w[free], n), ground, side)
    x = np.zeros_like(side)
    if len(live):
        scale = (ground + np.bincount(p, w, n) + np.bincount(q, w, n))[live]
        scale = np.where(scale > 0, 1 / np.sqrt(np.where(scale > 0, scale, 1.0)), 0.0)
        i, j = np.searchsorted(live, p), np.searchsorted(live, q)
        own = np.unique(of[live], return_inverse=True)[1]
        linked = (w * scale[i] * scale[j])[:, None]
        column = lambda at, v: np.stack([np.bincount(at, v[:, k], len(live)) for k in range(v.shape[1])], axis=1)
        product = lambda x: x - column(i, linked * x[j]) - column(j, linked * x[i])
        x[live] = scale[:, None] * _descend(int(np.bincount(own).max()), product, scale[:, None] * side[live], tolerance, own)
    chunks.follow(rounds, side, x)
    held = np.zeros(n, bool)
    held[part[fixed]] = True
    loose = ~held[part]  # stays as a whole
    x[loose] -= (spread(part, x) / np.maximum(np.bincount(part, minlength=n), 1)[:, None])[part[loose]]
    return x


def solve_graphs(poses: pd.DataFrame, factors: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """``solve_graph`` for many graphs at once: poses (g, id, x ..), g being the smallest id of their graph, and factors (g, a, b, x ..)."""
    poses = poses.sort_values("id")
    factors = factors[factors["a"] != factors["b"]]
    ids, g, x = poses["id"].to_numpy(), poses["g"].to_numpy(), poses[list(DOF)].to_numpy(dtype=float)
    a, b = (np.searchsorted(ids, factors[c].to_numpy(dtype=ids.dtype)) for c in "ab")
    w, e = factors["weight"].to_numpy(dtype=float), factors[list(DOF)].to_numpy(dtype=float) - (x[b] - x[a])
    odd = np.unique(g[a[~((w >= 0) & np.isfinite(w) & np.isfinite(e).all(axis=1))]])  # no plain weights or numbers
    used = (w > 0) & ~np.isin(g[a], odd)
    a, b, w, pull = a[used], b[used], w[used], w[used, None] * e[used]
    side = np.stack([np.bincount(b, pull[:, k], len(ids)) - np.bincount(a, pull[:, k], len(ids)) for k in range(len(DOF))], axis=1)
    moved = x + _eliminate(ids == g, g, a, b, w, side, tolerance)
    plain = ~np.isin(g, odd)
    out = pd.DataFrame({"id": ids, **{c: moved[:, k] for k, c in enumerate(DOF)}})[plain]
    return pd.concat([out, *(solve_graph(poses[g == one], factors[factors["g"] == one], tolerance) for one in odd)])


#: Graphs are solved together until they have so many poses and factors.
TOGETHER = 50_000


def _whole_graphs(tolerance: float, schema: pa.Schema):
    """Rows in order of their graph - poses, and factors with a link (a, b, weight) - to poses, some whole graphs at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            poses, factors = rows.filter(pc.is_valid(rows["id"])), rows.filter(pc.is_null(rows["id"]))
            if poses.num_rows:
                out = solve_graphs(poses.select(["g", "id", *DOF]).to_pandas(), factors.select(["g", "a", "b", *DOF, "weight"]).to_pandas(), tolerance)
                yield from pa.Table.from_pandas(out, schema, preserve_index=False).to_batches()

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            last = batch.column("g")[-1]
            if size >= TOGETHER and held[0].column("g")[0] != last:  # the last graph may go on
                rows = pa.Table.from_batches(held)
                at = pc.index(rows["g"], last).as_py()
                yield from solved(rows.slice(0, at))
                held = rows.slice(at).combine_chunks().to_batches()
                size = rows.num_rows - at
        if held:
            yield from solved(pa.Table.from_batches(held))

    return work


def optimise(poses: DataFrame, factors: DataFrame, sweeps: int = 1000, tolerance: float = 1e-9, by: str | None = None, small: int = 100_000) -> DataFrame:
    """Poses that fit the factors best, the pose of the smallest id held fixed; with ``by``, a column of ``poses``, that of each of its graphs.

    Factors (a, b, x, y, z, yaw, weight) may have a column information: 16 numbers, by rows, the matrix that weighs their residual.
    The residuals are linear, so one system is solved. Graphs of up to ``small`` poses and factors with plain weights are solved
    by one task each, many of them together. Larger ones are eliminated chunk by chunk (``chunks.solve``), those with matrices or weights below
    zero in rounds over the factor table (``blocks.solve``), so that a path of n poses is never gathered anywhere; only graphs with so many loops
    that most poses have three neighbours go on by ``sweeps`` conjugate gradients. All give the same poses. Factors link poses of one graph; ids are whole numbers.
    Poses that have no factors stay where they are, and so does what hangs on none of the fixed poses, as a whole. RuntimeError if a large graph is not solved.
    """
    plain = "information" not in factors.columns
    odd_pose = ~_finite(*DOF)
    odd = ~(_finite(*DOF, "weight") & (F.col("weight") >= 0))
    if plain and not by:  # one graph
        g, n, odd_poses = poses.agg(F.min("id"), F.count("*"), F.count_if(odd_pose)).first()
        m, odd_factors, nowhere = factors.agg(F.count("*"), F.count_if(odd), F.count_if(F.expr("a is null or b is null"))).first()
        if nowhere:
            raise ValueError("a factor names a pose that is not there")
        if n and max(n, m) > small and not odd_poses + odd_factors:
            return chunks.solve(poses.withColumn("g", F.lit(g)), factors.withColumn("g", F.lit(g)), n, m, small=min(small, 2000), sweeps=sweeps, tolerance=tolerance)
    names = materialise(poses.select("id", (F.col(by) if by else F.lit(0)).alias("of"), odd_pose.alias("odd")), "graph-poses")
    for end in "ab":
        if not factors.join(names, factors[end] == names["id"], "left_anti").isEmpty():
            raise ValueError("a factor names a pose that is not there")
    graphs = names.groupBy("of").agg(F.min("id").alias("g"), F.count("*").alias("n"), F.max("odd").alias("odd"))
    named = names.drop("odd").join(graphs, names["of"].eqNullSafe(graphs["of"])).select("id", "g", "n", "odd")
    dealt = factors.withColumn("odd_factor", odd).join(named.select(F.col("id").alias("a"), "g"), "a")
    sizes = materialise(dealt.groupBy("g").agg(F.count("*").alias("m"), F.max("odd_factor").alias("odd_factors")), "graph-sizes")
    large = (F.col("n") > small) | (F.coalesce("m", F.lit(0)) > small)
    way = F.when(F.lit(plain) & ~large, "small").when(F.lit(plain) & ~F.col("odd") & ~F.coalesce("odd_factors", F.lit(False)), "chunks").otherwise("blocks")
    named = materialise(named.join(sizes, "g", "left").select("id", "g", way.alias("way")), "graph-names")
    rows = poses.select("id", *DOF).join(named, "id")
    of = lambda way: factors.join(named.where(F.col("way") == way).select(F.col("id").alias("a"), "g"), "a")
    links = of("small").select("g", "a", "b", *DOF, "weight")
    both = rows.where("way = 'small'").select("g", "id", *DOF).unionByName(links, allowMissingColumns=True)
    kind = rows.select("id", *(F.col(c).cast("double") for c in DOF)).schema
    done = both.repartition("g").sortWithinPartitions("g").mapInArrow(_whole_graphs(tolerance, to_arrow_schema(kind)), kind)
    counts = {r.way: r.n for r in named.groupBy("way").agg(F.count("*").alias("n")).collect()}
    options = {"small": min(small, 2000), "sweeps": sweeps, "tolerance": tolerance}
    if "chunks" in counts:
        links = materialise(of("chunks"), "graph-links")
        done = done.unionByName(chunks.solve(rows.where("way = 'chunks'"), links, counts["chunks"], links.count(), **options))
    if "blocks" in counts:
        ends = named.where("way = 'blocks'").select(F.col("id").alias("a"))
        done = done.unionByName(_optimise_large(rows.where("way = 'blocks'").select("id", "g", *DOF), factors.join(ends, "a", "left_semi"), **options))
    return done


def _finite(*columns: str) -> Column:
    """Whether all columns are numbers, neither null nor infinite."""
    return F.forall(F.array(*(F.col(c).cast("double") for c in columns)), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def _optimise_large(poses: DataFrame, factors: DataFrame, small: int, sweeps: int, tolerance: float) -> DataFrame:
    """``optimise`` by elimination: poses (id, g, x ..), g being the smallest id of their graph."""
    links = factors.where("a <> b")
    if "information" not in factors.columns:
        links = links.withColumn("information", F.array(*(F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16))))
    h, b = normal_equations(poses, links)
    free = materialise(poses.where("id <> g").select(F.col("id").alias("i"), "g"), "graph-free")
    own = h.where("i = j").select("i", F.col("h").alias("d"))
    side = b.select("i", F.array(*(F.col(f"b_{c}") for c in DOF)).alias("b"))
    size = sum((F.get("d", F.lit(5 * i)) for i in range(1, 4)), F.get("d", F.lit(0)))
    nodes = own.join(side, "i").join(free, "i").select(F.col("g").cast("long").alias("g"), F.col("i").cast("long").alias("v"), "d", "b", size.alias("s"))
    edges = h.where("i < j").join(free, "i").join(free.select(F.col("i").alias("j")), "j", "left_semi")
    edges = edges.select(F.col("g").cast("long").alias("g"), F.col("i").cast("long").alias("p"), F.col("j").cast("long").alias("q"), "h")
    moves = blocks.solve(nodes, edges, 4, small=small, sweeps=sweeps, tolerance=tolerance).select(F.col("v").alias("_v"), F.col("x").alias("_x"))
    moved = poses.join(moves, F.col("id").cast("long") == F.col("_v"), "left")
    return moved.select("id", *((F.col(c) + F.coalesce(F.get("_x", F.lit(i)), F.lit(0.0))).alias(c) for i, c in enumerate(DOF)))


def graph_report(before: DataFrame, after: DataFrame, factors: DataFrame, by: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rows (by, poses, factors, initial, final, gradient, reason) of an optimisation: roots of the weighted squared residuals, and why it ended.

    gradient is the greatest pull that is left on a pose that may move, as a share of the sum of all weighted residuals' sizes before. reason is
    no_factors, converged (a gradient of up to ``tolerance``), worse (the residuals have grown) or stopped; an empty table of poses has no row.
    """
    own = before.select(F.col("id").alias("a"), (F.col(by) if by else F.lit(0)).alias("of"))
    error = F.array(*(F.col(f"e_{c}") for c in DOF))
    square = sum((F.col(f"e_{c}") * F.col(f"e_{c}") for c in DOF[1:]), F.col(f"e_{DOF[0]}") * F.col(f"e_{DOF[0]}"))
    if "information" in factors.columns:
        row = lambda i: F.aggregate(F.zip_with(F.slice("information", 4 * i + 1, 4), error, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        square = sum((F.col(f"e_{c}") * row(i) for i, c in enumerate(DOF)), F.lit(0.0))

    def norm(poses: DataFrame, name: str) -> DataFrame:
        rows = residuals(poses.select("id", *DOF), factors).join(own, "a").withColumn("square", F.col("weight") * square)
        return rows.groupBy("of").agg(F.count("*").alias("factors"), F.sqrt(F.sum("square")).alias(name), F.sum(F.sqrt(F.col("weight") * F.greatest("square", F.lit(0.0)))).alias("pull"))

    counts = own.groupBy("of").agg(F.count("*").alias("poses"), F.min("a").alias("fixed"))
    beside = lambda left, right: left.join(right.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of")
    _, left = normal_equations(after.select("id", *DOF), factors.where("a <> b"))
    left = beside(left.join(own.withColumnRenamed("a", "i"), "i"), counts.select("of", "fixed")).where("i <> fixed")
    left = left.groupBy("of").agg(F.max(F.greatest(*(F.abs(f"b_{c}") for c in DOF))).alias("left"))
    out = beside(beside(beside(counts, norm(before, "initial")), norm(after, "final").drop("factors", "pull")), left)
    zero = F.lit(0.0)
    out = out.select(F.col("of").alias(by or "graph"), "poses", F.coalesce("factors", F.lit(0)).alias("factors"), F.coalesce("initial", zero).alias("initial"), F.coalesce("final", zero).alias("final"), (F.coalesce("left", zero) / F.greatest(F.coalesce("pull", zero), F.lit(1e-300))).alias("gradient"))
    worse = F.col("final") > F.col("initial") * (1 + tolerance)
    return out.withColumn("reason", F.when(F.col("factors") == 0, "no_factors").when(worse, "worse").when((F.col("gradient") <= tolerance) | (F.col("final") <= 1e-12), "converged").otherwise("stopped"))
