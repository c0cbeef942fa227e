"""Exact inner-product search over norm buckets.

Vectors are grouped by length; a bucket is cut into pieces of bounded size. Pieces are visited from the longest on, in
sets of 1, 2, 4 .. pieces. What is found so far bounds a query's k-th best score from below: the bound divided by the
lengths is the cosine a candidate must reach in the next set. If it exceeds 1 the piece is skipped; if it is low only the
length of candidates is tested; if it is high, candidates must also lie in the feasible range of the query's largest
coordinates. What remains is verified by exact integer products. As a set is as large as all before it, it gives about k
answers a query in rows without order, so all sets together give about k log2(pieces).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import materialise

#: Below this cosine a coordinate's feasible range excludes next to nothing.
COORDINATE_FROM = 0.5


def finite_vector(v: Column) -> Column:
    """Whether an array is not null, not empty and holds finite numbers only."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False))


def quantised(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """All integer inner products, in doubles while these are exact and else in Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return order[rank < k]


def _search(left: pa.Table, right: pa.Table, k: int, rows: int = 256) -> pa.Table:
    """One block of queries against one piece."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if left.num_rows and right.num_rows:
        q, p = _matrix(left["v"], left.num_rows), _matrix(right["v"], right.num_rows)
        qid, pid = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        bound = left["bound"].to_numpy().astype(np.float64)  # null becomes NaN: no bound yet
        ql, pl = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((p.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-pl, kind="stable")
        p, pid, pl = p[order], pid[order], pl[order]
        unit = p / np.maximum(pl, 1e-300)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(bound > 0, bound / (ql * pl[0]), -1.0) - 1e-9  # local cosine threshold; -1: anything may do
        need = np.where(np.isnan(need), -1.0, need)
        for a in range(0, len(q), rows):
            part = np.flatnonzero(need[a : a + rows] <= 1) + a
            if not len(part):
                continue
            may = np.ones((len(part), len(p)), dtype=bool)
            for i in np.flatnonzero(need[part] > 0):  # length: p comes longest first
                least = bound[part[i]] / ql[part[i]] * (1 - 1e-9)
                may[i, np.searchsorted(-pl, -least, side="right") :] = False
            for i in np.flatnonzero(need[part] > COORDINATE_FROM):
                x, t = q[part[i]] / ql[part[i]], need[part[i]]
                for f in np.argsort(-np.abs(x))[:3]:
                    wide = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - x[f] * x[f])) + 1e-9
                    if t >= abs(x[f]):  # otherwise a pole of the sphere is within reach and the range is open
                        may[i] &= (unit[:, f] >= x[f] * t - wide) & (unit[:, f] <= x[f] * t + wide)
            use = np.flatnonzero(may.any(axis=0))
            if not len(use):
                continue
            score = _products(q[part], p[use])
            ok = may[:, use] & (qid[part][:, None] != pid[use][None, :]) & ~(score < np.nan_to_num(bound[part], nan=-np.inf)[:, None])
            i, j = np.nonzero(ok)
            best = _best(i, score[i, j], pid[use][j], k)
            out["query_id"].append(qid[part][i[best]])
            out["vec_id"].append(pid[use][j[best]])
            out["score"].append(score[i[best], j[best]])
    return pa.table({c: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for c, x in out.items()})


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, piece: int = 4096, block: int = 1024, per_octave: int = 8) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best candidates by integer inner product, ties to the smaller id.

    ``vectors`` and ``queries`` have (vec_id, embedding). Components become floor(scale * x). Vectors that are null,
    empty or hold null or non-finite components take no part, nor do rows without vec_id; a query meets only vectors of
    its own dimension and never rows of its own id. Repeated ids in ``queries`` count once; repeated candidates each count.
    Scores have to fit 64 bits. Work is cut into tiles of at most ``block`` queries by about ``piece`` vectors; no
    tile's answer is longer than k rows a query.
    """
    ready = lambda df: df.where(finite_vector(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bucket = F.when(length2 > 0, F.floor(F.log2(length2) / 2 * per_octave)).otherwise(-1)
    rows = ready(vectors).select("vec_id", "v", F.size("v").alias("dim"), bucket.alias("bucket"), F.sqrt(length2).alias("length"))
    sizes = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / piece).alias("cuts"))  # a row for each eighth of an octave
    ahead = Window.partitionBy("dim").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("cuts").over(ahead), F.lit(0)))
    rows = rows.join(sizes, ["dim", "bucket"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    rows = rows.withColumn("level", F.floor(F.log2(F.col("ahead") + F.col("cut") + 1)).cast("int"))
    rows = materialise(rows.drop("cuts", "ahead"), "norm-buckets")
    pieces = materialise(rows.groupBy("level", "dim", "bucket", "cut").agg(F.max("length").alias("longest")), "norm-pieces")
    asked = ready(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"), F.sqrt(length2).alias("length"))
    asked = materialise(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    last = pieces.agg(F.max("level")).first()[0] or 0
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = None
    for level in range(last + 1):
        now, todo = asked.withColumn("bound", F.lit(None).cast("double")), pieces.where(F.col("level") == level).drop("level")
        if found is not None:
            bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound"))
            now = asked.join(bound, "query_id", "left")
        salts = min(2**level, 64)  # a dimension may hold all rows, so its pieces and queries meet by salts
        now = now.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        todo = todo.withColumn("salt", F.pmod(F.xxhash64("bucket", "cut"), F.lit(salts)).cast("int"))
        reach = F.col("bound").isNull() | (F.col("bound") <= F.col("length") * F.col("longest") * (1 + 1e-9))
        new = _tiles(now.join(todo, ["dim", "salt"]).where(reach).drop("longest", "salt"), rows.where(F.col("level") == level).drop("level"), k)
        every = best(new if found is None else found.unionByName(new)).select("query_id", "rank", "vec_id", "score")
        if level == last:
            return every
        found = materialise(every.drop("rank"), f"scores-{level}")


def _tiles(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Meet queries (with block and the piece to visit) and pieces, tile by tile."""
    where = ["dim", "bucket", "cut", "block"]
    tiles = asked.select(*where).distinct()
    right = rows.join(tiles, where[:3]).select(*(F.col(c).alias(f"at_{c}") for c in where), "vec_id", "v")
    left = asked.select(*where, "query_id", "v", "bound")
    return left.groupBy(*where).cogroup(right.groupBy(*(f"at_{c}" for c in where))).applyInArrow(partial(_search, k=k), "query_id bigint, vec_id bigint, score bigint")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
