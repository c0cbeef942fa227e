"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import discard, materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node that has a link, with the smallest node reachable from it.

    Each round points the larger neighbours of every node at its smallest neighbour (large star), then all smaller
    neighbours and the node itself (small star). Both are a grouped minimum with map-side combining and an equality
    join whose two sides are plain tables, so that adaptive execution can split a hub. Rounds end when the link table
    no longer changes; it is then a star around each smallest node. Self links and links with a null end are ignored,
    repeated links count once; without links the result is empty. Nothing but two scalars per round reaches the driver.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = materialise(edges.distinct(), "links")
    before = _digest(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        discard(edges, least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(large, least)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
