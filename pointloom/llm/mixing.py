"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size. Documents are put in order within
their source (by size, then by a hash); the running sum of expected copies starts at one random offset per source, and
a copy is emitted for each integer boundary that a document crosses. Order by size makes the words taken follow the
target closely. All documents are sorted in one order by ranges, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, running, word_count

WEIGHTS = (5, 2, 1)


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """Rows (source, sid, source_size, before, target) from rows (source, size), one of each source, written down.

    Sources in order of their code points, null last, take the weights in turn; sid is the place in this order and before
    the number of rows of all sources ahead. Targets are the least of ``most_repeats`` times the source's size and of a common level times its
    weight; the level is where they add up to ``share`` of all sizes, which is what resharing the excess by weight ends
    at. Sources without words get target 0. Sums over sources are running sums over ranges of them, however many there are.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    every = running(every, [F.col("source").asc_nulls_last()], {"up_to": F.col("n")}, "sources").withColumnRenamed("position", "sid")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = every.withColumn("before", F.col("up_to") - F.col("n")).withColumn("weight", weight.cast("long")).withColumn("room", F.col("source_size") * most_repeats)
    every = materialise(every.select("source", "sid", "source_size", "before", "weight", "room"), "weighed-sources")
    budget, weights_of_all = every.agg(F.sum("source_size"), F.sum("weight")).first()
    by_room = running(every.select("sid", "weight", "room"), [F.col("room") / F.col("weight"), F.col("sid")], {"rooms": F.col("room"), "taken": F.col("weight")}, "sources-by-room")
    here = (F.lit(budget or 0) * F.lit(share) - (F.col("rooms") - F.col("room"))) / (F.lit(weights_of_all or 0) - F.col("taken") + F.col("weight"))
    # the first source, by room for each unit of weight, that isn't full at its level sets it; later ones give lower values
    level = by_room.select(F.max(F.when(here <= F.col("room") / F.col("weight"), here))).first()[0]
    most = F.col("room").cast("double")
    target = F.least(most, F.lit(level) * F.col("weight")) if level is not None else most
    return materialise(every.select("source", "sid", "source_size", "before", target.alias("target")), "mixing-plan")


def unit_hash(value: Column, bits: int) -> Column:
    """The leading bits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(value), 1, bits // 4), 16, 10).cast("long")


def copies_taken(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows of ``docs`` (columns doc_id, source, size and any others) with source_size, target and copies.

    ``docs`` is read more than once and should be a written table. Documents are ordered by source, size and a hash of
    doc_id, all of them in one order that Spark deals by ranges, so that a document's rank in its source is its place less the
    rows ahead of the source. Null doc_id is ranked like the empty string, null source is a source of its own, repeated
    rows each get a rank; an empty table gives an empty result. The same rows give the same copies, however they are partitioned.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = source_plan(docs.select("source", "size"), weights, most_repeats, share).withColumnRenamed("source", "of")
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # the last part of the order only parts equal rows, so that no range has to hold all copies of one
    order = [F.col("sid"), F.col("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)), name, F.monotonically_increasing_id()]
    rows = running(rows, order, {}, "mixing-order")
    rank = F.col("position") - F.col("before")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.concat(F.lit(f"{seed}:source:"), F.coalesce(F.col("source"), F.lit(""))), 16) / F.lit(65536.0)
    copies = F.floor(rank * expected + offset) - F.floor((rank - 1) * expected + offset)
    return rows.withColumn("copies", copies).drop("sid", "before", "position")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows (doc_id, size, source_size, target, copies, taken), one per row of ``docs``; size counts words, taken is copies times size."""
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = copies_taken(materialise(thin, "document-sizes"), **options)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS room
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s)),
l AS (SELECT *, sum(source_size) OVER () - (sum(room) OVER r - room) AS budget,
             sum(weight) OVER () - sum(weight) OVER r + weight AS weight_left
      FROM w WINDOW r AS (ORDER BY room / weight, sid ROWS UNBOUNDED PRECEDING)),
v AS (SELECT max(budget::DOUBLE / weight_left) AS level FROM l WHERE budget::DOUBLE / weight_left <= room / weight),
p AS (SELECT source, source_size, least(room::DOUBLE, coalesce(level * weight, room::DOUBLE)) AS target FROM l, v),
h AS (SELECT d.*, source_size, target, md5('42:' || doc_id::VARCHAR) AS hash,
             ('0x' || substr(md5('42:source:' || coalesce(d.source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS x
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, hash, doc_id::VARCHAR) AS rank FROM h),
c AS (SELECT *, (floor(rank * x + u) - floor((rank - 1) * x + u))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
