"""All pairs of two tables within groups, in pieces of bounded size: rows are packed into arrays, and a task compares two arrays in NumPy at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.durable import materialise


def packed(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], values: tuple[str, ...], size: int, name: str, box: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, piece, values as arrays, lo_ and hi_ of ``box``): up to ``size`` rows of a group that follow one another by ``order``.

    Rows are sorted by ranges, so no task holds a group; a group's pieces are cut where partitions and batches end, too.
    """
    # one value of a type at a time, as bytes, which need no conversion in the tasks
    kinds = {c: rows.schema[c].dataType for c in values}
    fields = [rows.schema[c] for c in by] + [T.StructField("piece", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in values]
    fields += [T.StructField(f"{e}_{c}", T.DoubleType()) for c in box for e in ("lo", "hi")]
    numpy_of = {c: np.float64 if isinstance(k, T.DoubleType) else np.int64 for c, k in kinds.items()}
    schema = T.StructType(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in by:
                keys = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            starts = np.flatnonzero(place % size == 0)
            ends = np.append(starts[1:], n)
            columns = [batch.column(c).take(pa.array(starts)) for c in by]
            columns.append(pa.array(np.arange(piece, piece + len(starts))))
            piece += len(starts)
            data = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(numpy_of[c]) for c in values}
            columns += [pa.array([data[c][a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c in values]
            columns += [pa.array(f.reduceat(data[c], starts)) for c in box for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    sorted_ = rows.select(*by, *dict.fromkeys((*order, *values))).orderBy(*by, *order)
    return materialise(sorted_.mapInArrow(cut, schema), name)


def doubles(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_py(), np.float64) for x in column)


def longs(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_py(), np.int64) for x in column)


def nearest_two(pairs: DataFrame, bits: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """Rows (by, query, one, train, two) for each query of a pair of pieces (q_id, q_.. and t_id, t_..): the least Hamming distance, ties to the smaller train, and the next."""
    fields = [*(pairs.schema[c] for c in by), T.StructField("query", T.LongType()), T.StructField("one", T.IntegerType()), T.StructField("train", T.LongType()), T.StructField("two", T.IntegerType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = zip(longs(batch.column("q_id")), longs(batch.column("t_id")), zip(*(longs(batch.column(f"q_{c}")) for c in bits)), zip(*(longs(batch.column(f"t_{c}")) for c in bits)))
            for row, (query, train, a, b) in enumerate(inputs):
                for at in range(0, len(query), 256):  # some megabytes at a time
                    d = sum(np.bitwise_count(x[at : at + 256, None] ^ y[None]).astype(np.int16) for x, y in zip(a, b))
                    best = d.min(axis=1)
                    first = np.where(d == best[:, None], train[None], np.iinfo(np.int64).max).min(axis=1)
                    d[np.arange(len(d)), (d == best[:, None]).argmax(axis=1)] = 1 << 14
                    second = pa.array(d.min(axis=1).astype(np.int32), mask=np.full(len(d), len(train) < 2))
                    groups = [batch.column(c).take(pa.array(np.full(len(d), row))) for c in by]
                    yield pa.RecordBatch.from_arrays([*groups, pa.array(query[at : at + 256]), pa.array(best.astype(np.int32)), pa.array(first), second], names=[f.name for f in fields])

    return pairs.mapInArrow(work, T.StructType(fields))


def weights_within(pairs: DataFrame, radius: float, by: tuple[str, ...]) -> DataFrame:
    """Rows (by, x, y, z, near): for each place of the piece a_ the weight of those of the piece b_ at most ``radius`` away."""
    fields = [*(pairs.schema[c] for c in by), *(T.StructField(c, T.DoubleType()) for c in "xyz"), T.StructField("near", T.LongType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = zip(*(doubles(batch.column(f"a_{c}")) for c in "xyz"))
            b = zip(*(doubles(batch.column(f"b_{c}")) for c in "xyz"))
            for row, (p, q, weight) in enumerate(zip(a, b, longs(batch.column("b_weight")))):
                far = sum(max(u.max() - v.min(), v.max() - u.min()) ** 2 for u, v in zip(p, q))
                near = np.full(len(p[0]), weight.sum())
                if far > radius * radius * (1 - 1e-9):
                    for at in range(0, len(near), 256):
                        d2 = 0.0
                        for u, v in zip(p, q):
                            e = u[at : at + 256, None] - v[None]
                            d2 = d2 + e * e
                        near[at : at + 256] = (d2 <= radius * radius) @ weight
                groups = [batch.column(c).take(pa.array(np.full(len(near), row))) for c in by]
                yield pa.RecordBatch.from_arrays([*groups, *(pa.array(u) for u in p), pa.array(near)], names=[f.name for f in fields])

    return pairs.mapInArrow(work, T.StructType(fields))


def dealt(links: DataFrame, one: DataFrame, other: DataFrame, ends: tuple[str, str], each: int = 16) -> DataFrame:
    """Pairs of pieces with the arrays of both, about ``each`` pairs or fewer to a task; ``one`` and ``other`` have the columns ``ends`` and their arrays."""
    n = links.count()
    parts = max(1, min(n, max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // each)))
    return links.join(one, ends[0]).join(other, ends[1]).repartition(parts, *ends)
