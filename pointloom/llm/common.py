"""Shared helpers: row selection by id, Arrow text access and array arithmetic."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.durable import discard, materialise, scratch_path, shared_dir, temporary_tables  # noqa: F401
from pointloom.operators.scans import running  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ASCII-whitespace separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds more than ``most_bytes`` of text, or else a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64) + 64
        part = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
    release_memory()


def release_memory() -> None:
    """Give memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` (along axis 0); runs may be empty."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sum_vectors(rows: DataFrame, column: str, length: int, kind: str = "<i8", parts: int = 16) -> np.ndarray:
    """The sum of equally long vectors kept as bytes. Tasks add up what they stream, ``parts`` partial sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype=kind)
        for batch in batches:
            for x in batch.column(column):
                total += np.frombuffer(x.as_buffer(), dtype=kind)
        yield pa.RecordBatch.from_pydict({column: pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(length, dtype=kind)
    for r in rows.select(column).repartition(parts).mapInArrow(add, f"`{column}` binary").collect():
        total += np.frombuffer(bytes(r[0]), dtype=kind)
    return total


def share_hash(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(2**53))


def placed(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Rows (row, file, at): all columns of ``docs`` as the struct row, and the place of the row: its file, as a hash, and its number in it.

    The place names a row from one job to the next, so that decisions can be thin tables and texts need no second copy.
    ``stored`` says that ``docs`` is a plain read of Parquet files; anything else is written first.
    """
    try:
        if not stored:
            raise AnalysisException("not a plain read")
        source = docs.metadataColumn("_metadata")
        return docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(source["file_path"]).alias("file"), source["row_index"].alias("at"))
    except AnalysisException:
        return placed(materialise(docs, "placed-rows"), stored=True)


def rows_with(rows: DataFrame, chosen: DataFrame, times: int = 1) -> DataFrame:
    """The rows (row, file, at) of ``placed`` that are in ``chosen`` (file, at), without moving them for it.

    Places are packed into the bits of longs first, dozens to a row, so that the side to join is small: Spark broadcasts
    it as long as its size allows and merges beyond. ``chosen`` has each place once. With ``times`` it also has a column
    copies, from 1 to ``times``, which the result gets.
    """
    width = times.bit_length()
    per = 63 // width
    word = F.floor(F.col("at") / F.lit(per)).cast("long")
    shift = (F.col("at") % per * width).cast("int")
    copies = F.col("copies").cast("long") if times > 1 else F.lit(1).cast("long")
    packed = chosen.select("file", word.alias("word"), F.call_function("shiftleft", copies, shift).alias("bits"))
    packed = materialise(packed.groupBy("file", "word").agg(F.bit_or("bits").alias("bits")), "packed-places")
    digit = F.call_function("shiftright", F.col("bits"), shift).bitwiseAND(F.lit((1 << width) - 1))
    found = rows.withColumn("word", word).join(packed, ["file", "word"]).withColumn("copies", digit).where("copies > 0")
    return found.select("row", "file", "at", *(["copies"] if times > 1 else []))
