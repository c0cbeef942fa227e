"""Quality by importance resampling of hashed n-grams.

Two generative models give the probability of each hashed token and token pair: one counted over all documents, one
over labelled documents of good quality, smoothed towards the first. A document's log weight is the mean log ratio of
its n-grams. Documents are sampled without replacement in proportion to exp(weight / temperature) by Gumbel top-k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import materialise, mix64, segment_sums, share_hash, slices, sum_vectors

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: What of a document's row goes on once its text is read.
THIN = ["row", "doc_id", "quality"]
#: Stands for a token that repeats one of the two tokens before it.
SAME = np.uint64(0x5851F42D4C957F2D)


class TokenHashes(dict):
    """64-bit hashes of tokens seen so far; forgotten when there are many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def gram_buckets(text: str | None, hashes: TokenHashes, bits: int) -> np.ndarray:
    """Buckets of all tokens and token pairs of a whole text, repeats included; empty for null and token-less texts."""
    tokens = TOKEN.findall(text) if text else []
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    same = np.zeros(len(h), dtype=bool)
    same[1:] |= h[1:] == h[:-1]
    same[2:] |= h[2:] == h[:-2]
    h[same] = SAME
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate((h, pairs)) >> np.uint64(64 - bits)).astype(np.int64)


class Ratios:
    """Log of target over raw probability for each bucket; the target model gets ``prior`` times its size of raw counts.

    Without target (or raw) n-grams all ratios are 0.
    """

    def __init__(self, target: np.ndarray, raw: np.ndarray, prior: float = 0.1):
        self.target, self.size, self.prior = target, int(target.sum()), prior
        self.raw = (raw + 0.5) / (raw.sum() + 0.5 * len(raw)) if raw.sum() else np.full(len(raw), 1 / len(raw))
        self.all = self._log(target, self.raw, self.size)

    def _log(self, target: np.ndarray, raw: np.ndarray, size: int) -> np.ndarray:
        return np.log((target + self.prior * size * raw) / ((1 + self.prior) * size) / raw) if size > 0 else np.zeros(len(raw))

    def without(self, grams: np.ndarray) -> np.ndarray:
        """The ratios of a document's own n-grams as if it were no part of the target, for it to compare with others."""
        used, at, own = np.unique(grams, return_inverse=True, return_counts=True)
        return self._log(self.target[used] - own, self.raw[used], self.size - len(grams))[at]


def labelled_sample(labels: DataFrame, most_rows: int) -> DataFrame:
    """Labelled ids (doc_id, quality 0 or 1): of each class the ``most_rows`` / 2 of least hash, all if there are fewer. Small enough to broadcast.

    Null ids and other labels are left out; of repeated labels the best counts. The same labels give the same sample.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = labels.withColumn("draw", -F.shiftrightunsigned(F.xxhash64(F.lit("labels"), "doc_id"), 13))
    labels = materialise(labels, "labelled-ids")
    drawn = [labels.where(F.col("quality") == q) for q in (0, 1)]
    least = [kth_largest(rows, "draw", most_rows // 2) for rows in drawn]  # None: there are fewer
    both = (rows.where(F.col("draw") >= x) if x is not None else rows for rows, x in zip(drawn, least))
    return reduce(DataFrame.union, both).select("doc_id", "quality")


def importance_weights(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = 16, label_rows: int = 20_000, prior: float = 0.1) -> DataFrame:
    """Thin rows, one for each of ``docs``: row (the columns ``keep`` as a struct), doc_id, quality (sampled label or null), n_grams and weight (mean log ratio, 0 without n-grams).

    The raw model counts all documents. The target model counts those with label quality 1 among at most ``label_rows``
    labelled ids chosen by hash; this sample of ids is all that is broadcast, besides a few numbers for each bucket. These
    documents are weighed without their own share of the target, so that they compare with all others.
    """
    size = 1 << bits
    sample = materialise(labelled_sample(labels, label_rows).withColumnRenamed("doc_id", "labelled"), "label-sample")
    rows = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(2 * size, dtype="<i8"), TokenHashes()
        for batch in slices(batches, "text"):
            for good, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist()):
                n = np.bincount(gram_buckets(text, hashes, bits), minlength=size)
                total[size:] += n
                if good == 1:
                    total[:size] += n
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    total = sum_vectors(rows.select("quality", "text").mapInArrow(count, "v binary"), "v", 2 * size)
    shared = docs.sparkSession.sparkContext.broadcast(Ratios(total[:size], total[size:], prior))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, hashes = shared.value, TokenHashes()
        for batch in slices(batches, "text", 4 << 20):
            grams = [gram_buckets(t, hashes, bits) for t in batch.column("text").to_pylist()]
            n = np.array([len(g) for g in grams], dtype=np.int64)
            good = batch.column("quality").to_pylist()
            total = segment_sums(np.concatenate([ratios.without(g) if q == 1 else ratios.all[g] for g, q in zip(grams, good)]), n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in THIN), pa.array(n), pa.array(total / np.maximum(n, 1))], names=[*THIN, "n_grams", "weight"])

    schema = T.StructType([*(rows.schema[c] for c in THIN), T.StructField("n_grams", T.LongType()), T.StructField("weight", T.DoubleType())])
    return rows.mapInArrow(weigh, schema)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut of least balanced error between good and other labelled documents, in the middle of its gap; -inf without both."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # cutting below position i loses the good before it and keeps the others from it on
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    kept = 1 - np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
    i = at[int(np.argmin((lost + kept)[at]))]
    if i == 0:
        return -np.inf
    return float((w[i - 1] + w[i]) / 2) if i < len(w) else float(np.nextafter(w[-1], np.inf))


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a long column (within 52 bits), found by counting in ever finer ranges; None if there are fewer than k rows."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    above = 0
    while True:
        step = max(1, -(-(high - low + 1) // bins))
        inside = scores.where(F.col(column).between(low, high))
        counts = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(step)).cast("long").alias("b")).count().collect()  # at most ``bins`` rows
        for r in sorted(counts, key=lambda r: -r["b"]):
            if above + r["count"] >= k:
                low, high = low + r["b"] * step, min(high, low + (r["b"] + 1) * step - 1)
                break
            above += r["count"]
        else:
            return None
        if step == 1:
            return low


def resample(docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), temperature: float = 0.02, seed: int = 42, **options) -> DataFrame:
    """Thin rows, one for each of ``docs``: the columns ``keep``, and n_grams, log_weight, key and kept.

    As many documents are sampled as have a weight above the cut that best parts the labelled documents by quality, so
    that all are kept where labels tell nothing apart. key is weight / temperature plus Gumbel noise, which depends on
    doc_id, n-grams and ``seed`` only, in millionths; documents are kept from the k-th largest key on, ties included. The
    odds of a document grow by a factor e for every ``temperature`` of weight: at 0.02 a document 0.1 above the cut is drawn with
    odds of 150 to 1, one 0.01 above with 1.6 to 1, so that sampling is soft near the cut and sure away from it.

    Null texts and texts without tokens have weight 0. Repeated rows each count and, being alike, have the same key. An
    empty table gives an empty result. Columns other than ``keep`` are ignored, which may not have the new ones' names.
    """
    if clash := {c.lower() for c in keep} & {"n_grams", "log_weight", "key", "kept"}:
        raise ValueError(f"the result has columns of its own named {clash}")
    u = share_hash(F.lit(seed), "doc_id", "n_grams")
    scored = importance_weights(docs, labels, keep=keep, **options)
    key = F.round((F.col("weight") / temperature - F.log(-F.log(u))) * 1e6).cast("long")
    scored = materialise(scored.withColumn("key", key), "importance-weights")
    # one row for each id of the bounded sample, however often it is repeated
    known = scored.where("quality is not null").groupBy("doc_id").agg(F.avg("weight").alias("weight"), F.max("quality").alias("quality")).toPandas()
    cut = best_cut(known["weight"].to_numpy(), known["quality"].to_numpy() == 1)
    k = scored.where(F.col("weight") >= cut).count()
    least = kth_largest(scored, "key", k)
    kept = F.col("key") >= least if least is not None else F.lit(False)
    return scored.select("row.*", "n_grams", F.col("weight").alias("log_weight"), "key", kept.alias("kept"))
