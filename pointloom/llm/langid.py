"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The document frequencies are counted over all documents to learn from. The weights are learned by the
follow-the-regularised-leader update with elastic-net penalties on a bounded sample of these documents, of about the
same size for each language, and a softmax temperature is fitted on a part of the sample that was held back.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import segment_sums, share_hash, slices, sum_vectors

UNKNOWN = "und"


LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


@cache
def other_numbers() -> frozenset[str]:
    """Fractions, exponents and the like: word characters to ``re``, but neither digits nor letters (``str.isalpha``, Unicode category L)."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def gram_counts(text: str | None, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the hashed character n-grams of a whole text, letters only, in words set off by blanks; None without letters."""
    if not text:
        return None
    if not text.isascii() and (found := other_numbers().intersection(text)):
        text = text.translate(dict.fromkeys(map(ord, found), " "))
    if not LETTER.search(text):
        return None
    folded = f" {OTHER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    buckets = []
    with np.errstate(over="ignore"):
        for n in orders:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            buckets.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
    counts = np.bincount(np.concatenate(buckets).view(np.int64), minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used, counts[used]


def inverse_frequencies(documents: np.ndarray, of: int) -> np.ndarray:
    """The smoothed IDF of buckets that occur in so many of ``of`` documents."""
    return (np.log((1 + of) / (1 + documents)) + 1).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    bits: int
    idf: np.ndarray  # float32 (buckets)
    weights: np.ndarray  # float32 (buckets, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[used]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (grams := gram_counts(text, self.bits)) is None:
            return UNKNOWN, 0.0
        z = (self.features(*grams) @ self.weights[grams[0]] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 1e-3, epochs: int = 4, batch: int = 32, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and bias from sparse rows. Per-coordinate learning rates; weights whose accumulated
    gradient stays within ``l1`` are exactly zero."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            # the last coordinate is the bias
            where = np.concatenate([np.append(rows[i][0], buckets) for i in part])
            value = np.concatenate([np.append(rows[i][1], 1.0) for i in part])
            lengths = np.array([len(rows[i][0]) + 1 for i in part])
            used, at = np.unique(where, return_inverse=True)
            w = weight(used)
            p = _softmax(segment_sums(value[:, None] * w[at], lengths))
            p[np.arange(len(part)), y[part]] -= 1
            each = value[:, None] * np.repeat(p, lengths, axis=0)
            g = np.stack([np.bincount(at, weights=each[:, k], minlength=len(used)) for k in range(classes)], axis=1)
            z[used] += g - (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha * w
            n[used] += g * g
    w = weight(np.arange(buckets + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search over a geometric grid; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def in_held_out_fold(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, *, bits: int = 15, per_language: int = 800, sample_bytes: int = 16 << 20, longest: int = 1 << 16, most_languages: int = 1000) -> Model:
    """Learn from the rows (doc_id, text, lang) of ``docs``; rows with a null text or lang, and texts without letters, teach nothing.

    Document frequencies cover all rows and whole texts. Weights are learned from about ``per_language`` rows of each language, chosen by
    hash, whose texts hold about ``sample_bytes`` in all: this sample is collected (at most 24 bytes for each of text). Of a text of over
    ``longest`` characters the weights are learned from so many in a row, from a place that a hash names. Repeated rows count once in the sample.
    Every language that any row has is learned, from one row at least; over ``most_languages`` of them are an
    error, for the model has a number for each bucket and language. Ties in a prediction go to the language first by code point.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    size = 1 << bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype="<i8")
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                if (grams := gram_counts(text, bits)) is not None:
                    total[grams[0]] += 1
                    total[size] += 1
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    total = sum_vectors(docs.mapInArrow(frequencies, "v binary"), "v", size + 1)
    idf = inverse_frequencies(total[:size], total[size])
    # lengths take the place of texts that are too long
    length = F.least(F.octet_length("text"), F.lit(longest))
    draw = share_hash(F.lit("sample"), "doc_id", F.octet_length("text"))
    lettered = docs.where(F.rlike("text", F.lit(r"\p{L}")))
    sizes = lettered.groupBy("lang").agg(F.count("*").alias("n"), F.sum(length).alias("bytes"), F.min(draw).alias("least")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"over {most_languages} languages to learn")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], bits, idf, np.zeros((size, 0), np.float32), np.zeros(0))
    shares = [(r["lang"], max(r["least"], min(1.0, per_language / r["n"], sample_bytes / len(sizes) / max(1, r["bytes"])))) for r in sizes]
    shares = docs.sparkSession.createDataFrame(shares, "of string, share double")  # a row for each language
    chosen = lettered.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(draw <= F.col("share"))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - longest + 1, F.lit(1))).cast("int") + 1
    chosen = chosen.withColumn("text", F.when(F.length("text") > longest, F.substring(F.col("text"), place, F.lit(longest))).otherwise(F.col("text")))
    chosen = chosen.groupBy("doc_id", "lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [(lang, *g) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if (g := gram_counts(text, bits)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in out], pa.string()), "used": pa.array([x[1].astype("<i4").tobytes() for x in out], pa.binary()), "counts": pa.array([x[2].astype("<i4").tobytes() for x in out], pa.binary())})

    sample = chosen.mapInArrow(grams, "lang string, used binary, counts binary").collect()
    sample.sort(key=lambda r: (bytes(r.used), bytes(r.counts), r.lang))
    model = Model(languages, bits, idf, np.zeros((size, len(languages)), np.float32), np.zeros(len(languages)))
    y = np.array([languages.index(r["lang"]) for r in sample], dtype=np.int64)
    rows = []
    for r in sample:
        used = np.frombuffer(bytes(r["used"]), "<i4")
        rows.append((used, model.features(used, np.frombuffer(bytes(r["counts"]), "<i4"))))
    number = np.zeros(len(rows), dtype=np.int64)  # within the language, so that none is held back whole
    for k in range(len(languages)):
        number[y == k] = np.arange((y == k).sum())
    back = number % 5 == 4  # held back for the temperature
    fit = np.flatnonzero(~back)
    w, model.bias = fit_ftrl([rows[i] for i in fit], y[fit], len(languages), size)
    model.weights = w.astype(np.float32)
    logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in np.flatnonzero(back)]).reshape(-1, len(languages))
    model.temperature = fit_temperature(logits, y[back])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", *, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with the predicted language and its calibrated probability.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. Whole texts are read; columns that
    have the names of the new ones already are replaced. Repeated rows get the same answer each; an empty table stays empty.
    """
    kept = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a float for each bucket and language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            found = [m.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, lang_pred, score])

    schema = T.StructType([*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return kept.mapInArrow(predict, schema)
