"""Periodic runs of words, by probing a harmonic grid.

A run of period p holds at least four periods, so four places of the grid 0, p, 2p, .. lie in it one after the other,
and the words at all four are equal. For every period the grid is probed for words at jp and (j+1)p that agree three
times in a row: n/1 + n/2 + .. places, taken as strides for short periods and across all periods for long ones. What
survives is probed between the grid places and then extended to both sides by comparing chunks of growing length. Grid
places within a run found before, of a smaller period, are passed over: no other run can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import WORD, slices

#: A run has this many periods at least, and this many words.
PERIODS, LEAST = 4, 6
RUN = "struct<start: bigint, length: bigint, period: bigint>"
#: Places between two of the grid at which survivors are probed before they are extended.
BETWEEN = 8


def _agreement(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many words from ``at`` on (backwards for step -1) equal those p later, one after the other."""
    n, done, chunk = len(w), 0, 64
    while True:
        if step > 0:
            a = at + done
            b = min(a + chunk, n - p)
            same = w[a:b] == w[a + p : b + p] if a < b else np.empty(0, bool)
        else:
            b = at - done + 1
            a = max(b - chunk, 0)
            same = (w[a:b] == w[a + p : b + p])[::-1] if a < b else np.empty(0, bool)
        if not same.all():
            return done + int(same.argmin())
        done += len(same)
        if len(same) < chunk:
            return done
        chunk *= 2


def _survivors(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Periods with the grid numbers j whose words at jp, (j+1)p, (j+2)p and (j+3)p are equal, by rising period."""
    n, most = len(w), len(w) // PERIODS
    root = min(most, int(np.sqrt(n)))
    for p in range(1, root + 1):
        g = w[::p]
        same = g[1:] == g[:-1]
        same = same[:-2] & same[1:-1] & same[2:]
        if same.any():
            yield p, np.flatnonzero(same)
    # longer periods have few grid places: one place of all periods at a time
    found_p, found_j = [], []
    for j in range(max(0, (n - 1) // (root + 1) - 2)):
        p = np.arange(root + 1, min(most, (n - 1) // (j + 3)) + 1)
        a = w[j * p]
        p = p[(a == w[(j + 1) * p]) & (a == w[(j + 2) * p]) & (a == w[(j + 3) * p])]
        found_p.append(p)
        found_j.append(np.full(len(p), j))
    if found_p and len(p := np.concatenate(found_p)):
        j = np.concatenate(found_j)
        order = np.lexsort((j, p))
        p, j = p[order], j[order]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for ps, js in zip(np.split(p, cuts), np.split(j, cuts)):
            yield int(ps[0]), js


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of an array of word numbers, by start and period."""
    runs: list[tuple[int, int, int]] = []
    covered = np.zeros(len(w), dtype=np.int64)  # end of the found run that reaches farthest over a place
    for p, js in _survivors(w):
        js = js[covered[js * p] <= (js + 3) * p]
        for o in range(1, min(p, BETWEEN + 1)):
            if not len(js):
                break
            x = js * p + o * p // min(p, BETWEEN + 1)
            js = js[(w[x] == w[x + p]) & (w[x + p] == w[x + 2 * p])]
        i = 0
        while i < len(js):
            at = int(js[i]) * p
            if covered[at] > at + 3 * p:  # within a run that is found already
                i = int(np.searchsorted(js, (covered[at] - 1) // p - 3, side="right"))
                continue
            same = _agreement(w, at, p, 1)
            if same <= 2 * p:  # the three grid steps aren't all periodic: go on behind the word that differs
                i = int(np.searchsorted(js, (at + same) // p, side="right"))
                continue
            start = at - _agreement(w, at - 1, p, -1)
            end = at + same + p
            if end - start >= max(LEAST, PERIODS * p):
                runs.append((start, end - start, p))
            i = int(np.searchsorted(js, (at + same) // p, side="right"))
            if end - start >= max(LEAST, PERIODS * p):
                covered[start:end] = np.maximum(covered[start:end], end)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", *, runs: str = "runs", words: str = "n_words", collapsed_text: str = "collapsed") -> DataFrame:
    """The rows of ``docs`` with n_words, all periodic runs of words, and the text in which each run keeps its first period only.

    A run (start, length, period; words from 0) is a longest stretch whose smallest period fits into it four times or more
    and that has six words or more. Words are what ASCII white space sets off; kept words are joined by one blank. Null and
    empty texts have no words, no runs and an empty collapsed text. Each text is handled whole, by itself: repeated rows get
    equal answers, an empty table stays empty, and columns that have the names of the new ones are replaced. A task holds
    the words of one text, or of some texts of 8 MB together; a text costs about n log n comparisons of n words.
    """
    kept = docs.drop(runs, words, collapsed_text)
    kind = T._parse_datatype_string(f"array<{RUN}>")
    schema = T.StructType([*kept.schema.fields, T.StructField(words, T.LongType()), T.StructField(runs, kind), T.StructField(collapsed_text, T.StringType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            parts = pc.ascii_split_whitespace(pc.fill_null(batch.column(text).cast(pa.string()), ""))
            bounds, flat = parts.offsets.to_numpy(), parts.flatten()
            full = pc.not_equal(pc.binary_length(flat), 0)  # blanks at the ends leave empty pieces
            before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
            bounds, flat = before[bounds - bounds[0]], flat.filter(full)
            ids = flat.dictionary_encode().indices.to_numpy()
            found = [find_runs(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            keep = [collapsed(b - a, r) if r else np.ones(b - a, bool) for a, b, r in zip(bounds, bounds[1:], found)]
            mask = np.concatenate(keep) if len(flat) else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(mask)))[bounds]
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(mask)))
            columns = {
                words: pa.array(np.diff(bounds), pa.int64()),
                runs: pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], arrow),
                collapsed_text: pc.binary_join(left, " "),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    return kept.mapInArrow(work, schema)


def sha256_of_runs(runs: Column) -> Column:
    """Lower-case hex digest of a line start,length,period for every run."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.concat_ws("", line), 256)


def run_digest(found: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, the figures of the longest run, runs_sha256, collapsed_sha256) from those of ``periodic_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), sha256_of_runs(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("r.start"), F.col("r.length"), -F.col("r.period")
    milli = F.expr("(1000 * r.length) div (-r.period)").alias("exponent_milli")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli, "runs_sha256", "collapsed_sha256", "n_words")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): about a tenth of the documents, by crc32 of doc_id, repeat a stretch of their words to the end.

    A null doc_id is never chosen.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n, g = F.col("w"), F.size("w"), F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    a = g % n
    rows = rows.withColumn("a", F.when(n > 0, a.cast("int")))
    rows = rows.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))

