"""Best-fit packing of documents into sequences of several permitted lengths.

Longer documents are cut at the largest length. Pieces are dealt by hash into groups of a bounded number, each packed by
itself: largest first, into the open bin with the least room that fits; where none fits, a bin of the length with the
least cost for what it can be expected to hold is opened. At the end every bin shrinks to the least length that holds
its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, word_count

LENGTHS = (512, 1024, 2048, 4096)


def sequence_cost(length: int) -> float:
    """Linear work, attention that grows with the square, and a fixed share for each sequence."""
    return length + length * length / 16384 + 32


def best_fit(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sizes in falling order, each from 1 to the largest length), and the final length of each bin.

    Bins are found by room: a bit set tells which amounts of room some open bin has.
    """
    lengths = sorted(lengths)
    rising = list(reversed(sizes))
    volume = [0]
    for s in rising:
        volume.append(volume[-1] + s)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    bins, offsets = [], []
    for k, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            after = len(sizes) - k - 1  # pieces still to come, the ``after`` smallest
            best = None
            for c in lengths:
                if c < size:
                    continue
                more = volume[min(after, bisect.bisect_right(rising, c - size))]
                price = (cost(c) / min(c, size + more), c)
                best = min(best or price, price)
            b, room = len(used), best[1]
            used.append(0)
            opened.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def _pack(table: pa.Table, lengths: tuple[int, ...], cost: Callable[[int], float]) -> pa.Table:
    table = table.sort_by([("n_tokens", "descending"), ("uid", "ascending"), ("piece", "ascending")])
    bins, offsets, final = best_fit(table["n_tokens"].to_pylist(), lengths, cost)
    group = table["group"][0].as_py() if table.num_rows else 0
    columns = [table["uid"], table["piece"], pa.array([(group << 32) + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([final[b] for b in bins], pa.int64())]
    return pa.table(columns, names=["uid", "piece", "bin", "bin_offset", "bin_length"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, group_pieces: int = 4096) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, bin, bin_offset, bin_length), one for each piece of each row of ``docs``.

    Tokens are words. A text longer than the largest length is cut into pieces of that length and a rest. Texts without
    words (and null ones) give one row of 0 tokens outside all bins (bin, bin_offset and bin_length null). Repeated rows are packed as often as they come.
    Groups hold about ``group_pieces`` pieces whatever the size of the input; all pieces are packed. Rows are named by their place
    in the table, so another split of the input into files may give other bins of as good a fill; pieces of one length are taken in the order of these
    names. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names; an empty table gives an empty result.
    """
    most = max(lengths)
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size")).withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows, "document-sizes")
    last = F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0)).cast("long")
    pieces = rows.select("doc_id", "uid", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * most
    pieces = pieces.select("doc_id", "uid", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(most)).cast("long").alias("n_tokens"))
    full = pieces.where("n_tokens > 0")
    n = rows.agg(F.sum(F.ceil(F.col("size") / most))).first()[0] or 0
    groups = max(1, -(-int(n) // group_pieces))
    dealt = full.select("uid", "piece", "n_tokens", F.pmod(F.xxhash64("uid", "piece"), F.lit(groups)).alias("group"))

    def pack_group(table: pa.Table) -> pa.Table:
        return _pack(table, lengths, cost)

    packed = dealt.groupBy("group").applyInArrow(pack_group, "uid bigint, piece bigint, bin bigint, bin_offset bigint, bin_length bigint")
    return pieces.join(packed, ["uid", "piece"], "left").drop("uid")
