"""Least-cost repair of the turn structure of conversations, by layers of rising cost.

The roles of a repaired conversation have to read ``(system? (user assistant)+)?``, so four grammar states are enough:
nothing yet, after the system turn, after a user, after an assistant. For every cost d there is a layer with one bitset for
each turn: the states from which the rest can be repaired for d at most. A layer follows from the ones of 1, 2 and 3
less by table look-ups; the first layer that holds the start at the first turn gives the cost. The audit is then traced
through the bits: at each turn the least edit, by letter, that any state on a cheapest way still allows.

All turns are sorted once by ranges and cut into blocks of ``BLOCK`` places. Conversations within one block are repaired at once. For
those that cross into others every block is first turned into the costs between its states, which add up along the
conversation; with the cost of what follows known, each block is then traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, running, slices

BLOCK = 256
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ASSISTANT)
CLASSES = "suao"  # system, user, assistant, any other
SOUND, DEAD, CUT = range(3)
#: What is still to pay at the end of a conversation: users lack an answer, a lone system turn lacks both.
AT_END = {START: 0, SYSTEM: 4, USER: 2, ASSISTANT: 0}
FAR = 1 << 40
#: The state that the next turn of the right role leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = [{START: SYSTEM}, {s: t for s, t in NEXT.items() if t == USER}, {s: t for s, t in NEXT.items() if t == ASSISTANT}, {}]


def _before(moves: dict[int, int]) -> bytes:
    """For every set of states the set of those that ``moves`` takes into it."""
    return bytes(sum(s for s, t in moves.items() if t & into) for into in range(16))


INTO = _before(NEXT)
KEEP_INTO = [_before(moves) for moves in KEEP]


def layers(codes: list[tuple[int, int]], at_end: dict[int, int], until: int) -> list[bytearray]:
    """The layers of turns (class, fault), up to the one that holds all states ``until`` at the first turn."""
    n, found = len(codes), []
    nothing = bytearray(n + 1)
    while True:
        d = len(found)
        one, two, three = (found[d - k] if d >= k else nothing for k in (1, 2, 3))
        here = bytearray(n + 1)
        here[n] = sum(s for s, c in at_end.items() if c <= d)
        for i in range(n - 1, -1, -1):
            kind, fault = codes[i]
            bits = three[i + 1] | INTO[two[i]]
            if fault == SOUND:
                bits |= KEEP_INTO[kind][here[i + 1]] | INTO[two[i + 1]]
            elif fault == CUT:
                bits |= KEEP_INTO[kind][one[i + 1]] | INTO[three[i + 1]]
            here[i] = bits
        found.append(here)
        if here[0] & until == until:
            return found


def first_layer(found: list[bytearray], state: int) -> int:
    return next(d for d, layer in enumerate(found) if layer[0] & state)


def trace(codes: list[tuple[int, int]], found: list[bytearray], states: int) -> tuple[str, int]:
    """The least letters that take cheapest ways from ``states`` through all turns, and the states where they end."""
    ways = {s: first_layer(found, s) for s in STATES if s & states}
    letters, i = [], 0
    while i < len(codes):
        kind, fault = codes[i]
        cut = int(fault == CUT)
        steps = [("D", lambda s: s, 3, i + 1), ("I", NEXT.get, 2, i)]
        if fault != DEAD:
            steps += [("K", KEEP[kind].get, cut, i + 1), ("R", NEXT.get, 2 + cut, i + 1)]
        for letter, move, cost, to in steps:
            after = {t: left - cost for s, left in ways.items() if left >= cost and (t := move(s)) and found[left - cost][to] & t}
            if after:
                letters.append(letter)
                ways, i = after, to
                break
    return "".join(letters), sum(ways)


def closing(states: int) -> str:
    """The letters behind the last turn."""
    return "I" * (min(AT_END[s] for s in STATES if s & states) // 2)


def block_costs(codes: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The least cost from each state before the turns to each one behind them."""
    n = len(codes)
    costs = {(START, START): 3 * n, (SYSTEM, SYSTEM): 3 * n}
    kept = [int(fault == CUT) for kind, fault in codes if kind == 0 and fault != DEAD]
    costs[START, SYSTEM] = 3 * (n - 1) + min(kept) if kept else FAR
    for end in (USER, ASSISTANT):
        found = layers(codes, {end: 0}, 15)
        costs |= {(s, end): first_layer(found, s) for s in STATES}
    return costs


def cost_of_rest(costs: dict[tuple[int, int], int], at_end: dict[int, int]) -> dict[int, int]:
    return {s: min([FAR, *(costs.get((s, e), FAR) + at_end[e] for e in STATES)]) for s in STATES}


def decode(codes: str) -> list[tuple[int, int]]:
    return [divmod(ord(c) - 65, 3) for c in codes]


def illegal_pairs(codes: list[tuple[int, int]]) -> int:
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for (a, _), (b, _) in zip(codes, codes[1:]))


def edits_of(codes: list[tuple[int, int]], letters: str) -> tuple[list[dict], int, bool | None]:
    """Each edit with the turn it belongs to, its place among those before the same turn and the number of its result (null if deleted);
    how many results there are; whether the first is a system turn."""
    rows, turn, step, made, first = [], 0, 0, 0, None
    for letter in letters:
        if letter != "D" and first is None:
            first = letter == "K" and codes[turn][0] == 0
        rows.append({"turn": turn, "step": step, "edit": letter, "made": None if letter == "D" else made})
        made += letter != "D"
        turn, step = (turn, step + 1) if letter == "I" else (turn + 1, 0)
    return rows, made, first


EDITS = pa.list_(pa.struct([("turn", pa.int32()), ("step", pa.int32()), ("edit", pa.string()), ("made", pa.int64())]))
SOLVED = "conv_id bigint, block bigint, place bigint, letters string, cost bigint, illegal bigint, n_made bigint, first_system boolean, edits array<struct<turn: int, step: int, edit: string, made: bigint>>"


def _solved(batch: pa.RecordBatch, solve) -> pa.RecordBatch:
    out = {k: [] for k in ("letters", "cost", "illegal", "n_made", "first_system", "edits")}
    for row in batch.to_pylist():
        codes = decode(row["codes"])
        letters, cost = solve(row, codes)
        edits, made, first = edits_of(codes, letters)
        for k, v in zip(out, (letters, cost, illegal_pairs(codes), made, first, edits)):
            out[k].append(v)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), EDITS)
    columns = [batch.column("conv_id").cast(pa.int64()), batch.column("block"), batch.column("place"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "place", *out])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, int]] = {}  # most conversations look like others; emptied when it is full

    def solve(row: dict, codes: list[tuple[int, int]]) -> tuple[str, int]:
        if (answer := known.get(row["codes"])) is None:
            found = layers(codes, AT_END, START)
            letters, ends = trace(codes, found, START)
            answer = letters + closing(ends), len(found) - 1
            if len(known) >= 1 << 14:
                known.clear()
            if len(codes) <= 16:
                known[row["codes"]] = answer
        return answer

    for batch in batches:
        for part in slices([batch], "codes", 1 << 20):
            yield _solved(part, solve)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [block_costs(decode(c)) for c in batch.column("codes").to_pylist()]
        flat = [[r.get((s, e), FAR) for s in STATES for e in STATES] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), batch.column("block"), pa.array(flat, pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])


def _rests(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the costs of what follows it, and of it and what follows, from each state."""
    rows = rows.sort_values("block", ascending=False)
    end, rests, totals = dict(AT_END), [], []
    for flat in rows["costs"]:
        rests.append([end[s] for s in STATES])
        costs = {(s, e): int(flat[4 * i + j]) for i, s in enumerate(STATES) for j, e in enumerate(STATES)}
        end = cost_of_rest(costs, end)
        totals.append(end[START])
    last = rows["block"].max()
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "rest": rests, "total": totals, "last": rows["block"] == last, "first": rows["block"] == rows["block"].min()})


def _block_layers(codes: list[tuple[int, int]], rest: list[int]) -> list[bytearray]:
    least = min(rest)
    return layers(codes, {s: min(c - least, FAR) for s, c in zip(STATES, rest)}, 15)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = []
        for row in batch.to_pylist():
            codes = decode(row["codes"])
            found = _block_layers(codes, row["rest"])
            ends.append([0, *(trace(codes, found, states)[1] for states in range(1, 16))])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), batch.column("block"), pa.array(ends, pa.list_(pa.int32()))], names=["conv_id", "block", "ends"])


def _begins(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the states in which the least audit enters it."""
    rows = rows.sort_values("block")
    states, begins = START, []
    for ends in rows["ends"]:
        begins.append(states)
        states = int(ends[states])
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "states": begins})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(row: dict, codes: list[tuple[int, int]]) -> tuple[str, int]:
        letters, ends = trace(codes, _block_layers(codes, row["rest"]), row["states"])
        return letters + (closing(ends) if row["last"] else ""), row["total"] if row["first"] else 0

    for batch in batches:
        yield _solved(batch, solve)


def order_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, position): nulls of role and text read as one blank, position numbers all turns in order, written down.

    The order is by conversation, turn (nulls first), role and text.
    """
    blank = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.monotonically_increasing_id()]
    return running(rows, by, {}, "turns-in-order")


def find_faults(turns: DataFrame) -> DataFrame:
    """The rows of ``order_turns`` without texts but with kind (letter of the role, or o) and fault, written down.

    Of blank, duplicate (same role and text earlier in the conversation) and truncated (does not end in a full stop,
    exclamation or question mark) the first that holds, else null.
    """
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    same = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    thin = turns.select("conv_id", "turn", "position", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"), fault.alias("fault"), same.alias("same"))
    thin = materialise(thin, "turn-faults")
    again = thin.groupBy("same").agg(F.min("position").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = (F.col("position") > F.col("earliest")) & (F.coalesce("fault", F.lit("")) != "blank")
    thin = thin.join(again, "same", "left").withColumn("fault", F.when(repeated, "duplicate").otherwise(F.col("fault")))
    return materialise(thin.drop("same", "earliest"), "turns-with-faults")


def plan_repairs(faults: DataFrame) -> DataFrame:
    """One row for each conversation and block: letters, cost (in the first block), illegal pairs within the block, and every edit; written down.

    A task holds some blocks at a time, the chain of a conversation one row of 16 costs for each of its blocks.
    """
    dead = F.coalesce("fault", F.lit("")).isin("blank", "duplicate")
    code = F.instr(F.lit(CLASSES), F.col("kind")) * 3 - 3 + F.when(dead, DEAD).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    rows = faults.select("conv_id", "position", F.expr(f"position div {BLOCK}").alias("block"), F.char(65 + code).alias("code"))
    one = F.array_sort(F.collect_list(F.struct("position", "code")))
    blocks = rows.groupBy("conv_id", "block").agg(one.alias("all"), F.min("position").alias("place"), F.max("position").alias("to"))
    crosses = (F.col("place") % BLOCK == 0) | (F.col("to") % BLOCK == BLOCK - 1)
    blocks = materialise(blocks.select("conv_id", "block", "place", F.array_join("all.code", "").alias("codes"), crosses.alias("crosses")), "turn-blocks")
    whole = blocks.where("not crosses").select("conv_id", "block", "place", "codes").mapInArrow(_whole, SOLVED)
    crossing = blocks.where("crosses").select("conv_id", "block", "place", "codes")
    costs = crossing.mapInArrow(_costs, "conv_id bigint, block bigint, costs array<bigint>")
    rests = costs.groupBy("conv_id").applyInPandas(_rests, "conv_id bigint, block bigint, rest array<bigint>, total bigint, last boolean, first boolean")

    def beside(other: DataFrame) -> DataFrame:
        other = other.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
        return other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))

    crossing = materialise(crossing.join(*beside(rests)).drop("_conv", "_block"), "blocks-with-rests")
    ends = crossing.mapInArrow(_ends, "conv_id bigint, block bigint, ends array<int>")
    begins = ends.groupBy("conv_id").applyInPandas(_begins, "conv_id bigint, block bigint, states int")
    parts = crossing.join(*beside(begins)).drop("_conv", "_block").mapInArrow(_parts, SOLVED)
    return materialise(whole.unionByName(parts), "repairs")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations, and the conversations repaired for the least cost.

    ``rows`` has conv_id, turn, role and text; other columns take no part. Keeping a turn is free, a new role (user or assistant)
    costs 2, deleting 3, inserting an empty turn 2; a truncated turn that stays costs 1 more; blank and duplicate
    turns have to go. The roles left read, by their first letters, ``(s?(ua)+)?``. Among cheapest repairs that with the
    least audit (the edits' letters D, I, K, R in order) is taken; it fixes all roles.

    The report has conv_id, gaps (missing turn numbers), blank, duplicate, truncated, illegal, cost and audit; the repaired
    turns have conv_id, position, step, edit, role and text, in the order of position and step. A null conv_id is a conversation of its own, null turns
    come first, null and empty roles fit nowhere, null texts are blank, rows of one turn are taken by role and text. An empty table gives empty results.
    """
    turns = order_turns(rows)
    faults = find_faults(turns)
    repairs = plan_repairs(faults)

    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    wrong = faults.groupBy("conv_id").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    seam = faults.where(F.col("position") % BLOCK >= BLOCK - 1).unionByName(faults.where(F.col("position") % BLOCK == 0))
    seam = seam.select("conv_id", F.expr(f"(position + 1) div {BLOCK}").alias("at"), F.col("position") % BLOCK == 0, "kind").toDF("conv_id", "at", "right", "kind")
    seam = seam.groupBy("conv_id", "at").agg(F.max(F.when(~F.col("right"), F.col("kind"))).alias("a"), F.max(F.when(F.col("right"), F.col("kind"))).alias("b"))
    seam = seam.where("a is not null and b is not null and concat(a, b) not in ('su', 'ua', 'au')").select("conv_id", F.lit(1).cast("long").alias("illegal"))
    letters = F.array_join(F.array_sort(F.collect_list(F.struct("block", "letters")))["letters"], "").alias("audit")
    audits = repairs.groupBy("conv_id").agg(F.sum("cost").alias("cost"), letters)
    illegal = repairs.select("conv_id", "illegal").unionByName(seam).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))

    def with_(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    report = with_(with_(wrong, illegal), audits).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # number of results and the first one's kind, carried along the blocks of a conversation
    along = "(PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    before = repairs.select("conv_id", "block", "place", "edits", F.expr(f"coalesce(sum(n_made) OVER {along.format('1 PRECEDING')}, 0)").alias("before"), F.expr(f"first(first_system, true) OVER {along.format('CURRENT ROW')}").alias("system"))
    edits = before.select("conv_id", "place", "before", "system", F.explode("edits").alias("e")).where("e.edit <> 'D'")
    number = F.col("before") + F.col("e.made")
    role = F.when(F.col("system") & (number == 0), F.lit(None)).when((number % 2 == 0) != F.col("system"), "user").otherwise("assistant")
    edits = edits.select("conv_id", (F.col("place") + F.col("e.turn")).alias("position"), F.col("e.step").alias("step"), F.col("e.edit").alias("edit"), role.alias("new_role"))
    kept = edits.where("edit <> 'I'").join(turns.select("position", "role", "text"), "position")
    kept = kept.select("conv_id", "position", "step", "edit", F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role")).alias("role"), "text")
    added = edits.where("edit = 'I'").select("conv_id", "position", "step", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return report, kept.unionByName(added)


def digest_of_turns(repaired: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256) of conversations with turns: the digest of their lines ``role:text``.

    A digest is made in order, so the turns of one conversation pass one task, which holds a batch of them at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if h is not None and conv == now:
                    h.update(b"\n" + line)
                    continue
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = conv, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "position", "step").select("conv_id", "role", "text")
    return ordered.mapInArrow(digest, "conv_id bigint, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fifth to a quarter of their rows damaged by crc32 of ``conv_id:turn``; nulls read as one blank, but for the order."""
    text = F.coalesce("text", F.lit(" "))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(name.cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(h == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_digest(rows: DataFrame) -> DataFrame:
    """The report on the damaged conversations and the digest of each once repaired, for every conv_id of ``rows``."""
    report, repaired = repair_conversations(damaged(rows))
    of = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(report.withColumnRenamed("conv_id", "_conv"), of("_conv"), "left").join(digest_of_turns(repaired).withColumnRenamed("conv_id", "_id"), of("_id"), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
