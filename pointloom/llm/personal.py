"""Personal data by bootstrapped contexts, with DataFrame functions alone.

Patterns for e-mail and IP addresses, card and telephone numbers find the seeds. Every run of words that hold a digit or
an at sign is an instance; the words around it make lexical patterns: the two words before, the one before, and those on both sides.
Patterns and instances form a graph, whose edges are the distinct pairs in the corpus. A pattern's confidence in a kind is
the share of its instances that are of this kind, as far as is known, and an instance's that of all confident patterns together. Seeds
count as one, values that look like a kind and fail its check as nothing; both stay as they are. Confidence spreads along the graph for some
rounds. The instances that are then sure enough, and have the outline of their kind, are found wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Runs are entered at their start or where the last match ended, and not given back once
# read: the matches are those of the plain patterns, without their square cost in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: What a text without any match of a kind mostly lacks, and which is quicker to look for.
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
IP_IN_RANGE = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
# Outlines of instances that contexts may add to a kind.
OUTLINE = {
    "email": r"^[^@\x20]+@[^@\x20]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[:.][0-9A-Fa-f]*){3,7}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9][\x20./0-9-]*[0-9]$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[(0-9][\x20()./0-9-]*[0-9]$",
}

SPACE = r"\x20\x09-\x0D"
IDENTIFIER_WORD = rf"[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
IDENTIFIER = rf"(?<![^{SPACE}]){IDENTIFIER_WORD}(?:\x20{IDENTIFIER_WORD})*+"
#: Characters of an instance, and of the text on either side that its context is taken from.
LONGEST, BEFORE, BEHIND = 64, 96, 48
#: Elements whose places are added up in one go.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: what stands in a lambda is made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(gaps: Column, values: Column) -> Column:
    """Structs start, end for values with so much text before each, in characters of the whole; both arrays of numbers.

    Two levels of sums, for a running sum over an array copies it at each step.
    """
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("size")))

    def add(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        return F.struct((start + s["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + s["size"]).alias("end")))).alias("out"))

    def summed(steps: Column) -> Column:
        part = lambda c: F.slice(steps, c * CHUNK + 1, CHUNK)
        chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda a, s: a + s["gap"] + s["size"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        along = lambda at: F.transform(chunks, lambda c: F.aggregate(part(c), F.struct(F.get(at, c).alias("at"), none.alias("out")), add, lambda a: a["out"]))
        return F.flatten(bound(before, along))

    return F.when(F.size(values) > 0, bound(pairs, summed)).otherwise(none)


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def passes(kind: str, value: Column) -> Column:
    """The check of a kind on what its pattern matched."""
    if kind == "ip":
        return F.rlike(value, F.lit(IP_IN_RANGE))
    if kind == "card":
        return digits(value).between(16, 19) & F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))
    return digits(value).between(8, 15) if kind == "phone" else F.lit(True)


def _spans(kind: str, text: Column, values: Column) -> Column:
    """Structs kind (its number), start, end of the values that pass."""
    pieces = F.slice(F.split(text, BASE[kind], -1), F.lit(1), F.size(values))
    at = places(F.transform(pieces, F.length), F.transform(values, F.length))
    all_ = F.zip_with(at, values, lambda p, v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), passes(kind, v).alias("ok")))
    good = F.transform(F.filter(all_, lambda s: s["ok"]), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return F.when(F.size(values) > 0, good).otherwise(F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)"))


def _instances(text: Column, values: Column) -> Column:
    """Structs start, end, value, patterns of the identifier words that have a context; punctuation at their ends is left out."""
    pieces = F.split(text, IDENTIFIER, -1)
    at = lambda p: places(F.transform(F.slice(p, F.lit(1), F.size(values)), F.length), F.transform(values, F.length))
    bare = lambda v: F.regexp_replace(v, r"^[^\p{L}\p{N}+(@]++|[^\p{L}\p{N}]++$", "")
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^\p{L}\p{N}+(@]*+", 0))

    def one(value: Column, start: Column, before: Column, behind: Column) -> Column:
        left, right = F.lower(F.right(before, F.lit(BEFORE))), F.lower(F.left(behind, F.lit(BEHIND)))
        w1 = F.regexp_extract(left, rf"([^{SPACE}]++)[{SPACE}]*$", 1)
        w2 = F.regexp_extract(left, rf"([^{SPACE}]++[{SPACE}]+[^{SPACE}]++)[{SPACE}]*$", 1)
        w2 = F.regexp_replace(w2, rf"[{SPACE}]+", " ")
        r1 = F.regexp_extract(right, rf"^[{SPACE}]*+([^{SPACE}]++)", 1)
        patterns = F.array(F.when(w2 != "", F.concat(w2, F.lit(" _"))), F.when(w1 != "", F.concat(w1, F.lit(" _"))), F.when((w1 != "") & (r1 != ""), F.concat(w1, F.lit(" _ "), r1)))
        start = start + lead(value)
        return F.struct(start.alias("start"), (start + F.length(bare(value))).alias("end"), bare(value).alias("value"), F.array_compact(patterns).alias("patterns"))

    def all_(p: Column) -> Column:
        return bound(at(p), lambda a: F.transform(values, lambda v, i: F.when(F.length(v) <= LONGEST, one(v, F.get(a, i)["start"], F.get(p, i), F.get(p, i + 1)))))

    return F.filter(bound(pieces, all_), lambda x: x.isNotNull() & (F.length(x["value"]) >= 5) & (F.size(x["patterns"]) > 0))


def read_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, doc_id, base, instances), one for each of ``docs``: the base spans of all kinds and the instances with their patterns, written down."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_.alias("text"))
    nothing = F.expr("cast(array() as array<string>)")
    found = {k: F.when(F.contains("text", F.lit(SIGN[k])), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(nothing) for k, p in BASE.items()}
    rows = rows.withColumns(found | {"identifiers": F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))})
    base = F.concat(*(_spans(k, F.col("text"), F.col(k)) for k in KINDS))
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string, patterns: array<string>>>)")
    instances = F.when(F.size("identifiers") > 0, _instances(F.col("text"), F.col("identifiers"))).otherwise(none)
    rows = rows.select("doc_id", base.alias("base"), instances.alias("instances"))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "personal-data")


def known(value: Column) -> dict[str, Column]:
    """For each kind 1 for a seed, 0 for what only looks like one, null for what may become one."""
    out = {}
    for k in KINDS:
        whole = F.rlike(value, F.lit(f"^{BASE[k]}$"))
        out[k] = F.when(whole & passes(k, value), 1.0).when(whole | ~F.rlike(value, F.lit(OUTLINE[k])), 0.0)
    return out


def spread(instances: DataFrame, *, least_seeds: int = 3, confident: float = 0.7, rounds: int = 4) -> DataFrame:
    """Rows (value, kind, score) of the instances that contexts make a kind of, from rows (pattern, value).

    A pattern needs ``least_seeds`` known instances (their scores added up) of one kind, and these have to be the share ``confident`` of
    all of its distinct instances and one more. The score of an instance is 1 less the product of 1 less the confidence of each
    confident pattern that it stands in, in steps of a millionth of the logarithm, so that it doesn't depend on the order of sums. What has ``confident`` counts for patterns in the
    next round. Rounds end when no pattern is new, at the latest after ``rounds``: that far from seeds are instances looked for.
    """
    edges = instances.distinct()
    edges = edges.withColumns({f"is_{k}": c for k, c in known(F.col("value")).items()})
    edges = materialise(edges, "pattern-edges")
    scores, confident_before = None, 0
    for _ in range(rounds):
        now = edges
        of = {k: F.col(f"is_{k}") for k in KINDS}
        if scores is not None:
            wide = scores.groupBy(F.col("value").alias("_value")).pivot("kind", list(KINDS)).agg(F.max("score"))
            now = edges.join(wide.withColumnsRenamed({k: f"new_{k}" for k in KINDS}), F.col("value") == F.col("_value"), "left")
            of = {k: F.coalesce(f"is_{k}", f"new_{k}") for k in KINDS}
        # sums of whole millionths are the same in any order
        hits = [F.sum(F.round(F.coalesce(of[k], F.lit(0.0)) * 1e6).cast("long")).alias(k) for k in KINDS]
        patterns = now.groupBy("pattern").agg(F.count("*").alias("n"), *hits)
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in KINDS)))
        patterns = patterns.select("pattern", "n", each.alias("e")).select("pattern", F.col("e.kind").alias("kind"), (F.col("e.hits") / 1e6).alias("hits"), "n")
        patterns = patterns.withColumn("confidence", F.col("hits") / (F.col("n") + 1))
        patterns = materialise(patterns.where((F.col("hits") >= least_seeds) & (F.col("confidence") >= confident)), "confident-patterns")
        found = patterns.count()
        if found == confident_before:
            break
        confident_before = found
        open_ = F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(f"is_{k}").isNull())))
        reached = edges.join(patterns.select(F.col("pattern").alias("_pattern"), "kind", "confidence"), F.col("pattern") == F.col("_pattern"))
        doubt = F.sum(F.round(-F.ln(1 - F.col("confidence")) * 1e6).cast("long"))
        reached = reached.where(F.element_at(open_, F.col("kind"))).groupBy("value", "kind").agg((1 - F.exp(-doubt / 1e6)).alias("score"))
        scores = materialise(reached.where(F.col("score") >= confident), "discovered")
    return scores if scores is not None else edges.select("value", F.lit("").alias("kind"), F.lit(0.0).alias("score")).limit(0)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (doc_id, base, found): all base spans, and those with the ones that contexts add, as structs kind, start, end, score by kind and start.

    Starts and ends count code points, ends are exclusive; base spans score 1. A value that contexts make more than one kind of
    is of the one with the best score, ties the first listed; spans that overlap base spans are not added. Whole texts are read; null and empty texts have
    no spans, and repeated rows equal ones. Other columns play no part; an empty table gives an empty result. Patterns and
    instances are counted once however often they occur, so copies lend no weight.
    """
    rows = read_texts(docs, doc_id, text)
    flat = rows.select("row", "base", F.explode("instances").alias("i"))
    graph = flat.select(F.explode("i.patterns").alias("pattern"), F.col("i.value").alias("value"))
    scores = spread(graph, **options)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = scores.groupBy("value").agg(F.max(F.struct("score", (-number).alias("less"))).alias("b"))
    best = best.select(F.col("value").alias("_value"), (-F.col("b.less")).alias("kind"), F.col("b.score").alias("score"))
    start, end = F.col("i.start"), F.col("i.end")
    apart = ~F.exists("base", lambda s: (s["start"] < end) & (s["end"] > start))
    added = flat.where(apart).select("row", F.col("i.value").alias("value"), start.alias("start"), end.alias("end"))
    added = added.join(best, F.col("value") == F.col("_value")).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))
    out = rows.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    every = F.when(F.col("added").isNotNull(), F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))
    return out.select("doc_id", "base", every.alias("found"))


def written(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
