"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are rendered, and each output is
compared with the one before: what was added is the span of the new turn, and a prefix that does not begin with its
predecessor shows that the template rewrites history. Nothing about the template's inside is used.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import slices

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROL = re.compile(r"\\|</?turn|###|>(?=\n)")
ESCAPED = re.compile(r"\\(.)", re.S)
MARKED = re.compile(r"<turn ((?:[^\\>]++|\\.|>(?!\n))*+)>\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class TurnTemplate:
    """Turns between marks, with a backslash before each control string and backslash of a text.

    Turns that were marked once are kept until ``forget``, which is called at the end of each conversation: what is held is the conversation.
    """

    def __init__(self) -> None:
        self.marked: dict[Turn, str] = {}

    def __call__(self, turns: list[Turn]) -> str:
        return "".join([self.marked.get(t) or self.mark(t) for t in turns])

    def mark(self, turn: Turn) -> str:
        role, text = turn
        self.marked[turn] = out = f"<turn {escape(role)}>\n{escape(text)}</turn>\n"
        return out

    def forget(self) -> None:
        self.marked.clear()


turn_template = TurnTemplate()


def unused(turns: list[Turn]) -> str:
    """A character that stands in none of the turns, to take the place of a text while that is looked for."""
    said = [x for turn in turns for x in turn]
    return next(c for c in map(chr, range(1, 0xD800)) if not any(c in x for x in said))


def parse_turns(formatted: str) -> list[Turn]:
    """The turns of ``turn_template``'s output; ValueError where something else stands between them."""
    turns, at = [], 0
    while at < len(formatted):
        m = MARKED.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    text: str
    #: role, start and end of the turn, start and end of its text (null if the template does not show it), under the loss mask or not
    spans: list[dict] = field(default_factory=list)
    rewritten_at: list[int] = field(default_factory=list)


def render_incrementally(template: Template, turns: list[Turn], loss_roles: frozenset[str]) -> Rendered:
    """Spans of all turns in the final output. Spans of turns whose text was rewritten later are cut to what stayed.

    Every prefix is rendered, so the cost of n turns grows with n squared; only the last output is kept.
    """
    before = template([])
    done = Rendered(before)
    prefix: list[Turn] = []
    sentinel = unused(turns)
    for k, (role, text) in enumerate(turns):
        marked = template([*prefix, (role, sentinel)])
        prefix.append((role, text))
        now = template(prefix)
        start = len(before)
        if not now.startswith(before):
            done.rewritten_at.append(k)
            start = len(os.path.commonprefix((before, now)))
            for s in done.spans:  # what lies beyond the common prefix is no longer where it was
                s["start"], s["end"] = min(s["start"], start), min(s["end"], start)
                if s["text_end"] is not None and s["text_end"] > start:
                    s["text_start"] = s["text_end"] = None
                    s["loss"] = False
        at = marked.rfind(sentinel)
        tail = len(marked) - at - 1
        same = start if marked.startswith(before) and start == len(before) else 0  # known to be equal
        shown = at >= start and now[same:at] == marked[same:at] and now.endswith(marked[at + 1 :])
        done.spans.append({"role": role, "start": start, "end": len(now), "text_start": at if shown else None, "text_end": len(now) - tail if shown else None, "loss": shown and role in loss_roles})
        before = now
    done.text = before
    return done


SPAN = [("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]
CONVERSATION = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct(SPAN))), ("rewrites_history", pa.bool_())])


def format_conversations(rows: DataFrame, template: Template = turn_template, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, n_turns, formatted, spans, rewrites_history) from rows (conv_id, turn, role, text).

    Turns follow ``turn`` (null first), ties role and text. Null roles and texts are empty; a null conv_id is one conversation of
    its own; repeated rows are turns of their own; other columns are ignored; an empty table gives an empty result.
    A template that keeps something between calls has a method ``forget``, which is called after each conversation.
    A template may treat a turn by any of those before it, so each conversation is rendered whole, by one task, which
    holds its turns and its last output.
    """
    roles = frozenset(loss_roles)
    forget = getattr(template, "forget", None)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, done, size = None, [], [], 0

        def flush() -> int:
            r = render_incrementally(template, turns, roles)
            done.append({"conv_id": current[0], "n_turns": len(turns), "formatted": r.text, "spans": r.spans, "rewrites_history": bool(r.rewritten_at)})
            if forget:
                forget()
            return len(r.text) + 100 * len(turns)

        for batch in slices(batches, "text"):
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv != current[0]:
                    size += flush()
                    turns = []
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(done, schema=CONVERSATION)
                        done, size = [], 0
                current = (conv,)
                turns.append((role or "", text or ""))
        if turns:
            flush()
            yield pa.RecordBatch.from_pylist(done, schema=CONVERSATION)

    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    spans = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>>"
    return ordered.mapInArrow(render, f"conv_id bigint, n_turns bigint, formatted string, spans {spans}, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted texts: turns are parsed and unescaped, loss texts are cut out by their spans.

    ``formatted`` are rows of ``format_conversations`` under ``turn_template``.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "formatted"):
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                turns = parse_turns(text)
                all_turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["loss"]:
                        said = unescape(text[s["text_start"] : s["text_end"]])
                        chars += len(said)
                        loss.update(said.encode())
                out.append((conv, len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return formatted.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(16 + length(regexp_replace(role, '(\\|</?turn|###)', '\\\1', 'g')) + length(text)
      + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn', ''))) // 6
      + (length(text) - length(replace(text, '<turn', ''))) // 5 + (length(text) - length(replace(text, '###', ''))) // 3
      + (length(text) - length(replace(text, '>' || chr(10), ''))) // 2)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
