"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to one string. It is rendered for each
successive prefix of a conversation, and consecutive outputs are compared: where an output
continues the one before, what it adds is the new turn's span. A template that changes
what it had already written rewrites history: the conversation is marked, and has no spans
and no loss mask from the first such turn on.

Conversations are put in order by a sort inside hash partitions and formatted one at a
time from the stream of rows, so that a task holds one conversation, not a partition. (The
digests that are asked for are sequential over a conversation, too.) Rendering all prefixes
costs the square of a conversation's length. A template that is known to be additive, which
means that a list's rendering is that of its turns one after the other, is rendered in blocks
of turns instead, prefixes of a block at a time: the cost is then proportional to the length.
The default template is additive.

Turns are in order of ``turn`` (nulls first), then role and text; repeated rows are turns of
their own. A null text or role is empty. Rows with a null ``conv_id`` are one conversation.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Turns to a block of an additive template.
BLOCK = 32
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_OPEN, _SEP, _CLOSE = "### ", ": ", " </turn>\n"
_CONTROL, _ROLE_CONTROL, _ESCAPED = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    """A backslash before each character that a control string or an escape begins with."""
    return pattern.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """The default template: ``### role: text </turn>`` and a line end for each turn."""
    return "".join([f"{_OPEN}{escape(role, _ROLE_CONTROL)}{_SEP}{escape(text)}{_CLOSE}" for role, text in turns])


def locate(turns: list[Turn], template: Template, block: int | None = None) -> tuple[str, list[tuple[int, int]], int | None]:
    """The whole rendering, the spans of the turns, and the first turn (from 0) that rewrote history, if any.

    block: turns to a block, for additive templates only; None renders each prefix from the start.
    """
    pieces, spans, at, size = [], [], 0, block or max(1, len(turns))
    for start in range(0, len(turns), size):
        own, before = turns[start : start + size], template([])
        for k in range(1, len(own) + 1):
            out = template(own[:k])
            if not out.startswith(before):
                return template(turns), spans, start + k - 1
            spans.append((at + len(before), at + len(out)))
            before = out
        pieces.append(before)
        at += len(before)
    return "".join(pieces) if turns else template([]), spans, None


def read_back(out: str, span: tuple[int, int]) -> tuple[str, str, int, int]:
    """Role, text, and where the (escaped) text lies, of a turn of the default template."""
    m = _TURN.fullmatch(out, *span)
    if m is None:
        raise ValueError(f"no turn at {span}")
    return unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


SCHEMA = "n_turns bigint, formatted string, spans array<struct<start:bigint,end:bigint>>, loss array<struct<start:bigint,end:bigint>>, rewrites_at bigint"


def format_conversations(conversations: DataFrame, template: Template = turn_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id`` and SCHEMA: the text, the span of each turn and of each trained turn's text, as code points, and the turn that rewrote history.

    The loss mask of other templates than the default is the whole span of a trained turn.
    """
    kind = conversations.schema["conv_id"]
    out = StructType([kind, *StructType.fromDDL(SCHEMA).fields])
    schema = to_arrow_schema(out)

    def one(turns: list[Turn]) -> tuple:
        text, spans, rewrote = locate(turns, template, BLOCK if template is turn_template else None)
        loss = [read_back(text, s)[2:] if template is turn_template else s for s, (role, _) in zip(spans, turns, strict=False) if role in trained] if rewrote is None else []
        pairs = lambda xs: [{"start": a, "end": b} for a, b in xs]
        return len(turns), text, pairs(spans), pairs(loss), rewrote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars, now, turns = [], 0, None, []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return got

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and conv != now:
                    rows.append((now, *one(turns)))
                    chars += len(rows[-1][2])
                    turns = []
                    if len(rows) >= 2000 or chars > 1 << 24:
                        yield flush()
                        chars = 0
                now = conv
                turns.append((role or "", text or ""))
        if turns:
            rows.append((now, *one(turns)))
        if rows:
            yield flush()

    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, out)


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"


def digest(formatted: DataFrame) -> DataFrame:
    """``conv_id`` and DIGESTS, read back from the output of ``format_conversations`` with the default template."""
    out = StructType([formatted.schema["conv_id"], *StructType.fromDDL(DIGESTS).fields])
    schema = to_arrow_schema(out)

    def one(conv: object, text: str, spans: list, loss: list, rewrites: int | None) -> tuple:
        turns, learnt = hashlib.sha256(), hashlib.sha256()
        for s in spans:
            role, said, _, _ = read_back(text, (s["start"], s["end"]))
            turns.update(f"{role}\n{said}\n".encode())
        chars = 0
        for s in loss:
            said = unescape(text[s["start"] : s["end"]])
            chars += len(said)
            learnt.update(said.encode())
        return conv, len(spans), turns.hexdigest(), chars, learnt.hexdigest(), len(text), rewrites is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*r) for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "formatted", "spans", "loss", "rewrites_at").mapInArrow(run, out)


def planted(conversations: DataFrame) -> DataFrame:
    """The table's own turns and conversation -7, whose texts look like the template's marks."""
    said = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    own = ["conv_id", "turn", "role", "text"]
    return conversations.select(*own).unionByName(extra.select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("t.turn").cast("bigint").alias("turn"), F.col("t.role").alias("role"), F.lit(said).alias("text")))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('###  :  </turn> ') - 1 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM c GROUP BY conv_id
"""
