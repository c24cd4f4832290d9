"""Chat formatting: render conversations with a template and find each turn's span by comparing renderings of prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Escapes inside texts; afterwards neither "<" nor "[" is left, so no control string of the template can appear.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_TURN = re.compile(r"<s>\[INST\] ([^<\[]*) \[/INST\]| ([^<\[]*)</s>|<s>\[ROLE ([^<\[\]]*)\] ([^<\[]*) \[/ROLE\]")
PROBE = "␂probe␃"

Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    for plain, safe in reversed(ESCAPES):
        text = text.replace(safe, plain)
    return text


def _role(role: str) -> str:
    return escape(role).replace("]", "&#93;")


def inst_template(turns: list[tuple[str, str]]) -> str:
    """The production template. Control strings: <s> </s> [INST] [/INST] [ROLE ...] [/ROLE]."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"<s>[ROLE {_role(role)}] {escape(text)} [/ROLE]")
    return "".join(out)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of inst_template, unescaped; ValueError on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((unescape(m[3].replace("&#93;", "]")), unescape(m[4])))
        at = m.end()
    return turns


def turn_spans(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """(output, spans, rewritten): renders successive prefixes of the turns and compares consecutive outputs.

    A span is (start, end, text_start, text_end) in the final output: what turn k added, and where its text lies,
    found by rendering the prefix once more with a probe as the last text. ``rewritten`` counts the turns whose
    arrival changed earlier output; a rewritten output has no stable spans, so theirs are (-1, -1, -1, -1)."""
    before, spans, rewritten = template([]), [], 0
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewritten += 1
            spans = [(-1, -1, -1, -1)] * (k + 1)
        else:
            probed = template([*turns[:k], (turns[k][0], PROBE)])
            at = probed.rfind(PROBE)
            tail = len(probed) - at - len(PROBE)
            ok = at >= len(before) and len(now) - tail >= at and probed[:at] == now[:at] and probed[at + len(PROBE) :] == now[len(now) - tail :]
            spans.append((len(before), len(now), at, len(now) - tail) if ok else (len(before), len(now), -1, -1))
        before = now
    return before, spans, rewritten


def format_chats(convs: DataFrame, template: Template = inst_template, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, spans, loss_spans, rewritten, unplaced): one row per conversation.

    Turns are rendered in the order of turn (null first, ties by role, then text); null roles and texts are empty. All
    rows with a null conversation id are one conversation. ``loss_spans`` are the texts (escaped, as rendered) of the
    loss roles; ``unplaced`` counts those whose place the probe could not tell, which the mask then lacks. A template is a
    black box from turns to output: any prefix may render differently from the last one, so each conversation is rendered
    twice per turn, which costs the square of its length; a template that rewrites history yields spans of -1 and
    ``rewritten`` above 0. Conversations are dealt by id, sorted and streamed, one in memory at a time."""
    span = pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")])
    fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span)), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewritten", pa.int64()), ("unplaced", pa.int64())])
    schema = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long>>, loss_spans array<struct<start:long,end:long>>, rewritten long, unplaced long"

    def one(conv, turns):
        out, spans, rewritten = turn_spans(turns, template)
        wanted = [s for (r, _), s in zip(turns, spans, strict=True) if r in loss_roles]
        loss = [{"start": s[2], "end": s[3]} for s in wanted if s[2] >= 0]
        named = [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True)) for s in spans]
        return {"conv_id": conv, "n_turns": len(turns), "formatted": out, "spans": named, "loss_spans": loss, "rewritten": rewritten, "unplaced": len(wanted) - len(loss)}

    def part(batches):
        conv, turns = None, []
        for batch in batches:
            done = []
            for c, r, x in zip(*(batch[n].to_pylist() for n in ("c", "r", "x")), strict=True):
                if turns and c != conv:
                    done.append(one(conv, turns))
                    turns = []
                conv = c
                turns.append((r, x))
            yield pa.RecordBatch.from_pylist(done, fields)
        if turns:
            yield pa.RecordBatch.from_pylist([one(conv, turns)], fields)

    rows = convs.select(
        F.col(conv_col).cast("long").alias("c"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("t"),
        F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"),
    )
    return rows.repartition(C.shuffle_width(convs.sparkSession), "c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(part, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when read back: digests of the turns and of the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def part(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv, out, spans in zip(*(batch[n].to_pylist() for n in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = read_back(out)
                loss = "".join(unescape(out[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{x}\n" for r, x in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(part, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(convs.unionByName(extra)))


_ESC = "length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 4 * (length(text) - length(replace(text, '[', '')))"
_ROLE = "length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', ''))) + 4 * (length(role) - length(replace(role, '[', ''))) + 4 * (length(role) - length(replace(role, ']', '')))"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_ESC} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 19 + {_ROLE} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
