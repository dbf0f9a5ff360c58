"""Operator 4, chat formatting with a compiled template.

Conversations are rows by turn.  Rows are dealt by conversation, sorted by turn, and streamed:
the compiled template pulls one turn at a time, so memory does not grow with a conversation.

Rows: null roles and texts are empty; turns that tie are ordered by role and text; repeated
rows are turns of their own; the null conv_id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.template import compile_template

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role|line|control }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|control }}{% endgeneration %}{% else %}{{ m.text|control }}{% endif %}" + END + "{{ '\\n' }}{% endfor %}"
)


def control(text: str) -> str:
    """No ``<|`` stays: each gets a backslash inside, as does each that already has some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def uncontrol(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS = {"control": control, "line": line}
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
SEGMENTS_DDL = "conv_id long, text string, loss array<struct<begin: long, end: long>>"
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def segments(rows: Iterator[tuple], template: str = TEMPLATE) -> Iterator[tuple]:
    """(conv_id, role, text) rows by conversation -> (conv_id, text, loss spans): one segment per turn, which join to the formatted text."""
    render = compile_template(template, FILTERS)
    for conv_id, turns in groupby(rows, key=lambda r: r[0]):
        done: list[tuple] = []
        text: list[str] = []
        spans: list[dict] = []
        at = 0

        def flush():
            nonlocal at
            if text:
                done.append((conv_id, "".join(text), list(spans)))
            text.clear()
            spans.clear()
            at = 0

        def messages():
            first = True
            for _, role, said in turns:
                if not first:
                    flush()
                first = False
                yield {"role": role or "", "text": said or ""}

        for piece, loss in render(messages=messages()):
            if done:
                yield from done
                done.clear()
            text.append(piece)
            if loss and piece:
                if spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(piece)
                else:
                    spans.append({"begin": at, "end": at + len(piece)})
            at += len(piece)
        flush()
        yield from done


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Segments -> one row per conversation, parsed from the formatted text and its loss spans alone."""
    for conv_id, parts in groupby(rows, key=lambda r: r[0]):
        turns, losses = hashlib.sha256(), hashlib.sha256()
        n = chars = loss_chars = 0
        rest = ""
        for _, text, spans in parts:
            chars += len(text)
            for span in spans:
                said = uncontrol(text[span["begin"] : span["end"]])
                loss_chars += len(said)
                losses.update(said.encode())
            rest, at = rest + text, 0
            for m in _TURN.finditer(rest):
                if m.start() != at:
                    raise ValueError(f"conversation {conv_id}: text between turns")
                turns.update(f"{unline(uncontrol(m[1]))}\n{uncontrol(m[2])}\n".encode())
                n, at = n + 1, m.end()
            rest = rest[at:]
        if rest:
            raise ValueError(f"conversation {conv_id}: an unfinished turn")
        yield conv_id, n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Turns -> formatted segments in order within each partition, a conversation wholly in one."""
    compile_template(template, FILTERS)  # a bad template fails here, not in a task
    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "t", "r", "x").select("conv_id", "r", "x")
    return dealt.mapInArrow(lambda batches: _batches(segments(_rows(batches), template), SEGMENTS), SEGMENTS_DDL)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads ``format_conversations`` output back, in its order (no shuffle between them)."""
    return formatted.mapInArrow(lambda batches: _batches(read_back(_rows(batches)), DIGESTS), DIGESTS_DDL)
