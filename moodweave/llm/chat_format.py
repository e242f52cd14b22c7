"""Formatting of conversations with a compiled template, and reading them back.

A conversation is dealt out in parts of ``TURNS`` turn numbers, so one with a
third of all rows is rendered by many tasks.  A first pass over the keys alone
counts the turns of each part and of the parts before it; its rows precede the
part's turns in the one shuffle of the texts, and every task renders its turns
as they stream by.  Parts end early at ``PART_CHARS`` code points; a
conversation's texts in the order of (part, piece) are its formatted text.

``read_back`` parses the formatted text again.  Digests of conversations in one
piece are taken there; only the pieces of longer ones travel to one task, which
hashes them as they stream by (a sequential hash has no parallel form).

Defined results: null roles and texts are empty, null turns come first, equal
turns are ordered by role and text; repeated rows are turns of their own; null
ids are one conversation; extra columns are ignored; an empty table has no
conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodweave.llm.chat_template import Controls, Sink, Template, loop_at

TURNS = 1024
PART_CHARS = 1 << 22

# Strings that steer a model, and the layout of turns.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<END>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TEMPLATE = """
{%- for message in messages -%}
  {%- if message.role == 'user' -%}
    {{ '[INST] ' }}{{ message.text | escape }}{{ ' [/INST]' }}
  {%- elif message.role == 'assistant' -%}
    {{ bos }}{% generation %}{{ message.text | escape }}{% endgeneration %}{{ eos }}
  {%- else -%}
    <<SYS>>{{ message.role | escape }}<</SYS>>{{ message.text | escape }}<<END>>
  {%- endif -%}
{%- endfor -%}
"""
CONSTANTS = {"bos": "<s>", "eos": "</s>"}
_TURN = re.compile(r"(?s)\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|<<SYS>>(.*?)<</SYS>>(.*?)<<END>>")


def default_template() -> Template:
    return Template(TEMPLATE, CONTROLS, CONSTANTS)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a text that the default template made."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m[1] is not None:
            yield "user", Controls.unescape(m[1])
        elif m[2] is not None:
            yield "assistant", Controls.unescape(m[2])
        else:
            yield Controls.unescape(m[3]), Controls.unescape(m[4])


def _arranged(rows: DataFrame) -> DataFrame:
    """Turns behind a row (kind 0) with their part's counts, in order, in the partition of the part."""
    part = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))).cast("long")
    keys = rows.select("conv_id", part.alias("part"))
    conv = Window.partitionBy("conv_id")
    none = F.lit(None).cast("string")
    counts = keys.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"),
        (F.sum("n").over(conv.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(conv).alias("total"),
        "n", F.count(F.lit(1)).over(conv).alias("parts"))
    zero = F.lit(0).cast("long")
    turns = rows.select("conv_id", part.alias("part"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        zero.alias("before"), zero.alias("total"), zero.alias("n"), zero.alias("parts"))
    return counts.unionByName(turns).repartition("conv_id", "part") \
        .sortWithinPartitions("conv_id", "part", "kind", F.asc_nulls_first("turn"), "role", "text")


_PARTS = "conv_id {id}, part long, piece long, whole boolean, n_turns long, text string, spans array<struct<start: long, stop: long>>"


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, part, piece, whole, n_turns, text, spans): formatted text with the spans under the loss mask.

    ``whole`` marks a conversation in one piece; spans count code points in their own text.
    """
    template = template or default_template()
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        sink, head, i, piece, first = None, None, 0, 0, 0
        done: list[tuple] = []

        def close(last: bool):
            nonlocal sink, piece, first
            conv, part, _, _, parts = head
            done.append((conv, part, piece, last and piece == 0 and parts == 1, i - first, sink.text(),
                         [{"start": a, "stop": b} for a, b in sink.spans]))
            sink, piece, first = Sink(), piece + 1, i

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [[]] * 7
            done.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            if schema is None:
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int64()), ("piece", pa.int64()),
                                    ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("spans", span)])
            size = 0
            for conv, part, kind, role, text, before, total, n, parts in zip(*[batch.column(c).to_pylist() for c in (
                    "conv_id", "part", "kind", "role", "text", "before", "total", "n", "parts")]):
                if kind == 0:
                    head, i, piece, first, sink = (conv, part, before + n, total, parts), before, 0, before, Sink()
                    if before == 0:
                        template.head(sink, None, None)
                    continue
                template.turn(sink, {"role": role, "text": text}, loop_at(i, head[3]) if template.positional else None)
                i += 1
                if i == head[3]:
                    template.foot(sink, None, None)
                if i == head[2] or sink.size >= PART_CHARS:
                    size += sink.size
                    close(i == head[2])
                    if size >= PART_CHARS:
                        size = 0
                        yield flushed()
            if done:
                yield flushed()

    return _arranged(rows).mapInArrow(run, _PARTS.format(id=id_type))


_READ = "conv_id {id}, part long, piece long, whole boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"
_DIGEST = ("conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {c: batch.column(c) for c in ("conv_id", "part", "piece", "whole")}
        out = []
        for text, spans, whole in zip(batch.column("text"), batch.column("spans"), batch.column("whole")):
            text = text.as_py()
            turns = list(read_turns(text))
            said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
            loss = "".join(Controls.unescape(text[s["start"]:s["stop"]]) for s in spans.as_py())
            n_loss, loss = len(loss), loss.encode()
            if whole.as_py():
                said, loss = hashlib.sha256(said).digest(), hashlib.sha256(loss).digest()
            out.append((len(turns), said, n_loss, loss, len(text)))
        types = [("n_turns", pa.int64()), ("turns", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("formatted_chars", pa.int64())]
        done = list(zip(*out)) if out else [[]] * 5
        yield pa.record_batch([*cols.values(), *[pa.array(c, t) for c, (_, t) in zip(done, types)]], names=[*cols, *[n for n, _ in types]])


def _merge_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces arrive in order; only hash states are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, open_ = None, False
    for batch in batches:
        types[0] = batch.schema.field("conv_id").type
        out = []
        for r in batch.to_pylist():
            if open_ and (r["whole"] or r["conv_id"] != now[0]):
                out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                open_ = False
            if r["whole"]:
                out.append((r["conv_id"], r["n_turns"], r["turns"].hex(), r["loss_chars"], r["loss"].hex(), r["formatted_chars"]))
                continue
            if not open_:
                now, open_ = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            now[1] += r["n_turns"]
            now[2].update(r["turns"])
            now[3] += r["loss_chars"]
            now[4].update(r["loss"])
            now[5] += r["formatted_chars"]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if open_:
        last = (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
        yield pa.record_batch([pa.array([v], t) for v, t in zip(last, types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts of the default template alone."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    pieces = formatted.mapInArrow(_read_pieces, _READ.format(id=id_type))
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece") \
        .mapInArrow(_merge_pieces, _DIGEST.format(id=id_type))
