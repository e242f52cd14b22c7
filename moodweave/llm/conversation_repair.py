"""Repair of conversation structure by a persistent audit dynamic programme.

A conversation should read ``(system? (user assistant)+)?``.  The cheapest
edits that make it so are found by a dynamic programme over an automaton of
four states (nothing yet, after a system turn, after a user, after an
assistant); of equally cheap edits the one with the least audit string, the
edits' initials in order, wins.

Audit strings are persistent: an edit is a node that points to the edits
before it, so candidates share their beginnings and a step costs one node.
Nodes hold a rolling hash and binary-lifting ancestors.  A tie is decided by a
search for the longest common beginning: lifting finds the last place with
equal hashes, then the labels behind it are compared.  Equal hashes are
verified by walking down to a shared node; if a collision shows, the labels
are compared one by one.  Insertions come before the edit of a row, so two
audits of the same rows are never prefixes of each other unless equal.

Rows are dealt out in parts of ``TURNS`` turn numbers.  A part is solved for
every state that it can be entered in; folding the parts of a conversation in
order takes the same steps with whole parts in place of rows, and carries one
hash of the repaired text for each state.  Only conversations in several parts
send their rows on.  Repeats across parts are found beforehand, by a join of
hashed rows, and reach a part as marks in front of its rows.

Defined results: see ``damage`` and ``repair``; ties of turns are ordered by
role and text; repeated rows are repeats; extra columns are ignored; an empty
table has no conversations.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURNS = 1024
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: state and role initial to the next state; ``ACCEPT`` holds what must still be inserted at the end.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPT = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
ROLES = {"u": "user", "a": "assistant"}

_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_FINAL = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """One edit and those before it."""
    __slots__ = ("up", "label", "depth", "hash")

    def __init__(self, parent: Node | None, label: str):
        self.label = label
        if parent is None:
            self.up, self.depth, self.hash = [], 0, 0
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + hash_label(label)) % _MOD
        # up[k] is the ancestor 2 ** k edits before
        self.up = up = [parent]
        k, node = 0, parent
        while len(node.up) > k:
            node = node.up[k]
            up.append(node)
            k += 1

    def labels(self) -> list[str]:
        out, node = [], self
        while node.depth:
            out.append(node.label)
            node = node.up[0]
        return out[::-1]


def hash_label(label: str) -> int:
    value = 7
    for c in label:
        value = (value * 131 + ord(c)) % _MOD
    return value


def _same(a: Node, b: Node) -> bool:
    while a is not b:
        if a.label != b.label:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, a_label: str, b: Node, b_label: str) -> bool:
    """Whether the audit of ``a`` then ``a_label`` comes before that of ``b`` then ``b_label``; both have as many edits."""
    if a is not b and a.hash != b.hash:
        for k in range(len(a.up) - 1, -1, -1):
            if k < len(a.up) and a.up[k].hash != b.up[k].hash:
                a, b = a.up[k], b.up[k]
        a_label, b_label, a, b = a.label, b.label, a.up[0], b.up[0]
    if not _same(a, b):             # unequal beginnings of equal hash
        return a.labels() + [a_label] < b.labels() + [b_label]
    return a_label < b_label


def _steps() -> dict:
    """Edits of a row by (role initial, must go, truncated): [(state before, state after, cost, label, roles written)].

    ``roles`` spells what the edits write: initials for inserted and re-roled turns, '=' for a kept one.
    """
    out = {}
    for initial, gone, cut in itertools.product("sua?", (False, True), (False, True)):
        best: dict = {(s, s): (COST[DELETE], DELETE, "") for s in range(4)}
        for state in range(4) if not gone else ():
            for inserted in ("", "u", "a", "ua", "au"):
                at = state
                for r in inserted:
                    at = NEXT.get((at, r))
                for role, edit in ((initial, KEEP), ("u", REROLE), ("a", REROLE)):
                    to = NEXT.get((at, role))
                    if at is None or to is None:
                        continue
                    cost = COST[INSERT] * len(inserted) + COST[edit] + TRUNCATED_COST * cut
                    option = (cost, INSERT * len(inserted) + edit, inserted + ("=" if edit == KEEP else role))
                    best[state, to] = min(best.get((state, to), option), option)
        out[initial, gone, cut] = [(a, b, *v) for (a, b), v in sorted(best.items())]
    return out


STEPS = _steps()


def advance(row: list, options: Iterable[tuple]) -> list:
    """States after an edit: row[s] is None or (cost, node); options are (before, after, cost, label)."""
    new: list = [None] * 4
    for a, b, cost, label, *_ in options:
        if row[a] is None:
            continue
        total, node, old = row[a][0] + cost, row[a][1], new[b]
        if old is None or total < old[0] or total == old[0] and less(node, label, old[1], old[2]):
            new[b] = (total, node, label)
    return [n and (n[0], Node(n[1], n[2])) for n in new]


def solve(kinds: list[tuple], entries: Iterable[int]) -> list[tuple[int, int, int, list[str]]]:
    """(state before, state after, cost, labels): the best audit of rows of these ``STEPS`` keys, a label per row."""
    out = []
    for entry in entries:
        row: list = [(0, Node(None, "")) if s == entry else None for s in range(4)]
        for kind in kinds:
            row = advance(row, STEPS[kind])
        out += [(entry, s, r[0], r[1].labels()) for s, r in enumerate(row) if r]
    return out


def written(rows: list[tuple[str, str]], kinds: list[tuple], entry: int, labels: list[str]) -> Iterator[str]:
    """The turns that an audit leaves, as ``role:text``."""
    state = entry
    for (role, text), kind, label in zip(rows, kinds, labels):
        spelt = next(roles for a, b, _, lab, roles in STEPS[kind] if a == state and lab == label)
        for r in spelt:
            state = NEXT[state, role[:1] if r == "=" else r]
        yield from (f"{ROLES[r]}:" for r in spelt[:-1])
        if spelt:
            yield f"{role}:{text}" if spelt[-1] == "=" else f"{ROLES[spelt[-1]]}:{text}"


class Fold:
    """The parts of one conversation, folded in order."""

    def __init__(self):
        self.row = [(0, Node(None, "")), None, None, None]
        self.texts: list = [(hashlib.sha256(), False), None, None, None]      # hash and whether anything was written
        self.counts = [0, 0, 0, 0]                                            # blank, duplicate, truncated, illegal
        self.last, self.low, self.high, self.turns = None, None, None, 0

    def add(self, rows, kinds, counts, low, high, turns, solved) -> None:
        labels = {(a, b): lab for a, b, _, lab in solved}
        old, texts = self.row, self.texts
        new: list = [None] * 4
        for a, b, cost, lab in solved:
            if old[a] is None:
                continue
            total, node, text = old[a][0] + cost, old[a][1], "".join(lab)
            if new[b] is None or total < new[b][0] or total == new[b][0] and less(node, text, new[b][1], new[b][2]):
                new[b] = (total, node, text, a)
        self.row = [n and (n[0], Node(n[1], n[2])) for n in new]
        self.texts = [None] * 4
        for b, n in enumerate(new):
            if n:
                sha, some = texts[n[3]][0].copy(), texts[n[3]][1]
                for line in written(rows, kinds, n[3], labels[n[3], b]):
                    sha.update((("\n" if some else "") + line).encode())
                    some = True
                self.texts[b] = (sha, some)
        for i, c in enumerate(counts):
            self.counts[i] += c
        if rows:
            self.counts[3] += self.last is not None and illegal(self.last, rows[0][0])
            self.last = rows[-1][0]
        self.turns += turns
        self.low = low if self.low is None else self.low if low is None else min(low, self.low)
        self.high = high if self.high is None else self.high if high is None else max(high, self.high)

    def result(self) -> tuple:
        best = None
        for s, r in enumerate(self.row):
            if r:
                end = ACCEPT[s]
                total, label = r[0] + COST[INSERT] * len(end), INSERT * len(end)
                if best is None or total < best[0] or total == best[0] and less(r[1], label, best[1], best[2]):
                    best = (total, r[1], label, s)
        cost, node, label, s = best
        sha, some = self.texts[s]
        for r in ACCEPT[s]:
            sha.update((("\n" if some else "") + f"{ROLES[r]}:").encode())
            some = True
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts, cost, "".join(node.labels()) + label, sha.hexdigest())


def illegal(before: str, after: str) -> bool:
    return before[:1] + after[:1] not in ("su", "ua", "au")


def read_part(rows: list[tuple], marks: set) -> tuple:
    """Faults of a part's rows (turn, role, text, hash): kinds, counts, least and greatest turn, and distinct turns."""
    kinds, counts, seen = [], [0, 0, 0, 0], set()
    turns = {t for t, *_ in rows if t is not None}
    for _, role, text, key in rows:
        first = None if key in seen or key in marks else key
        seen.add(key)
        blank = not _SEEN.search(text)
        repeat = not blank and first is None
        cut = not blank and not repeat and not _FINAL.search(text)
        counts[0] += blank
        counts[1] += repeat
        counts[2] += cut
        initial = role[:1] if role[:1] in ("s", "u", "a") and role else "?"
        kinds.append((initial, blank or repeat, cut))
    counts[3] = sum(illegal(a[1], b[1]) for a, b in itertools.pairwise(rows))
    return kinds, counts, min(turns, default=None), max(turns, default=None), len(turns)


# --- Spark ----------------------------------------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """Damaged copies of the rows, by the crc32 of ``conv_id:turn`` modulo 20; a dropped row stays as ``live`` = false.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it in place, 4 makes its role ``user``.
    Null ids and turns count as one space in the sum; null roles and texts become one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20))
    text = F.coalesce(F.col("text"), space)
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), fate.alias("fate"),
                       F.when(fate == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
                       F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.select("conv_id", "turn", "role", "text", (F.col("fate") != 0).alias("live"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    part = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))).cast("long")
    key = F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    return rows.select("conv_id", part.alias("part"), "turn", "role", "text", "live", key.alias("key"))


def _marks(rows: DataFrame) -> DataFrame:
    """(conv_id, part, key): rows of a part whose role and text stand in an earlier part of the conversation."""
    same = F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("no_id")
    long = rows.groupBy("conv_id").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where(F.col("p0") < F.col("p1")).select(*same)
    inside = rows.where("live").select("conv_id", "part", "key", *same).join(long, ["c", "no_id"], "left_semi") \
        .groupBy("conv_id", "c", "no_id", "key", "part").agg(F.lit(1).alias("one"))
    first = inside.groupBy("c", "no_id", "key").agg(F.min("part").alias("first"))
    return inside.join(first, ["c", "no_id", "key"]).where(F.col("part") > F.col("first")).select("conv_id", "part", "key")


_PART = ("conv_id {id}, part long, whole boolean, result struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, "
         "cost: long, audit: string, repaired_sha256: string>, state binary")
_RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _solve_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    now, rows, marks, size, id_type = None, [], set(), 0, None
    done: list = []

    def close():
        conv, part, parts = now
        kinds, counts, low, high, turns = read_part(rows, marks)
        plain = [(r, t) for _, r, t, _ in rows]
        if parts == 1:
            f = Fold()
            f.add(plain, kinds, counts, low, high, turns, solve(kinds, (START,)))
            done.append((conv, part, True, dict(zip(_FIELDS, f.result())), None))
        else:
            state = (plain, kinds, counts, low, high, turns, solve(kinds, range(4)))
            done.append((conv, part, False, None, pickle.dumps(state)))

    def flushed() -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.bool_(), pa.struct(list(zip(_FIELDS, _TYPES))), pa.binary()]
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", "part", "whole", "result", "state"])
        done.clear()
        return batch

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv, part, kind, parts, turn, role, text, key in zip(*[batch.column(c).to_pylist() for c in (
                "conv_id", "part", "kind", "parts", "turn", "role", "text", "key")]):
            if kind == 0:
                if now is not None:
                    close()
                now, rows, marks = (conv, part, parts), [], set()
            elif kind == 1:
                marks.add(key)
            else:
                rows.append((turn, role, text, key))
                size += len(text)
        if done and size > 1 << 22:
            size = 0
            yield flushed()
    if now is not None:
        close()
    if done:
        yield flushed()


def _fold_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    now, fold, id_type = None, None, None
    for batch in batches:
        id_type, out = batch.schema.field("conv_id").type, []
        for conv, whole, result, state in zip(*[batch.column(c) for c in ("conv_id", "whole", "result", "state")]):
            conv, whole = conv.as_py(), whole.as_py()
            if fold is not None and (whole or conv != now):
                out.append((now, *fold.result()))
                fold = None
            if whole:
                out.append((conv, *result.as_py().values()))
                continue
            if fold is None:
                now, fold = conv, Fold()
            fold.add(*pickle.loads(state.as_py()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [id_type, *_TYPES])], names=["conv_id", *_FIELDS])
    if fold is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((now, *fold.result()), [id_type, *_TYPES])], names=["conv_id", *_FIELDS])


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows with ``live`` false name a conversation without belonging to it; without any other row it has zeros,
    an empty audit and the hash of an empty text.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    keyed = _keyed(rows)
    heads = keyed.groupBy("conv_id", "part").agg(F.max(F.lit(1)).alias("one")) \
        .select("conv_id", "part", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("parts"))
    no_long, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    none = {"parts": no_long, "turn": no_long, "role": no_text, "text": no_text, "key": F.lit(None).cast("binary")}

    def shaped(df, kind, *has):
        return df.select("conv_id", "part", F.lit(kind).alias("kind"), *[F.col(c) if c in has else v.alias(c) for c, v in none.items()])

    arranged = shaped(heads, 0, "parts").unionByName(shaped(_marks(keyed), 1, "key")) \
        .unionByName(shaped(keyed.where("live"), 2, "turn", "role", "text", "key")) \
        .repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "kind", F.asc_nulls_first("turn"), "role", "text")
    parts = arranged.mapInArrow(_solve_parts, _PART.format(id=id_type))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_fold_parts, _RESULT.format(id=id_type))
