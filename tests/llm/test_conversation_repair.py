import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import CLASH, EDGE  # noqa: E402

from moodweave.llm import conversation_repair as CR  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, audit, lines) over all edits, by trying them all on short lists of (role, text, must go, truncated)."""
    best = {"": (0, "", ())}

    def better(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    def after(key, role):        # what may follow depends on the last turn alone
        tail = {"": "", "s": "s", "u": "u", "a": "ua"}[key] + role[:1]
        return tail[-1] if role and re.match(r"s?(ua)*u?\Z", tail) else None

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for key, (c, a, lines) in list(out.items()):
                for r in ("user", "assistant"):
                    if after(key, r):
                        better(out, after(key, r), (c + 2, a + "I", (*lines, r + ":")))
        return out

    for role, text, gone, cut in rows:
        new = {}
        for key, (c, a, lines) in inserted(best).items():
            better(new, key, (c + 3, a + "D", lines))
            if gone:
                continue
            for to, cost, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                if after(key, to):
                    better(new, after(key, to), (c + cost + cut, a + edit, (*lines, f"{to}:{text}")))
        best = new
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def brute(rows):
    """The contract, row by row, on (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        by[c] += []
        if fate == 4:
            r = "user"
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        by[c] += [(t, r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, marked, n = set(), [], [0, 0, 0]
        for _, r, x in turns:
            solid = x.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not solid else 1 if (r, x) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((r, x))
            if fault < 3:
                n[fault] += 1
            marked.append((r, x, fault < 2, fault == 2))
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = cheapest(marked)
        out[c] = (gaps, *n, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = CR.repair(CR.damage(spark.createDataFrame(rows, SCHEMA)))
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


KIND = st.tuples(st.sampled_from("sua?"), st.booleans(), st.booleans())


def in_memory(kinds):
    f = CR.Fold()
    rows = [({"s": "system", "u": "user", "a": "assistant", "?": "?"}[k[0]], str(i)) for i, k in enumerate(kinds)]
    f.add(rows, kinds, [0, 0, 0, 0], None, None, 0, CR.solve(kinds, (0,)))
    return f.result()[5:]


@given(st.lists(KIND, max_size=9))
@settings(max_examples=400, deadline=None)
def test_cheapest_least_audit(kinds):
    rows = [({"s": "system", "u": "user", "a": "assistant", "?": "?"}[k], str(i), g, c and not g) for i, (k, g, c) in enumerate(kinds)]
    cost, audit, lines = cheapest(rows)
    got = in_memory([(k, g, c and not g) for k, g, c in kinds])
    assert got == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert RIGHT.match("".join(line[0] for line in lines))


@given(st.lists(KIND, min_size=1, max_size=60), st.integers(2, 9))
@settings(max_examples=200, deadline=None)
def test_parts_fold_to_the_whole(kinds, size):
    kinds = [(k, g, c and not g) for k, g, c in kinds]
    rows = [({"s": "system", "u": "user", "a": "assistant", "?": "?"}[k[0]], str(i)) for i, k in enumerate(kinds)]
    f = CR.Fold()
    for i in range(0, len(kinds), size):
        part = kinds[i:i + size]
        f.add(rows[i:i + size], part, [0, 0, 0, 0], None, None, 0, CR.solve(part, range(4)))
    assert f.result()[5:] == in_memory(kinds)


@given(st.lists(KIND, max_size=12))
@settings(max_examples=100, deadline=None)
def test_hash_collisions_change_nothing(kinds):
    want = in_memory(kinds)
    mod, CR._MOD = CR._MOD, 2
    try:
        assert in_memory(kinds) == want
    finally:
        CR._MOD = mod


def test_long_conversation_shares_its_audits():
    rnd = random.Random(5)
    kinds = [(rnd.choice("sua?"), rnd.random() < .2, rnd.random() < .2) for _ in range(20000)]
    whole = in_memory(kinds)
    assert whole[0] > 0 and len(whole[1]) >= len(kinds)


def conversations(seed=3, n=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? \n", "same one.", " ", "x.\x85"]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "admin", ""]), rnd.choice([*texts, None, f"t{t}."]))
            for c in range(n) for t in range(rnd.randrange(1, 9)) if rnd.random() < .9]
    rows += [(None, t, "user", "hi.") for t in (None, 1, 1, 5)] + [(-3, None, r, "x.") for r in ("user", "assistant", "user")]
    rows += [(200, t * 700, ("user", "assistant")[t % 2], ("same.", f"only {t}.", "again", "")[t % 4]) for t in range(40)]     # over many parts
    rows += [(201, t, ("user", "assistant")[t % 2], f"long {t % 1500}.") for t in range(3000)]
    return rows + [(300, i, "user", t) for i, (_, t) in enumerate(EDGE)] + [rows[0]] * 3


def test_equals_brute_force(spark):
    rows = conversations()
    assert repaired(spark, rows) == brute(rows)


def test_conversation_without_rows_and_clashing_names(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "x.")], SCHEMA).selectExpr("*", *[f"{v} as {k}" for k, v in CLASH.items() if v != "doc_id"], "1 as part", "2 as kind", "true as live")
    got = CR.repair(CR.damage(df)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert CR.repair(CR.damage(df.limit(0))).count() == 0


@pytest.mark.parametrize("kinds,cost,audit", [("", 0, ""), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("u", 2, "KI"), ("uu", 2, "KR"),
                                              ("au", 4, "IKKI"), ("s", 3, "D"), ("ss", 4, "KIR")])
def test_small_audits(kinds, cost, audit):
    assert in_memory([(k, False, False) for k in kinds])[:2] == (cost, audit)
