import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import CLASH, edge_docs, empty_docs  # noqa: E402

from moodweave.llm import collocations as CO  # noqa: E402
from moodweave.llm.common import Scratch  # noqa: E402


def brute_counts(docs, longest):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i:i + m])] += 1
    return f, n


def brute(docs, longest=3, least=10, share=50, top=2000):
    f, n = brute_counts(docs, longest)
    cand = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    held = Counter()
    for (lang, p), a in cand.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, " ".join(w[i:i + m])] = max(held[lang, " ".join(w[i:i + m])], a)
    rows = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * held[lang, p] >= share * a and held[lang, p]:
            continue
        w, cuts = p.split(" "), []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        rows[lang].append((-s, -a, p.encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, r in rows.items()
            for i, (s, a, p, left, right) in enumerate(sorted(r)[:top], 1)}


def mined(spark, docs, **kw):
    df = spark.createDataFrame(docs, "text string, lang string")
    return {tuple(r) for r in CO.mine(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def corpus(seed, n=150):
    rnd = random.Random(seed)
    chorus = " ".join(f"w{i}" for i in range(25))
    words = ["the", "of", "New", "york", "city", "a", "b", "Ünder", "x\xa0y", "z"]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rnd.randrange(0, 40)))
        out.append((t + rnd.choice(["", chorus, "a a a a a a", chorus + " end"]), rnd.choice(["en", "en", None, "d\te"])))
    return out + [(None, "en"), ("", None), ("one", "xx"), (" \t ", "xx")] + [out[0]] * 12


@pytest.mark.parametrize("longest,least", [(3, 10), (2, 3), (4, 5), (3, 2)])
def test_equals_brute_force(spark, longest, least):
    docs = corpus(longest * 10 + least)
    assert mined(spark, docs, longest=longest, min_count=least) == brute(docs, longest, least)


@given(st.lists(st.text("ab. \t", max_size=12), max_size=4), st.integers(1, 4), st.booleans())
@settings(max_examples=200, deadline=None)
def test_edges_start_at_every_word(texts, longest, many_words):
    # an edge of 40 different words does not fit one number
    texts = texts + [" ".join(f"v{i}" for i in range(40))] * many_words
    longest = longest + 11 * many_words
    got = Counter()
    edges, counts = CO.combine_edges([t for x in [*texts, " "] for t in CO._tokens(x)], longest)
    assert len(set(edges.to_pylist())) == len(edges)
    for e, n in zip(edges.to_pylist(), counts.tolist()):
        w = e.split(b" ")
        for k in range(1, len(w) + 1):
            got["und", b" ".join(w[:k]).decode()] += n
    assert got == +brute_counts([(t, None) for t in texts], longest)[0]


def test_runs_end_at_a_piece(spark, monkeypatch):
    monkeypatch.setattr(CO, "RUN", 7)
    docs = [("a b c d e f g h i j. k l m " * 3, "en"), ("x " * 30, "fr"), ("a b c", "en")] * 4
    assert mined(spark, docs, min_count=2) == brute(docs, least=2)


def test_paths_are_maximal_and_keep_every_edge(spark):
    chorus = " ".join(f"w{i}" for i in range(300))
    docs = [(chorus, "en")] * 10 + [("start " + chorus.replace("w250", "other"), "en")] * 10
    with Scratch(spark) as s:
        counts, _ = CO.count_phrases(spark.createDataFrame(docs, "text string, lang string"), s)
        paths = CO.compact(counts, s)
        got = {r["path"]: r["weight"] for r in paths.collect()}
        edges = {(r["phrase"], r["a"]) for r in CO.windows(paths).collect()}
        f, _ = brute_counts(docs, 3)
        assert edges == {(p, a) for (_, p), a in f.items() if p.count(" ") == 2}
    w = chorus.split(" ")
    want = {(0, 250): 20, (248, 253): 10, (251, 300): 20}       # shared, own word, shared again
    assert got == {" ".join(w[i:j]): n for (i, j), n in want.items()} | {
        "start w0 w1": 10, " ".join([*w[248:250], "other", *w[251:253]]): 10}


def test_ties_rank_by_bytes_and_tops_are_cut_per_language(spark):
    docs = [(f"{a} {b}", lang) for a, b in (("p", "q"), ("ä", "z"), ("m", "n")) for lang in ("en", "fr") for _ in range(10)]
    got = mined(spark, docs, top=2)
    assert {(g[0], g[1], g[2]) for g in got} == {(x, i, p) for x in ("en", "fr") for i, p in ((1, "m n"), (2, "p q"))}


def test_counts_past_64_bits(spark):
    c = spark.createDataFrame([("en", "a b", 4_000_000_000_000, None, None)], "lang string, phrase string, a long, head_f long, tail_f long")
    counts = spark.createDataFrame([("en", "a", 1, 5_000_000_000_000), ("en", "b", 1, 4_000_000_000_001)], "lang string, phrase string, words int, f long")
    assert CO.weakest_cuts(c, counts).first()["score"] == 10**6 * 4 * 10**12 * 4 * 10**12 // (5 * 10**12 * (4 * 10**12 + 1))


def test_edge_rows_clashing_names_and_empty_table(spark):
    docs = edge_docs(spark).selectExpr("*", "cast(null as string) as lang", "1 as edge", "2 as phrase", "3 as f")
    want = brute([(r["text"], r["lang"]) for r in docs.collect()])
    got = CO.mine(docs)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want
    assert set(CLASH)
    none = CO.mine(empty_docs(spark).selectExpr("*", "'en' as lang"))
    assert none.count() == 0 and none.schema.names == got.schema.names


def test_nothing_but_the_result_stays_behind(spark, tmp_path):
    before = set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("phrase-*"))
    CO.mine(spark.createDataFrame([("a b " * 20, "en")], "text string, lang string")).collect()
    after = set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("phrase-*")) - before
    assert [p.name.rsplit("-", 1)[0] for p in after] == ["phrase-top"]
