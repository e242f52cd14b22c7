import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import EDGE, edge_docs, empty_docs, rows  # noqa: E402

from moodweave.llm import dp_packing as DP  # noqa: E402

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_round_trip_and_gapless_sequences(spark, tokenizer):
    docs = edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = DP.pack(docs, PATH).collect()
    texts = dict(EDGE)
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for d, rs in by.items():
        want = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [DP.CLOSING]
        ids = []
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == len(ids) and r["doc_tokens"] == len(want)
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] + r["length"] == len(ids)
        assert ids == want
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rs[0]["sequence_tokens"] <= DP.WINDOW


def test_null_and_repeated_ids_and_order(spark):
    got = DP.pack(edge_docs(spark), PATH).where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got}[10] == 2
    ordered = DP.pack(edge_docs(spark).where("doc_id is not null"), PATH, order_by="doc_id").collect()
    ids = [r["doc_id"] for r in sorted(ordered, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert ids == sorted(ids)
    assert rows(DP.pack(empty_docs(spark), PATH)) == []


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_of_words_are_ids_of_the_text(tokenizer, words):
    text = " ".join(words)
    lookup = DP.WordIds(tokenizer).learn(set(text.encode().split()))
    ids = b"".join(lookup[w] for w in text.encode().split())
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def brute_cost(at, pen, window):
    f = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best = None
        for i in range(j):
            size = at[j] - at[i]
            if size <= window and f[i] is not None:
                c = f[i] + pen[j] + (0 if size & (size - 1) == 0 else window - size)
                best = c if best is None or c < best else best
        f[j] = best
    return f[-1]


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        at = sorted({0, *(rng.randrange(1, 200) for _ in range(rng.randrange(1, 40)))})
        at = [0] + [x for k, x in enumerate(at[1:], 1)]
        if max(b - a for a, b in zip(at, at[1:])) > 32 if len(at) > 1 else True:
            continue
        pen = [rng.choice((0, 2, 9)) for _ in at]
        path = DP.cut(np.array(at), np.array(pen), 32)
        cost = sum(pen[j] + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else 32 - n) for i, j in zip(path, path[1:]))
        assert path[0] == 0 and path[-1] == len(at) - 1 and cost == brute_cost(at, pen, 32)


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [r[0] for r in DP.pack(docs, PATH).select("sequence_tokens", "sequence_id").distinct().collect()]
    waste = sum(DP.padded(n) - n for n in sizes)
    assert waste < 0.02 * sum(sizes)


def test_remembered_words_are_bounded_and_ids_stay(spark, tokenizer):
    few, many = DP.WordIds(tokenizer, remembered=50), DP.WordIds(tokenizer)
    for lot in range(40):
        words = {f"w{lot * 7 + k}x,".encode() for k in range(30)} | {b"again"}
        assert {w: few.learn(words)[w] for w in words} == {w: many.learn(words)[w] for w in words}
        assert len(few.now) + len(few.old) <= 2 * (50 + len(words))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    assert rows(DP.pack(docs, PATH, remembered=1000)) == rows(DP.pack(docs, PATH))
