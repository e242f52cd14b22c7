"""Property tests for the distributed helpers against plain Python."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodweave.operators import split as S
from moodweave.plans.scale import bounded_broadcast, dense_index, global_rank, is_small, prefix_sum

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
words = st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="abcxyzé", min_size=1, max_size=4)),
                 min_size=1, max_size=60, unique_by=lambda t: t[1])


@SETTINGS
@given(rows=words)
def test_global_rank_is_a_total_order(spark, rows):
    df = spark.createDataFrame(rows, "n int, word string")
    got = {r.word: r["rank"] for r in global_rank(df.withColumn("neg", -F.col("n")), ["neg", "word"],
                                                   partitions=3).collect()}
    want = {w: i + 1 for i, (_, w) in enumerate(sorted(rows, key=lambda t: (-t[0], t[1].encode())))}
    assert got == want


@SETTINGS
@given(rows=st.lists(st.sampled_from(["joy", "fear", "anger", None]), min_size=1, max_size=40))
def test_dense_index(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "e string")
    names = sorted({x for x in rows if x is not None})
    want = {n: i for i, n in enumerate(names)}
    assert {r.e: r["index"] for r in dense_index(df, "e").collect()} == want


@SETTINGS
@given(vals=st.dictionaries(st.integers(0, 2 ** 62), st.integers(0, 9), min_size=1, max_size=300))
def test_prefix_sum_equals_running_total_on_sparse_ids(spark, vals):
    df = spark.createDataFrame(list(vals.items()), "k bigint, v int")
    got = {r.k: r.start for r in prefix_sum(df, ["k"], "v").collect()}
    run = 0
    for k in sorted(vals):
        assert got[k] == run
        run += vals[k]


def test_prefix_sum_spreads_sparse_ids_over_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(2 ** 62)).alias("k"), F.lit(1).alias("v"))
    per_task = [r["count"] for r in prefix_sum(df, ["k"], "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > n // 2 and max(per_task) < 3 * 20_000 / n


@SETTINGS
@given(n=st.integers(1, 400), pos_share=st.integers(1, 9), seed=st.integers(0, 5000))
def test_stratified_split_exact_counts(spark, n, pos_share, seed):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 < pos_share).cast("int").alias("y"))
    s = S.stratified_split(df, "doc_id", "y", seed=seed)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        ny = sum(1 for i in range(n) if (i % 10 < pos_share) == bool(y))
        if ny == 0:
            continue
        nt = math.ceil(ny * 0.1)
        nv = math.ceil((ny - nt) * 0.1)
        assert c.get((y, "test"), 0) == nt
        assert c.get((y, "valid"), 0) == nv
        assert c.get((y, "train"), 0) == ny - nt - nv


def test_bounded_broadcast_only_under_the_bound(spark):
    small = spark.range(10)
    assert is_small(small, 10) and not is_small(small, 9)
    assert is_small(small, 10, 90) and not is_small(small, 10, 79)     # {"id":k}: 8 bytes a row
    p = spark.range(1000).join(bounded_broadcast(small), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in p


ALPHABET = "aZé漢Ωß9_ [](),.!?'\"-\t\n  　\u0085ñÜ"


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=20))
def test_tokeniser_matches_python_unicode_semantics(spark, texts):
    import re

    from moodweave.functions.text import lexicon_tokens
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", lexicon_tokens("t").alias("a"),
                                              lexicon_tokens("t", " ").alias("b")).collect()}
    for i, t in enumerate(texts):
        want_a = re.sub(r"[^\w\s\[\]]", "", t.lower()).split()
        want_b = re.sub(r"[^\w\s\[\]]", " ", t.lower()).split()
        assert got[i] == (want_a, want_b), repr(t)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(st.tuples(st.integers(0, 1), st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "éé", "x_1"]),
                                                             max_size=8)), min_size=2, max_size=15))
def test_class_tfidf_matches_plain_python(spark, docs):
    import math as m
    from collections import Counter

    from moodweave.operators.wordstats import class_tfidf_top
    rows = [(lab, " ".join(ws)) for lab, ws in docs]
    df = spark.createDataFrame(rows, "labels int, t string")
    got = {(r.labels, r.word): r.tfidf for r in class_tfidf_top(df, "labels", "t", k=1000).collect()}
    classes = sorted({lab for lab, _ in docs})
    tf = {c: Counter(w for lab, ws in docs if lab == c for w in ws) for c in classes}
    dfreq = Counter(w for c in classes for w in tf[c])
    want = {}
    for c in classes:
        wts = {w: n * (m.log((1 + len(classes)) / (1 + dfreq[w])) + 1) for w, n in tf[c].items()}
        norm = m.sqrt(sum(v * v for v in wts.values()))
        want.update({(c, w): v / norm for w, v in wts.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
