"""Plan shape of every query: windows, exchanges, joins, Python nodes -- read from the physical plan's nodes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from moodweave.plans.queries import REGISTRY

QUERIES = {k: v for k, v in E.queries().items() if k in REGISTRY}

# Queries whose only unpartitioned window runs over one row per partition (the offsets of a range partitioning).
OFFSET_WINDOWS = {"emotion_regroup", "label_file_regroup", "attach_by_position", "batch_metrics", "label_encode", "encode_ids", "encode_ids_full", "segment_ids", "segment_ids_full"}
PYTHON = ("Python", "Pandas", "Arrow")
# Queries that number rows in file order, as they stream out of their splits (an Arrow pass that holds one batch).
NUMBERED = {"attach_by_position", "label_file_regroup", "lexicon_files", "lexicon_scan", "batch_metrics"}


def nodes(df):
    """All physical nodes, before exchanges are reused or re-planned."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        n = todo.pop()
        out.append(n)
        kids = n.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return out


def faults(df, offsets=False):
    found = []
    for n in nodes(df):
        kind = n.getClass().getSimpleName()
        if kind == "WindowExec" and n.partitionSpec().isEmpty():
            order = n.orderSpec().mkString(",")
            if not (offsets and "_pid" in order):
                found.append(f"unpartitioned window by {order}")
        if kind in ("CartesianProductExec", "BroadcastNestedLoopJoinExec"):
            found.append(kind)
        if any(p in kind for p in PYTHON):
            found.append(kind)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_has_a_fault(spark, name):
    """No window over all rows in one task, no cartesian or nested-loop join, no Python evaluation."""
    found = faults(QUERIES[name](spark, SF_SMALL), name in OFFSET_WINDOWS)
    assert [f for f in found if not (name in NUMBERED and "Arrow" in f)] == []


def test_the_check_finds_bad_plans(spark):
    df = spark.range(10)
    bad = df.withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert faults(bad) and faults(bad, offsets=True)
    assert faults(df.crossJoin(spark.range(3).toDF("x")))
    assert faults(df.withColumn("x", F.udf(lambda x: str(x))("id")))
    assert faults(df.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("id")))) == []


def test_top_k_is_limited_before_the_shuffle(spark):
    p = QUERIES["class_top_words"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["emotion_tag", "vad_matched", "vad_all_words", "big_five"])
def test_lexicon_scoring_shuffles_nothing(spark, name):
    p = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "Join" not in p


@pytest.mark.parametrize("name,most", [("emotion_regroup", 1), ("class_tfidf_diff", 0), ("classification_report", 2),
                                       ("emotion_tag", 1), ("premise_dialog", 2)])
def test_text_is_scanned_once_for_its_purpose(spark, name, most):
    """Scans of a text or embedding column left in the final plan (written intermediate tables are read instead)."""
    p = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    reads = [x for x in p.split("ReadSchema")[1:] if "text:" in x.split("\n")[0] or "embedding:" in x.split("\n")[0]]
    assert len(reads) <= most, p


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["ensemble_pos_neg"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in p
    d2 = QUERIES["stratified_split"](spark, SF_SMALL)
    p2 = d2._jdf.queryExecution().executedPlan().toString()
    assert "text" not in p2.split("ReadSchema")[1].split("\n")[0] or "struct<doc_id:bigint>" in p2


@pytest.mark.parametrize("name", ["emotion_transition", "align_emory", "align_meld", "premise_dialog",
                                  "class_tfidf", "class_top_words", "stratified_split", "nli_sweep_split",
                                  "emotion_regroup", "encode_ids", "speaker_pool", "result_grid",
                                  "aligned_distribution", "exact_sweep_split", "attach_by_position",
                                  "label_file_regroup"])
def test_same_result_at_1_and_64_shuffle_partitions(spark, name):
    res = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            res.append(sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
