"""Rows numbered in file order, and what is built on it."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from moodweave.operators import dialog, evaluate
from moodweave.sources import files as FS
from moodweave.sources import order as FO


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(tmp_dir, name, lines, header="a\tb"):
    os.makedirs(f"{tmp_dir}/{name}", exist_ok=True)
    for i, part in enumerate(lines):
        with open(f"{tmp_dir}/{name}/part-{i}.tsv", "w") as f:
            f.write("".join(x + "\n" for x in [header, *part]))
    return f"{tmp_dir}/{name}"


def test_numbers_follow_files_and_lines(spark, tmp_dir, small_splits):
    parts = [[f"{i}\t{'x' * (i % 50)}" for i in range(a, b)] for a, b in ((0, 700), (700, 700), (700, 701), (701, 1500))]
    scan = FS.read_csv(spark, write(tmp_dir, "n", parts), "a long, b string", "\t")
    assert scan.rdd.getNumPartitions() > 5
    rows = FO.number_rows(FO.place_rows(FO.with_split(scan))).select("a", "row_no").collect()
    assert len(rows) == 1500 and all(r.a == r.row_no for r in rows)


@pytest.mark.parametrize("size", ["4096", "1m"])
def test_attach_by_position(spark, tmp_dir, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        left = FS.read_csv(spark, write(tmp_dir, "l", [[f"{i}\tkey {i}" for i in range(1000)]]), "a long, b string", "\t")
        right = FS.read_csv(spark, write(tmp_dir, "r", [[str(i) for i in range(333)], [str(i) for i in range(333, 900)]], "c"), "c long", "\t")
        got = {r.a: r.c for r in FO.attach_by_position(left, right).collect()}
        assert got == {i: i if i < 900 else None for i in range(1000)}
        assert FO.attach_by_position(right, left).count() == 900
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lexicon_in_several_files_keeps_the_later_row(spark, tmp_dir, small_splits):
    files = [[f"w{i}\t0.1\t0.{i % 10}\t0.3" for i in range(400)] + ["twice\t0.1\t0.1\t0.1"],
             [f"w{i}\t0.2\t0.{i % 10}\t0.3" for i in range(0, 400, 2)] + ["twice\t0.5\t0.1\t0.1", "twice\t0.6\t0.1\t0.1"],
             [f"w{i}\t0.3\t0.{i % 10}\t0.3" for i in range(0, 400, 3)]]
    got = {r.word: round(r.v) for r in FS.read_lexicon(spark, write(tmp_dir, "x", files, "Word\tValence\tArousal\tDominance")).collect()}
    assert got == {f"w{i}": 300 if i % 3 == 0 else 200 if i % 2 == 0 else 100 for i in range(400)} | {"twice": 600}


def test_one_line_label_file_is_read_by_many_tasks(spark, tmp_dir, small_splits):
    labels = [float(random.Random(3).choices(range(7), k=1)[0]) if i % 5 else 6.0 for i in range(20000)]
    os.makedirs(f"{tmp_dir}/labels")
    with open(f"{tmp_dir}/labels/a.txt", "w") as f:
        f.write(str(labels))
    with open(f"{tmp_dir}/labels/b.txt", "w") as f:
        f.write("[]\n[1.0]\n[2.0, 3e0]\n\n[]\n[-4]")
    read = FS.read_label_file(spark, f"{tmp_dir}/labels")
    assert spark.read.option("lineSep", ",").text(f"{tmp_dir}/labels").rdd.getNumPartitions() > 10
    assert [tuple(r) for r in read.orderBy("idx").collect()] == list(enumerate([*labels, 1.0, 2.0, 3.0, -4.0]))
    # regrouped to dialogues, whose lengths come from elsewhere
    rnd, sizes, start = random.Random(4), [], 0
    while start < len(labels):
        sizes.append((f"s{start}", start, rnd.choice([0, 1, 7, 5000])))
        start += sizes[-1][2]
    dialogs = spark.createDataFrame(sizes, "scene_id string, start long, len long")
    got = {(r.scene_id, r.pos): r.flat_idx for r in dialog.regroup_labels(read, dialogs).collect() if r.flat_idx < len(labels)}
    assert got == {(s, p): a + p for s, a, n in sizes for p in range(n) if a + p < len(labels)}


def test_label_file_round_trip(spark, tmp_dir):
    flat = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("label"))
    FS.write_label_file(flat, f"{tmp_dir}/out")
    assert not any("\n" in open(f"{tmp_dir}/out/{f}").read() for f in os.listdir(f"{tmp_dir}/out") if f.endswith(".txt"))
    assert sorted(map(tuple, FS.read_label_file(spark, f"{tmp_dir}/out").collect())) == sorted(map(tuple, flat.collect()))


def _mcc(pairs):
    n, c = len(pairs), sum(a == b for a, b in pairs)
    ks = {k for p in pairs for k in p}
    t = {k: sum(a == k for a, _ in pairs) for k in ks}
    p = {k: sum(b == k for _, b in pairs) for k in ks}
    den = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    return (c * n - sum(t[k] * p[k] for k in ks)) / den if den else 0.0


def test_metrics_per_batch_are_summed(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(3), rnd.randrange(3)) for i in range(100)] + [(i, 1, 1) for i in range(100, 116)] + [(116, 0, 2), (117, 2, 2)]
    df = spark.createDataFrame(rows, "row_no long, label int, pred int").repartition(5)
    got = evaluate.batch_metrics(df, "label", "pred", "row_no", 16).first()
    batches = [[(a, b) for _, a, b in rows[i:i + 16]] for i in range(0, len(rows), 16)]
    assert got.batches == len(batches) == 8 and len(batches[-1]) == 6 and got.n == len(rows)
    assert math.isclose(got.mcc_sum, sum(map(_mcc, batches)), abs_tol=1e-9)
    assert math.isclose(got.accuracy_sum, sum(sum(a == b for a, b in x) / len(x) for x in batches), abs_tol=1e-9)


def test_csv_with_quotes_and_line_breaks(spark, tmp_dir):
    rows = [(1, 'a "quoted", text', 0), (2, "line\nbreak,\r\nand", 1), (3, "", None), (4, None, 1), (5, "plain", 0)]
    df = spark.createDataFrame(rows, "doc_id long, utterance string, labels int")
    df.write.options(**FS.TEXT_WRITE).csv(f"{tmp_dir}/csv")
    back = FS.read_csv(spark, f"{tmp_dir}/csv", "doc_id long, utterance string, labels int", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_a_run_is_committed_once(spark, tmp_dir):
    """Committed twice, and again after a job that failed half-way: one copy of every run, types as declared."""
    schema = "cell string, value long, run string"
    path = f"{tmp_dir}/results"
    one = spark.createDataFrame([("a", 1, "007"), ("b", 2, "007"), ("a", 3, "8")], schema)
    FS.commit_results(one, path)
    FS.commit_results(one.repartition(3), path)
    two = spark.range(0, 100, 1, 8).select(F.col("id").cast("string").alias("cell"), F.col("id").alias("value"), F.lit("9").alias("run"))
    broken = two.withColumn("value", F.when(F.col("value") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        FS.commit_results(broken, path)
    assert FS.read_results(spark, path, schema).where("run = '9'").count() == 0
    for _ in range(2):
        FS.commit_results(two.unionByName(one.withColumn("value", F.col("value") + 100)), path)
    got = sorted(map(tuple, FS.read_results(spark, path, schema).collect()))
    assert got == sorted([("a", 1, "007"), ("b", 2, "007"), ("a", 3, "8")] + [(str(i), i, "9") for i in range(100)])
