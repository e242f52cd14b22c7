"""What the classifiers and the alignment write grows with their input, not with cells, steps or pairs."""

import os
import random

from pyspark.sql import functions as F

from moodweave.operators import align as AL
from moodweave.operators import model as ML
from moodweave.operators import train as TN
from moodweave.session import checkpoint_root


def test_a_bag_row_is_written_once_for_all_cells(spark, monkeypatch):
    bags = spark.createDataFrame([("m", f"s{i}", "c", w, 1) for i in range(10) for w in ("aa", "bb")],
                                 "mode string, scene_id string, character string, word string, tf bigint")
    splits = spark.createDataFrame([(f"s{i}", "c", t, k, i % 2, "test" if i < 2 else "train") for i in range(10) for t in "AB" for k in (0, 1)],
                                   "scene_id string, character string, trait string, seed int, label int, split string")
    rows, keep = {}, ML.stored
    monkeypatch.setattr(ML, "stored", lambda df, name: (t := keep(df, name), rows.setdefault(name, t.count()))[0])
    assert ML.naive_bayes(bags, splits).count() == 2 * 4 * len(ML.ALPHAS)
    assert rows == {"bayes-truth": 10, "bayes-bags": 20, "bayes-counts": 2}


def test_training_leaves_only_what_its_result_reads(spark):
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    rows = [(f"s{i}", "c", "A", 0, i % 2, ("train", "train", "valid", "test")[i % 4]) for i in range(16)]
    splits = spark.createDataFrame(rows, "scene_id string, character string, trait string, seed int, label int, split string")
    features = splits.select(F.lit(1.0).alias("flow_len"), F.lit("m").alias("mode"), "scene_id", "character",
                             F.col("label").cast("string").alias("word"), F.lit(1.0).alias("x"))
    out = TN.train(features, splits, traits=("A",), seeds=(0,), steps=2)
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before if x.startswith("train-"))
    assert left == ["train-groups", "train-rows", "train-rows", "train-truth"]
    assert out.count() == 2 * 8


def test_long_texts_of_common_grams_form_few_pairs(spark):
    rnd = random.Random(4)
    words = ["sunny", "rainy", "cloudy", "windy", "stormy", "quiet", "early", "later"]
    n = 120
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(n)]
    rows = [(1, 0, i, t) for i, t in enumerate(texts)] + [(1, 1, i, "so, " + t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "bk long, side int, id long, text string")
    pairs = {(r.tid, r.aid) for r in AL._candidates(df, AL.GRAM, AL.WINDOW).collect()}
    assert pairs >= {(i, i) for i in range(n)} and len(pairs) < 2 * n


def _corpus(spark):
    turns = [(f"0{k % 2 + 1}_e01_c{k}", p, "Ann X", f"turn {p} of dialogue {k} says that all is well") for k in range(6) for p in range(3)]
    ann = [("s", int(s[:2]), 1, "['Ann X']" if s[:2] == "01" else "['Bob']", t, "joy", 10 * k) for k, (s, _, _, t) in enumerate(turns)]
    return spark.createDataFrame(turns, "scene_id string, pos long, speaker string, text string"), spark.createDataFrame(
        ann, "split string, Season int, Episode int, Speaker string, Utterance string, Emotion string, ann_order long")


def test_coverage_keeps_neither_fingerprints_nor_shuffled_texts(spark, monkeypatch):
    """Corpora are aligned one after the other, each from blocks that both sides have; the last step reads numbers only."""
    root = checkpoint_root(spark).removeprefix("file:")
    before, rows, keep = set(os.listdir(root)), {}, AL.stored
    monkeypatch.setattr(AL, "stored", lambda df, name: (t := keep(df, name), rows.setdefault(name, []).append(t.count()))[0])
    turns, ann = _corpus(spark)
    out = AL.coverage({"emory": AL.align(turns, ann, "emory"), "meld": AL.align(turns, ann, "meld")})
    r = out.first()
    assert (r.n_turns, r.emory_labelled, r.meld_labelled) == (18, 9, 0)
    assert rows["align-prints"] == [18, 0]          # nine turns and nine annotations of season 1; no block of the other corpus
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before if x.startswith("align")}
    assert left == {"align-turns", "align-annotations", "align-blocks", "align-pairs", "aligned-emory", "aligned-meld"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in x.split("\n")[0] and "Utterance" not in x.split("\n")[0] for x in plan.split("ReadSchema")[1:])


def test_labelled_dialogs_reads_numbers_only(spark):
    turns, ann = _corpus(spark)
    out = AL.labelled_dialogs({"emory": AL.align(turns, ann, "emory"), "meld": AL.align(turns, ann, "meld")})
    assert {r.scene_id: (r.any_emory, r.all_emory, r.any_meld) for r in out.collect()} == \
        {f"0{k % 2 + 1}_e01_c{k}": (k % 2 == 0, k % 2 == 0, False) for k in range(6)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan
    assert all("text" not in x.split("\n")[0] and "Utterance" not in x.split("\n")[0] for x in plan.split("ReadSchema")[1:])
