"""Invariants of SURVEY section 5 on the driver tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID

Q = E.queries()


def test_distribution_shares_sum_to_one(spark):
    d = Q["emotion_distribution"](spark, SF_MID)
    sums = d.groupBy("trait", "label").agg(F.sum("n").alias("n"), F.sum("share").alias("s")).collect()
    for r in sums:
        assert r.n == 0 or abs(r.s - 1.0) < 1e-5, r


def test_transition_rows_sum_to_one_or_are_empty(spark):
    t = Q["emotion_transition"](spark, SF_MID)
    for r in t.groupBy("trait", "e_from").agg(F.sum("n").alias("n"), F.sum("ratio").alias("s")).collect():
        assert (r.n == 0 and r.s is None) or abs(r.s - 1.0) < 1e-5, r


def test_ensemble_flips_when_hypotheses_swap(spark):
    from moodweave.operators.evaluate import ensemble_pos_neg
    from moodweave.sources.fixtures import v_logits
    lg = v_logits(spark, SF_MID)
    a = ensemble_pos_neg(lg).select("vec_id", "pred", (F.col("p0") == F.col("p1")).alias("tie"))
    sw = lg.select("vec_id", F.col("neg0").alias("pos0"), F.col("neg1").alias("pos1"),
                   F.col("pos0").alias("neg0"), F.col("pos1").alias("neg1"))
    b = ensemble_pos_neg(sw).select("vec_id", F.col("pred").alias("pred2"))
    bad = a.join(b, "vec_id").where(~F.col("tie") & (F.col("pred") + F.col("pred2") != 1)).count()
    assert bad == 0


def test_mask_length_equals_turn_count(spark):
    m = Q["mask_full"](spark, SF_MID)
    t = Q["speaker_mask"](spark, SF_MID).groupBy("scene_id", "character").agg(F.count("*").alias("n"))
    j = m.join(t, ["scene_id", "character"])
    assert j.where(F.col("n") != F.col("n_turns")).count() == 0
    assert m.count() == t.count()


def test_sweep_splits_complete_and_disjoint(spark):
    s = Q["nli_sweep_split"](spark, SF_MID)
    per = s.groupBy("trait", "flow_len", "seed").agg(F.sum("n").alias("n")).select("n").distinct().collect()
    assert len(per) == 1  # every (trait, length, seed) splits the same sample set completely
