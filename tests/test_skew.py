"""One dialogue holding most rows: pre-aggregated operators against a brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from moodweave.operators import dialog, patterns

EMOS = ["neutral", "joy", "surprise", "anger", "sadness", "disgust", "fear"]
SPEAKERS = ["Una Smith", "Una Sr.", "Abe Jones", "Narrator"]


def _fixture(spark):
    rnd = random.Random(7)
    rows = []
    sizes = {"big": 2000, "s1": 3, "s2": 5, "s3": 1}
    for sc, n in sizes.items():
        for p in range(n):
            rows.append((sc, p, rnd.choice(SPEAKERS), rnd.choice(EMOS), rnd.randrange(7)))
    tagged = spark.createDataFrame(rows, "scene_id string, pos bigint, speaker string, emotion string, "
                                         "emotion_id int").repartition(8)
    chars = sorted({(r[0], r[2]) for r in rows})
    flags = [(sc, ch, rnd.random() < 0.6, None, None, None, None) for sc, ch in chars]
    traits = spark.createDataFrame(flags, "scene_id string, character string, cAGR boolean, cCON boolean, "
                                          "cEXT boolean, cOPN boolean, cNEU boolean")
    return rows, flags, tagged, traits


def fw(s):
    return s.split(" ")[0]


def test_transition_matches_brute_force(spark):
    rows, flags, tagged, traits = _fixture(spark)
    by_scene = {}
    for sc, p, spk, emo, _ in rows:
        by_scene.setdefault(sc, {})[p] = (spk, emo)
    want = Counter()
    for sc, ch, f, *_ in flags:
        if not f:
            continue
        turns = by_scene[sc]
        for j in range(len(turns) - 1):
            a, b = turns[j], turns[j + 1]
            if fw(a[0]) != fw(ch) and fw(b[0]) == fw(ch) and a[1] != "neutral" and b[1] != "neutral":
                want[(a[1], b[1])] += 1
    got = {(r.e_from, r.e_to): r.n for r in
           patterns.emotion_transition(tagged, traits).where("trait = 'A' AND n > 0").collect()}
    assert got == dict(want)


def test_distribution_matches_brute_force(spark):
    rows, flags, tagged, traits = _fixture(spark)
    last = {}
    for sc, p, *_ in rows:
        last[sc] = max(last.get(sc, -1), p)
    want = Counter()
    for sc, ch, f, *_ in flags:
        for s2, p, spk, emo, _ in rows:
            if s2 == sc and p < last[sc] and fw(spk) == fw(ch):
                want[(f, emo)] += 1
    got = {(bool(r.label), r.emotion): r.n for r in
           patterns.emotion_distribution(tagged, traits).where("trait = 'A' AND n > 0").collect()}
    assert got == dict(want)


def test_regroup_with_one_giant_dialogue(spark):
    rows, _, tagged, _ = _fixture(spark)
    t = tagged.withColumn("conv_id", F.when(F.col("scene_id") == "big", 5).otherwise(
        F.substring("scene_id", 2, 1).cast("int")))
    offsets = dialog.dialog_offsets(t, "conv_id")
    back = dialog.regroup_labels(dialog.flatten_labels(t, offsets), offsets, bucket=64)
    got = {(r.scene_id, r.pos): r.emotion for r in back.collect()}
    names = {0: "neutral", 1: "joy", 2: "surprise", 3: "anger", 4: "sadness", 5: "disgust", 6: "fear"}
    assert got == {(sc, p): names[i] for sc, p, _, _, i in rows}


def test_a_long_dialogue_is_joined_from_ranges(spark, monkeypatch):
    """Strings of a dialogue with most of all turns are built range by range; only the last step sees one row a range."""
    from moodweave.operators import dialog as D
    monkeypatch.setattr(D, "RANGE", 16)
    turns = [("hot", i, ("Ann X", "Bob", "Ann Y", None)[i % 4], f"t{i}" if i % 7 else None) for i in range(1000)]
    turns += [(f"s{i}", p, "Bob", f"u{p}") for i in range(20) for p in range(3)]
    cast = [("hot", "Ann X"), ("hot", "Bob"), ("hot", "Nobody"), ("hot", None), ("s3", "Bob"), ("s3", "Bob"), ("gone", "Bob")]
    t = spark.createDataFrame(turns, "scene_id string, pos long, speaker string, text string").repartition(7)
    c = spark.createDataFrame(cast, "scene_id string, character string")
    assert D.range_arrays(t, "text").where("scene_id = 'hot'").selectExpr("max(size(arr)) as m", "count(1) as n").first() == (16, 63)

    def brute(owns, sep):
        return sorted(((s, who, "".join(sep + x for sc, _, k, x in turns if sc == s and x is not None and owns(k, who)))
                       for s, who in cast), key=str)

    def got(df):
        return sorted(map(tuple, df.collect()), key=str)
    def exact(k, who):
        return k is not None and k == who

    def first(k, who):
        return k is not None and who is not None and k.split(" ")[0] == who.split(" ")[0]
    assert got(D.speaker_text(t, c)) == brute(exact, " ")
    assert got(D.speaker_text(t, c, "first_word")) == brute(first, " ")
    assert got(D.context_text(t, c)) == brute(lambda k, who: not exact(k, who), " ")
    assert got(D.dialog_text(t, c)) == brute(lambda k, who: True, "")
