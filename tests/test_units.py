"""Hand-written rows for the traps of the analysed workflows."""

import math

from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.numeric import round6
from moodweave.functions.text import first_word, first_word_exact, lexicon_tokens, tfidf_tokens
from moodweave.operators import affect, align, dialog, encode, evaluate, lexicon, pairs, patterns
from moodweave.operators import split as S
from moodweave.operators import traits as TR
from moodweave.operators import wordstats as WS
from moodweave.sources import files as FS

TURNS = "scene_id string, pos bigint, speaker string, text string"


def lex(spark, rows):
    return spark.createDataFrame(rows, "word string, v bigint, a bigint, d bigint")


def test_tokenise_keeps_accents_and_brackets(spark):
    df = spark.createDataFrame([("Élan, vital! [x] ça-va  ",)], "t string")
    assert df.select(lexicon_tokens("t")).first()[0] == ["élan", "vital", "[x]", "çava"]
    assert df.select(lexicon_tokens("t", " ")).first()[0] == ["élan", "vital", "[x]", "ça", "va"]
    assert df.select(tfidf_tokens("t")).first()[0] == ["élan", "vital", "ça", "va"]


def test_punctuation_only_and_empty_text_give_no_tokens(spark):
    df = spark.createDataFrame([("?!...",), ("",)], "t string")
    assert [r[0] for r in df.select(lexicon_tokens("t")).collect()] == [[], []]


def test_first_word_variants(spark):
    df = spark.createDataFrame([(" Una Smith",), ("Una Sr.",), ("",)], "s string")
    got = df.select(first_word_exact("s"), first_word("s")).collect()
    assert [tuple(r) for r in got] == [("", "Una"), ("Una", "Una"), ("", None)]


def test_nearest_anchor_and_no_match_is_neutral(spark):
    turns = spark.createDataFrame([("s", 0, "A", "joyword joyword"), ("s", 1, "A", "nothing here"),
                                   ("s", 2, "A", "")], TURNS)
    lx = lex(spark, [("joyword", 760, 480, 350)])
    got = {r.pos: r.emotion for r in affect.emotion_tag(turns, lx).collect()}
    assert got == {0: "joy", 1: "neutral", 2: "neutral"}


def test_anchor_tie_goes_to_lowest_id(spark):
    # mean exactly between joy (id 1) and surprise (id 2) on every axis
    j, s = K.EMOTION_ANCHORS_MILLI["joy"], K.EMOTION_ANCHORS_MILLI["surprise"]
    turns = spark.createDataFrame([("s", 0, "A", "p q")], TURNS)
    lx = lex(spark, [("p", *j), ("q", *s)])
    row = affect.emotion_tag(turns, lx).first()
    assert row.emotion == "joy"


def test_argmax_label_rule(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([0.2, 0.5, 0.5],), ([-1.0, -2.0, -0.5],)],
                               "s array<double>")
    got = [r[0] for r in df.select(affect.argmax_label(F.col("s"), ["a", "b", "c"])).collect()]
    assert got == ["neutral", "b", "neutral"]


def test_parse_transcript_edges(spark):
    scenes = spark.createDataFrame([
        ("s1", "note<br><b>Ann</b>: hi<br><b>Bob</b>: x</b>: y</b>: z<br>"),
        ("s2", "only a note<br>"),
        ("s3", "<b>Ann</b>:<br>"),
    ], "scene_id string, raw_text string")
    got = [tuple(r) for r in dialog.parse_transcript(scenes).orderBy("scene_id", "pos").collect()]
    assert got == [("s1", 0, "Ann", " hi"), ("s1", 1, "Bob", " x"), ("s3", 0, "Ann", "")]


def _dialogue(spark):
    return spark.createDataFrame([
        ("s", 0, "Una Smith", "a"), ("s", 1, "Abe Jones", "b"), ("s", 2, "Una Sr.", "c"),
        ("s", 3, "Una Smith", "d")], TURNS)


def test_exact_name_for_texts_first_word_for_mask(spark):
    t = _dialogue(spark)
    c = spark.createDataFrame([("s", "Una Smith"), ("s", "Ghost")], "scene_id string, character string")
    st = {r.character: r.utterance for r in dialog.speaker_text(t, c).collect()}
    ct = {r.character: r.context for r in dialog.context_text(t, c).collect()}
    assert st == {"Una Smith": " a d", "Ghost": ""}
    assert ct == {"Una Smith": " b c", "Ghost": " a b c d"}
    m = dialog.speaker_mask(t, c).where("character = 'Una Smith'").orderBy("pos")
    assert [r.is_speaker for r in m.collect()] == [1, 0, 1, 1]
    assert [r.is_last for r in m.collect()] == [0, 0, 0, 1]


def test_prefix_floor_and_zero_turn_prefix(spark):
    t = spark.createDataFrame([("s", 0, "Ann X", "hi"), ("s", 1, "Bob", "yo"), ("s", 2, "Ann X", "ok")], TURNS)
    c = spark.createDataFrame([("s", "Ann X")], "scene_id string, character string")
    tags = spark.createDataFrame([("s", 0, "joy"), ("s", 1, "anger"), ("s", 2, "fear")],
                                 "scene_id string, pos bigint, emotion string")
    got = {r.flow_len: r for r in pairs.pair_texts(t, tags, c).collect()}
    assert got[0.25].origin_sent == "; " and got[0.25].affective_prompt == ""
    assert got[0.5].origin_sent == "Speaker : hi, ; "
    assert got[1.0].only_speaker == "hi, ok, ; "
    assert got[1.0].affective_prompt == ("The emotion of Ann is initially joy, "
                                         "the emotion of others is anger, Ann respond with fear, ")


def test_trait_labels_only_true_is_one(spark):
    tr = spark.createDataFrame([("s", "c", True, False, None, True, None)],
                               "scene_id string, character string, cAGR boolean, cCON boolean, "
                               "cEXT boolean, cOPN boolean, cNEU boolean")
    got = {r.trait: r.label for r in TR.trait_labels(tr).collect()}
    assert got == {"A": 1, "C": 0, "E": 0, "O": 1, "N": 0}
    vc = {(r.trait, r.flag): r.n for r in TR.trait_value_counts(tr).collect()}
    assert ("E", None) not in vc and vc[("A", True)] == 1


def _tagged(spark, rows):
    return spark.createDataFrame(rows, "scene_id string, pos bigint, speaker string, emotion string")


def _traits(spark, rows):
    return spark.createDataFrame(rows, "scene_id string, character string, cAGR boolean, cCON boolean, "
                                       "cEXT boolean, cOPN boolean, cNEU boolean")


def test_transition_counts_others_to_speaker_and_empty_rows_are_null(spark):
    tg = _tagged(spark, [("s", 0, "Bob", "joy"), ("s", 1, "Ann", "anger"), ("s", 2, "Bob", "fear"),
                         ("s", 3, "Ann", "anger")])
    tr = _traits(spark, [("s", "Ann", True, None, None, None, None), ("s", "Bob", False, None, None, None, None)])
    m = patterns.emotion_transition(tg, tr).where("trait = 'A'")
    got = {(r.e_from, r.e_to): (r.n, r.ratio) for r in m.collect()}
    assert got[("joy", "anger")] == (1, 0.5) or got[("joy", "anger")][0] == 1
    assert got[("fear", "anger")][0] == 1
    assert got[("surprise", "joy")] == (0, None)
    rows = m.where("e_from = 'joy'").collect()
    assert abs(sum(r.ratio for r in rows) - 1.0) < 1e-9


def test_distribution_skips_last_turn_and_null_flags(spark):
    tg = _tagged(spark, [("s", 0, "Ann", "joy"), ("s", 1, "Bob", "fear"), ("s", 2, "Ann", "anger")])
    tr = _traits(spark, [("s", "Ann", True, None, None, None, None)])
    d = patterns.emotion_distribution(tg, tr)
    a = {r.emotion: r.n for r in d.where("trait = 'A' AND label = 1").collect()}
    assert a["joy"] == 1 and a["anger"] == 0
    assert sum(r.n for r in d.where("trait = 'C'").collect()) == 0
    d2 = patterns.emotion_distribution(tg, tr, include_last=True)
    assert {r.emotion: r.n for r in d2.where("trait = 'A' AND label = 1").collect()}["anger"] == 1


def test_big_five_chained_reuses_new_agreeableness(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "v double, a double, d double")
    ch = lexicon.big_five(df).first()
    ind = lexicon.big_five(df, mode="independent").first()
    a_new = 0.83 + 0.19 - 0.21
    assert math.isclose(ch.A, a_new) and math.isclose(ch.E, 0.23 + 0.12 + 0.82)
    assert math.isclose(ch.N, 0.57 - 0.65 * a_new) and math.isclose(ind.N, 0.57 - 0.65)


def test_two_vad_divisors(spark):
    docs = spark.createDataFrame([(1, "good bad"), (2, "")], "id int, text string")
    lx = lex(spark, [("good", 800, 200, 400)])
    s = lexicon.vad_sums(docs, ["id"], "text", lx)
    m = {r.id: (r.v, r.a) for r in lexicon.vad_matched(s).collect()}
    w = {r.id: r.v for r in lexicon.vad_all_words(s).collect()}
    assert m == {1: (0.8, 0.2), 2: (0.0, 0.0)}
    assert w == {1: 0.4, 2: None}


def test_top_words_keeps_21(spark):
    rows = [(1, f"w{i:02d}") for i in range(30) for _ in range(30 - i)]
    counts = spark.createDataFrame(rows, "labels int, word string").groupBy("labels", "word").count() \
        .withColumnRenamed("count", "n")
    top = WS.class_top_words(counts, "labels").collect()
    assert len(top) == 21 and max(r["rank"] for r in top) == 21


def test_tfidf_two_classes_idf(spark):
    df = spark.createDataFrame([(1, "aa bb"), (0, "aa cc cc")], "labels int, t string")
    r = {(x.labels, x.word): x for x in WS.class_tfidf_top(df, "labels", "t", k=10).collect()}
    assert r[(1, "aa")].w == 1.0 and math.isclose(r[(1, "bb")].w, math.log(1.5) + 1)
    norm1 = math.sqrt(1 + (math.log(1.5) + 1) ** 2)
    assert math.isclose(r[(1, "aa")].tfidf, 1 / norm1)


def test_report_swap_and_mcc_constant(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "label int, pred int")
    rep = {r.cls: r for r in evaluate.classification_report(df, "label", "pred").collect()}
    assert math.isclose(rep["accuracy"].f1, 1 / 3) and rep["3"].precision == 1.0
    const = spark.createDataFrame([(1, 1), (0, 1), (1, 1)], "label int, pred int")
    assert evaluate.binary_metrics(const, "label", "pred").first().mcc == 0.0
    uneven = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, pred int")
    sw = {r.cls: r for r in evaluate.classification_report(uneven, "label", "pred", swap=True).collect()}
    assert sw["1"].support == 3 and sw["1"].recall == 2 / 3


def test_ensemble_tie_and_symmetry(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 0.0), (2, 0.3, 0.1, 0.2, 0.9)],
                               "vec_id int, pos0 double, pos1 double, neg0 double, neg1 double")
    e = {r.vec_id: r.pred for r in evaluate.ensemble_pos_neg(df).collect()}
    assert e[1] == 1
    tie = spark.createDataFrame([(3, 0.5, 0.5, 0.5, 0.5)], "vec_id int, pos0 double, pos1 double, neg0 double, neg1 double")
    assert evaluate.ensemble_pos_neg(tie).first().pred == 0
    fused = evaluate.late_fusion(df).collect()
    assert all(math.isclose(r.fused0 + r.fused1, 2.0) for r in fused)


def test_alignment_first_match_empty_text_and_meld_case(spark):
    turns = spark.createDataFrame([("01_e02_c5", 0, "Ann X", "Hello There"), ("01_e02_c5", 1, "Bob", ""),
                                   ("01_e02_c5", 2, "Ann Y", "nothing")], TURNS)
    ann = spark.createDataFrame([
        (1, 2, "Ann", "hello there friend", "Joyful", 20),
        (1, 2, "Ann", "hello", "Mad", 10),
        (1, 2, "Bob", "whatever", "Sad", 30),
        (1, 2, "Ann", "Hello There", "Scared", 5),
    ], "Season int, Episode int, Speaker string, Utterance string, Emotion string, ann_order bigint")
    listed = ann.withColumn("Speaker", F.concat(F.lit("['"), F.col("Speaker"), F.lit(" Geller', 'Zed Q']")))
    for a in (ann, listed):  # plain names, and list literals of which the first name counts
        e = {r.pos: r.emotion for r in align.align(turns, a, "emory").collect()}
        assert e == {0: "Scared", 1: "Sad", 2: None}
    m = {r.pos: r.emotion for r in align.align(turns, ann, "meld").collect()}
    assert m == {0: "Mad", 1: "Sad", 2: None}


def test_labelled_dialog_flags(spark):
    a = spark.createDataFrame([("s", 0, "Joyful"), ("s", 1, None), ("t", 0, "Mad")],
                              "scene_id string, pos bigint, emotion string")
    got = {r.scene_id: (r.any_x, r.all_x) for r in align.labelled_dialogs({"x": a}).collect()}
    assert got == {"s": (True, False), "t": (True, True)}


def test_splits_disjoint_complete_and_exact_counts(spark):
    df = spark.range(0, 350).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = S.stratified_split(df, "doc_id", "y", seed=3)
    assert s.count() == 350 and s.select("doc_id").distinct().count() == 350
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "test")] == math.ceil(280 * 0.1) and c[(1, "test")] == math.ceil(70 * 0.1)
    assert c[(0, "valid")] == math.ceil((280 - 28) * 0.1)


def test_sweep_split_stable_under_repartition(spark):
    keys = spark.range(0, 500).select(F.col("id").cast("string").alias("k"))
    a = S.sweep_split(keys, ["k"]).collect()
    b = S.sweep_split(keys.repartition(13), ["k"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_regroup_range_join_and_label_list_file(spark, tmp_dir):
    path = f"{tmp_dir}/labels.txt"
    with open(path, "w") as f:
        f.write("[1.0, 0.0, 3.0, 6.0, 2.0]\n")
    flat = FS.read_label_list(spark, path)
    dialogs = spark.createDataFrame([("a", 0, 2), ("b", 2, 0), ("c", 2, 3)], "scene_id string, start bigint, len bigint")
    got = [tuple(r) for r in dialog.regroup_labels(flat, dialogs, bucket=2).orderBy("flat_idx").collect()]
    assert got == [("a", 0, 0, "joy"), ("a", 1, 1, "neutral"), ("c", 0, 2, "anger"), ("c", 1, 3, "fear"),
                   ("c", 2, 4, "surprise")]


def test_prefix_sum_matches_running_total(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    r = {x.k: x.start for x in dialog.prefix_sum(df, ["k"], "v").collect()}
    run, ok = 0, True
    for k in range(3000):
        ok &= r[k] == run
        run += k % 7
    assert ok


def test_pad_and_list_literal(spark):
    df = spark.createDataFrame([([1, 0],), ([1, 1, 1, 1],)], "a array<int>")
    got = [r[0] for r in df.select(encode.pad(F.col("a"), 3, -1)).collect()]
    assert got == [[1, 0, -1], [1, 1, 1]]


def test_tsv_round_trip_keeps_specials(spark, tmp_dir):
    rows = [(1, "line1\nline2", 1), (2, "tab\there", 0), (3, 'say "hi"', 1), (4, "", 0), (5, None, 1),
            (6, "back\\slash \\n \\b \r\n end\\", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, utterance string, labels int")
    FS.write_tsv(df, f"{tmp_dir}/t")
    back = FS.read_tsv(spark, f"{tmp_dir}/t", "doc_id bigint, utterance string, labels int")
    assert sorted(map(tuple, back.collect())) == rows


def test_jsonl_label_check_and_routing(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 0, "train"), (2, "b", 1, "valid")],
                               "doc_id bigint, utterance string, labels int, split string")
    FS.write_jsonl(df, f"{tmp_dir}/j", ["doc_id", "utterance", "labels"], partition_by=["split"])
    back = FS.route_by_file_name(FS.read_jsonl(spark, f"{tmp_dir}/j", "doc_id bigint, utterance string, labels int",
                                               label="labels", recursive=True))
    assert sorted((r.doc_id, r.split) for r in back.collect()) == [(1, "train"), (2, "valid")]


def test_lexicon_reader_later_duplicate_wins(spark, tmp_dir):
    p = f"{tmp_dir}/lex.tsv"
    with open(p, "w") as f:
        f.write("Word\tValence\tArousal\tDominance\nhappy\t0.9\t0.5\t0.6\nsad\t0.1\t0.3\t0.2\nhappy\t1.0\t0.4\t0.7\n")
    got = {r.word: (r.v, r.a, r.d) for r in FS.read_lexicon(spark, p).collect()}
    assert got == {"happy": (1000, 400, 700), "sad": (100, 300, 200)}


def test_literal_decode(spark):
    df = spark.createDataFrame([("[['Ross', ' hi'], ['Joey', ' yo']]",)], "s string")
    assert df.select(FS.decode_literal("s", "array<array<string>>")).first()[0] == [["Ross", " hi"], ["Joey", " yo"]]


def test_round6_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.0000005,), (-0.0000005,), (1.2345675,)], "x double")
    got = [r[0] for r in df.select(round6("x")).collect()]
    assert got[0] == 0.000001 and got[1] == -0.000001


def test_tag_distribution_matches_fixture_notes(spark):
    from moodweave.plans.queries import REGISTRY
    from conftest import SF_MID
    t = REGISTRY["emotion_tag"](spark, SF_MID)
    got = {r.emotion: r["count"] for r in t.groupBy("emotion").count().collect()}
    assert got == {"anger": 144, "disgust": 126, "surprise": 104, "neutral": 64, "fear": 64,
                   "sadness": 20, "joy": 14}
    assert t.where("n_matched = 0").count() == 22


def test_keep_roles_and_class_names(spark):
    df = spark.createDataFrame([("s", "Ann"), ("s", "Extra")], "scene_id string, character string")
    assert [r.character for r in TR.keep_roles(df, ["Ann"]).collect()] == ["Ann"]
    assert [tuple(r) for r in pairs.class_names(spark).orderBy("label").collect()] == [(0, "no"), (1, "yes")]


def test_second_corpus_variant_whole_dialogue_and_fixed_name(spark):
    t = spark.createDataFrame([("s", 0, "Ann X", "hi"), ("s", 1, "Bob", "yo")], TURNS)
    c = spark.createDataFrame([("s", "Ann X")], "scene_id string, character string")
    tags = spark.createDataFrame([("s", 0, "joy"), ("s", 1, "anger")], "scene_id string, pos bigint, emotion string")
    got = {r.flow_len: r for r in pairs.pair_texts(t, tags, c, speaker_name="Speaker", cut=False).collect()}
    assert got[0.25].affective_prompt == got[1.0].affective_prompt == \
        "The emotion of Speaker is initially joy, the emotion of others is anger, "


def test_transition_seven_keeps_neutral(spark):
    tg = _tagged(spark, [("s", 0, "Bob", "neutral"), ("s", 1, "Ann", "joy")])
    tr = _traits(spark, [("s", "Ann", True, None, None, None, None)])
    six = patterns.emotion_transition(tg, tr, "six").where("n > 0").count()
    seven = {(r.e_from, r.e_to): r.n for r in patterns.emotion_transition(tg, tr, "seven").where("n > 0").collect()}
    assert six == 0 and seven == {("neutral", "joy"): 1}


def test_model_plug_in_scores_in_arrow_batches(spark):
    import numpy as np

    def scorer(texts):
        # toy model: score "joy" by the count of '!' and "anger" by upper-case letters
        return np.array([[0.0, t.count("!"), sum(ch.isupper() for ch in t)] for t in texts])

    turns = spark.createDataFrame([("s", 0, "A", "yay!!"), ("s", 1, "A", "NO"), ("s", 2, "A", "meh")], TURNS)
    got = {r.pos: r.emotion for r in affect.tag_with_model(turns, scorer, ["neutral", "joy", "anger"],
                                                           ["scene_id", "pos"]).collect()}
    assert got == {0: "joy", 1: "anger", 2: "neutral"}


def test_write_sweep_partitions_and_counts(spark, tmp_dir):
    from conftest import SF_SMALL
    from moodweave.sources import fixtures as V
    turns = V.v_turns(spark, SF_SMALL)
    tags = affect.emotion_tag(turns, V.lexicon(spark))
    texts = pairs.pair_texts(turns, tags, V.v_characters(spark, SF_SMALL))
    pr = pairs.nli_pairs(texts, V.v_traits(spark, SF_SMALL), V.descriptions(spark))
    sp = S.sweep_split(pairs.sweep_keys(V.v_traits(spark, SF_SMALL)), ["scene_id", "character"])
    pairs.write_sweep(pr, sp, f"{tmp_dir}/sweep")
    back = spark.read.parquet(f"{tmp_dir}/sweep")
    assert back.count() == pr.count() * len(K.SEEDS)
    one = back.where("trait = 'A' AND flow_len = 0.5 AND seed = 42")
    assert one.select("scene_id", "character").distinct().count() == one.count()
    assert {r.split for r in back.select("split").distinct().collect()} <= {"train", "valid", "test"}


def test_append_results_accumulates(spark, tmp_dir):
    df = spark.createDataFrame([("A", 0, 0.5)], "trait string, seed int, acc double")
    FS.append_results(df, f"{tmp_dir}/res")
    FS.append_results(df, f"{tmp_dir}/res")
    assert spark.read.parquet(f"{tmp_dir}/res").count() == 2


def test_alignment_short_needles_both_directions(spark):
    turns = spark.createDataFrame([("01_e02_c5", 0, "Ann X", "yo yo ma"), ("01_e02_c5", 1, "Ann X", "ok"),
                                   ("01_e02_c5", 2, "Ann X", "abcdefgh"), ("01_e02_c5", 3, "Ann X", "zz")], TURNS)
    ann = spark.createDataFrame([
        (1, 2, "Ann", "yo", "Joyful", 7),          # short annotation inside turn 0
        (1, 2, "Ann", "ok then", "Mad", 9),        # short turn 1 inside this annotation
        (1, 2, "Ann", "cdef", "Sad", 11),          # exactly k long, inside turn 2
        (1, 2, "Ann", "xbcdefghx", "Scared", 3),   # contains turn 2 ("bcdefgh" is not the whole turn)
    ], "Season int, Episode int, Speaker string, Utterance string, Emotion string, ann_order bigint")
    for gram, window in ((4, 5), (2, 2), (4, 1)):
        got = {r.pos: r.emotion for r in align.align(turns, ann, "emory", gram, window).collect()}
        assert got == {0: "Joyful", 1: "Mad", 2: "Sad", 3: None}, (gram, window)


def test_first_word_variant_of_dialogue_texts(spark):
    t = _dialogue(spark)
    c = spark.createDataFrame([("s", "Una Smith")], "scene_id string, character string")
    assert dialog.speaker_text(t, c, match="first_word").first().utterance == " a c d"
    assert dialog.context_text(t, c, match="first_word").first().context == " b"


def _aligned_brute(turns, ann):
    out = {}
    for scene, pos, speaker, text in turns:
        season, episode = int(scene[:2]), int(scene[4:6])
        hits = [] if text is None else [
            (o, e) for s, ep, sp, u, e, o in ann if (s, ep, sp) == (season, episode, speaker) and u is not None
            and (u.lower() in text.lower() or text.lower() in u.lower())]
        out[scene, pos] = min(hits)[1] if hits else None
    return out


def test_alignment_equals_brute_force(spark):
    import random
    rnd = random.Random(8)
    pool = ["a", "b", "ab ", " ", "\u00e9", "\U0001F600", "the cat ", "aaaa", "So, "]
    text = lambda: rnd.choice([None, "", "".join(rnd.choices(pool, k=rnd.randrange(1, 9)))])
    turns = [(f"0{rnd.choice('12')}_e0{rnd.choice('12')}_c1", i, rnd.choice(["Ann", "Bob"]), text()) for i in range(300)]
    turns += [("01_e01_c1", 1000 + i, "Ann", "x" * i + "the long middle part" + "y" * i) for i in range(12)]
    ann = [(rnd.choice([1, 2]), rnd.choice([1, 2]), rnd.choice(["Ann", "Bob"]), text(), f"e{i % 7}", rnd.randrange(10**6)) for i in range(300)]
    ann += [(1, 1, "Ann", "long middle", "deep", -1), (None, 1, "Ann", "a", "never", -5)]
    t = spark.createDataFrame(turns, TURNS)
    a = spark.createDataFrame(ann, "Season int, Episode int, Speaker string, Utterance string, Emotion string, ann_order bigint")
    want = _aligned_brute(turns, ann)
    for gram, window in ((4, 5), (3, 2)):
        assert {(r.scene_id, r.pos): r.emotion for r in align.align(t, a, "emory", gram, window).collect()} == want


def test_alignment_of_a_hot_block_forms_few_pairs(spark):
    """One block with all rows: 600 x 600 texts that share one phrase meet about once each."""
    phrase = "said the man in the room"
    td = spark.createDataFrame([(7, f"turn number {i * 7919} {phrase} {i * 104729}") for i in range(600)], "bk long, t string")
    ad = spark.createDataFrame([(7, f"number {i * 7919} {phrase}") for i in range(600)], "bk long, u string")
    pairs = align._candidates(align._texts(td, ad), align.GRAM, align.WINDOW)
    assert pairs.count() < 3 * 600
    held = pairs.join(td.select(F.xxhash64("t").alias("tid"), "t"), "tid").join(ad.select(F.xxhash64("u").alias("aid"), "u"), "aid")
    assert held.where(F.col("t").contains(F.col("u"))).select("tid").distinct().count() == 600


def test_centring_mean_on_all_rows_or_train_only(spark):
    df = spark.createDataFrame([(1, "A", 1.0, "train"), (2, "A", 3.0, "train"), (3, "A", 8.0, "test")],
                               "id int, trait string, score double, split string")
    all_rows = {r.id: r.centered for r in lexicon.center(df, "score", ["trait"]).collect()}
    train = {r.id: r.centered for r in lexicon.center(df, "score", ["trait"],
                                                         fit_filter=F.col("split") == "train").collect()}
    assert all_rows == {1: -3.0, 2: -1.0, 3: 4.0}
    assert train == {1: -1.0, 2: 1.0, 3: 6.0}


def test_lexicon_reader_keeps_all_digits(spark, tmp_dir):
    p = f"{tmp_dir}/lex.tsv"
    with open(p, "w") as f:
        f.write("Word\tValence\tArousal\tDominance\nfine\t0.123456\t0.57\t0.29\n")
    r = FS.read_lexicon(spark, p).first()
    assert (r.v, r.a, r.d) == (123.456, 570.0, 290.0)


def test_first_listed_speaker(spark):
    df = spark.createDataFrame([("['Monica Geller']",), ("['Joey', 'Ross B']",), ("Plain Name",), ("[]",), (None,)], "s string")
    assert [r[0] for r in df.select(FS.first_listed("s")).collect()] == ["Monica", "Joey", "Plain", None, None]


def test_tagging_gives_one_row_per_row_without_a_shuffle(spark):
    turns = spark.createDataFrame([("s", 0, None, "joyword"), ("s", 0, None, "joyword"), ("s", 1, "A", None)], TURNS)
    lx = lex(spark, [("joyword", 760, 480, 350)])
    tagged = affect.emotion_tag(turns, lx)
    assert sorted(r.emotion for r in tagged.collect()) == ["joy", "joy", "neutral"]
    assert "Exchange" not in tagged._jdf.queryExecution().executedPlan().toString()


def test_large_lexicon_is_joined_with_the_same_result(spark, monkeypatch):
    from conftest import SF_SMALL
    from moodweave.sources import fixtures as V
    docs = V.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    small = sorted(map(tuple, lexicon.vad_sums(docs, ["doc_id"], "text", V.lexicon(spark)).collect()))
    monkeypatch.setattr(lexicon, "LOOKUP_MAX_ROWS", 0)
    assert sorted(map(tuple, lexicon.vad_sums(docs, ["doc_id"], "text", V.lexicon(spark)).collect())) == small


def test_all_words_mean_keeps_case_when_told(spark):
    docs = spark.createDataFrame([(1, "Good good")], "id int, text string")
    lx = lex(spark, [("good", 800, 200, 400)])
    assert lexicon.vad_sums(docs, ["id"], "text", lx).first().n_matched == 2
    assert lexicon.vad_sums(docs, ["id"], "text", lx, lower=False).first().n_matched == 1


def test_speaker_pool_reads_every_turn(spark):
    tg = _tagged(spark, [("s", p, "Ann X", "joy" if p < 15 else "fear") for p in range(30)])
    c = spark.createDataFrame([("s", "Ann Y"), ("s", "Bob")], "scene_id string, character string")
    got = {r.character: r for r in affect.speaker_pool(tg, c).collect()}
    assert got["Ann Y"].n_own == 30 and got["Ann Y"].p_joy == 0.5 and got["Bob"].n_own == 0


def test_turn_without_speaker_is_one_of_the_others(spark):
    t = spark.createDataFrame([("s", 0, "Ann", "hi"), ("s", 1, None, "psst"), ("s", 2, "Bob", "yo")], TURNS)
    c = spark.createDataFrame([("s", "Ann")], "scene_id string, character string")
    tags = spark.createDataFrame([("s", 0, "joy"), ("s", 1, "fear")], "scene_id string, pos bigint, emotion string")
    r = pairs.pair_texts(t, tags, c, lens=[1.0]).first()
    assert r.affective_prompt == "The emotion of Ann is initially joy, the emotion of others is fear, "
    assert r.origin_sent == "Speaker : hi, Others : psst, Others : yo, ; "      # an untagged turn stays
    assert dialog.context_text(t, c).first().context == " psst yo"
    vocab = spark.createDataFrame([("hi", 4), ("psst", 5), ("yo", 6)], "word string, id int")
    assert encode.segment_ids(t, c, vocab, None).first().input_ids == "[1, 4, 2, 5, 6, 2]"


def test_uncut_encodings(spark):
    t = spark.createDataFrame([("s", p, "Ann", " ".join(["aa", "bb"] * 100)) for p in range(25)], TURNS)
    c = spark.createDataFrame([("s", "Ann")], "scene_id string, character string")
    vocab = spark.createDataFrame([("aa", 4), ("bb", 5)], "word string, id int")
    full = encode.encode_turns(t, vocab, None).first()
    assert full.input_ids == "[1, " + ", ".join(["4, 5"] * 100) + ", 2]"
    cut = encode.encode_turns(t, vocab, 8).first()
    assert cut.input_ids == "[1, 4, 5, 4, 5, 4, 5, 2]"
    assert encode.mask_pad(t, c, None).first().n_turns == 25
    assert encode.mask_pad(t, c, 20).first().dialog_state.count("1") == 20


def test_salted_vocabulary_join_equals_the_broadcast_one(spark, monkeypatch):
    from conftest import SF_SMALL
    from moodweave.sources import fixtures as V
    turns = V.v_turns(spark, SF_SMALL)
    vocab = encode.vocabulary(turns).select("word", "id").checkpoint()
    want = sorted(map(str, encode.turn_ids(turns, vocab).collect()))
    monkeypatch.setattr(encode, "is_small", lambda df: False)
    assert sorted(map(str, encode.turn_ids(turns, vocab).collect())) == want


def test_naive_bayes_against_plain_python(spark):
    import random
    from collections import Counter

    from moodweave.operators import model as ML
    rnd = random.Random(5)
    bags, splits = [], []
    for i in range(60):
        y = i % 2
        words = [rnd.choice(["aa", "bb", "cc"] if y else ["bb", "cc", "dd"]) for _ in range(rnd.randrange(0, 9))]
        bags += [("m", f"s{i}", "c", w, n) for w, n in Counter(words).items()]
        splits.append((f"s{i}", "c", "A", 0, y, ("train", "train", "train", "valid", "test")[i % 5]))
    b = spark.createDataFrame(bags, "mode string, scene_id string, character string, word string, tf bigint")
    s = spark.createDataFrame(splits, "scene_id string, character string, trait string, seed int, label int, split string")
    got = {(r.scene_id, r.alpha): r.pred for r in ML.naive_bayes(b, s).collect()}
    train = {x[0]: x[4] for x in splits if x[5] == "train"}
    count = [Counter(), Counter()]
    for _, sid, _, w, n in bags:
        if sid in train:
            count[train[sid]][w] += n
    vocab = set(count[0]) | set(count[1])
    d1 = sum(train.values())
    for sid, _, _, _, _, split in splits:
        if split == "train":
            continue
        for a in ML.ALPHAS:
            score = math.log(d1 / (len(train) - d1))
            for _, x, _, w, n in bags:
                if x == sid and w in vocab:
                    score += n * sum(sign * math.log((count[k][w] + a) / (sum(count[k].values()) + a * len(vocab)))
                                     for k, sign in ((1, 1), (0, -1)))
            assert got[sid, a] == int(round(score, 9) > 0), (sid, a)
    chosen = ML.select_and_score(ML.naive_bayes(b, s)).collect()
    assert len(chosen) == 12 and len({r.alpha for r in chosen}) == 1


def test_classifier_has_every_input_mode(spark):
    from collections import Counter

    from moodweave.operators import model as ML
    turns, chars, splits, bags = [], [], [], Counter()
    for i in range(20):
        said = {"Ann": f"sunny day word{i % 3} sunny", "Bob": f"rainy night word{i % 4}"}
        for pos, (who, text) in enumerate(said.items()):
            turns.append((f"s{i}", pos, who, text))
            chars.append((f"s{i}", who))
            splits.append((f"s{i}", who, "A", 0, int(who == "Ann"), ("train", "train", "train", "valid", "test")[i % 5]))
            for other in said:
                mark = "own:" if other == who else "other:"
                bags.update((f"s{i}", who, mark + w) for w in said[other].split())
    t = spark.createDataFrame(turns, "scene_id string, pos int, speaker string, text string")
    c = spark.createDataFrame(chars, "scene_id string, character string")
    s = spark.createDataFrame(splits, "scene_id string, character string, trait string, seed int, label int, split string")
    got = {(r.scene_id, r.character, r.word): r.tf for r in ML.input_counts("speaker_context", t, c).collect()}
    assert got == dict(bags)
    out = ML.trait_classifier(t, c, s, t.withColumn("emotion", F.lit("joy"))).collect()
    assert Counter(r["mode"] for r in out) == {m: 8 for m in ML.MODES}
    assert all(r.pred == r.label for r in out if r["mode"] == "speaker_context")


def test_cluster_without_a_checkpoint_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from moodweave.session import checkpoint_root
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=sc)
    with pytest.raises(RuntimeError):
        checkpoint_root(fake)
