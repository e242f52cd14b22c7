"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the stand-in views, so its work
grows with the input.  Computed columns carry the same names as the SQL
oracles in ``moodweave.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.numeric import round6
from moodweave.operators import affect, patterns, traits as TR
from moodweave.operators import align as AL
from moodweave.operators import dialog as D
from moodweave.operators import encode as EN
from moodweave.operators import evaluate as EV
from moodweave.operators import lexicon as LX
from moodweave.operators import model as ML
from moodweave.operators import pairs as P
from moodweave.operators import split as S
from moodweave.operators import train as TN
from moodweave.operators import wordstats as WS
from moodweave.session import scratch_path
from moodweave.sources import files as FS
from moodweave.sources import fixtures as V
from moodweave.sources import order as FO

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def tagged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.v_turns(spark, sf_dir)
    return affect.emotion_tag(turns, V.lexicon(spark))


@query
def emotion_tag(spark, sf_dir):
    t = tagged_turns(spark, sf_dir)
    return t.select("scene_id", "pos", "n_matched", "emotion")


@query
def emotion_transition(spark, sf_dir):
    return patterns.emotion_transition(tagged_turns(spark, sf_dir), V.v_traits(spark, sf_dir))


@query
def emotion_distribution(spark, sf_dir):
    return patterns.emotion_distribution(tagged_turns(spark, sf_dir), V.v_traits(spark, sf_dir))


@query
def trait_labels(spark, sf_dir):
    return TR.trait_labels(V.v_traits(spark, sf_dir))


@query
def trait_value_counts(spark, sf_dir):
    return TR.trait_value_counts(V.v_traits(spark, sf_dir))


# --- dialogue structure ------------------------------------------------------


@query
def parse_transcript(spark, sf_dir):
    return D.parse_transcript(V.v_scenes(spark, sf_dir))


@query
def flow_prefix(spark, sf_dir):
    return D.flow_prefix(V.v_turns(spark, sf_dir))


@query
def speaker_mask(spark, sf_dir):
    return D.speaker_mask(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir))


@query
def speaker_text(spark, sf_dir):
    return D.speaker_text(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir))


@query
def context_text(spark, sf_dir):
    return D.context_text(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir))


@query
def dialog_text(spark, sf_dir):
    return D.dialog_text(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir))


@query
def scene_key_parse(spark, sf_dir):
    return D.scene_keys(V.v_characters(spark, sf_dir))


def _pair_texts(spark, sf_dir):
    turns = V.v_turns(spark, sf_dir)
    tags = affect.emotion_tag(turns, V.lexicon(spark))
    return P.pair_texts(turns, tags, V.v_characters(spark, sf_dir))


@query
def premise_dialog(spark, sf_dir):
    return _pair_texts(spark, sf_dir).select("scene_id", "character", "flow_len", "origin_sent")


@query
def premise_speaker(spark, sf_dir):
    return _pair_texts(spark, sf_dir).select("scene_id", "character", "flow_len", "only_speaker")


@query
def affective_prompt(spark, sf_dir):
    return _pair_texts(spark, sf_dir).select("scene_id", "character", "flow_len", "affective_prompt")


@query
def nli_pairs(spark, sf_dir):
    return P.nli_pairs(_pair_texts(spark, sf_dir), V.v_traits(spark, sf_dir), V.descriptions(spark))


@query
def nli_sweep_split(spark, sf_dir):
    keys = P.sweep_keys(V.v_traits(spark, sf_dir))
    s = S.sweep_split(keys, ["scene_id", "character"])
    return s.groupBy("trait", "flow_len", "seed", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"))


@query
def stratified_split(spark, sf_dir):
    e = V.v_essays(spark, sf_dir).select("doc_id", "labels")
    return S.stratified_split(e, "doc_id", "labels", seed=0)


@query
def emotion_regroup(spark, sf_dir):
    offsets = D.dialog_offsets(V.v_turns(spark, sf_dir), "conv_id")
    return D.regroup_labels(D.flatten_labels(tagged_turns(spark, sf_dir), offsets), offsets)


# --- lexicon and word statistics --------------------------------------------


def _doc_sums(spark, sf_dir, lower=True):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return LX.vad_sums(docs, ["doc_id"], "text", V.lexicon(spark), lower=lower)


def _r6(*cols):
    return [round6(c).alias(c) for c in cols]


@query
def vad_matched(spark, sf_dir):
    m = LX.vad_matched(_doc_sums(spark, sf_dir))
    return m.select("doc_id", "n_tokens", "n_matched", *_r6("v", "a", "d"))


@query
def vad_all_words(spark, sf_dir):
    m = LX.vad_all_words(_doc_sums(spark, sf_dir, lower=False))
    return m.select("doc_id", "n_tokens", "n_matched", *_r6("v", "a", "d"))


def _big_five_docs(spark, sf_dir):
    return LX.big_five(LX.vad_matched(_doc_sums(spark, sf_dir)))


@query
def big_five(spark, sf_dir):
    return _big_five_docs(spark, sf_dir).select("doc_id", *_r6("A", "C", "E", "O", "N"))


@query
def big_five_centered(spark, sf_dir):
    long = LX.trait_feature(_big_five_docs(spark, sf_dir).select("doc_id", "A", "C", "E", "O", "N"))
    c = LX.center(long, "score", ["trait"])
    return c.select("doc_id", "trait", *_r6("score", "centered"))


def _essays(spark, sf_dir):
    return V.v_essays(spark, sf_dir)


@query
def class_vad(spark, sf_dir):
    r = LX.class_vad(_essays(spark, sf_dir), "labels", "utterance", V.lexicon(spark), V.stopwords(spark))
    return r.select("labels", "total", "oov", *_r6("v", "a", "d"))


@query
def class_word_counts(spark, sf_dir):
    return WS.class_word_counts(_essays(spark, sf_dir), "labels", "utterance", V.stopwords(spark))


@query
def class_top_words(spark, sf_dir):
    c = WS.class_word_counts(_essays(spark, sf_dir), "labels", "utterance", V.stopwords(spark))
    return WS.class_top_words(c, "labels")


@query
def class_tfidf(spark, sf_dir):
    t = WS.class_tfidf_top(_essays(spark, sf_dir), "labels", "utterance")
    return t.select("labels", "word", "tf", "rank", *_r6("tfidf"))


@query
def class_tfidf_diff(spark, sf_dir):
    t = WS.class_tfidf_top(_essays(spark, sf_dir), "labels", "utterance")
    return WS.set_difference(t, "labels")


@query
def threshold_sweep(spark, sf_dir):
    e = _essays(spark, sf_dir)
    s = LX.big_five(LX.vad_matched(LX.vad_sums(e, ["doc_id", "labels"], "utterance", V.lexicon(spark))))
    m = EV.threshold_sweep(s, "A", "labels", [i / 10.0 for i in range(10)])
    return m.select("threshold", "n", *_r6("accuracy", "f1"))


# --- scoring and evaluation --------------------------------------------------


@query
def ensemble_pos_neg(spark, sf_dir):
    e = EV.ensemble_pos_neg(V.v_logits(spark, sf_dir))
    return e.select("vec_id", "label", *_r6("p0", "p1"), "pred")


@query
def late_fusion(spark, sf_dir):
    e = EV.late_fusion(V.v_logits(spark, sf_dir))
    return e.select("vec_id", "label", *_r6("fused0", "fused1"), "pred")


@query
def speaker_pool(spark, sf_dir):
    p = affect.speaker_pool(tagged_turns(spark, sf_dir), V.v_characters(spark, sf_dir))
    return p.select("scene_id", "character", "n_own", *_r6(*[f"p_{n}" for n in affect.EMOTION_NAMES]))


def _multiclass(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", EV.argmax_index(F.col("embedding")).alias("pred"))


@query
def eval_metrics(spark, sf_dir):
    b = EV.binary_metrics(EV.ensemble_pos_neg(V.v_logits(spark, sf_dir)), "label", "pred") \
        .select(F.lit("ensemble").alias("task"), "n", "accuracy", "f1", "mcc")
    m = EV.multiclass_metrics(_multiclass(spark, sf_dir), "label", "pred") \
        .select(F.lit("argmax").alias("task"), "n", "accuracy", F.lit(None).cast("double").alias("f1"), "mcc")
    u = b.unionByName(m)
    return u.select("task", "n", *_r6("accuracy", "f1", "mcc"))


@query
def classification_report(spark, sf_dir):
    r = EV.classification_report(_multiclass(spark, sf_dir), "label", "pred")
    return r.select("cls", *_r6("precision", "recall", "f1"), "support")


@query
def confusion(spark, sf_dir):
    return EV.confusion(_multiclass(spark, sf_dir), "label", "pred")


CLASSIFIER_SEEDS = (0, 42, 3407)


def _classified(spark, sf_dir):
    keys = TR.trait_labels(V.v_traits(spark, sf_dir)).select("scene_id", "character", "trait", "label")
    splits = S.sweep_split(keys, ["scene_id", "character"], CLASSIFIER_SEEDS)
    return ML.trait_classifier(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir), splits,
                               tagged_turns(spark, sf_dir))


@query
def trait_classifier(spark, sf_dir):
    """Test predictions of the classifier picked by validation F1, per input mode, trait and seed."""
    return _classified(spark, sf_dir)


@query
def result_grid(spark, sf_dir):
    """Accuracy and F1 of the trait classifiers by input mode, trait and seed, with mean and spread over seeds."""
    by = ["mode", "trait", "seed"]
    m = EV.binary_metrics(_classified(spark, sf_dir), "label", "pred", by).select(*by, "n", "accuracy", "f1")
    g = EV.result_grid(m, by)
    return g.select(*by, "n", *_r6("accuracy", "f1", "acc_mean", "f1_mean", "acc_std"))


@query
def exact_sweep_split(spark, sf_dir):
    """J1 with J4: exact split sizes in every cell of the sweep, and the sum of hashes as a fingerprint of who is where."""
    keys = P.sweep_keys(V.v_traits(spark, sf_dir))
    by = ["scene_id", "character"]
    s = S.exact_sweep_split(keys, ["trait", "flow_len"], by).withColumn("h", S.key_hash(F.col("seed"), *by))
    return s.groupBy("trait", "flow_len", "seed", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"), F.sum("h").alias("members"))


@query
def trained_grid(spark, sf_dir):
    """Classifiers trained in joins; test accuracy and F1 by flow_len, mode, trait and seed."""
    keys = TR.trait_labels(V.v_traits(spark, sf_dir)).select("scene_id", "character", "trait", "label")
    splits = S.exact_sweep_split(keys, ["trait"], ["scene_id", "character"], CLASSIFIER_SEEDS)
    rows = TN.trained_classifier(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir), splits, tagged_turns(spark, sf_dir),
                                 seeds=CLASSIFIER_SEEDS)
    by = ["flow_len", "mode", "trait", "seed"]
    m = EV.binary_metrics(rows, "label", "pred", [*by, "best_step"]).select(*by, "best_step", "n", "accuracy", "f1")
    g = EV.result_grid(m, by)
    return g.select(*by, "best_step", "n", *_r6("accuracy", "f1", "acc_mean", "f1_mean", "acc_std"))


# --- corpus alignment --------------------------------------------------------


def _aligned(spark, sf_dir, variant, **kw):
    return AL.align(V.v_turns(spark, sf_dir), V.v_annotations(spark, sf_dir), variant, **kw)


@query
def align_emory(spark, sf_dir):
    return _aligned(spark, sf_dir, "emory")


@query
def align_meld(spark, sf_dir):
    return _aligned(spark, sf_dir, "meld")


@query
def align_coverage(spark, sf_dir):
    c = AL.coverage({"emory": _aligned(spark, sf_dir, "emory"), "meld": _aligned(spark, sf_dir, "meld")})
    return c.select("n_turns", "emory_labelled", "meld_labelled",
                    *_r6("emory_coverage", "meld_coverage"))


@query
def align_emory_grams(spark, sf_dir):
    """The same alignment from other fingerprints: three-grams, and windows of two."""
    return _aligned(spark, sf_dir, "emory", gram=3, window=2)


@query
def labelled_dialogs(spark, sf_dir):
    return AL.labelled_dialogs({"emory": _aligned(spark, sf_dir, "emory"), "meld": _aligned(spark, sf_dir, "meld")})


# --- encodings ---------------------------------------------------------------


def _unpivoted(spark, sf_dir):
    return EN.unpivot_triples(V.v_triples(spark, sf_dir), ["conv_id", "part"])


@query
def utterance_unpivot(spark, sf_dir):
    return _unpivoted(spark, sf_dir)


@query
def label_encode(spark, sf_dir):
    # tagged once: both the label set and the rows read the written table
    u = _unpivoted(spark, sf_dir).select("conv_id", "part", "slot", "Emotion").checkpoint()
    return EN.label_encode(u, "Emotion")


def _mask(spark, sf_dir, width):
    m = EN.mask_pad(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir), width)
    return m.withColumn("n_turns", F.col("n_turns").cast("bigint"))


@query
def mask_pad(spark, sf_dir):
    """Fixed-width model input: 20 turns."""
    return _mask(spark, sf_dir, 20)


@query
def mask_full(spark, sf_dir):
    return _mask(spark, sf_dir, None)


def _encoded(spark, sf_dir, max_len):
    turns = V.v_turns(spark, sf_dir)
    return EN.encode_turns(turns, EN.vocabulary(turns), max_len)


@query
def encode_ids(spark, sf_dir):
    """Fixed-width model input: 128 ids."""
    return _encoded(spark, sf_dir, 128)


@query
def encode_ids_full(spark, sf_dir):
    return _encoded(spark, sf_dir, None)


def _segments(spark, sf_dir, half):
    turns = V.v_turns(spark, sf_dir)
    return EN.segment_ids(turns, V.v_characters(spark, sf_dir), EN.vocabulary(turns), half)


@query
def segment_ids(spark, sf_dir):
    """Fixed-width model input: 64 ids a side."""
    return _segments(spark, sf_dir, 64)


@query
def segment_ids_full(spark, sf_dir):
    return _segments(spark, sf_dir, None)


# --- sources, sinks and the model shell --------------------------------------

ESSAY_SCHEMA = "doc_id bigint, utterance string, labels int"


@query
def roundtrip_tsv(spark, sf_dir):
    """v_essays written as TSV to the shared folder and read back with a declared schema."""
    path = scratch_path(spark, "essays-tsv")
    FS.write_tsv(_essays(spark, sf_dir), path)
    return FS.read_tsv(spark, path, ESSAY_SCHEMA)


@query
def roundtrip_jsonl(spark, sf_dir):
    """JSON lines per split, read back with a schema, label check and file-name routing."""
    e = S.stratified_split(_essays(spark, sf_dir), "doc_id", "labels", seed=0)
    path = scratch_path(spark, "essays-jsonl")
    FS.write_jsonl(e, path, ["doc_id", "utterance", "labels"], partition_by=["split"])
    back = FS.read_jsonl(spark, path, ESSAY_SCHEMA, label="labels", recursive=True)
    return FS.route_by_file_name(back)


@query
def nli_pairs_whole(spark, sf_dir):
    """Second-corpus construction: whole dialogue at every length, the fixed name 'Speaker'."""
    turns = V.v_turns(spark, sf_dir)
    tags = affect.emotion_tag(turns, V.lexicon(spark))
    texts = P.pair_texts(turns, tags, V.v_characters(spark, sf_dir), speaker_name="Speaker", cut=False)
    return P.nli_pairs(texts, V.v_traits(spark, sf_dir), V.descriptions(spark))


@query
def aligned_distribution(spark, sf_dir):
    """Distribution of the corpus-aligned emotions of own turns per trait and polarity.

    Unlabelled turns (null) fall outside the dense grid of annotation names;
    the last turn of each dialogue is excluded as for the tagger's emotions.
    """
    turns = V.v_turns(spark, sf_dir)
    aligned = AL.align(turns, V.v_annotations(spark, sf_dir), "emory")
    with_speaker = aligned.join(turns.select("scene_id", "pos", "speaker"), ["scene_id", "pos"])
    names = [n for n, _ in K.ANNOTATION_CODES]
    return patterns.emotion_distribution(with_speaker, V.v_traits(spark, sf_dir), emotions=names)


@query
def emotion_transition_seven(spark, sf_dir):
    """7 x 7 variant: pairs touching neutral are kept."""
    return patterns.emotion_transition(tagged_turns(spark, sf_dir), V.v_traits(spark, sf_dir), mode="seven")


# --- operators of the inventory that the queries above do not reach ----------


@query
def lexicon_scan(spark, sf_dir):
    """A3: a lexicon derived from the documents, written as TSV and scanned back."""
    words = V.table(spark, sf_dir, "documents").select(F.explode(LX.lexicon_tokens("text")).alias("Word")) \
        .groupBy("Word").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("Word")
    lex = words.select("Word", *[(F.pmod(F.col("n") * k + size, F.lit(20011)) / F.lit(10000.0)).cast("decimal(20,9)").alias(c)
                                 for k, c in ((7, "Valence"), (11, "Arousal"), (13, "Dominance"))])
    path = scratch_path(spark, "lexicon")
    lex.write.options(**FS.TEXT_WRITE).option("sep", "\t").csv(path)
    back = FS.read_lexicon(spark, path)
    return back.select("word", *_r6("v", "a", "d"))


@query
def literal_decode(spark, sf_dir):
    """A4: the list-literal speaker masks decoded to arrays again."""
    m = EN.mask_pad(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir), None)
    x = FS.decode_literal("dialog_state", "array<int>")
    return m.select("scene_id", "character", F.posexplode(x).alias("pos", "is_speaker"))


@query
def label_dump(spark, sf_dir):
    """A5: label lists, one line per dialogue, written as text and scanned back."""
    t = tagged_turns(spark, sf_dir)
    lines = D.scene_arrays(t, "emotion_id").select(F.concat(F.lit("["), F.array_join(
        F.transform("arr", lambda x: x["emotion_id"].cast("double").cast("string")), ", "), F.lit("]")).alias("value"))
    path = scratch_path(spark, "labels")
    lines.write.text(path)
    return FS.read_label_list(spark, path).groupBy("idx", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def result_append(spark, sf_dir):
    """A10: results of several runs appended to one table."""
    path = scratch_path(spark, "results")
    t = V.v_turns(spark, sf_dir)
    for run, part in (("even", t.where("pos % 2 = 0")), ("odd", t.where("pos % 2 = 1"))):
        FS.append_results(part.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).select("run", "speaker", "n")


@query
def result_commit(spark, sf_dir):
    """A10: runs committed to one table, the first of them three times; each is there once."""
    path = scratch_path(spark, "runs")
    t = V.v_turns(spark, sf_dir)
    for run, part in (("even", t.where("pos % 2 = 0")), ("even", t.where("pos % 2 = 0")), ("odd", t.where("pos % 2 = 1")), ("even", t)):
        FS.commit_results(part.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run)), path)
    return FS.read_results(spark, path, "speaker string, n bigint, run string").select("run", "speaker", "n")


@query
def main_roles(spark, sf_dir):
    """The main characters only."""
    return TR.keep_roles(V.v_characters(spark, sf_dir), ["Una Smith", "Abe Jones"])


@query
def model_inputs(spark, sf_dir):
    """B14 with I6: input text, hypotheses and the verbaliser word of the label."""
    pairs = P.nli_pairs(_pair_texts(spark, sf_dir), V.v_traits(spark, sf_dir), V.descriptions(spark))
    rows = P.model_inputs(pairs)
    return rows.join(F.broadcast(P.class_names(spark)), "label").withColumnRenamed("name", "answer")  # two local rows


@query
def question_pairs(spark, sf_dir):
    """H9: the second pair template."""
    pairs = P.nli_pairs(_pair_texts(spark, sf_dir), V.v_traits(spark, sf_dir), V.descriptions(spark),
                        K.QUESTION_TEMPLATE)
    return pairs.select("scene_id", "character", "trait", "flow_len", "sent", "model_input")


@query
def pattern_codes(spark, sf_dir):
    """C4: emotion codes of the pattern analysis per speaker."""
    t = tagged_turns(spark, sf_dir).withColumn("code", affect.pattern_code(F.col("emotion")))
    return t.groupBy("speaker", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def speaker_text_first_word(spark, sf_dir):
    """Own turns by first word."""
    return D.speaker_text(V.v_turns(spark, sf_dir), V.v_characters(spark, sf_dir), match="first_word")


@query
def classification_report_swapped(spark, sf_dir):
    """D14 as called with arguments in (prediction, label) order."""
    r = EV.classification_report(_multiclass(spark, sf_dir), "label", "pred", swap=True)
    return r.select("cls", *_r6("precision", "recall", "f1"), "support")


@query
def trait_value_counts_ordered(spark, sf_dir):
    """value counts, sorted at the end."""
    return TR.trait_value_counts(V.v_traits(spark, sf_dir), ordered=True)


@query
def decision_rule(spark, sf_dir):
    """Highest score strictly above 0 wins, first on ties, else neutral -- over the whole embedding."""
    e = V.table(spark, sf_dir, "embeddings")
    names = affect.EMOTION_NAMES
    scores = [V.every_nth(F.col("embedding"), len(names), k) for k in range(len(names))]
    return e.select("vec_id", affect.argmax_label(F.array(*scores), names).alias("emotion"))


# --- rows known by their place in files --------------------------------------


@query
def attach_by_position(spark, sf_dir):
    """Trait flags in a file without keys, attached row for row to the characters of another."""
    traits = V.v_traits(spark, sf_dir)
    keys, flags = scratch_path(spark, "characters"), scratch_path(spark, "flags")
    by = ["scene_id", "character"]
    FS.write_tsv(traits.select(*by).orderBy(*by), keys)
    FS.write_tsv(traits.repartitionByRange(5, *by).sortWithinPartitions(*by).select("cAGR", "cEXT", "cNEU"), flags)
    left = FS.read_csv(spark, keys, "scene_id string, character string", "\t")
    right = FS.read_csv(spark, flags, "cAGR boolean, cEXT boolean, cNEU boolean", "\t")
    return FO.attach_by_position(left, right)


@query
def label_file_regroup(spark, sf_dir):
    """A5 with C9: labels dumped as one list over files, read back by many tasks and regrouped to turns."""
    offsets = D.dialog_offsets(V.v_turns(spark, sf_dir), "conv_id")
    path = scratch_path(spark, "label-list")
    FS.write_label_file(D.flatten_labels(tagged_turns(spark, sf_dir), offsets), path)
    return D.regroup_labels(FS.read_label_file(spark, path), offsets)


@query
def lexicon_files(spark, sf_dir):
    """A3 over several files: the file with the greatest path that lists a word decides."""
    words = V.table(spark, sf_dir, "documents").select(F.explode(LX.lexicon_tokens("text")).alias("Word")) \
        .groupBy("Word").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    path = scratch_path(spark, "lexicons")
    for k in (1, 2, 3):
        part = words.where(F.length("Word") % k == 0)
        lex = part.select("Word", *[((F.pmod(F.col("n") * m, F.lit(2003)) + 10000 * k) / F.lit(10000.0)).cast("decimal(20,9)").alias(c)
                                    for m, c in ((7, "Valence"), (11, "Arousal"), (13, "Dominance"))])
        lex.write.options(**FS.TEXT_WRITE).option("sep", "\t").csv(f"{path}/{k}")
    return FS.read_lexicon(spark, [f"{path}/{k}" for k in (2, 3, 1)]).select("word", *_r6("v", "a", "d"))


@query
def batch_metrics(spark, sf_dir):
    """Metrics per batch of 32 predictions in the order of a written prediction file, summed."""
    path = scratch_path(spark, "predictions")
    m = _multiclass(spark, sf_dir).orderBy("vec_id").select(F.col("label").cast("int"), F.col("pred").cast("int"))
    FS.write_tsv(m, path)
    scan = FS.read_csv(spark, path, "label int, pred int", "\t")
    rows = FO.number_rows(FO.place_rows(FO.with_split(scan)))
    b = EV.batch_metrics(rows, "label", "pred", "row_no", 32)
    return b.select("batches", "n", *_r6("accuracy_sum", "mcc_sum"))


@query
def roundtrip_csv(spark, sf_dir):
    """A1: comma-separated text with quotes and raw line breaks inside fields."""
    path = scratch_path(spark, "essays-csv")
    _essays(spark, sf_dir).select("doc_id", "utterance", "labels").write.options(**FS.TEXT_WRITE).csv(path)
    return FS.read_csv(spark, path, ESSAY_SCHEMA, multi_line=True)
