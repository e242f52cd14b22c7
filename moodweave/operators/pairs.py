"""Premise / hypothesis pairs.

The turns of a dialogue are gathered once, in order; the narrow characters
join that array, and every phrase and dialogue length is a transform or slice
of it.  Text is shuffled once per dialogue, not per character or length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.text import first_word, first_word_exact
from moodweave.operators.dialog import prefix_len, scene_arrays
from moodweave.operators.traits import trait_labels
from moodweave.plans.scale import bounded_broadcast


def pair_texts(turns: DataFrame, tags: DataFrame, characters: DataFrame,
               lens=K.FLOW_LENS, speaker_name: str | None = None, cut: bool = True) -> DataFrame:
    """(scene_id, character, c_name, flow_len, origin_sent, only_speaker, affective_prompt).

    ``origin_sent``: 'Speaker : t, ' / 'Others : t, ' per turn (exact name),
    then '; '.  ``only_speaker``: 't, ' per own turn, then '; '.
    ``affective_prompt``: one phrase per turn by (first turn?, speaker?) with
    the first-word mask.  ``cut=False`` keeps whole dialogues at every length
    (second corpus), ``speaker_name`` replaces the character's first name.

    A turn without a speaker is one of the others; a turn without a tag stays
    in the premises and has no prompt phrase.
    """
    t = turns.select("scene_id", "pos", "speaker", "text") \
        .join(tags.select("scene_id", "pos", "emotion"), ["scene_id", "pos"], "left")
    c = characters.select("scene_id", "character", first_word_exact("character").alias("c_mask"),
                          (first_word("character") if speaker_name is None else F.lit(speaker_name))
                          .alias("c_name"))
    g = c.join(scene_arrays(t, "speaker", "text", "emotion"), "scene_id", "left")
    g = g.withColumn("arr", F.coalesce("arr", F.array().cast(g.schema["arr"].dataType)))
    g = g.select("*", F.explode(F.array(*[F.lit(float(x)) for x in lens])).alias("flow_len"))
    k = prefix_len(F.size("arr"), F.col("flow_len")) if cut else F.size("arr")
    g = g.withColumn("part", F.slice(F.col("arr"), F.lit(1), k))
    false = F.lit(False)
    pre_self, post_self = K.PROMPT_FIRST_SELF

    def own(x):
        return F.coalesce(x["speaker"] == F.col("character"), false)

    def prompt(x):
        mask = F.coalesce(first_word_exact(x["speaker"]) == F.col("c_mask"), false)
        first, e = x["pos"] == 0, x["emotion"]
        phrase = (F.when(first & ~mask, F.concat(F.lit(K.PROMPT_FIRST_OTHERS), e, F.lit(", ")))
                  .when(first & mask, F.concat(F.lit(pre_self), F.col("c_name"), F.lit(post_self), e, F.lit(", ")))
                  .when(~mask, F.concat(F.lit(K.PROMPT_OTHERS), e, F.lit(", ")))
                  .otherwise(F.concat(F.col("c_name"), F.lit(K.PROMPT_SELF), e, F.lit(", "))))
        return F.coalesce(phrase, F.lit(""))

    def said(x):
        return F.concat(F.when(own(x), F.lit("Speaker")).otherwise(F.lit("Others")), F.lit(" : "), x["text"], F.lit(", "))

    join = lambda f: F.array_join(F.transform("part", f), "")
    return g.select(
        "scene_id", "character", "c_name", "flow_len",
        F.concat(join(said), F.lit("; ")).alias("origin_sent"),
        F.concat(F.array_join(F.transform(F.filter("part", own), lambda x: F.concat(x["text"], F.lit(", "))), ""),
                 F.lit("; ")).alias("only_speaker"),
        join(prompt).alias("affective_prompt"))


def hypotheses(descriptions: DataFrame) -> DataFrame:
    """(trait, pos_text, neg_text) from the long description table."""
    return descriptions.groupBy("trait").agg(
        F.max(F.when(F.col("polarity") == "pos", F.col("text"))).alias("pos_text"),
        F.max(F.when(F.col("polarity") == "neg", F.col("text"))).alias("neg_text"))


def pair_template(a, b, template=K.PAIR_TEMPLATE, mask: str = K.MASK_TOKEN):
    """H9: the pair inside a template (before, between, after, end)."""
    lead, mid, tail, end = template
    return F.concat(F.lit(lead), a, F.lit(mid), b, F.lit(tail), F.lit(mask), F.lit(end))


def nli_pairs(texts: DataFrame, traits: DataFrame, descriptions: DataFrame,
              template=K.PAIR_TEMPLATE) -> DataFrame:
    """Join texts with trait labels and both hypotheses; build the model-input columns."""
    lab = trait_labels(traits).select("scene_id", "character", "trait", "label")
    hyp = bounded_broadcast(hypotheses(descriptions))  # one row per trait of the caller's table
    j = texts.join(lab, ["scene_id", "character"]).join(hyp, "trait")
    sp = F.concat(F.col("origin_sent"), F.col("affective_prompt"))
    pos_d = F.concat(F.col("c_name"), F.lit(" "), F.col("pos_text"))
    neg_d = F.concat(F.col("c_name"), F.lit(" "), F.col("neg_text"))
    return j.select(
        "scene_id", "character", "trait", "flow_len", "label",
        F.col("label").alias("nli_label"),
        "origin_sent", F.col("origin_sent").alias("sent"), "only_speaker", "affective_prompt",
        sp.alias("sent_and_prompt"), sp.alias("affective_dialog"),
        pos_d.alias("pos_personality_description"), neg_d.alias("neg_personality_description"),
        pos_d.alias("personality_description"),
        sp.alias("sentence1"), pos_d.alias("sentence2"),
        pair_template(sp, pos_d, template).alias("model_input"))


def sweep_keys(traits: DataFrame, lens=K.FLOW_LENS) -> DataFrame:
    """Narrow (scene_id, character, trait, flow_len, label) table of the sweep (no text)."""
    lab = trait_labels(traits).select("scene_id", "character", "trait", "label")
    return lab.select("*", F.explode(F.array(*[F.lit(float(x)) for x in lens])).alias("flow_len"))


# Class names of the pair task, in label order.
CLASS_NAMES = ["no", "yes"]


def class_names(spark) -> DataFrame:
    """(label, name) table; join or map labels to their verbaliser words."""
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "label int, name string")


def model_inputs(pairs_df: DataFrame, input_col: str = "affective_dialog") -> DataFrame:
    """The narrow projection a scorer reads: input text, both hypotheses, label."""
    return pairs_df.select(F.col(input_col).alias("text_a"),
                           "pos_personality_description", "neg_personality_description", "label")


def write_sweep(pairs_df: DataFrame, splits: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One partition per (trait, flow_len, seed, split).

    The sweep multiplies rows by the number of seeds, so the split is assigned
    on the narrow key table (``splits``: scene_id, character, trait, flow_len,
    seed, split) and the wide text columns join only at write time.
    """
    keys = ["scene_id", "character", "trait", "flow_len"]
    out = splits.select(*keys, "seed", "split").join(pairs_df, keys)
    w = out.write.mode("overwrite").partitionBy("trait", "flow_len", "seed", "split")
    if fmt == "tsv":
        from moodweave.sources.files import TEXT_WRITE
        w.options(**TEXT_WRITE).option("sep", "\t").csv(path)
    else:
        w.parquet(path)
