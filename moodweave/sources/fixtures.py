"""Stand-in views over the driver tables (see FIXTURES.md, part 2).

The analysed workflows read transcripts, trait flags, annotated corpora and
lexicons that are not shipped; these views derive equivalents from the
``conversations``, ``labels``, ``documents`` and ``embeddings`` tables so
every query's work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.text import scene_episode, scene_season

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns(conv_id, scene_id, pos, speaker, text), one row per turn."""
    return turns_from_conversations(table(spark, sf_dir, "conversations"))


def turns_from_conversations(c: DataFrame) -> DataFrame:
    """Stateless projection conversations -> turns (works on batch and streaming frames)."""
    conv = F.col("conv_id")
    scene_id = F.concat(
        F.lpad((conv % 10 + 1).cast("string"), 2, "0"), F.lit("_e"),
        F.lpad((conv % 24 + 1).cast("string"), 2, "0"), F.lit("_c"), conv.cast("string"))
    speaker = (F.when(F.col("role") == "user",
                      F.when(F.col("turn") % 4 < 2, F.lit("Una Smith")).otherwise(F.lit("Una Sr.")))
               .when(F.col("role") == "assistant", F.lit("Abe Jones"))
               .when(F.col("role") == "system", F.lit("Narrator")))
    return c.select(conv.alias("conv_id"), scene_id.alias("scene_id"),
                    F.col("turn").alias("pos"), speaker.alias("speaker"), F.col("text"))


def v_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with the raw markup transcript."""
    t = v_turns(spark, sf_dir)
    piece = F.concat(F.lit("<b>"), F.col("speaker"), F.lit("</b>: "), F.col("text"), F.lit("<br>"))
    return (t.withColumn("piece", piece)
            .groupBy("conv_id", "scene_id")
            .agg(F.concat(F.lit("Scene note<br>"),
                          F.expr("listagg(piece, '') within group (order by pos)")).alias("raw_text")))


def v_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v_turns(spark, sf_dir)
    return t.select("conv_id", "scene_id", F.col("speaker").alias("character")).distinct()


def v_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, scene_id, character, cAGR, cCON, cEXT, cOPN, cNEU)."""
    t = v_turns(spark, sf_dir)
    own = t.groupBy("conv_id", "scene_id", F.col("speaker").alias("character")).agg(
        F.count(F.lit(1)).alias("own_turns"))
    n = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    j = own.join(n, "conv_id").join(lab, "conv_id", "left")
    return j.select(
        "conv_id", "scene_id", "character",
        (F.col("quality") == 1).alias("cAGR"),
        (F.col("n_turns") >= 5).alias("cCON"),
        (2 * F.col("own_turns") >= F.col("n_turns")).alias("cEXT"),
        (F.col("conv_id") % 2 == 0).alias("cOPN"),
        (F.col("toxic") == 1).alias("cNEU"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    """36-word VAD lexicon in thousandths; word k takes the anchor of emotion id 1+((k-1)%6)."""
    names = [n for _, n in K.TAG_EMOTIONS]
    rows = []
    for k, w in enumerate(K.FIXTURE_LEXICON_WORDS, start=1):
        v, a, d = K.EMOTION_ANCHORS_MILLI[names[1 + (k - 1) % 6]]
        rows.append((w, v, a, d))
    return spark.createDataFrame(rows, "word string, v bigint, a bigint, d bigint")


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in K.FIXTURE_STOPWORDS], "word string")


def descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.DESCRIPTIONS, "trait string, polarity string, text string")


def v_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An emotion-annotated corpus aligned to the turns, with splits and duplicates.

    Whole turns: equal (lower-cased), containing the turn (text added), or
    from another dialogue position.  Speakers are list literals, some of two names.
    """
    t = v_turns(spark, sf_dir)
    names = F.array(*[F.lit(n) for n, _ in K.ANNOTATION_CODES])
    utter = F.when(F.col("pos") % 3 == 0, F.lower("text")) \
        .when(F.col("pos") % 3 == 1, F.concat(F.col("text"), F.lit(" extra"))) \
        .otherwise(F.concat(F.lit("so, "), F.col("text")))
    speaker = F.concat(F.lit("['"), F.col("speaker"), F.when(F.col("pos") % 2 == 0, F.lit("', 'Abe Jones']"))
                       .otherwise(F.lit("']")))
    split = F.when(F.col("conv_id") % 10 < 8, "train").when(F.col("conv_id") % 10 == 8, "dev") \
        .otherwise("test")
    base = t.select(
        scene_season("scene_id").alias("Season"),
        scene_episode("scene_id").alias("Episode"),
        speaker.alias("Speaker"),
        utter.alias("Utterance"),
        F.get(names, F.length("text") % 7).alias("Emotion"),
        split.alias("split"),
        (F.col("conv_id") * 100 + F.col("pos")).alias("ann_order"),
        "conv_id",
    )
    dup = base.where(F.col("conv_id") % 7 == 0)
    return base.unionByName(dup).drop("conv_id")


def v_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("text").alias("utterance"),
                                        F.col("quality").alias("labels"))


def every_nth(arr, n: int, k: int):
    """Sum of the values at 0-based places k, k + n, ... in millionths (integers, so any order adds up alike)."""
    picked = F.filter(F.transform(arr, lambda x, i: F.when(i % n == k, F.round(x.cast("double") * 1e6).cast("bigint"))),
                      lambda x: x.isNotNull())
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, x: a + x)


def v_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding")
    return e.select(
        "vec_id",
        *[(every_nth(emb, 4, k) / F.lit(1e6)).alias(c) for k, c in enumerate(("pos0", "pos1", "neg0", "neg1"))],
        (F.col("label") % 2).alias("label"),
    )


def v_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of three turns as a row (conv_id, part): Utterance/Emotion/Sentiment_1..3, null when absent."""
    from moodweave.operators.affect import emotion_tag
    t = v_turns(spark, sf_dir).withColumn("copy", F.col("text"))
    j = emotion_tag(t, lexicon(spark)).withColumnRenamed("copy", "text").withColumn("part", F.expr("pos div 3"))
    sent = F.when(F.col("sv") > 0, "positive").when(F.col("sv") < 0, "negative").otherwise("neutral")
    aggs = []
    for i in range(3):
        on = F.col("pos") % 3 == i
        aggs += [F.max(F.when(on, F.col("text"))).alias(f"Utterance_{i + 1}"),
                 F.max(F.when(on, F.col("emotion"))).alias(f"Emotion_{i + 1}"),
                 F.max(F.when(on, sent)).alias(f"Sentiment_{i + 1}")]
    return j.groupBy("conv_id", "part").agg(*aggs)
