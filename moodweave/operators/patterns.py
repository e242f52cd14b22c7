"""Emotion distributions and transition matrices per trait.

Both pre-aggregate the tagged turns per scene (and speaker first word) before
meeting the samples, so the shuffled volume is bounded by distinct
(scene, speaker, emotion) combinations, and a very long dialogue is spread
over many tasks by the partial aggregation instead of sitting in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.numeric import round6
from moodweave.functions.text import first_word_exact
from moodweave.operators.dialog import next_turn_pairs
from moodweave.operators.traits import trait_labels

SIX = ["joy", "surprise", "anger", "sadness", "fear", "disgust"]
SEVEN = ["neutral"] + SIX


def _grid(spark: SparkSession, traits: list[str], emotions: list[str], two: bool,
          flags: bool = False) -> DataFrame:
    """Dense result grid of fixed labels (at most 5 x 2 x 7 x 7 rows), one partition."""
    if two:
        rows = [(t, a, b) for t in traits for a in emotions for b in emotions]
        return spark.createDataFrame(rows, "trait string, e_from string, e_to string").coalesce(1)
    if flags:
        rows = [(t, f, e) for t in traits for f in (True, False) for e in emotions]
        return spark.createDataFrame(rows, "trait string, flag boolean, emotion string").coalesce(1)
    rows = [(t, e) for t in traits for e in emotions]
    return spark.createDataFrame(rows, "trait string, emotion string").coalesce(1)


def _samples_by_first(traits: DataFrame, flag_value: bool | None) -> DataFrame:
    """(scene_id, trait, label, first, mult): samples grouped by character first word."""
    s = trait_labels(traits).where(F.col("flag").isNotNull())
    if flag_value is not None:
        s = s.where(F.col("flag") == F.lit(flag_value))
    return s.groupBy("scene_id", "trait", "flag", first_word_exact("character").alias("first")) \
        .agg(F.count(F.lit(1)).alias("mult"))


def emotion_transition(tagged: DataFrame, traits: DataFrame, mode: str = "six") -> DataFrame:
    """Counts and row shares of (others' emotion at j -> character's emotion at j+1).

    Positive samples only.  ``six`` drops pairs touching neutral (6x6 grid of
    the reference call), ``seven`` keeps them.  Dense grid; an empty row has a
    null share.
    """
    spark = tagged.sparkSession
    t = tagged.select("scene_id", "pos", first_word_exact("speaker").alias("f"), F.col("emotion").alias("e"))
    pairs = next_turn_pairs(t, ["f", "e"]).where(F.col("f_from") != F.col("f_to"))
    if mode == "six":
        pairs = pairs.where((F.col("e_from") != "neutral") & (F.col("e_to") != "neutral"))
    pc = pairs.groupBy("scene_id", "f_to", "e_from", "e_to").agg(F.count(F.lit(1)).alias("n"))
    smp = _samples_by_first(traits, True)
    j = pc.join(smp.withColumnRenamed("first", "f_to"), ["scene_id", "f_to"])
    counts = j.groupBy("trait", "e_from", "e_to").agg(F.sum(F.col("n") * F.col("mult")).alias("n"))
    emos = SIX if mode == "six" else SEVEN
    grid = _grid(spark, [s for _, s in K.TRAITS], emos, two=True)
    dense = grid.join(counts, ["trait", "e_from", "e_to"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row = Window.partitionBy("trait", "e_from")  # <= 7 rows per window partition
    return dense.select(
        "trait", "e_from", "e_to", "n",
        round6(F.try_divide(F.col("n"), F.sum("n").over(row))).alias("ratio"))


def emotion_distribution(tagged: DataFrame, traits: DataFrame, include_last: bool = False,
                         emotions: list[str] = SEVEN) -> DataFrame:
    """Share of each emotion among the character's own turns, per trait and polarity.

    Own turns use the first-word mask; the last turn of each dialogue is
    excluded unless ``include_last``.  Samples with a null flag count on
    neither side.  ``personality`` is ``AGR`` / ``non-AGR`` style.
    """
    spark = tagged.sparkSession
    t = tagged.select("scene_id", "pos", first_word_exact("speaker").alias("first"), "emotion")
    c = t.groupBy("scene_id", "first", "emotion").agg(F.count(F.lit(1)).alias("n"))
    if not include_last:
        last = t.groupBy("scene_id").agg(F.max_by(F.struct("first", "emotion"), "pos").alias("l"))
        last = last.select("scene_id", "l.first", "l.emotion", F.lit(-1).cast("bigint").alias("n"))
        c = c.unionByName(last).groupBy("scene_id", "first", "emotion").agg(F.sum("n").alias("n"))
    smp = _samples_by_first(traits, None)
    j = c.join(smp, ["scene_id", "first"])
    counts = j.groupBy("trait", "flag", "emotion").agg(F.sum(F.col("n") * F.col("mult")).alias("n"))
    grid = _grid(spark, [s for _, s in K.TRAITS], emotions, two=False, flags=True)
    dense = grid.join(counts, ["trait", "flag", "emotion"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    long_name = F.create_map(*[x for c_, s in K.TRAITS for x in (F.lit(s), F.lit(c_[1:]))])
    tot = Window.partitionBy("trait", "flag")  # 7 rows per window partition
    return dense.select(
        "trait", F.col("flag").cast("int").alias("label"),
        F.when(F.col("flag"), long_name[F.col("trait")])
        .otherwise(F.concat(F.lit("non-"), long_name[F.col("trait")])).alias("personality"),
        "emotion", "n",
        round6(F.try_divide(F.col("n"), F.sum("n").over(tot))).alias("share"))
