"""Utterance emotion tagging and pooling (I1, I2, I5, C4, D19, H7 helpers).

The default scorer is pure column code: mean VAD of the matched lexicon words,
then the nearest of the seven emotion anchors.  A model can be plugged in as
an Arrow-batched pandas function (``tag_with_model``).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.operators.lexicon import vad_sums
from moodweave.plans.scale import settle

EMOTION_NAMES = [n for _, n in K.TAG_EMOTIONS]


def nearest_anchor(n: Column, sv: Column, sa: Column, sd: Column) -> Column:
    """Struct(score, id, emotion) of the anchor nearest to the mean (sv,sa,sd)/n.

    n*|anchor - mean|^2 = n|anchor|^2 - 2 anchor.s + |s|^2/n; the last term is
    the same for every anchor, so the argmin of n|anchor|^2 - 2 anchor.s is
    exact in integers.  Ties go to the lowest id; n = 0 gives neutral.
    """
    cands = []
    for eid, name in K.TAG_EMOTIONS:
        av, aa, ad = K.EMOTION_ANCHORS_MILLI[name]
        score = n * F.lit(av * av + aa * aa + ad * ad) - F.lit(2) * (
            sv * F.lit(av) + sa * F.lit(aa) + sd * F.lit(ad))
        cands.append(F.struct(score.alias("score"), F.lit(eid).alias("emotion_id"),
                              F.lit(name).alias("emotion")))
    return F.array_min(F.array(*cands))


def emotion_tag(turns: DataFrame, lexicon: DataFrame, keys: list[str] | None = None,
                text_col: str = "text") -> DataFrame:
    """Tag every row with an emotion: keys + n_matched, sv, emotion_id, emotion.

    One row out per row in, tagged where it is; ``keys`` (every non-text
    column by default) are carried along and need not be unique.
    """
    keys = keys or [c for c in turns.columns if c != text_col]
    s = vad_sums(turns, keys, text_col, lexicon)
    best = nearest_anchor(F.col("n_matched"), F.col("sv"), F.col("sa"), F.col("sd"))
    s = settle(s.withColumn("_b", best), "_b")
    return s.select(*keys, "n_tokens", "n_matched", "sv", "sa", "sd",
                    F.col("_b.emotion_id").alias("emotion_id"), F.col("_b.emotion").alias("emotion"))


def pattern_code(emotion: Column) -> Column:
    """C4: code of an emotion name in the pattern analysis ('disgust' and 'love' share one); null if unknown."""
    names = F.create_map(*[F.lit(x) for pair in K.PATTERN_CODES for x in pair])
    return F.try_element_at(names, emotion)


def argmax_label(scores: Column, names: list[str], default: str = "neutral") -> Column:
    """Highest score strictly above 0 wins, first on ties, else ``default``."""
    best = F.array_max(scores)
    idx = F.array_position(scores, best)
    return F.when(best > 0, F.get(F.array(*[F.lit(x) for x in names]), (idx - 1).cast("int"))) \
        .otherwise(F.lit(default))


def tag_with_model(turns: DataFrame, score_batch: Callable, class_names: list[str],
                   keys: list[str], text_col: str = "text") -> DataFrame:
    """Plug-in scorer: ``score_batch(pd.Series[str]) -> np.ndarray[n, k]``.

    Runs as one Arrow-batched pandas UDF (model loaded once per worker by the
    caller's closure); the decision rule is ``argmax_label``.
    """
    @F.pandas_udf("array<double>")
    def _score(texts: pd.Series) -> pd.Series:
        out = score_batch(texts)
        return pd.Series([list(map(float, r)) for r in out])

    scored = turns.select(*keys, _score(F.col(text_col)).alias("scores"))
    return scored.withColumn("emotion", argmax_label(F.col("scores"), class_names))


def one_hot(emotion: Column) -> list[Column]:
    return [F.when(emotion == F.lit(n), 1.0).otherwise(0.0).alias(f"p_{n}") for n in EMOTION_NAMES]


def speaker_pool(turns_tagged: DataFrame, samples: DataFrame) -> DataFrame:
    """Speaker-masked mean of the per-turn emotion vectors.

    The mask is 1 where the first word of the turn's speaker equals the first
    word of the character, over all turns.  A sample without own turns gets
    nulls.
    """
    from moodweave.functions.text import first_word_exact
    t = turns_tagged.select("scene_id", first_word_exact("speaker").alias("first"), *one_hot(F.col("emotion")))
    # pre-aggregate per (scene, first word) before meeting the samples
    sums = t.groupBy("scene_id", "first").agg(
        F.count(F.lit(1)).alias("n_own"), *[F.sum(f"p_{n}").alias(f"s_{n}") for n in EMOTION_NAMES])
    s = samples.select("scene_id", "character", first_word_exact("character").alias("first"))
    j = s.join(sums, ["scene_id", "first"], "left")
    return j.select("scene_id", "character", F.coalesce("n_own", F.lit(0)).alias("n_own"),
                    *[F.try_divide(F.col(f"s_{n}"), F.col("n_own")).alias(f"p_{n}")
                      for n in EMOTION_NAMES])
