"""The per-turn operators inside a stream.

Each is stateless: one output row per input row, a generator, or a join with a
static table.  They run inside the streaming plan itself, in append mode, so
Spark's file sink makes the result exactly-once across triggers and restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodweave.functions.text import first_word_exact, lexicon_tokens, strip_punct
from moodweave.operators import dialog as D
from moodweave.operators import lexicon as LX


def parsed(scenes: DataFrame) -> DataFrame:
    """B1: a stream of markup transcripts as a stream of turns."""
    return D.parse_transcript(scenes)


def cleaned(turns: DataFrame) -> DataFrame:
    """H1, H2: the text without punctuation, and its tokens."""
    return turns.withColumn("clean", strip_punct("text")).withColumn("tokens", lexicon_tokens("text"))


def matched_words(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row per token that the static lexicon lists, with its values (a stream-static join)."""
    words = turns.select("scene_id", "pos", F.explode(lexicon_tokens("text")).alias("word"))
    return words.join(lexicon.select("word", "v", "a", "d"), "word")


def scored(turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """D3, H4: the Big Five of every turn."""
    sums = LX.vad_sums(turns, ["scene_id", "pos"], "text", lexicon)
    return LX.big_five(LX.vad_matched(sums)).select("scene_id", "pos", "n_matched", "A", "C", "E", "O", "N")


def speaker_mask(turns: DataFrame, characters: DataFrame) -> DataFrame:
    """A row per turn and character of the static cast, with is_speaker and is_first.

    Which turn is the last is not known while a dialogue still arrives.
    """
    cast = characters.select("scene_id", "character", first_word_exact("character").alias("c_first"))
    return turns.select("scene_id", "pos", first_word_exact("speaker").alias("t_first")).join(cast, "scene_id") \
        .select("scene_id", "character", "pos", (F.col("t_first") == F.col("c_first")).cast("int").alias("is_speaker"),
                (F.col("pos") == 0).cast("int").alias("is_first"))


def run_stream(source: DataFrame, operator: Callable[[DataFrame], DataFrame], sink_path: str, checkpoint_path: str,
               available_now: bool = True) -> StreamingQuery:
    """Append what ``operator`` makes of the streaming frame ``source`` to the Parquet files of ``sink_path``."""
    w = operator(source).writeStream.format("parquet").option("checkpointLocation", checkpoint_path).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_path)
