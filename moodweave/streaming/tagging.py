"""Tag turns as they arrive.

The analysed workflows have no streams; the per-turn operators are pure
DataFrame -> DataFrame functions, so a stream of turns is tagged per
micro-batch with ``foreachBatch``.  Each batch overwrites its own ``epoch``
partition of the sink, so a retried batch replaces its output (exactly-once
results with an at-least-once source).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodweave.operators.affect import emotion_tag


def tag_stream(spark: SparkSession, source_path: str, schema: str, lexicon: DataFrame,
               sink_path: str, checkpoint_path: str,
               to_turns: Callable[[DataFrame], DataFrame] | None = None,
               available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Read parquet files as a stream, tag every turn, append tags to ``sink_path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    turns = to_turns(stream) if to_turns else stream

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        tagged = emotion_tag(batch, lexicon).withColumn("epoch", F.lit(epoch_id))
        (tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(sink_path))

    w = turns.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
