"""Per-turn tagging over a file stream with foreachBatch."""

from conftest import SF_SMALL
from moodweave.operators.affect import emotion_tag
from moodweave.sources import fixtures as V
from moodweave.streaming.tagging import tag_stream


def test_stream_tags_equal_batch_tags(spark, tmp_dir):
    schema = "conv_id bigint, turn bigint, role string, text string"
    q = tag_stream(spark, f"{SF_SMALL}/conversations*.parquet", schema, V.lexicon(spark),
                   f"{tmp_dir}/out", f"{tmp_dir}/ckpt", to_turns=V.turns_from_conversations)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/out").select("scene_id", "pos", "emotion")
    want = emotion_tag(V.v_turns(spark, SF_SMALL), V.lexicon(spark)).select("scene_id", "pos", "emotion")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_streaming_frame_is_tagged_directly(spark, tmp_dir):
    """Tagging needs no aggregate, so it runs inside the stream itself."""
    schema = "conv_id bigint, turn bigint, role string, text string"
    stream = spark.readStream.schema(schema).parquet(f"{SF_SMALL}/conversations*.parquet")
    tagged = emotion_tag(V.turns_from_conversations(stream), V.lexicon(spark))
    q = tagged.writeStream.option("checkpointLocation", f"{tmp_dir}/c").trigger(availableNow=True) \
        .format("parquet").start(f"{tmp_dir}/o")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/o").select("scene_id", "pos", "emotion")
    want = emotion_tag(V.v_turns(spark, SF_SMALL), V.lexicon(spark)).select("scene_id", "pos", "emotion")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
