"""Per-turn operators inside a stream equal the batch, over several triggers and a restart."""

import pytest

from conftest import SF_SMALL
from moodweave.operators import dialog as D
from moodweave.sources import fixtures as V
from moodweave.streaming import turns as ST

TURNS = "conv_id bigint, scene_id string, pos bigint, speaker string, text string"


def run(spark, tmp_dir, batch, schema, operator):
    """Feed the rows in three files, the third after a restart of the query."""
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt"))
    thirds = batch.randomSplit([1.0, 1.0, 1.0], seed=7)
    epochs = 0
    for k, parts in enumerate((thirds[:2], thirds[2:])):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ST.run_stream(stream, operator, out, ckpt)
        assert q.awaitTermination(300)
        epochs += len([p for p in q.recentProgress if p["numInputRows"] > 0])
    assert epochs >= 3
    got = spark.read.parquet(out)
    want = operator(batch)
    show = lambda df: sorted(map(str, df.select(want.columns).collect()))
    assert show(got) == show(want) and want.count() > 0


@pytest.mark.parametrize("name", ["cleaned", "matched_words", "scored", "speaker_mask"])
def test_stream_equals_batch(spark, tmp_dir, name):
    turns = V.v_turns(spark, SF_SMALL)
    ops = {"cleaned": ST.cleaned, "matched_words": lambda t: ST.matched_words(t, V.lexicon(spark)),
           "scored": lambda t: ST.scored(t, V.lexicon(spark)), "speaker_mask": lambda t: ST.speaker_mask(t, V.v_characters(spark, SF_SMALL))}
    run(spark, tmp_dir, turns, TURNS, ops[name])


def test_parsing_inside_a_stream(spark, tmp_dir):
    scenes = V.v_scenes(spark, SF_SMALL).select("scene_id", "raw_text")
    run(spark, tmp_dir, scenes, "scene_id string, raw_text string", ST.parsed)


def test_mask_equals_the_batch_operator(spark):
    turns, cast = V.v_turns(spark, SF_SMALL), V.v_characters(spark, SF_SMALL)
    cols = ["scene_id", "character", "pos", "is_speaker", "is_first"]
    got, want = ST.speaker_mask(turns, cast).select(cols), D.speaker_mask(turns, cast).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
