"""Dialogue structure: parsing, prefixes, speaker masks, ordered texts.

(B1, B8, B9, B11, B12, D2, E2, E3, C9, G5)

Data model: ``turns(scene_id, pos, speaker, text)`` with ``pos`` a dense
0-based index inside the dialogue; arrays appear only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.text import first_word, first_word_exact, scene_episode, scene_season
from moodweave.plans.scale import prefix_sum


def parse_transcript(scenes: DataFrame, raw_col: str = "raw_text", keys=("scene_id",)) -> DataFrame:
    """Markup transcript -> turns.

    Split on ``<br>``, keep pieces containing ``</b>:``; the speaker is the part
    before it without ``<b>``, the text the part after it (a third part is
    dropped, the leading blank is kept).
    """
    pieces = F.filter(F.split(F.col(raw_col), "<br>"), lambda p: p.contains("</b>:"))
    ex = scenes.select(*keys, F.posexplode(pieces).alias("pos", "piece"))
    parts = F.split(F.col("piece"), "</b>:")
    return ex.select(*keys, F.col("pos").cast("bigint").alias("pos"),
                     F.replace(parts.getItem(0), F.lit("<b>"), F.lit("")).alias("speaker"),
                     parts.getItem(1).alias("text"))


def scene_sizes(turns: DataFrame) -> DataFrame:
    """(scene_id, n_turns); an aggregate, so a long dialogue is split by partial aggregation."""
    return turns.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_turns"))


def prefix_len(n: Column, flow_len: Column) -> Column:
    """``int(n * flow_len)``: floor, so a short dialogue can keep zero turns."""
    return F.floor(n * flow_len).cast("int")


def flow_prefix(turns: DataFrame, lens=K.FLOW_LENS) -> DataFrame:
    """Every turn that falls in the first int(n * flow_len) turns, per length."""
    t = turns.join(scene_sizes(turns), "scene_id")
    t = t.withColumn("flow_len", F.explode(F.array(*[F.lit(float(x)) for x in lens])))
    return t.where(F.col("pos") < prefix_len(F.col("n_turns"), F.col("flow_len"))).drop("n_turns")


def next_turn_pairs(turns: DataFrame, payload: list[str]) -> DataFrame:
    """(scene_id, pos of the later turn, <c>_from, <c>_to for c in payload) for turns j, j+1.

    One pass instead of a self-join: every turn is emitted as the 'to' side at
    its own position and as the 'from' side at pos + 1, and one aggregate
    keyed by (scene_id, position) assembles the pairs.  The key includes the
    position, so a long dialogue spreads over all reducers.
    """
    def side(k, is_to):
        return F.struct(k.alias("_k"), F.lit(is_to).alias("_to"), *[F.col(c) for c in payload])
    x = turns.select("scene_id", F.explode(F.array(side(F.col("pos"), True), side(F.col("pos") + 1, False)))
                     .alias("_x")).select("scene_id", "_x.*")
    to, fr = F.col("_to"), ~F.col("_to")
    aggs = [F.max(fr.cast("int")).alias("_has_from"), F.max(to.cast("int")).alias("_has_to")]
    for c in payload:
        aggs += [F.max(F.when(fr, F.col(c))).alias(f"{c}_from"), F.max(F.when(to, F.col(c))).alias(f"{c}_to")]
    g = x.groupBy("scene_id", "_k").agg(*aggs)
    return g.where((F.col("_has_from") == 1) & (F.col("_has_to") == 1)) \
        .select("scene_id", F.col("_k").alias("pos"), *[f"{c}_{s}" for c in payload for s in ("from", "to")])


def speaker_mask(turns: DataFrame, characters: DataFrame) -> DataFrame:
    """Long mask: one row per (scene, character, turn) with is_speaker / is_first / is_last.

    is_speaker compares first words split on a single blank (no trim).
    """
    n = scene_sizes(turns)
    t = turns.select("scene_id", "pos", first_word_exact("speaker").alias("t_first")).join(n, "scene_id")
    c = characters.select("scene_id", "character", first_word_exact("character").alias("c_first"))
    j = c.join(t, "scene_id")
    return j.select(
        "scene_id", "character", "pos",
        (F.col("t_first") == F.col("c_first")).cast("int").alias("is_speaker"),
        (F.col("pos") == 0).cast("int").alias("is_first"),
        (F.col("pos") == F.col("n_turns") - 1).cast("int").alias("is_last"))


def _owner_test(match: str):
    """Which turns belong to the character: exact full name, or equal first words; a null speaker owns none."""
    if match == "exact":
        return lambda spk, ch: F.coalesce(spk == ch, F.lit(False))
    if match == "first_word":
        return lambda spk, ch: F.coalesce(first_word_exact(spk) == first_word_exact(ch), F.lit(False))
    raise ValueError(match)


def scene_arrays(turns: DataFrame, *cols: str) -> DataFrame:
    """(scene_id, arr): the dialogue's turns in order, once per dialogue; characters join it afterwards.

    The text of a dialogue is shuffled once, however many characters it has.
    """
    return turns.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("arr"))


#: Turn positions whose texts one task joins; a long dialogue's strings are put together from such ranges.
RANGE = 4096


def _range(pos="pos"):
    return F.floor(F.col(pos) / RANGE).alias("_range")


def range_arrays(turns: DataFrame, *cols: str) -> DataFrame:
    """(scene_id, _range, arr): the turns of every position range in order, so a long dialogue is spread over many tasks."""
    return turns.groupBy("scene_id", _range()).agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("arr"))


def _joined_ranges(parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """One string per key from the strings ``_part`` of its ranges: only this step sees a dialogue, at a row per range."""
    ordered = F.array_sort(F.collect_list(F.struct("_range", "_part")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_part"]), "").alias(out))


def ordered_concat(turns: DataFrame, keys: list[str], piece: str, out: str) -> DataFrame:
    """(keys, out): the pieces of a key's turns by position, joined range by range."""
    parts = turns.groupBy(*keys, _range()).agg(F.expr(f"listagg({piece}, '') within group (order by pos)").alias("_part"))
    return _joined_ranges(parts, keys, out)


def _side_text(turns: DataFrame, characters: DataFrame, match: str, own: bool, out: str) -> DataFrame:
    owns = _owner_test(match)
    c = characters.select("scene_id", "character")

    def picked(x):
        mine = owns(x["speaker"], F.col("character"))
        return mine if own else ~mine

    text = F.array_join(F.transform(F.filter("arr", picked), lambda x: F.concat(F.lit(" "), x["text"])), "")
    parts = c.distinct().join(range_arrays(turns, "speaker", "text"), "scene_id") \
        .select("scene_id", F.col("character").alias("_who"), "_range", text.alias("_part"))
    texts = _joined_ranges(parts, ["scene_id", "_who"], out).withColumnRenamed("scene_id", "_scene")
    return c.join(texts, (F.col("scene_id") == F.col("_scene")) & F.col("character").eqNullSafe(F.col("_who")), "left") \
        .select("scene_id", "character", F.coalesce(out, F.lit("")).alias(out))


def speaker_text(turns: DataFrame, characters: DataFrame, match: str = "exact") -> DataFrame:
    """Own turns, each preceded by a blank; '' when none.

    ``exact`` compares full names; ``first_word`` compares the first words
    (a variant used by one of the baseline classifiers).
    """
    if match == "exact":  # own turns are a plain group by (scene, speaker): no fan-out
        c = characters.select("scene_id", "character")
        own = ordered_concat(turns, ["scene_id", "speaker"], "concat(' ', text)", "utterance").withColumnRenamed("speaker", "character")
        return c.join(own, ["scene_id", "character"], "left") \
            .select("scene_id", "character", F.coalesce("utterance", F.lit("")).alias("utterance"))
    return _side_text(turns, characters, match, True, "utterance")


def context_text(turns: DataFrame, characters: DataFrame, match: str = "exact") -> DataFrame:
    """Other speakers' turns (also those without a speaker), each preceded by a blank; '' when none."""
    return _side_text(turns, characters, match, False, "context")


def dialog_text(turns: DataFrame, characters: DataFrame) -> DataFrame:
    """All turns concatenated without separator, roles ignored."""
    s = ordered_concat(turns, ["scene_id"], "text", "sent")
    return characters.select("scene_id", "character").join(s, "scene_id", "left") \
        .select("scene_id", "character", F.coalesce("sent", F.lit("")).alias("sent"))


def scene_keys(characters: DataFrame) -> DataFrame:
    """Season / episode from the scene id; first name (trimmed split) of the character."""
    return characters.select("scene_id", "character",
                             scene_season("scene_id").alias("season"),
                             scene_episode("scene_id").alias("episode"),
                             first_word("character").alias("first_name"))


def dialog_offsets(turns: DataFrame, order_col: str = "conv_id") -> DataFrame:
    """(scene_id, start, len): dialogues laid end to end in ``order_col`` order.

    Only keys are read: pass the plain turns, so no text is tagged for it.
    """
    sizes = turns.groupBy(order_col, "scene_id").agg(F.count(F.lit(1)).alias("len"))
    return prefix_sum(sizes, [order_col, "scene_id"], "len").select("scene_id", "start", "len")


def flatten_labels(tagged: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per-turn labels -> the flat (idx, label) list of the legacy label dump."""
    j = tagged.select("scene_id", "pos", "emotion_id").join(offsets.select("scene_id", "start"), "scene_id")
    return j.select((F.col("start") + F.col("pos")).alias("idx"),
                    F.col("emotion_id").cast("double").alias("label"))


def regroup_labels(flat: DataFrame, dialogs: DataFrame, bucket: int = 4096) -> DataFrame:
    """Dialogue k gets flat labels [start, start+len) -- a range join done as an equi-join.

    ``dialogs(scene_id, start, len)``.  Each dialogue is expanded to the
    index buckets its range touches (len/bucket + 2 rows), flat rows carry
    their bucket; the range test is the residual.
    """
    d = dialogs.where(F.col("len") > 0).select(
        "scene_id", "start", "len",
        F.explode(F.sequence(F.floor(F.col("start") / bucket),
                             F.floor((F.col("start") + F.col("len") - 1) / bucket))).alias("_bk"))
    f = flat.withColumn("_bk", F.floor(F.col("idx") / bucket))
    j = f.join(d, "_bk").where((F.col("idx") >= F.col("start")) &
                               (F.col("idx") < F.col("start") + F.col("len")))
    names = F.create_map(*[x for i, n in K.TAG_EMOTIONS for x in (F.lit(float(i)), F.lit(n))])
    return j.select("scene_id", (F.col("idx") - F.col("start")).alias("pos"), F.col("idx").alias("flat_idx"),
                    names[F.col("label")].alias("emotion"))
