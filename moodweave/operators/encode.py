"""Encodings for model inputs and label tables.

Pretrained subword tokenizers are replaced by a corpus vocabulary: words are
numbered by descending frequency (ties by word) with a distributed ranking.
Widths are arguments: an integer cuts and pads to it (fixed-length model
input), ``None`` keeps every token or turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave.functions.text import first_word_exact, lexicon_tokens, list_literal
from moodweave.operators.dialog import scene_arrays
from moodweave.plans.scale import dense_index, global_rank, is_small

PAD, CLS, SEP, UNK = 0, 1, 2, 3
FIRST_WORD_ID = 4
SALTS = 16


def unpivot_triples(wide: DataFrame, keys: list[str], n: int = 3,
                    groups=("Utterance", "Emotion", "Sentiment")) -> DataFrame:
    """Wide column groups (X_1..X_n) to rows (slot, X...); null groups stay rows."""
    parts = ", ".join(f"{i}, " + ", ".join(f"{g}_{i}" for g in groups) for i in range(1, n + 1))
    return wide.selectExpr(*keys, f"stack({n}, {parts}) as (slot, {', '.join(groups)})")


def label_encode(df: DataFrame, col: str, out: str = "label_id") -> DataFrame:
    """Sorted distinct names -> 0..k-1; null stays null."""
    return df.join(dense_index(df, col, out), col, "left")


def pad(arr, width: int, fill) -> "F.Column":
    """Cut or pad an array to ``width`` with ``fill``."""
    return F.slice(F.concat(arr, F.array_repeat(F.lit(fill), width)), 1, width)


def mask_pad(turns: DataFrame, characters: DataFrame, width: int | None) -> DataFrame:
    """Speaker mask (first-word match) of the first ``width`` turns, padded with -1; of all turns when None."""
    t = turns.select("scene_id", "pos", first_word_exact("speaker").alias("tf"))
    c = characters.select("scene_id", "character", first_word_exact("character").alias("cf"))
    j = c.join(scene_arrays(t, "tf"), "scene_id", "left")
    arr = F.coalesce(F.col("arr"), F.array().cast("array<struct<pos:bigint,tf:string>>"))
    if width is not None:
        arr = F.filter(arr, lambda x: x["pos"] < width)
    m = F.transform(arr, lambda x: F.coalesce(x["tf"] == F.col("cf"), F.lit(False)).cast("int"))
    return j.select("scene_id", "character", F.size(arr).alias("n_turns"),
                    list_literal(m if width is None else pad(m, width, -1)).alias("dialog_state"))


def vocabulary(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, id): id = FIRST_WORD_ID + rank by (n desc, word)."""
    w = turns.select(F.explode(lexicon_tokens(text_col)).alias("word")).groupBy("word") \
        .agg(F.count(F.lit(1)).alias("n"))
    r = global_rank(w.select("word", "n", (-F.col("n")).alias("_negn")), ["_negn", "word"], "rank")
    return r.select("word", "n", (F.col("rank") + FIRST_WORD_ID - 1).cast("int").alias("id"))


def turn_ids(turns: DataFrame, vocab: DataFrame, text_col: str = "text", first: int | None = None) -> DataFrame:
    """(scene_id, pos, n_tokens, ids): token ids of every turn, of its ``first`` tokens only if given.

    A word meets the vocabulary once per turn, not once per token.  A
    vocabulary proven small is broadcast; else every word has ``SALTS`` join
    keys, so that a frequent word spreads over as many tasks.
    """
    toks = lexicon_tokens(text_col)
    t = turns.select("scene_id", "pos", F.size(toks).alias("n_tokens"),
                     (toks if first is None else F.slice(toks, 1, first)).alias("_k"))
    word = t.select("scene_id", "pos", F.posexplode("_k").alias("p", "word")) \
        .groupBy("scene_id", "pos", "word").agg(F.collect_list("p").alias("at"))
    v = vocab.select("word", "id")
    if is_small(v):
        j = word.join(F.broadcast(v), "word", "left")
    else:
        salted = v.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        j = word.withColumn("salt", F.pmod(F.xxhash64("scene_id", "pos"), F.lit(SALTS)).cast("int")) \
            .join(salted, ["word", "salt"], "left")
    placed = j.select("scene_id", "pos", F.transform("at", lambda p: F.struct(
        p.alias("p"), F.coalesce(F.col("id"), F.lit(UNK)).alias("id"))).alias("x"))
    g = placed.groupBy("scene_id", "pos").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x")) \
        .select("scene_id", "pos", F.transform("x", lambda y: y["id"]).alias("ids"))
    return t.drop("_k").join(g, ["scene_id", "pos"], "left") \
        .withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def encode_turns(turns: DataFrame, vocab: DataFrame, max_len: int | None) -> DataFrame:
    """Per turn: [CLS] word ids [SEP]; cut to ``max_len`` and padded with [PAD] if given; mask = id > 0."""
    j = turn_ids(turns, vocab, first=None if max_len is None else max_len - 2)
    full = F.concat(F.array(F.lit(CLS)), F.col("ids"), F.array(F.lit(SEP)))
    if max_len is not None:
        full = pad(full, max_len, PAD)
    j = j.withColumn("f", full)
    return j.select("scene_id", "pos", "n_tokens", list_literal(F.col("f")).alias("input_ids"),
                    list_literal(F.transform("f", lambda x: (x > 0).cast("double"))).alias("attention_mask"))


def segment_ids(turns: DataFrame, characters: DataFrame, vocab: DataFrame, half: int | None) -> DataFrame:
    """Utterance ids + context ids without its [CLS]; segments 1 for the utterance part, 0 after.

    Utterance = the character's own turns (exact name), context = the other
    turns (also those without a speaker); each cut to ``half`` ids including
    [CLS] and [SEP] if given.  Every turn is encoded once and gathered once
    per dialogue; characters read both sides from that array.
    """
    t = turns.select("scene_id", "pos", "speaker").join(turn_ids(turns, vocab).drop("n_tokens"), ["scene_id", "pos"])
    j = characters.select("scene_id", "character").join(scene_arrays(t, "speaker", "ids"), "scene_id", "left")
    own = lambda x: F.coalesce(x["speaker"] == F.col("character"), F.lit(False))

    def side(keep):
        ids = F.flatten(F.transform(F.filter("arr", keep), lambda x: x["ids"]))
        ids = F.coalesce(ids, F.array().cast("array<int>"))
        return ids if half is None else F.slice(ids, 1, half - 2)

    j = j.select("scene_id", "character", side(own).alias("u"), side(lambda x: ~own(x)).alias("x"))
    uid = F.concat(F.array(F.lit(CLS)), F.col("u"), F.array(F.lit(SEP)))
    xid = F.concat(F.col("x"), F.array(F.lit(SEP)))  # context ids without [CLS]
    seg = F.concat(F.array_repeat(F.lit(1), F.size("u") + 2), F.array_repeat(F.lit(0), F.size("x") + 1))
    return j.select("scene_id", "character", list_literal(F.concat(uid, xid)).alias("input_ids"),
                    list_literal(seg).alias("segment_ids"))
