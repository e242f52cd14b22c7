"""Alignment of turns with an emotion-annotated corpus.

For every turn: the first annotation (lowest ``ann_order``) of the same season,
episode and speaker whose text equals the turn text, contains it, or is
contained in it.

Plan.  Turns and annotations of a block (season, episode, speaker) are reduced
to distinct texts, and pairs of texts meet on *winnowed fingerprints* only:
of every ``WINDOW`` consecutive ``GRAM``-grams of a text the least hash is
kept.  A contained text of at least ``WINDOW + GRAM - 1`` characters fills at
least one whole window of its container, so every fingerprint of it is one of
the container's; it is looked up by the one that is rarest on the other side.
Single grams grow common as a block grows.  So the minima are winnowed once
more, as hashes of ``RUN`` minima in a row: a text that fills a window of these
is looked up by its rarest run, and its candidates hold some fifteen of its
characters or more in one piece.  A shorter text is looked up by itself among the container's substrings of the
lengths that short texts of the block have.  Empty texts are met by per-block
minima.  No pairs of a block are formed, whatever its size; texts join back
once per candidate, the containment test decides, and one ``min_by`` ends it.

Distinct texts, fingerprints, rarest ones and pairs are written one after the
other, so that the shuffle files of one step are gone before the next begins.
Only blocks that both sides have are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodweave.functions.text import first_word, scene_episode, scene_season
from moodweave.plans.scale import bounded_broadcast, drop_stored, settle, stored
from moodweave.sources.files import first_listed

BLOCK = ["season", "episode", "spk"]


def dedup_annotations(ann: DataFrame) -> DataFrame:
    """Union-all of the splits, then full-row dedup keeping the first (lowest) order."""
    cols = ["Season", "Episode", "Speaker", "Utterance", "Emotion"]
    return ann.groupBy(*cols).agg(F.min("ann_order").alias("ann_order"))


def prepare(turns: DataFrame, ann: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """Narrow both sides to (block, text, order) -- wide text columns stay behind.

    ``emory``: annotation speakers are list literals, of which the first name's
    first word counts; text lower-cased.
    ``meld``: annotation speaker and text used as they are.
    """
    t = turns.select(
        "scene_id", "pos",
        scene_season("scene_id").alias("season"), scene_episode("scene_id").alias("episode"),
        first_word("speaker").alias("spk"), F.lower("text").alias("t"))
    a = dedup_annotations(ann)
    spk = first_listed("Speaker") if variant == "emory" else F.col("Speaker")
    u = F.lower("Utterance") if variant == "emory" else F.col("Utterance")
    a = a.select(F.col("Season").alias("season"), F.col("Episode").alias("episode"), spk.alias("spk"),
                 u.alias("u"), F.col("Emotion").alias("emotion"), "ann_order")
    return t, a


#: Characters of a gram, and consecutive grams of which the least hash is kept.
GRAM, WINDOW = 4, 5
#: Window minima of a run, and consecutive runs of which the least hash is kept.
RUN, RUN_WINDOW = 8, 8


def _gram_hashes(text: Column, gram: int, window: int) -> Column:
    """Hashes of all grams of a text that fills a window; null for a shorter one."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{gram}}}))"), 1)
    return F.when(F.length(text) > gram + window - 2, F.transform(grams, lambda g: F.xxhash64(g)))


def _least(hashes: Column, window: int) -> Column:
    """The least hash of every window, in order."""
    return F.transform(F.slice(hashes, 1, F.size(hashes) - (window - 1)),
                       lambda h, i: F.least(h, *[F.get(hashes, i + k) for k in range(1, window)]) if window > 1 else h)


def _changes(minima: Column) -> Column:
    """Without repeats of the item before: a contained text's list is a contiguous part of its container's."""
    return F.filter(minima, lambda h, i: (i == 0) | (h != F.get(minima, i - 1)))


def _runs(minima: Column) -> Column:
    """Hashes of all runs of ``RUN`` minima of a text that fills a window of them; null for a shorter one."""
    runs = F.transform(F.slice(minima, 1, F.size(minima) - (RUN - 1)),
                       lambda h, i: F.xxhash64(h, *[F.get(minima, i + k) for k in range(1, RUN)]))
    return F.when(F.size(minima) > RUN + RUN_WINDOW - 2, runs)


def _texts(td: DataFrame, ad: DataFrame) -> DataFrame:
    """(bk, side, id, text) of both sides' non-empty texts; side 0 are the turns, 1 the annotations."""
    both = td.select("bk", F.lit(0).alias("side"), F.col("t").alias("text")) \
        .unionByName(ad.select("bk", F.lit(1).alias("side"), F.col("u").alias("text")))
    return both.where(F.length("text") > 0).select("bk", "side", F.xxhash64("text").alias("id"), "text")


def _candidates(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """(bk, tid, aid): pairs of a turn and an annotation of which one may contain the other, written.

    Exploded rows carry hashes, never texts.  The planner sizes them like their source, far too
    small, so their joins are pinned to sort-merge.
    """
    other = 1 - F.col("side")
    winnowed = settle(texts.select("bk", "side", "id", _gram_hashes(F.col("text"), gram, window).alias("h")), "h")
    winnowed = settle(winnowed.select("bk", "side", "id", _least(F.col("h"), window).alias("minima")), "minima")
    winnowed = settle(winnowed.withColumn("minima", _changes(F.col("minima"))), "minima")
    winnowed = settle(winnowed.withColumn("runs", _runs(F.col("minima"))), "runs")
    far = F.col("runs").isNotNull()
    keys = F.concat(
        F.transform(F.array_distinct("minima"), lambda h: F.struct(h.alias("key"), (~far).alias("asks"))),
        F.coalesce(F.transform(F.array_distinct(_least(F.col("runs"), RUN_WINDOW)), lambda h: F.struct(h.alias("key"), F.lit(True).alias("asks"))),
                   F.array().cast("array<struct<key:bigint,asks:boolean>>")))
    # three joins read the fingerprints: they are computed once
    winnowed = stored(winnowed.select("bk", "side", "id", keys.alias("fps")), "align-prints")
    prints = winnowed.select("bk", "side", "id", F.explode("fps").alias("p")).select("bk", "side", "id", "p.key", "p.asks").hint("merge")
    shared = prints.groupBy("bk", "key").agg(*[F.sum((F.col("side") == s).cast("long")).alias(f"f{s}") for s in (0, 1)]) \
        .where((F.col("f0") > 0) & (F.col("f1") > 0)).hint("merge")
    f_other = F.coalesce(F.when(F.col("side") == 0, F.col("f1")).otherwise(F.col("f0")), F.lit(0))
    rarest = prints.where("asks").join(shared, ["bk", "key"], "left").groupBy("bk", "side", "id") \
        .agg(F.min(F.struct(f_other.alias("f"), "key")).alias("k")).where("k.f > 0")
    rarest = stored(rarest.select("bk", other.alias("side"), F.col("id").alias("needle"), "k.key"), "align-rarest")
    long = stored(rarest.join(prints.drop("asks"), ["bk", "side", "key"]).select("bk", "side", "needle", "id"), "align-long")
    drop_stored(winnowed, rarest)
    few = texts.where(F.length("text") < gram + window - 1)
    chars = F.split("text", "")
    needles = few.select("bk", other.alias("side"), F.col("id").alias("needle"), F.xxhash64(F.size(chars), chars).alias("key"))
    lengths = few.groupBy("bk", other.alias("side")).agg(F.collect_set(F.size(chars)).alias("lengths"))
    hay = settle(texts.join(lengths, ["bk", "side"]).select("bk", "side", "id", "lengths", chars.alias("chars")), "chars")
    n = F.size("chars")
    inside = F.flatten(F.transform(F.filter("lengths", lambda m: m <= n), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.xxhash64(m, F.slice("chars", i, m)))))
    hay = settle(hay.select("bk", "side", "id", F.array_distinct(inside).alias("keys")), "keys")
    short = needles.join(hay.select("bk", "side", "id", F.explode("keys").alias("key")).hint("merge"), ["bk", "side", "key"])
    pairs = long.unionByName(short.select("bk", "side", "needle", "id"))
    turn = F.col("side") == 0            # the container's side
    pairs = stored(pairs.select("bk", F.when(turn, F.col("id")).otherwise(F.col("needle")).alias("tid"),
                                F.when(turn, F.col("needle")).otherwise(F.col("id")).alias("aid")), "align-pairs")
    drop_stored(long)
    return pairs


def align(turns: DataFrame, ann: DataFrame, variant: str = "emory", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(scene_id, pos, emotion): emotion of the first matching annotation, null if none.

    Matching runs on distinct texts per block: an annotation text keeps only
    its first occurrence (later copies can never win), and a turn text is
    matched once and joined back to all turns carrying it.  Duplicated texts
    therefore cost nothing extra, however often they repeat.
    """
    t, a = prepare(turns, ann, variant)
    there = F.col("season").isNotNull() & F.col("episode").isNotNull() & F.col("spk").isNotNull()
    bk = F.xxhash64(*BLOCK)              # narrow join key; the block itself is compared at the end
    td = t.where(there & F.col("t").isNotNull()).select(*BLOCK, "t").distinct().withColumn("bk", bk)
    ad = a.where(there & F.col("u").isNotNull()).groupBy(*BLOCK, "u").agg(F.min(F.struct("ann_order", "emotion")).alias("first"))
    ad = ad.select(*BLOCK, "u", "first.ann_order", "first.emotion").withColumn("bk", bk)
    td, ad = stored(td, "align-turns"), stored(ad, "align-annotations")
    blocks = bounded_broadcast(stored(td.select(*BLOCK).distinct().join(ad.select(*BLOCK).distinct(), BLOCK), "align-blocks"))
    td, ad = [x.join(blocks, BLOCK, "left_semi") for x in (td, ad)]
    ours = [F.col(c).alias(f"t_{c}") for c in BLOCK]
    pairs = _candidates(_texts(td, ad), gram, window)
    met = pairs.join(td.select("bk", F.xxhash64("t").alias("tid"), *ours, "t"), ["bk", "tid"]) \
        .join(ad.select("bk", F.xxhash64("u").alias("aid"), *BLOCK, "u", "ann_order", "emotion"), ["bk", "aid"])
    same_block = [F.col(c) == F.col(f"t_{c}") for c in BLOCK]
    holds = F.col("u").contains(F.col("t")) | F.col("t").contains(F.col("u"))
    out = [*BLOCK, "t", "ann_order", "emotion"]
    met = met.where(same_block[0] & same_block[1] & same_block[2] & holds).select(*out)
    # an empty annotation is in every turn, an empty turn in every annotation: the block's first one wins
    first = F.struct("ann_order", "emotion")
    firsts = ad.groupBy(*BLOCK).agg(F.min(first).alias("any"), F.min(F.when(F.length("u") == 0, first)).alias("empty"))
    best = F.when(F.length("t") == 0, F.col("any")).otherwise(F.col("empty"))
    empty = td.join(firsts, BLOCK).withColumn("b", best).where(F.col("b").isNotNull()) \
        .select(*BLOCK, "t", "b.ann_order", "b.emotion")
    best = met.unionByName(empty).groupBy(*BLOCK, "t").agg(F.min_by("emotion", "ann_order").alias("emotion"))
    return t.join(best, BLOCK + ["t"], "left").select("scene_id", "pos", "emotion")


def side_by_side(aligned: dict[str, DataFrame]) -> DataFrame:
    """(scene_id, pos, <corpus>...): the emotion that each corpus gives a turn; corpora are aligned one after the other."""
    out = None
    for name, df in aligned.items():
        one = stored(df.select("scene_id", "pos", F.col("emotion").alias(name)), f"aligned-{name}")
        out = one if out is None else out.join(one, ["scene_id", "pos"])
    return out


def coverage(aligned: dict[str, DataFrame]) -> DataFrame:
    """Labelled turns / all turns per corpus: one aggregate, one row."""
    g = side_by_side(aligned).agg(F.count(F.lit(1)).alias("n_turns"),
                                  *[F.count(name).alias(f"{name}_labelled") for name in aligned])
    return g.withColumns({f"{name}_coverage": F.col(f"{name}_labelled") / F.col("n_turns") for name in aligned})


def labelled_dialogs(aligned: dict[str, DataFrame]) -> DataFrame:
    """Per dialogue and corpus: any turn labelled (empty -> false) and all turns labelled (empty -> true)."""
    cols = []
    for name in aligned:
        there = F.col(name).isNotNull()
        cols += [F.coalesce(F.bool_or(there), F.lit(False)).alias(f"any_{name}"),
                 F.coalesce(F.bool_and(there), F.lit(True)).alias(f"all_{name}")]
    return side_by_side(aligned).groupBy("scene_id").agg(*cols)
