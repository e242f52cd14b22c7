"""Per-trait baseline classifier (I7) over input modes (I9), with model selection.

The neural classifiers are not rebuilt; this is the tabular shell around them:
for every input mode, trait and seed, train on the train split, pick the
setting with the best validation F1 (strictly greater wins, grid order breaks
ties), score the test split.  The model is multinomial naive Bayes, whose
scores are closed forms over word counts: counting and scoring are joins and
grouped sums for all modes, traits and seeds at once, over the whole
vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave.functions.text import tfidf_tokens
from moodweave.operators import dialog as D
from moodweave.operators.evaluate import binary_metrics
from moodweave.plans.scale import stored

ALPHAS = (0.1, 1.0, 10.0)
CELL = ["mode", "trait", "seed"]
SAMPLE = ["scene_id", "character"]
FEW_ROWS = 100_000              # of some numbers for every (trait, seed): broadcast up to here
MODES = ("speaker", "speaker_context", "dialog", "features")


def input_counts(mode: str, turns: DataFrame, characters: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(scene_id, character, word, tf) that an input mode feeds to the classifier.

    ``speaker``: words of the own turns; ``speaker_context``: those and the
    others' words, marked apart; ``dialog``: all words of the dialogue;
    ``features``: the emotions of the own turns (first-word mask).
    """
    def bag(texts, col, mark=""):
        word = texts.select(*SAMPLE, F.explode(tfidf_tokens(col)).alias("word"))
        return word.groupBy(*SAMPLE, F.concat(F.lit(mark), F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("tf"))

    if mode == "speaker":
        return bag(D.speaker_text(turns, characters), "utterance")
    if mode == "speaker_context":
        return bag(D.speaker_text(turns, characters), "utterance", "own:") \
            .unionByName(bag(D.context_text(turns, characters), "context", "other:"))
    if mode == "dialog":
        # counted once per dialogue, before the characters join
        word = turns.select("scene_id", F.explode(tfidf_tokens("text")).alias("word"))
        counts = word.groupBy("scene_id", "word").agg(F.count(F.lit(1)).alias("tf"))
        return characters.select(*SAMPLE).join(counts, "scene_id")
    if mode == "features":
        first = D.first_word_exact
        own = tagged.groupBy("scene_id", first("speaker").alias("f"), F.col("emotion").alias("word")) \
            .agg(F.count(F.lit(1)).alias("tf"))
        return characters.select(*SAMPLE, first("character").alias("f")).join(own, ["scene_id", "f"]).drop("f")
    raise ValueError(mode)


def _numbered(splits: DataFrame, cells: list) -> DataFrame:
    """``splits`` with the number ``i`` of a row's (trait, seed) in ``cells``."""
    number = [F.when((F.col("trait") == t) & (F.col("seed") == s), F.lit(k)) for k, (t, s) in enumerate(cells)]
    return splits.withColumn("i", F.coalesce(*number, F.lit(None).cast("int")))


def _truth(splits: DataFrame, cells: list) -> DataFrame:
    """(scene_id, character, m1, m, r): for each cell the train rows of label 1, all train rows, the other rows."""
    train = F.col("split") == "train"

    def per_cell(what):
        return F.array(*[F.count(F.when((F.col("i") == k) & what, 1)).cast("int") for k in range(len(cells))])

    return _numbered(splits, cells).where("scene_id is not null and character is not null").groupBy(*SAMPLE).agg(
        per_cell(train & (F.col("label") == 1)).alias("m1"), per_cell(train).alias("m"),
        per_cell(F.col("split") != "train").alias("r"))


def _word_counts(bags: DataFrame, n_cells: int) -> DataFrame:
    """(mode, word, c): for each cell how often a word is in train rows of label 1 (n1) and in all of them (n)."""
    sums = [F.sum(F.col("tf") * F.get(c, F.lit(k))).alias(f"{c}_{k}") for c in ("m1", "m") for k in range(n_cells)]
    c = F.array(*[F.struct(F.col(f"m1_{k}").alias("n1"), F.col(f"m_{k}").alias("n")) for k in range(n_cells)])
    return bags.where(F.exists("m", lambda n: n > 0)).groupBy("mode", "word").agg(*sums).select("mode", "word", c.alias("c"))


def naive_bayes(bags: DataFrame, splits: DataFrame, alphas=ALPHAS) -> DataFrame:
    """(mode, trait, seed, scene_id, character, label, split, alpha, pred) of the valid and test rows.

    ``bags``: (mode, scene_id, character, word, tf); ``splits``: (scene_id,
    character, trait, seed, label, split).  Words unseen in training are left
    out; a class without training rows is never predicted; ties give 0.

    A bag's row goes through every shuffle once for all cells (trait, seed): a
    sample carries arrays of its places in them, a word arrays of its counts.
    """
    # a handful, as are the modes; without any rows one that matches none
    cells = [tuple(r) for r in splits.select("trait", "seed").distinct().orderBy("trait", "seed").collect()] or [(None, None)]
    truth = stored(_truth(splits, cells).withColumn("sid", F.monotonically_increasing_id()), "bayes-truth")
    few = truth.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    bags = stored(bags.join(F.broadcast(truth) if few else truth.hint("merge"), SAMPLE, "left")
                  .select("mode", "word", "tf", "sid", "m1", "m", "r"), "bayes-bags")
    counts = stored(_word_counts(bags, len(cells)), "bayes-counts")
    total = counts.select("mode", F.posexplode("c").alias("i", "c")).where("c.n > 0")
    totals = total.groupBy("mode", "i").agg(F.sum("c.n1").alias("t1"), F.sum("c.n").alias("t"), F.count(F.lit(1)).alias("v"))
    splits = _numbered(splits, cells)
    docs = splits.where("split = 'train'").groupBy("i").agg(F.sum("label").alias("d1"), F.count(F.lit(1)).alias("d"))
    # of the words of valid and test rows: counts in the cells where the sample is such a row
    places = F.filter(F.transform("r", lambda r, i: F.struct(i.alias("i"), (F.col("tf") * r).alias("tf"), F.get("c", i).alias("c"))),
                      lambda x: (x["tf"] > 0) & (x["c"]["n"] > 0))
    scored = bags.where(F.exists("r", lambda n: n > 0)).select("mode", "word", "tf", "sid", "r")
    if counts.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        met = scored.join(F.broadcast(counts), ["mode", "word"]).select("mode", "sid", places.alias("p"))
    else:
        met = scored.join(counts.hint("merge"), ["mode", "word"]).select("mode", "sid", places.alias("p")).repartition("mode", "sid")
    gains = [F.sum(F.col("x.tf") * F.log((F.col("x.c.n1") + a) / (F.col("x.c.n") - F.col("x.c.n1") + a))).alias(f"g{k}")
             for k, a in enumerate(alphas)]
    seen = met.select("mode", "sid", F.explode("p").alias("x")).groupBy("mode", "sid", F.col("x.i").alias("i")) \
        .agg(F.sum("x.tf").alias("size"), *gains)
    # every sample has a row in every mode, also without a known word
    names = [r["mode"] for r in bags.select("mode").distinct().orderBy("mode").collect()]
    rows = splits.where("split <> 'train'").join(truth.select(*SAMPLE, "sid"), SAMPLE, "left") \
        .withColumn("mode", F.explode(F.array(*[F.lit(m) for m in names]).cast("array<string>")))
    rows = rows.join(seen, ["mode", "sid", "i"], "left").join(F.broadcast(docs), "i", "left") \
        .join(F.broadcast(totals), ["mode", "i"], "left")
    d1, d0 = F.coalesce("d1", F.lit(0)), F.coalesce(F.col("d") - F.col("d1"), F.lit(0))

    def pred(k, a):
        size = F.coalesce("size", F.lit(0))
        norm = F.log((F.col("t1") + F.col("v") * a) / (F.col("t") - F.col("t1") + F.col("v") * a))
        score = F.log(d1 / d0) + F.coalesce(f"g{k}", F.lit(0.0)) - size * F.coalesce(norm, F.lit(0.0))
        return F.when(d1 == 0, 0).when(d0 == 0, 1).otherwise((F.round(score, 9) > 0).cast("int"))

    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), pred(k, a).alias("pred"))
                               for k, a in enumerate(alphas)]))
    return rows.select(*CELL, *SAMPLE, "label", "split", each.alias("x")).select(*CELL, *SAMPLE, "label", "split", "x.*")


def select_and_score(scored: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Test rows of the smoothing with the best validation F1 per cell (grid order breaks ties; first without one)."""
    scored = stored(scored, "bayes-scored")
    order = F.array_position(F.array(*[F.lit(float(a)) for a in alphas]), F.col("alpha"))
    f1 = binary_metrics(scored.where("split = 'valid'"), "label", "pred", [*CELL, "alpha"]).select(*CELL, "alpha", "f1")
    best = f1.groupBy(*CELL).agg(F.max(F.struct(F.round("f1", 9).alias("f"), (-order).alias("o"), "alpha")).alias("b")) \
        .select(*CELL, F.col("b.alpha").alias("best"))
    test = scored.where("split = 'test'").join(best, CELL, "left")
    return test.where(F.col("alpha") == F.coalesce("best", F.lit(float(alphas[0])))).drop("best", "split")


def trait_classifier(turns: DataFrame, characters: DataFrame, splits: DataFrame, tagged: DataFrame | None = None,
                     modes=MODES, alphas=ALPHAS) -> DataFrame:
    """(mode, trait, seed, scene_id, character, label, alpha, pred) of the test rows."""
    bags = None
    for m in modes:
        b = input_counts(m, turns, characters, tagged).withColumn("mode", F.lit(m))
        bags = b if bags is None else bags.unionByName(b)
    return select_and_score(naive_bayes(bags, splits, alphas), alphas)
