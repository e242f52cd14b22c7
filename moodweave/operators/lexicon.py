"""Lexicon scoring: token lookup, VAD means, Big Five mapping."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave import constants as K
from moodweave.functions.text import lexicon_tokens
from moodweave.plans.scale import bounded_broadcast, is_small, settle


def tokens(df: DataFrame, keys: list[str], text_col: str, repl: str = "",
           stopwords: DataFrame | None = None, keep_empty: bool = True) -> DataFrame:
    """One row per token (``word``), keys carried along.

    ``keep_empty`` keeps a null-word row for texts without tokens so that
    later per-key aggregates still see the key.
    """
    gen = F.explode_outer if keep_empty else F.explode
    tok = df.select(*keys, gen(lexicon_tokens(text_col, repl)).alias("word"))
    if stopwords is not None:
        # left_anti keeps the null-word rows (null never matches).
        tok = tok.join(bounded_broadcast(stopwords.select("word")), "word", "left_anti")
    return tok


LOOKUP_MAX_ROWS = 200_000


def lexicon_lookup(lexicon: DataFrame):
    """word -> struct(v, a, d) or null, as a column function; None when the lexicon is not proven small.

    The lexicon becomes one literal: an array of small maps, indexed by a hash
    of the word, so a lookup reads one short map.
    """
    lex = lexicon.select("word", "v", "a", "d").where(F.col("word").isNotNull())
    if not is_small(lex, LOOKUP_MAX_ROWS):
        return None
    rows = lex.collect()
    n = max(1, len(rows) // 8)
    buckets: list[dict] = [{} for _ in range(n)]
    for r in rows:
        buckets[zlib.crc32(r["word"].encode()) % n][r["word"]] = {"v": r["v"], "a": r["a"], "d": r["d"]}
    kind = "struct<" + ", ".join(f"{c}: {t}" for c, t in lex.dtypes[1:]) + ">"
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string, {kind}>>")
    return lambda w: F.try_element_at(F.get(table, F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(n)).cast("int")), w)


def vad_sums(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame,
             repl: str = "", lower: bool = True) -> DataFrame:
    """Per row: keys, n_tokens, n_matched and the summed v / a / d of matched tokens.

    One output row per input row, whatever the keys: with a lexicon proven
    small every row is scored where it is, without any shuffle (also on a
    stream).  A larger lexicon is joined, under a row id that is unique by
    construction.
    """
    kind = dict(lexicon.dtypes)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0).cast(kind[c]).alias(c) for c in "vad"])
    tok = df.select(*keys, F.coalesce(lexicon_tokens(text_col, repl, lower), F.array().cast("array<string>")).alias("_t"))
    look = lexicon_lookup(lexicon)
    if look is not None:
        hit = tok.select(*keys, F.size("_t").cast("bigint").alias("n_tokens"),
                         F.filter(F.transform("_t", look), lambda x: x.isNotNull()).alias("_h"))
        add = lambda acc, x: F.struct((acc["n"] + 1).alias("n"), *[(acc[c] + x[c]).alias(c) for c in "vad"])
        summed = settle(hit.select(*keys, "n_tokens", F.aggregate("_h", zero, add).alias("_s")), "_s")
    else:
        ided = tok.withColumn("_id", F.monotonically_increasing_id())
        words = ided.select(*keys, "_id", F.explode_outer("_t").alias("word")) \
            .join(lexicon.select("word", "v", "a", "d"), "word", "left")
        sums = [F.count("v").alias("n"), *[F.coalesce(F.sum(c), F.lit(0).cast(kind[c])).cast(kind[c]).alias(c) for c in "vad"]]
        summed = words.groupBy(*keys, "_id").agg(F.count("word").alias("n_tokens"), F.struct(*sums).alias("_s"))
    return summed.select(*keys, "n_tokens", F.col("_s.n").alias("n_matched"),
                         *[F.col(f"_s.{c}").alias(f"s{c}") for c in "vad"])


def vad_matched(sums: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Mean over matched words; no match gives (0, 0, 0)."""
    def m(c):
        return F.when(F.col("n_matched") > 0, F.col(c) / F.col("n_matched") / F.lit(scale)) \
            .otherwise(F.lit(0.0))
    return sums.withColumn("v", m("sv")).withColumn("a", m("sa")).withColumn("d", m("sd"))


def vad_all_words(sums: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Mean over all words (misses count as 0); an empty text gives null."""
    def m(c):
        return F.try_divide(F.try_divide(F.col(c), F.col("n_tokens")), F.lit(scale))
    return sums.withColumn("v", m("sv")).withColumn("a", m("sa")).withColumn("d", m("sd"))


def big_five(df: DataFrame, v="v", a="a", d="d", mode: str = "chained") -> DataFrame:
    """VAD -> (A, C, E, O, N).

    ``chained`` reproduces the reference order of assignment: agreeableness
    is overwritten first and C, N, O read the new value in place of arousal.
    ``independent`` reads arousal everywhere.
    """
    # Spark resolves names case-insensitively: arousal 'a' would clash with 'A'.
    df = df.withColumnRenamed(v, "_v").withColumnRenamed(a, "_a").withColumnRenamed(d, "_d")
    V, A, D = F.col("_v"), F.col("_a"), F.col("_d")

    def lin(t, a_term):
        cv, ca, cd = K.BIG_FIVE_COEF[t]
        return F.lit(cv) * V + F.lit(ca) * a_term + F.lit(cd) * D

    e_ = lin("E", A)
    a_ = lin("A", A)
    a_in = a_ if mode == "chained" else A
    return df.select("*", a_.alias("A"), lin("C", a_in).alias("C"), e_.alias("E"),
                     lin("O", a_in).alias("O"), lin("N", a_in).alias("N")).drop("_v", "_a", "_d")


def trait_feature(df: DataFrame, trait_scores: list[str] = ("A", "C", "E", "O", "N")) -> DataFrame:
    """Long (key..., trait, score) with the fused-model scale (x10, N x100)."""
    stack = ", ".join(f"'{t}', {t} * {K.TRAIT_SCALE[t]}" for t in trait_scores)
    keep = [c for c in df.columns if c not in trait_scores]
    return df.selectExpr(*keep, f"stack({len(trait_scores)}, {stack}) as (trait, score)")


def center(df: DataFrame, value: str, by: list[str], out: str = "centered",
           fit_filter=None) -> DataFrame:
    """value minus its mean per ``by`` group.

    ``df`` is computed once: the means and the rows both read the checkpointed values.
    """
    df = df.checkpoint()
    fit = df if fit_filter is None else df.where(fit_filter)
    means = fit.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return df.join(means, by, "left") \
        .withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def class_vad(df: DataFrame, label: str, text_col: str, lexicon: DataFrame,
              stopwords: DataFrame) -> DataFrame:
    """Per class: sum(v)/(total-oov) over non-stop words, with oov and total."""
    tok = tokens(df, [label], text_col, repl=" ", stopwords=stopwords, keep_empty=False)
    lex = bounded_broadcast(lexicon.select("word", "v", "a", "d"))
    j = tok.join(lex, "word", "left")
    g = j.groupBy(label).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("v").alias("matched"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("sv"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("sa"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("sd"))
    return g.select(
        label, "total", (F.col("total") - F.col("matched")).alias("oov"),
        *[F.try_divide(F.col(s), F.col("matched") * F.lit(1000.0)).alias(n)
          for s, n in (("sv", "v"), ("sa", "a"), ("sd", "d"))])
