"""Word statistics per class.

Tokens are aggregated, never whole class texts: a class with a third of all
documents is still spread over every task by partial aggregation.  Top-k per
class uses ``row_number() <= k``, which Spark plans with a partial
WindowGroupLimit before the shuffle (at most k rows per map task and class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodweave.functions.text import tfidf_tokens
from moodweave.operators.lexicon import tokens


def class_word_counts(df: DataFrame, label: str, text_col: str, stopwords: DataFrame) -> DataFrame:
    """(label, word, n): non-stop words after blanking punctuation and lower-casing."""
    tok = tokens(df, [label], text_col, repl=" ", stopwords=stopwords, keep_empty=False)
    return tok.groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def class_top_words(counts: DataFrame, label: str, k: int = 21) -> DataFrame:
    """Most frequent words per class; 21 as in the reference loop; ties by word."""
    return top_k(counts, [label], [F.desc("n"), F.asc("word")], k)


def class_tfidf_weights(df: DataFrame, label: str, text_col: str) -> DataFrame:
    """(label, word, tf, df, w): w = tf * (ln((1 + n_classes) / (1 + df)) + 1), one document per class.

    Tokens are counted per class, so words at the border of two texts never
    fuse.  The counts are written once to the shared checkpoint folder: the
    class count, the norms and the ranking all read them, and no text is
    tokenised again.  The document frequency is a window per word (at most one
    row per class in it).  A class without any word counts as a class.
    """
    tok = df.select(label, F.explode_outer(tfidf_tokens(text_col)).alias("word"))
    tf = tok.groupBy(label, "word").agg(F.count("word").alias("tf")).checkpoint()
    n_cls = tf.agg(F.count_distinct(label)).first()[0]
    w = tf.where(F.col("word").isNotNull()).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("word")))
    return w.withColumn("w", F.col("tf") * (F.log(F.lit(n_cls + 1) / (F.col("df") + 1)) + 1))


def class_tfidf_top(df: DataFrame, label: str, text_col: str, k: int = 200) -> DataFrame:
    """Top-k words per class by TF-IDF (l2-normalised per class); ties by word.

    The ranking uses the unnormalised weight (same order within a class); the
    per-class norm is a grouped aggregate joined onto the k rows kept.
    """
    w = class_tfidf_weights(df, label, text_col)
    norm = w.groupBy(label).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    top = top_k(w, [label], [F.desc("w"), F.asc("word")], k)
    return top.join(norm, label).withColumn("tfidf", F.col("w") / F.col("norm"))


def set_difference(top: DataFrame, label: str, a=1, b=0) -> DataFrame:
    """Words in the top list of class a but not b, and the reverse, tagged.

    One grouped pass over the (small) top table: a word listed for exactly one
    of the two classes belongs to that class's difference.
    """
    g = top.where(F.col(label).isin(a, b)).groupBy("word").agg(
        F.count(F.lit(1)).alias("_k"), F.first(label).alias("_cls"))
    return g.where(F.col("_k") == 1).select(
        "word", F.concat(F.col("_cls").cast("string"), F.lit("_only")).alias("direction"))
