"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule.  A policy is a version name and a mask of the
rules it enforces: a document is kept when no enforced bit is set.  Because
the bits are stored, new policies and leave-one-rule-out ablations are bit
operations over the ledger and never read a text again.

Defined results: a null text has no words; an empty or blank text has none
either, so it fails ``few_words``; every input row gives one ledger row,
repeated rows included; extra columns are ignored by ``ledger`` and carried
unchanged by ``keep_documents``, whatever they are called; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodweave.llm.common import gram_hashes, settle, split_words

WINDOW = 5

# Rule name -> condition on the measurements under which it fails.
# The position in this table is the rule's bit; append only.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BASE_RULES = ("few_words", "repeated_words")
# Policy versions.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _measure(df: DataFrame) -> DataFrame:
    """Add the measurement columns to a frame with a ``text`` column (other columns pass through)."""
    text = F.col("text")
    df = df.withColumn("text", F.coalesce(text, F.lit("")))
    df = df.withColumn("words", split_words(text)) \
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
    }).drop("words", "lines")
    df = df.withColumn("grams", gram_hashes("hashes", WINDOW)).drop("hashes")
    # Only documents with a repeated window pay for sorting their windows.
    df = df.withColumn("ordered", F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")
    o = F.col("ordered")
    repeated = F.transform(o, lambda x, i: F.when(
        F.coalesce(x.g == F.get(o, i - 1).g, F.lit(False)) | F.coalesce(x.g == F.get(o, i + 1).g, F.lit(False)), x.i))
    df = df.withColumn("at", F.sort_array(F.filter(repeated, lambda p: p.isNotNull()))).drop("ordered")
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def _ledger(df: DataFrame) -> DataFrame:
    """Other columns, measurements and bits; settled, so filters on them never run the rules again."""
    kept = [c for c in df.columns if c != "text"]
    judged = _measure(df).withColumn("fail_bits", failure_bits())
    all_in_one = judged.select(*kept, F.struct(*MEASURES, "fail_bits").alias("m"))
    return settle(all_in_one, "m").select(*kept, "m.*")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``."""
    out = _ledger(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return out.select("doc_id", *MEASURES, "fail_bits")


def apply_policy(led: DataFrame, version: str, policies: dict = POLICIES) -> DataFrame:
    """Add ``policy`` and ``kept`` (no enforced rule failed)."""
    return led.withColumns({"policy": F.lit(version),
                            "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version]))) == 0})


def ablate(led: DataFrame, policies: dict = POLICIES) -> DataFrame:
    """Per policy and enforced rule: documents the rule rejects, and those that it alone rejects.

    The ledger is first reduced to its distinct bit patterns (at most
    2 ** rules rows, map-side combined), so no policy scans the documents.
    """
    patterns = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    grid = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"),
                              F.lit(mask(rules)).cast("long").alias("mask"),
                              F.lit(1 << names.index(r)).cast("long").alias("bit"))
                     for v, rules in policies.items() for r in rules])
    x = patterns.select("fail_bits", "n", F.explode(grid).alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"))


def keep_documents(docs: DataFrame, version: str = "v2", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns unchanged."""
    judged = _ledger(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    return apply_policy(judged, version).where("kept").select("row.*")
