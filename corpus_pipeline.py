"""A training-data pipeline over ``documents``.

Each stage gets the rows that its predecessor kept, with the columns of
``documents``, and its result is written as Parquet and read again, so a lost
executor never replays an earlier stage.  The last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodweave.llm import blob_ledger, dp_packing, hyperminhash, rule_ledger, simhash_decon
from moodweave.llm.common import table
from moodweave.session import scratch_path

# Words that a worker of the packing stage remembers: its executor's heap has grown in the stages before.
REMEMBERED_WORDS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return rule_ledger.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return hyperminhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return simhash_decon.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` brought in line."""
    masked = blob_ledger.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    import public_tokenizers

    return dp_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED_WORDS)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", packing)]

# The packing stage needs a tokenizer, which SQL lacks; tests compare run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
