"""File scans and sinks.

Parquet is the native format.  The text formats of the analysed workflows
(CSV, TSV, JSON lines, list-literal columns, one-line label dumps) are read
with explicit schemas -- never inferred -- and written so that newline, tab,
quote, empty string and null all survive a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodweave.functions.text import split_words
from moodweave.sources.order import ORDER, number_rows, place_rows, with_split

# Quoting that keeps '' and null apart.
TEXT_WRITE = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N",
              "emptyValue": '""', "quoteAll": "false"}
TEXT_READ = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N",
             "emptyValue": "", "mode": "FAILFAST"}


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def _escape(df: DataFrame) -> DataFrame:
    """Line breaks inside fields as two characters, so that a file splits at any line end."""
    def one(c):
        out = F.replace(F.col(c), F.lit("\\"), F.lit("\\b"))
        return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return df.withColumns({c: one(c) for c in _strings(df)})


def _unescape(df: DataFrame) -> DataFrame:
    def one(c):
        out = F.replace(F.replace(F.col(c), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
        return F.replace(out, F.lit("\\b"), F.lit("\\"))
    return df.withColumns({c: one(c) for c in _strings(df)})


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             multi_line: bool = False) -> DataFrame:
    """A1 / A2: delimited text with a header and a declared schema.

    ``multi_line`` is for files of other writers that hold raw line breaks in
    quoted fields: such a file cannot be split and is one task.
    """
    r = spark.read.schema(schema).options(**TEXT_READ).option("sep", sep)
    return r.option("multiLine", "true").csv(path) if multi_line else r.csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """TSV of ``write_tsv`` (escaped line breaks, splittable); ``multi_line`` for raw ones."""
    df = read_csv(spark, path, schema, "\t", multi_line)
    return df if multi_line else _unescape(df)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """TSV sink; ``partition_by`` replaces one-file-per-(trait, length, seed, split)."""
    w = _escape(df).write.mode(mode).options(**TEXT_WRITE).option("sep", "\t")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_lexicon(spark: SparkSession, path: str | list[str], scale: int = 1000) -> DataFrame:
    """A3: VAD lexicon TSV (Word, Valence, Arousal, Dominance) -> (word, v, a, d) in 1/scale.

    A word listed twice keeps its later row; of several files, those with the
    greater path are later.  Values keep all their digits: they are scaled as
    decimals, never rounded.
    """
    raw = read_csv(spark, path, "Word string, Valence decimal(20,9), Arousal decimal(20,9), Dominance decimal(20,9)", "\t")
    raw = place_rows(with_split(raw))
    last = raw.groupBy("Word").agg(F.max_by(F.struct("Valence", "Arousal", "Dominance"), F.struct(*ORDER)).alias("x"))

    def milli(c):
        return (F.col(f"x.{c}") * scale).cast("double")

    return last.select(F.col("Word").alias("word"), milli("Valence").alias("v"),
                       milli("Arousal").alias("a"), milli("Dominance").alias("d"))


def decode_literal(col, ddl: str) -> Column:
    """A4: a Python list literal stored as text -> native array (single quotes accepted)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, ddl, {"allowSingleQuotes": "true"})


def first_listed(col) -> Column:
    """First word of the first name of a list literal; a plain name is taken as it is."""
    c = F.col(col) if isinstance(col, str) else col
    listed = F.get(decode_literal(c, "array<string>"), F.lit(0))
    return F.get(split_words(F.when(F.trim(c).startswith("["), listed).otherwise(c)), 0)


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """A5: files whose lines are lists of class ids -> (idx, label), idx within the line.

    For a line per dialogue.  Where one line lists all turns, ``read_label_file``
    reads it in many tasks.  New pipelines keep labels keyed by (scene_id, pos)
    instead (see ``emotion_tag``).
    """
    t = spark.read.text(path)
    return t.select(F.posexplode(decode_literal("value", "array<double>")).alias("idx", "label"))


_NUMBER = r"-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"


def read_label_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A5: the list of class ids that whole files spell out, however long its lines -> (idx, label).

    Records end at commas, so one line of any length is split over many tasks; a record at a line's
    end holds the last label of one list and the first of the next.  Files follow each other by path.
    """
    records = with_split(spark.read.option("lineSep", ",").text(path))
    labels = records.select(F.explode(F.regexp_extract_all("value", F.lit(f"({_NUMBER})"), 1)).alias("label"), "_path", "_start")
    return number_rows(place_rows(labels), "idx").select("idx", F.col("label").cast("double").alias("label"))


def write_label_file(flat: DataFrame, path: str) -> None:
    """A5: (idx, label) as one list over the files of a folder, in path order, each a stretch of it without line ends."""
    n = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat.repartitionByRange(n, "idx").sortWithinPartitions("idx").select(F.col("label").cast("string")) \
        .write.option("lineSep", ",").text(path)


def write_jsonl(df: DataFrame, path: str, cols: list[str], mode: str = "overwrite", partition_by=()) -> None:
    """JSON lines of a narrow projection."""
    w = df.select(*cols, *partition_by).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, label: str | None = None,
               classes=(0, 1), recursive: bool = False) -> DataFrame:
    """JSON lines with a declared schema; the label is checked against the class ids."""
    r = spark.read.schema(schema)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.json(path)
    if label:
        ok = F.col(label).isin(*classes)
        df = df.withColumn(label, F.when(ok, F.col(label)).otherwise(
            F.raise_error(F.concat(F.lit(f"{label} outside {list(classes)}: "), F.col(label).cast("string")))))
    return df


def route_by_file_name(df: DataFrame, routes=("train", "valid", "test"), out: str = "split") -> DataFrame:
    """The split named inside the source file path (first route that matches)."""
    p = F.col("_metadata.file_path")
    expr = None
    for r in routes:
        expr = F.when(p.contains(r), F.lit(r)) if expr is None else expr.when(p.contains(r), F.lit(r))
    return df.withColumn(out, expr)


def append_results(df: DataFrame, path: str) -> None:
    """A10: results are appended to a table instead of printed lists."""
    df.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commit_results(df: DataFrame, path: str, run: str = "run") -> None:
    """A10: results of runs, each of which is in the table once however often it is committed.

    Rows of runs that the table already has are left out, by an anti-join with its run names; the rest
    replaces the partition of its run.  The files of a job that failed half-way are never visible, and a
    repeat of it writes the same partitions again.  Null run names are kept under Spark's default partition.
    """
    spark = df.sparkSession
    new = df
    if _exists(spark, path):
        done = read_results(spark, path, df.schema).select(F.col(run).alias("_run")).distinct()
        new = df.join(done, F.col(run).eqNullSafe(F.col("_run")), "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The result table with its declared types (run names that look like numbers stay strings)."""
    return spark.read.schema(schema).parquet(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """An intermediate table is a temp view, not a file written and deleted."""
    df.createOrReplaceTempView(name)
    return df
