"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodweave.session import freed_shuffles, scratch_path

# The six ASCII white-space characters; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null ids count as the text 'null')."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(m))


def split_words(text: Column) -> Column:
    """Words of a text as an array; null, empty and blank texts give an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def gram_hashes(hashes: str, width: int) -> Column:
    """64-bit hash of every window of ``width`` consecutive items of the bigint array column ``hashes``.

    The column must already be a plain attribute (not an expression), so that
    it is computed once and only indexed here.
    """
    h = F.col(hashes)
    grams = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
    keep = F.size(h) - (width - 1)
    return F.when(keep > 0, F.slice(grams, F.lit(1), keep)).otherwise(F.array().cast("array<bigint>"))


def proven_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it is counted to hold at most ``max_rows`` rows, else ``df``.

    Callers pass tables of fixed-width rows, so the row bound is a byte bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def settle(df: DataFrame, name: str) -> DataFrame:
    """The same frame with column ``name`` computed once.

    A filter on a computed column is otherwise rewritten to the column's
    expression and pushed below it, so the expression runs again -- per array
    element, when it feeds a higher-order function.  Filters on the output of
    a generator stay above it.
    """
    return df.withColumn(name, F.explode_outer(F.array(F.col(name))))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: computed once, with no lineage behind it."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables under the shared folder that are deleted once nothing reads them any more.

    ``write`` materialises a frame and reads it back; ``drop`` removes tables whose readers
    have been written themselves.  Used as a context, it removes on leaving whatever was
    written and not released with ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` stays: it is part of the result."""
        self.paths.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.pop(id(t), (None,))[0]
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop(*[t for _, t in list(self.paths.values())])
