"""Helpers that keep plans safe at cluster scale.

* ``bounded_broadcast`` broadcasts a side only after proving its rows and bytes
  are under a bound; otherwise the side stays a normal (shuffled) join input.
* ``global_rank`` and ``prefix_sum`` number and sum rows in a total order without a single-partition
  window: range partitioning, per-partition counts, offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodweave.session import freed_shuffles, scratch_path

# A dimension table that may be broadcast (a VAD lexicon has ~20k rows, ~1 MB).
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def settle(df: DataFrame, name: str) -> DataFrame:
    """The same frame with column ``name`` computed once per row.

    A filter on a computed column is otherwise rewritten to the column's
    expression and pushed below it, which computes it again for every mention.
    Filters on the output of a generator stay above it.
    """
    return df.withColumn(name, F.explode_outer(F.array(F.col(name))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table under the shared folder, read again: computed once, its shuffles freed."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` is counted to have at most so many rows and bytes (reads at most max_rows + 1 rows)."""
    size = F.octet_length(F.to_json(F.struct("*")))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint only when rows and bytes are proven small.

    Driver-local literal tables (``isLocal``) already live on the driver and
    are bounded by construction; anything else is measured.
    """
    return F.broadcast(df) if df.isLocal() or is_small(df) else df


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "rank",
                partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Attach 1-based row numbers in the total order ``order_cols``.

    The order must be total (add a unique tie-break column).  Rows are range
    partitioned on the order, so every partition holds a contiguous, balanced
    slice; each partition is numbered locally and shifted by the row count of
    all earlier partitions (a table with one row per partition).  The range
    partitioning is checkpointed so recomputation after an executor loss sees
    the same partition boundaries.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols)
    if checkpoint:
        ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    # offsets has one row per partition: bounded by the partition count.
    out = local.join(F.broadcast(offsets), "_pid")
    return out.withColumn(rank_col, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")) \
        .drop("_pid", "_local", "_off")


def dense_index(df: DataFrame, col: str, out: str = "index") -> DataFrame:
    """0-based index of each distinct non-null value of ``col`` in ascending order."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    r = global_rank(d, [col], "_rk")
    return r.select(col, (F.col("_rk") - 1).cast("int").alias(out))


def prefix_sum(df: DataFrame, order_cols: list, value_col: str, out: str = "start") -> DataFrame:
    """Exclusive running sum of ``value_col`` in the total order ``order_cols``.

    Rows are range partitioned on the order (by rank, so sparse and dense keys
    spread alike), summed per partition, and shifted by the totals of all
    earlier partitions -- a table with one row per partition.  The range
    partitioning is checkpointed, so a recomputation after an executor loss
    sees the same boundaries.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).checkpoint().withColumn("_pid", F.spark_partition_id())
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_t")) \
        .select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_in", F.coalesce(F.sum(value_col).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_pid", "_in", "_off")
