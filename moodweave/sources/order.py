"""Row numbers in file order, for files whose rows are known by their place alone.

The order is (file path, start of the split, place in the split).  Places are
counted as rows stream out of a split, so nothing is shuffled or sorted; the
sizes of the splits (one row each) are summed up in order and joined back.
Reading the same files with other split sizes gives the same numbers.

    placed = place_rows(with_split(spark.read.csv(...)))
    numbered = number_rows(placed)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from moodweave.plans.scale import bounded_broadcast, prefix_sum

PATH, START, PLACE = "_path", "_start", "_place"
ORDER = [PATH, START, PLACE]


def with_split(scan: DataFrame) -> DataFrame:
    """The scan with the file and the start of the split of each row; rows may be filtered or exploded afterwards."""
    return scan.select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(START))


def place_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_split``, without a shuffle in between, with their 0-based place in the split."""
    schema = StructType([*rows.schema.fields, StructField(PLACE, LongType(), False)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            places = []
            for key in zip(batch.column(PATH).to_pylist(), batch.column(START).to_pylist()):
                split, at = key, at + 1 if key == split else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, PLACE])

    return rows.mapInArrow(count, schema)


def number_rows(placed: DataFrame, out: str = "row_no") -> DataFrame:
    """0-based numbers over all files in path order."""
    sizes = placed.groupBy(PATH, START).agg((F.max(PLACE) + 1).alias("_rows"))
    offsets = prefix_sum(sizes, [PATH, START], "_rows", "_before").select(PATH, START, "_before")   # one row per split
    return placed.join(bounded_broadcast(offsets), [PATH, START]) \
        .withColumn(out, F.col("_before") + F.col(PLACE)).drop("_before", *ORDER)


def attach_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of the scan ``right`` beside those of the scan ``left``, row for row.

    Rows of ``left`` beyond the end of ``right`` get nulls, rows of ``right`` beyond the end of ``left``
    are left out, as when a column is assigned to a table.
    """
    numbered = [number_rows(place_rows(with_split(x)), "_row") for x in (left, right)]
    return numbered[0].join(numbered[1], "_row", "left").drop("_row")
