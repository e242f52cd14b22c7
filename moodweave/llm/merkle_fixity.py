"""WARC fixity audit with Merkle trees over ordered offset ranges.

Records (header and payload) are laid out in archive files at byte offsets.
Every record is hashed; ``fanout`` consecutive records make a leaf range,
``fanout`` consecutive ranges the next level, up to one root per file.  A
record's node also hashes its start and end offset, a range's node the bounds of
its children, so an intact record at another offset is a difference.  Two
replicas are compared by their roots; only the children of mismatching nodes
are compared on the next level, down to the records.

Defined results: a null url or payload counts as empty; rows that are equal in
id, url and payload are one record; an empty table gives an empty layout and
audit; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 16
RECORDS_PER_FILE = 1024


def warc_record(url: Column, payload: Column) -> Column:
    """A WARC response record as text."""
    size = F.octet_length(payload).cast("string")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def record_hashes(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, spot, length, sha): spot orders records and deals them to files; payloads are read once."""
    u, p = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(payload), F.lit(""))
    rec = pages.select(F.col(page_id).alias("page_id"), u.alias("url"), warc_record(u, p).alias("record"))
    rec = rec.select("page_id", "url", F.octet_length("record").cast("bigint").alias("length"),
                     F.sha2("record", 256).alias("sha"))
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "sha")
    return rec.select("page_id", F.sha2(name, 256).alias("spot"), "length", "sha").distinct()


def layout(hashes: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Place records in files: (warc_file, record_no, page_id, start_offset, end_offset, sha).

    Files hold about ``records_per_file`` records whatever the input, because
    the number of files follows the number of records and records are dealt
    out by a hash that is unique per record.
    """
    files = F.lit(max(1, -(-hashes.count() // records_per_file)))
    number = F.conv(F.substring("spot", 1, 12), 16, 10).cast("bigint")
    w = Window.partitionBy("warc_file").orderBy("spot")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = hashes.withColumn("warc_file", F.pmod(number, files).cast("int")) \
        .withColumns({"record_no": (F.row_number().over(w) - 1).cast("bigint"),
                      "end_offset": F.sum("length").over(run)})
    return placed.select("warc_file", "record_no", "page_id", "spot",
                         (F.col("end_offset") - F.col("length")).alias("start_offset"), "end_offset", "sha")


def levels_for(records_per_file: int, fanout: int = FANOUT) -> int:
    n, k = max(2, 2 * records_per_file), 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def node_level(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Parents of (warc_file, node, start_offset, end_offset, sha): hash of the children's bounds and hashes in order."""
    parent = nodes.groupBy("warc_file", F.expr(f"node div {fanout}").alias("parent"))
    kids = F.sort_array(F.collect_list(F.struct("node", "start_offset", "end_offset", "sha")))  # at most ``fanout`` children
    joined = F.concat_ws(",", F.transform(kids, lambda x: F.concat_ws(":", x["node"], x["start_offset"], x["end_offset"], x["sha"])))
    return parent.agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
                      F.sha2(joined, 256).alias("sha")).withColumnRenamed("parent", "node")


def tree(placed: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Node tables from the records (level 0) up to the file roots."""
    leaf = F.sha2(F.concat_ws(":", "start_offset", "end_offset", "sha"), 256)
    out = [placed.select("warc_file", F.col("record_no").alias("node"), "start_offset", "end_offset", leaf.alias("sha"))]
    for _ in range(levels):
        out.append(node_level(out[-1], fanout))
    return out


def mismatches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one replica lacks."""
    side = lambda nodes, name: nodes.select("warc_file", "node", F.col("sha").alias(name))
    both = side(ours, "a").join(side(theirs, "b"), ["warc_file", "node"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def audit(primary: DataFrame, replica: DataFrame, levels: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: (warc_file, record_no, status).

    ``status`` is changed (content or offsets), missing (not in the replica) or extra (only there).
    ``levels`` must reach the file roots; by default it suits files of about
    ``RECORDS_PER_FILE`` records.  Larger files are still compared in full: a
    level that stops short of the root only widens the first comparison.
    """
    levels = levels_for(RECORDS_PER_FILE, fanout) if levels is None else levels
    a, b = tree(primary, levels, fanout), tree(replica, levels, fanout)
    bad = mismatches(a[-1], b[-1])
    for k in range(levels - 1, -1, -1):
        suspects = bad.select("warc_file", F.col("node").alias("parent"))
        below = [t[k].withColumn("parent", F.expr(f"node div {fanout}"))
                 .join(suspects, ["warc_file", "parent"], "left_semi").drop("parent") for t in (a, b)]
        bad = mismatches(*below)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return bad.select("warc_file", F.col("node").alias("record_no"), status.alias("status"))


def read_back(pages: DataFrame, rot: Column, lose: Column, cut: Column, payload: str = "html") -> DataFrame:
    """A damaged replica for drills: rotten payloads lose their first character to '?', cut ones their second half."""
    p = F.coalesce(F.col(payload), F.lit(""))
    half = F.substring(p, F.lit(1), (F.length(p) / 2).cast("int"))
    bad = F.when(rot, F.concat(F.lit("?"), F.substring(p, 2, 2 ** 31 - 1))).when(cut, half).otherwise(p)
    return pages.where(~lose).withColumn(payload, bad)
