import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from moodweave.llm import merkle_fixity as MF  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def placed(spark, n=300, per_file=64):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * (k % 50)) for k in range(n)], SCHEMA)
    return MF.layout(MF.record_hashes(pages), per_file).cache()


def test_offsets_are_gapless_and_lengths_true(spark):
    p = placed(spark).collect()
    files = {}
    for r in p:
        files.setdefault(r["warc_file"], []).append(r)
    assert len(p) == 300 and len(files) == 5
    for rs in files.values():
        at = 0
        for k, r in enumerate(sorted(rs, key=lambda r: r["record_no"])):
            assert r["record_no"] == k and r["start_offset"] == at
            at = r["end_offset"]
            header = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{r['page_id']}\r\nContent-Length: "
            size = r["page_id"] % 50
            assert at - r["start_offset"] == len(header) + len(str(size)) + 4 + size + 4


def test_audit_finds_exactly_the_damage(spark):
    p = placed(spark)
    bad = p.withColumn("sha", F.when(F.col("page_id").isin(5, 77), F.lit("rot")).otherwise(F.col("sha"))) \
        .where("page_id <> 123") \
        .unionByName(p.where("page_id = 9").withColumn("record_no", F.lit(5000).cast("long")))
    at = {r["page_id"]: (r["warc_file"], r["record_no"]) for r in p.collect()}
    got = {(r["warc_file"], r["record_no"]): r["status"] for r in MF.audit(p, bad, levels=2).collect()}
    assert got == {at[5]: "changed", at[77]: "changed", at[123]: "missing", (at[9][0], 5000): "extra"}
    assert rows(MF.audit(p, p)) == []


def test_matching_branches_are_not_descended(spark):
    p = placed(spark)
    bad = p.withColumn("sha", F.when(F.col("page_id") == 5, F.lit("rot")).otherwise(F.col("sha")))
    a, b = MF.tree(p, 2), MF.tree(bad, 2)
    for k, most in ((2, 1), (1, 1), (0, 1)):
        assert MF.mismatches(a[k], b[k]).count() == most


def test_nulls_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "é"), (2, "u", "long " * 50000)], SCHEMA)
    p = MF.layout(MF.record_hashes(pages))
    assert sorted(str(r["page_id"]) for r in p.collect()) == ["1", "2", "None"]
    empty = MF.layout(MF.record_hashes(pages.limit(0)))
    assert rows(empty) == [] and rows(MF.audit(empty, empty)) == []
    assert {r["status"] for r in MF.audit(p, empty.select(p.columns)).collect()} == {"missing"}


def test_intact_records_at_other_offsets_are_changed(spark):
    p = placed(spark)
    late = (F.col("warc_file") == 2) & (F.col("record_no") >= 20)
    shift = lambda c: (F.col(c) + F.when(late, 7).otherwise(0)).cast("long")
    moved = p.withColumns({"start_offset": shift("start_offset"), "end_offset": shift("end_offset")})
    got = {(r["warc_file"], r["record_no"], r["status"]) for r in MF.audit(p, moved, levels=2).collect()}
    want = {(r["warc_file"], r["record_no"], "changed") for r in p.where(late).collect()}
    assert want and got == want
