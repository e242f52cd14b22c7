import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import EDGE, edge_docs, empty_docs, rows  # noqa: E402

from moodweave.llm import zstd_quality as ZQ  # noqa: E402
from moodweave.llm.common import crc_mod  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = ZQ.train(docs, labels, usable=crc_mod("doc_id", 3) != 1)
    got = ZQ.score(docs, model).join(labels.where(crc_mod("doc_id", 3) == 1), "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    good = [r for r in got if r["quality"] == 1]
    assert len(got) > 80 and right / len(got) > 0.95
    assert sum(r["score"] >= 0.5 for r in good) / len(good) > 0.97
    assert abs(sum(r["score"] for r in got) / len(got) - sum(r["quality"] for r in got) / len(got)) < 0.05  # calibrated


def test_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(6, 1), (7, 1), (9, 0), (11, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = ZQ.score(docs, ZQ.train(docs, labels)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    one_class = ZQ.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in ZQ.score(docs, one_class).collect()} == {one_class.prior}
    assert ZQ.train(docs, labels.limit(0)).prior == 0.5
    assert rows(ZQ.score(empty_docs(spark), one_class)) == []


def test_training_is_repeatable(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert ZQ.train(docs, labels) == ZQ.train(docs.repartition(7), labels.repartition(5))


def test_a_repeated_id_gives_one_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"version {k % 50}") for k in range(400)] + [(2, "two"), (3, "three"), (4, "four")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(ZQ, "fit", lambda good, bad, n, m: seen.append((good, bad, n, m)))
    ZQ.train(docs, labels)
    ZQ.train(docs.repartition(7), labels)
    good, bad, n, m = seen[0]
    assert len(good) == 2 and len(bad) == 2 and (n, m) == (2, 2) and seen[0] == seen[1]
