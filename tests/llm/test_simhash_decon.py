import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import edge_docs, empty_docs, rows  # noqa: E402

from moodweave.llm import simhash_decon as SD  # noqa: E402


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_exact_and_near_leaks_are_found_and_clean_text_is_not(spark):
    rng = random.Random(1)
    items = {k: words(rng, n) for k, n in enumerate((5, 20, 40, 60, 60, 120))}
    docs, want = [], {}
    for k, item in items.items():
        for shift in (0, 7, 300):
            docs.append((len(docs), " ".join(words(rng, shift) + item + words(rng, 50))))
            want[docs[-1][0], k] = shift
    near = items[5][:]
    near[60] = "CHANGED!"                                 # 5 of 116 shingles differ: 111 / 121
    docs.append((100, "Intro.\n" + ", ".join(near).upper() + "."))
    want[100, 5] = 1
    far = items[2][:]
    far[10], far[25] = "x", "y"                           # 26 shared of 46: too far
    docs.append((101, " ".join(far)))
    docs.append((102, " ".join(items[1][:10])))           # shorter than the item
    docs += [(200 + k, " ".join(words(rng, 400))) for k in range(20)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(77, None), (78, ""), (79, "too short an")],
                                  "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = SD.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["start"] for r in got} == want
    assert {r["similarity"] for r in got if r["doc_id"] < 100} == {1.0}
    assert {(r["shared"], r["total"]) for r in got if r["doc_id"] == 100} == {(111, 121)}
    kept = {r["doc_id"] for r in SD.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_cover_the_radius():
    rng = random.Random(2)
    for _ in range(500):
        flips = rng.sample(range(64), SD.RADIUS)
        assert min(sum(f // SD.BLOCK_BITS == b for f in flips) for b in range(SD.BLOCKS)) <= SD.BLOCK_RADIUS


def test_edge_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "same " * 12)], "item_id long, text string")
    docs = edge_docs(spark)
    got = {(r["doc_id"], r["item_id"]) for r in SD.find_leaks(docs, bench).collect()}
    assert got == {(6, 1), (10, 2)}
    out = SD.drop_leaks(docs, bench)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None, 11}
    assert rows(SD.find_leaks(empty_docs(spark), bench)) == []
    assert rows(SD.find_leaks(docs, bench.limit(0))) == []
    assert SD.drop_leaks(docs, bench.limit(0)).count() == docs.count()
