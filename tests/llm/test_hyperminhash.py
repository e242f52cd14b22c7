import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from cases import EDGE, edge_docs, empty_docs, rows  # noqa: E402

from moodweave.llm import hyperminhash as HM  # noqa: E402
from moodweave.llm.graph import components  # noqa: E402


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(docs, width):
    sets = {}
    for d, t in docs:
        sets[d] = shingles(t, width)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def family(rng, size, copies, first_id):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for k in range(copies):
        words = base[:]
        for _ in range(rng.randrange(0, max(2, size // 12))):
            words[rng.randrange(size)] = f"w{rng.randrange(5000)}"
        out.append((first_id + k, " ".join(words)))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for size, copies in ((3, 4), (12, 10), (60, 25), (300, 20), (560, 12), (620, 12), (700, 12), (1500, 8)):
        docs += family(rng, size, copies, len(docs))
    docs += [(len(docs) + k, docs[40][1]) for k in range(30)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for width in (2, 5):
        got = sorted(rows(HM.near_duplicates(df, width=width), "doc_id", "n_shingles", "component_id", "kept"))
        assert got == brute(docs, width)


def test_edge_rows(spark):
    got = HM.near_duplicates(edge_docs(spark), width=2).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    for d in (1, 2, 3):
        assert (by[d]["n_shingles"], by[d]["component_id"], by[d]["kept"]) == (0, d, True)
    assert by[4]["n_shingles"] == 1 and by[5]["n_shingles"] == 1
    assert by[8]["component_id"] == 7 and not by[8]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert sum(r["doc_id"] == 10 and r["kept"] for r in got) == 2  # rows of one id are one document


def test_kept_rows_are_unchanged(spark):
    docs = edge_docs(spark)
    out = HM.keep_first(docs, width=2)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(d) for d, _ in EDGE if d != 8)


def test_empty_table(spark):
    assert rows(HM.near_duplicates(empty_docs(spark))) == []
    assert rows(HM.keep_first(empty_docs(spark))) == []


def test_estimate_is_close_and_collision_corrected():
    rng = np.random.default_rng(5)
    for n, sketch, kind in ((400, HM.small_sketch, 0), (2000, HM.large_sketch, 1)):
        for share in (0.0, 0.5, 0.9):
            errors = []
            for _ in range(20):
                common = rng.integers(0, 2 ** 63, int(n * share), dtype=np.uint64)
                a, b = (np.concatenate((common, rng.integers(0, 2 ** 63, n - len(common), dtype=np.uint64))) for _ in "ab")
                x, y = sketch(a), sketch(b)
                pair = [[x], [y]] if kind == 0 else [[None], [None]]
                large = [[x], [y]] if kind else [[None], [None]]
                obj = lambda v: np.array([*v, None], object)[:-1]
                est = HM.estimate(obj(pair[0]), obj(pair[1]), obj(large[0]), obj(large[1]), np.array([n]), np.array([n]))
                errors.append(est[0] - len(common) / (2 * n - len(common)))
            assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15


def test_overlapping_kinds_cover_every_linkable_pair():
    assert HM.LARGE <= HM.PERCENT / 100 * HM.SMALL
    assert HM.SEEDS * HM.BUCKETS == HM.BANDS * HM.ROWS == HM.REGISTERS


def test_long_chain_components(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, 999), (5000, 1000)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(201)) and got[5000] == got[1000] == got[999] == 999


def test_own_shingles_are_counted_for_each_version_of_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    short, near, long = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(f"v{k}" for k in range(400))
    docs = [(1, short), (1, long), (2, near), (1, short)]
    linker = HM.Linker(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = sorted(rows(linker.sizes(ids), "doc_id", "n", "own"))
    assert got == [(1, 59, 1), (1, 399, 399), (2, 59, 1)]


def test_a_short_version_of_an_id_links_in_a_mixed_bucket(spark, monkeypatch):
    """With no hub round, the bound alone decides on the pair of the short version."""
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "z", *words[k + 1:]]) for k in (5, 30)]
    docs = [(1, " ".join(words)), (1, " ".join(f"v{k}" for k in range(400))), (2, near[0]), (3, near[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = lambda members: members.select(members.doc_id.alias("a"), members.doc_id.alias("b")).limit(0)
    monkeypatch.setattr(HM, "_hub_pairs", none)
    monkeypatch.setattr(HM, "_other_hubs", none)
    assert {r["component_id"] for r in HM.near_duplicates(df, width=2).collect()} == {1}
