import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import rows  # noqa: E402

from moodweave.llm import url_gbt as UG  # noqa: E402

SCHEMA = "page_id long, url string"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    best = None
    for verdict, h, p in UG.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "nothing", "http://", "HTTP://Example.NET/en/1", "http://example.net/en", "https://a.example.net/EN/x",
        "http://x.net", "http://x.net/", "http://notexample.net/en/", "http://sub.example.com/de/a?b#c", "http://example.com/de",
        "http://w.org/fr/", "http://org/fr/x", "ftp://a://b.net/", "http://u:p@Host.ORG:80/fr/q", "http://x.com?y=/de/",
        "http://x.net#/en/", "http://ÄB.net/ä", "x\ny://q.org/fr/\nz"]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://x.net/"), (3, "http://x.net/")], SCHEMA)
    got = UG.judge(pages, UG.Model(None, {}, 0.0)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is None or r["page_id"] == 3 and r["host"]:
            continue
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] == (verdict or "allow")


def test_trees_generalise_to_unseen_hosts(spark):
    good = [f"https://{w}.example.{t}/en/{k}" for k, w in enumerate(["alpha", "beta", "gamma", "delta", "news", "travel"] * 30)
            for t in ("com", "org")]
    bad = [f"http://{a}-{b}.example.{t}/en/{k}" for k, (a, b) in enumerate([("cheap", "pills"), ("casino", "win"),
           ("free", "bets"), ("spam", "farm")] * 30) for t in ("com", "org")]
    urls = spark.createDataFrame(list(enumerate(good + bad)), SCHEMA)
    labels = UG.weak_labels(urls.select("url"))
    assert labels.where("label = 1").select("url").distinct().count() == len(set(bad))
    model = UG.train(labels)
    fresh = spark.createDataFrame([(1, "http://lucky-dice.example.com/en/5"), (2, "https://garden.example.com/en/9"),
                                   (3, None), (4, "nothing")], SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in UG.judge(fresh, model).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    again = UG.train(labels.repartition(5))
    score = lambda m: sorted(rows(UG.judge(urls, m), "page_id", "block_score"))
    assert score(model) == score(again)


def test_one_class_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = UG.train(UG.weak_labels(empty.select("url")))
    assert model.trees is None
    assert rows(UG.judge(empty, model)) == []
