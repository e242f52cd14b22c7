import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import EDGE, CLASH, edge_docs, empty_docs, rows  # noqa: E402

from moodweave.llm import rule_ledger as RL  # noqa: E402


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)))


def test_measures_equal_brute_force(spark):
    got = sorted(rows(RL.ledger(edge_docs(spark)), "doc_id", *RL.MEASURES), key=str)
    assert got == sorted([(d, *brute(t)) for d, t in EDGE], key=str)


def test_bits_follow_the_conditions(spark):
    for r in RL.ledger(edge_docs(spark)).collect():
        env = r.asDict()
        for k, condition in enumerate(RL.RULES.values()):
            assert bool(r["fail_bits"] >> k & 1) == eval(condition, {}, env), (condition, env)


def test_policies_and_ablation_use_only_the_ledger(spark):
    led = RL.ledger(edge_docs(spark)).cache()
    bits = [r["fail_bits"] for r in led.collect()]
    for version, names in RL.POLICIES.items():
        kept = RL.apply_policy(led, version).where("kept").count()
        assert kept == sum(b & RL.mask(names) == 0 for b in bits)
    table = {(r["policy"], r["rule"]): r for r in RL.ablate(led).collect()}
    for version, names in RL.POLICIES.items():
        for name in names:
            r, bit = table[version, name], RL.mask([name])
            assert r["n_docs"] == len(bits)
            assert r["n_only_this_rule"] == sum(b & RL.mask(names) == bit for b in bits)
            assert r["n_failed"] == sum(b & bit != 0 for b in bits)


def test_kept_documents_are_unchanged(spark):
    docs = edge_docs(spark)
    out = RL.keep_documents(docs)
    assert out.columns == docs.columns
    keep = {str(r["doc_id"]) for r in RL.apply_policy(RL.ledger(docs), "v2").where("kept").collect()}
    assert {str(r["doc_id"]) for r in out.collect()} == keep
    assert all(r["fail_bits"] == int(CLASH["fail_bits"]) for r in out.collect())


def test_empty_table(spark):
    assert rows(RL.ledger(empty_docs(spark))) == []
    assert rows(RL.keep_documents(empty_docs(spark))) == []
