"""Every registered training-data query with SQL equals its SQL; the pipeline equals its stages by brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest import SF_SMALL  # noqa: E402
from oracle_harness import compare  # noqa: E402
from test_blob_ledger import brute as secrets  # noqa: E402
from test_hyperminhash import brute as groups  # noqa: E402
from test_rule_ledger import brute as measures  # noqa: E402

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline as P  # noqa: E402
from moodweave.llm import rule_ledger as RL  # noqa: E402
from moodweave.llm.oracle import LLM_ORACLE  # noqa: E402
from moodweave.llm.queries import LLM_QUERIES  # noqa: E402


def test_all_operators_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert {*LLM_QUERIES, "pipeline"} <= set(E.queries())
    assert set(LLM_ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    r = compare(spark, name, SF_SMALL, E.queries(), E.oracle_sql())
    assert r.get("match") and not r.get("type_mismatch"), r


NATIVE = ["op2_rule_ledger", "op3_blob_ledger", "op8_simhash_decon"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), plan


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    names = RL.MEASURES

    def passes(t):
        env = dict(zip(names, measures(t)))
        return not any(eval(c, {}, env) for c in RL.RULES.values())

    docs = [x for x in docs if passes(x[1])]
    kept = {d for d, _, _, k in groups(docs, 5) if k}
    docs = [x for x in docs if x[0] in kept]
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    docs = [x for x in docs if not any(clean(i) in clean(x[1]) for i in items)]

    def masked(t):
        pos, out = 0, []
        for a, _, b, _ in secrets(t):
            if a >= pos:
                out += [t[pos:a], "[SECRET]"]
            pos = max(pos, b)
        return "".join(out) + t[pos:]

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: tok.encode(masked(t), add_special_tokens=False).ids + [1] for d, t in docs}
    got = {}
    for r in sorted(P.run(spark, SF_SMALL).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], b"")
        got[r["doc_id"]] += bytes(r["ids"])
    import numpy as np
    assert {d: np.frombuffer(b, "<u4").tolist() for d, b in got.items()} == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).schema.names == docs.schema.names
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
