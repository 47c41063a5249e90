"""Audits: what the texts of hits say, searched once."""

from __future__ import annotations

from tickloom.functions.text import FINDING_WORDS
from tickloom.plans.audit_queries import audits
from tickloom.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_audits_search_the_texts_once(spark):
    a = audits(spark, SF)
    hits = {r.doc_id: r for r in A.search_hits(spark, SF).select("doc_id", "name", "title", "snippet").collect()}
    got = {r.doc_id: r.findings for r in a.collect()}
    told = {d: f"{r.title} {r.snippet}" for d, r in hits.items()}
    assert got == {d: [k for k, words in FINDING_WORDS.items() if hits[d].name in t and any(w in t for w in words)] for d, t in told.items()}
    assert any(got.values()) and not all(got.values())
    assert all(r.title == r.snippet.split("\n")[0] for r in hits.values())
    # a condition on audits is asked of what is written, not of the texts again
    plan = a.where("verdict = 'fail' OR size(findings) > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "snippet" not in plan and "Join" not in plan and "text" not in plan
