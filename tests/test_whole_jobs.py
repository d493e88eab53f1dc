"""Queries that do the whole job of an operator, against brute force."""

import numpy as np

from folium.plans import catalog
from folium.sources.tables import table


def run(spark, data, name):
    return catalog.queries()[name](spark, data).collect()


def test_search_meets_all_vectors(spark, data, monkeypatch):
    from folium.plans import retrieval

    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, data, "embeddings").collect()}
    want, best = set(), {}
    for q in (i for i in rows if i % 100 == 0):
        top = sorted((-round(float(rows[q] @ v), 9), c) for c, v in rows.items() if c != q)[:5]
        best[q] = -top[0][0]
        want |= {(q, c, k, round(-d, 8)) for k, (d, c) in enumerate(top, 1) if k <= 2 or -d >= best[q] - 0.05}
    assert {(r.q, r.c, r.k, round(r.cosine, 8)) for r in run(spark, data, "j11_claim_retrieval")} == want
    assert {r.q: round(r.best, 8) for r in run(spark, data, "j13_max_cosine")} == {q: round(b, 8) for q, b in best.items()}


def test_audit_takes_all_doubtful_claims(spark, data):
    import hashlib
    import math

    from folium.plans.evaluation import decided

    claims = decided(spark, data).collect()
    want, groups = set(), {}
    for r in claims:
        if r.cosine < 0.4 or "evidence_unverified" in r.flags:
            want.add((r.note, r.claim_idx, r.label))
        groups.setdefault((r.note, r.label), []).append((hashlib.sha256(f"{r.note}|{r.claim}".encode()).hexdigest(), r.claim_idx))
    for (note, label), rows in groups.items():
        for _, k in sorted(rows)[: max(1, math.ceil(0.02 * len(rows)))]:
            want.add((note, k, label))
    assert {tuple(r) for r in run(spark, data, "w23_audit_sample")} == want


def test_lookups_read_all_parts(spark, data):
    parts = table(spark, data, "part").collect()
    names = {}
    for p in parts:
        names.setdefault(p.p_name.lower(), set()).add(p.p_partkey)
    want = {p.p_partkey: p.p_partkey if len(names[p.p_name.lower()]) == 1 else None for p in parts}
    assert {r.p_partkey: r.path for r in run(spark, data, "j1_concept_lookup")} == want
    for r in run(spark, data, "j22_caption_range"):
        assert r.chunk == min((p.p_partkey for p in parts if p.p_size <= r.page <= p.p_size + 3), default=None)
