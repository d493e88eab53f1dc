import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import bpe, lines, mixing, quality_model, simhash
from folium.llm.common import documents
from tests.llm.helpers import AWKWARD, empty, table


def test_stages_against_brute_force(spark, data, tmp_path):
    docs = documents(spark, data)
    known = documents(spark, data, "labels")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], data).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:5]]
    assert all(s.columns == columns for s in steps[:5])

    model = quality_model.train(docs, known)
    score = dict(zip(rows[0], model.score(quality_model.Featuriser(), [r.text for r in rows[0].values()]), strict=True))
    assert set(rows[1]) == {i for i, s in score.items() if s >= 0.5}

    hosts, holds = {}, {}
    for r in rows[1].values():
        hosts[r.source] = hosts.get(r.source, 0) + 1
        for x in {x.strip(" \t\r\x0b\x0c") for x in r.text.split("\n")} - {""}:
            holds[r.source, x] = holds.get((r.source, x), 0) + 1
    bad = {k for k, n in holds.items() if n >= lines.MIN_PAGES and n > lines.RATIO * hosts[k[0]]}
    for i, r in rows[1].items():
        kept = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r\x0b\x0c")) not in bad)
        assert rows[2][i].text == kept and rows[2][i].n_chars == len(kept)

    fps = {i: simhash.fingerprint(r.text) for i, r in rows[2].items()}
    group, todo = {}, dict(fps)
    while todo:
        root = min(todo)
        reach, edge = {root}, [root]
        while edge:
            a = edge.pop()
            new = [b for b in todo if b not in reach and bin(fps[a] ^ fps[b]).count("1") <= simhash.MAX_BITS]
            reach.update(new)
            edge += new
        for b in reach:
            group[b] = root
            todo.pop(b)
    assert set(rows[3]) == set(group.values())

    mixed = steps[4].groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in mixed}
    want = {r.doc_id: r.copies for r in mixing.mix(steps[3], known).collect() if r.copies}
    assert n == want and set(n) == set(rows[3])

    encoder = bpe.Codec(steps[4], size=0).encoder()
    for r in steps[5].collect():
        ids = encoder.encode(rows[4][r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    assert np.isclose(steps[5].count(), steps[4].count())


def test_stages_take_awkward_rows(spark, data):
    """Nulls, empty and long texts, ties, repeats and clashing columns, stage by stage."""
    extra = {c: F.lit(5) for c in ("_h", "_g", "_p", "_n", "_lines", "_kept", "_bad", "_row", "_t", "_line_dedup_text")}
    docs = table(spark).withColumns(extra)
    long = " ".join(f"w{i % 5000} |" for i in range(120_000))
    docs = docs.unionByName(docs.where("doc_id = 1").withColumns({"doc_id": F.lit(70).cast("long"), "text": F.lit(long)}))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        rows = out.collect()
        if name == "bpe_encoding":
            assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
            continue
        assert out.columns == docs.columns
        assert all(r._h == r._p == r._row == r._line_dedup_text == 5 for r in rows)
        if name == "line_dedup":
            assert len(rows) == docs.count() and [r.text for r in rows if r.doc_id == 2] == [None]
        elif name == "simhash_near_dedup":
            assert sum(r.text == AWKWARD[0][1] for r in rows) == 1 and sum(not (r.text or "").strip() for r in rows) == 1
        elif name == "mixing":
            assert {70, 7} <= {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark, data):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), data).collect() == []


def test_near_dedup_keeps_one_row_of_each_group(spark, data):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [
        *[(None, texts["a"], "en", "s")] * 3,  # no ids, equal rows
        (None, texts["b"], "en", "s"), (None, texts["b"], None, "s"), (None, texts["b"], "s", None),
        *[(5, texts["c"], "en", "s")] * 4, (9, texts["c"], "en", "s"), (None, texts["c"], "en", "s"),
        (5, texts["d"], "en", "s"), (2, texts["d"], "en", "s"),  # 5 survives in another group only
        (5, texts["e"], "en", "s"),
    ]
    docs = table(spark, rows)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, data)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text[0]) for r in kept.collect()), key=lambda x: x[1])
    assert got == [(None, "a"), (None, "b"), (5, "c"), (2, "d"), (5, "e")]
