"""Model calls, stores, vectors, hubs and other operators against plain results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.operators import durable, evaluate, models, vectors
from folium.operators.components import connected_components
from folium.plans import catalog
from folium.sources import stores


def run(spark, data, name):
    return catalog.queries()[name](spark, data).collect()


def test_anchor_tiers(spark, data):
    want = ["exact", "fuzzy", "semantic", "loose", "none"]
    for r in run(spark, data, "f66_anchor_tiers"):
        assert r.tier == want[r.id % 5] and r.page == (None if r.tier == "none" else 9 if r.tier == "semantic" else 7)


def test_diffs(spark):
    rows = [("a\nb\nc", "a\nx\nc", "n"), ("same", "same", "n"), (None, "new", "n"), ("\n".join(map(str, range(200))), "", "n")]
    df = spark.createDataFrame(rows, "o string, n string, f string").coalesce(1)
    got = [r[0] for r in df.select(evaluate.unified_diff(F.col("o"), F.col("n"), F.col("f"))).collect()]
    assert "-b" in got[0] and "+x" in got[0] and got[0].startswith("--- old/n") and got[1] == "" and "+new" in got[2]
    assert len(got[3].split("\n")) == 61 and got[3].endswith("more lines")


def test_label_sheets(spark):
    rows = [("n", k, f"claim {k}", f"context {k}") for k in range(6)]
    df = spark.createDataFrame(rows, "note string, claim_idx int, claim string, context string")
    shown = stores.label_sheet(df, 7, F.lit(False)).first()["sheet"].split("\n")
    blind = stores.label_sheet(df, 7, F.lit(True)).first()["sheet"]
    assert sorted(shown) == sorted(f"| <!--claim_idx={k}--> | claim {k} | context {k} | |" for k in range(6))
    assert "context" not in blind and shown != sorted(shown)


def test_calls_keep_rows_and_errors(spark):
    def rule(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt[::-1]

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "")], "k int, prompt string")
    got = {r.k: (r.text, r.error) for r in models.called(df, models.Offline(rule), "m").collect()}
    assert got == {1: ("cba", None), 2: (None, "ValueError: no"), 3: ("", None)}
    assert models.called(df.where("k > 9"), models.Offline(rule), "m").collect() == []


def test_command_line_provider(tmp_path):
    program = tmp_path / "p.sh"
    program.write_text('#!/bin/sh\nread line\n[ "$line" = fail ] && { echo "401 bad api key" >&2; exit 1; }\necho "{\\"text\\": \\"$line $1\\", \\"usage\\": {\\"input_tokens\\": 3}}"\n')
    provider = models.CommandLine(["sh", str(program)])
    a = provider.answer("hello\n", "m")
    assert (a.text, a.input_tokens) == ("hello m", 3)
    with pytest.raises(RuntimeError, match="api key"):
        provider.answer("fail\n", "m")


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, int(i % 2), (base[i % 6] + rng.normal(size=8) * 0.3).tolist()) for i in range(60)]
    unit = {i: (r, np.array(v) / np.linalg.norm(v)) for i, r, v in rows}
    df = spark.createDataFrame([(i, r, v.tolist()) for i, (r, v) in unit.items()], "id int, run int, embedding array<double>")
    pairs = [(i, j) for i in unit for j in unit if i < j and unit[i][0] == unit[j][0] and round(float(unit[i][1] @ unit[j][1]), 9) >= 0.8]
    want = {i: sum(i in p for p in pairs) for i in unit}
    for block in (4, 512):
        assert {r.id: r.links for r in vectors.link_counts(df, 0.8, block=block).collect()} == want
        edges = {tuple(sorted((r.u, r.v))) for r in vectors.spanning_links(df, 0.8, block=block).collect()}
        assert edges <= set(pairs)
        full = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
        assert {r.node: r.root for r in connected_components(spark.createDataFrame(sorted(edges), "u int, v int")).collect()} == full


def test_components_of_hubs(spark):
    """Two stars of thousands of leaves, joined by one edge, and a chain: hubs go by broadcast."""
    edges = [(5000, i) for i in range(1, 1500)] + [(9000, i) for i in range(6000, 7500)] + [(1499, 6000)] + [(20_000 + i, 20_001 + i) for i in range(30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: 1 for e in edges[:-30] for n in e if n != 1} | {20_000 + i: 20_000 for i in range(1, 31)}
    assert got == want


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://x"
        _jsc = None

        def getConf(self):
            return {"a": "b"}

    class Empty:
        def isEmpty(self):
            return True

    class Java:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Empty()

    class Session:
        sparkContext = Context()

    Context._jsc = Java()
    with pytest.raises(ValueError, match="checkpoint"):
        durable.shared_dir(Session())


def test_evolved_tables(spark):
    df = spark.createDataFrame([(1, "2")], "a int, b string")
    got = stores.evolved(df, "b int, c string, a long")
    assert got.columns == ["b", "c", "a"] and tuple(got.first()) == (2, None, 1)
