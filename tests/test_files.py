from pyspark.sql import functions as F

from folium.operators import render
from folium.sources import files


def test_json_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"agent": "critic", "input_tokens": 5}\nnot json\n{"agent": "x", "cached": true}\n')
    rows = files.json_lines(spark, str(tmp_path / "t.jsonl")).collect()
    assert {(r.agent, r.input_tokens, r.cached) for r in rows} == {("critic", 5, None), ("x", None, True)}


def test_run_logs(spark, tmp_path):
    (tmp_path / "bates_v4.2.log").write_text("1200 words\n-> vault\n-> vault\n→ inbox (score)\n900 words\n")
    [r] = files.routing_counts(files.run_logs(spark, str(tmp_path))).collect()
    assert (r.key, r.version, r.n_vault, r.n_inbox, r.n_merge, r.accept_pct, r.words) == ("bates", "v4.2", 2, 1, 0, 66.7, 900)


def test_notes_and_links(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\ntype: concept\naliases: ["ISP", "Search"]\n---\nintro\n# Alpha\nsee [[Beta|b]] and [[ISP]]\n## Quellen\n[[Gamma]]\n')
    (tmp_path / "sub" / "b.md").write_text("# Beta\nsee [[isp]] and [[nothing]]\n")
    found = files.notes(spark, str(tmp_path))
    of = {r.title: r for r in found.collect()}
    assert set(of) == {"Alpha", "Beta"} and of["Alpha"].aliases == ["ISP", "Search"] and of["Alpha"].meta["type"] == "concept"
    assert of["Alpha"].body.startswith("# Alpha") and "Quellen" not in of["Alpha"].body
    edges = {(r.src[-4:], r.dst[-4:]) for r in files.link_graph(found).collect()}
    assert edges == {("a.md", "b.md"), ("b.md", "a.md")}


def test_label_cells(spark, tmp_path):
    (tmp_path / "l.md").write_text("| <!--claim_idx=0--> s | | |\n| <!--claim_idx=1--> H | | |\n| <!--claim_idx=2--> maybe | |\n| other |\n")
    assert {(r.claim_idx, r.label) for r in files.label_cells(spark, str(tmp_path)).collect()} == {(0, "s"), (1, "h"), (2, None)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "c", 2)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in files.upsert(old, new, "k", "seq").collect()} == {(1, "c"), (2, "b")}


def test_render(spark, tmp_path):
    df = spark.createDataFrame([("T", ["x", 'a"b'], ["One.", "Two.", "Three."], [4, 7, 4])], "t string, g array<string>, s array<string>, p array<int>")
    body = render.footnotes_by_page(F.col("s"), F.col("p"))
    assert df.select(body).first()[0] == "One.[^1] Two.[^2] Three.[^1]\n\n[^1]: S. 4\n[^2]: S. 7"
    made = df.select(render.note(F.col("t"), F.col("g"), body).alias("content"), F.lit("T.md").alias("name"))
    checked = made.select(render.pristine(F.col("content")), render.pristine(F.concat("content", F.lit("edited"))), render.pristine(F.lit("x"))).first()
    assert tuple(checked) == (True, False, False)
    assert df.select(render.strip_anchors(render.page_anchor(F.lit("A."), F.lit(3)))).first()[0] == "A."
    render.write_notes(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
