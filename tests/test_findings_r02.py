"""Cases of the second round's findings."""

from pyspark.sql import functions as F

from folium.functions import text as T
from folium.plans import catalog


def test_long_run_of_names_is_no_stack_overflow(spark):
    names = "Lee, " * 30000
    rows = [(1, names + "S. 12"), (2, names + "and more"), (3, "A text\n> [!quote] said\n" + "> line\n" * 30000 + "after")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert {r.id: r.c for r in df.select("id", T.is_citation(F.col("t")).alias("c")).collect()} == {1: True, 2: False, 3: False}
    assert df.where("id = 3").select(T.without_callouts(F.col("t"))).first()[0] == "A text\nafter"


def test_citations_are_those_of_the_one_expression(spark):
    good = [
        "Bates et al. 1999, Kuhlthau & Belkin 2004, S. 12-14", "Lee S. 3", "LeeS. 3", "S. S. 1", "Lee,S. 4).", "van der Lee 2001a , S.9 – 10", "del Rio und Della S. 1", "Lee et al S. 2",
        "A S. 12 S. 1234", "Lee 2001S. 4", "le S. 4", "laS. 4", "de,la&du S. 5",
    ]
    bad = ["lee S. 3", "Lee und und S. 3", "Lee 201 S. 3", "Lee,, S. 3", "Lee S. 3 and", "S. 3", "delLee S. 3", "20011 S. 3", "Lee S. x", ", S. 3", "deS. 4 S. x", "Lee; S. 3"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    for t, one, two in df.select("t", F.col("t").rlike(T.CITATION), T.is_citation(F.col("t"))).collect():
        assert one == two, t


def test_lexical_search_over_classes_of_titles(spark, data, monkeypatch):
    import math

    from folium.plans import retrieval

    copies = [*["small ring of steel"] * 9, *["large ring"] * 3, "ring small of steel", "blue bolt", "an of", "small blue bolt nut", "nut"]
    rows = [(100 * i if i % 2 else i, t) for i, t in enumerate(copies * 2)]
    monkeypatch.setattr(retrieval, "titles", lambda s, d: spark.createDataFrame(rows, "id long, title string"))
    monkeypatch.setattr(retrieval, "TITLE_BLOCK", 1)
    monkeypatch.setattr(retrieval, "WIDE", 2)
    toks = {i: {w for w in t.split() if len(w) > 2} for i, t in rows}
    toks = {i: t for i, t in toks.items() if t}
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    want = set()
    for q in (i for i in toks if i % 100 == 0):
        scored = [(-round(sum(idf[w] for w in toks[q] & t) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / avg)), 9), c) for c, t in toks.items() if c != q and toks[q] & t]
        want |= {(q, c, k, -s) for k, (s, c) in enumerate(sorted(scored)[:4], 1)}
    assert {tuple(r) for r in retrieval.bm25(spark, data, 4).collect()} == want


def test_title_vector_hashes_its_words_once():
    assert str(T.hashed_vector(F.col("t"))).count("xxhash64") == 1


def test_keys_of_mentions_are_not_broadcast(spark, data, capsys):
    catalog.queries()["j25_cross_mentions"](spark, data).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_free_variant_beyond_a_thousand(spark, tmp_path):
    spark.range(700).select(F.lit("blue bolt").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in catalog.queries()["w35_free_variant"](spark, str(tmp_path)).collect()] == [("blue bolt", "blue bolt-1400")]


def test_coverage_reads_text_and_overview_once(spark):
    from folium.functions import chunks as C

    titles = F.array(*map(F.lit, ["Small Ring", "blue bolt", "red  nut", "of", "steel gear wheel rim"]))
    c = C.coverage(titles, F.col("x"), F.col("y"), T.content_tokens)
    rows = spark.createDataFrame([("a small ring, a blue nut; steel gear wheel rim", "the SMALL\n ring and steel gear wheel")], "x string, y string")
    # Held: small ring, blue bolt and red nut by a half, and the steel gear; of those the overview keeps two.
    assert tuple(rows.select(c.alias("c")).select("c.*").first()) == (5, 4, 2, 2, 1, 1)
    plan = catalog.queries()["a43_overview_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\p{L}\\p{N}_]+") <= 3
