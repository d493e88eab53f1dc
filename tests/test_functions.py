"""Rules on the representative cases, without tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from folium.functions import decision as D
from folium.functions import stats, text


def decide(spark, rows):
    df = spark.createDataFrame(rows, "p string, a string, c double, e boolean, f boolean")
    row = D.decide(F.col("p"), F.col("a"), F.col("c"), F.col("e"), F.col("f"))
    return [r[0] for r in df.select(row).collect()]


def test_full_grid(spark):
    grid = list(itertools.product(D.LABELS, [None, *D.LABELS], [0.0, 0.399, 0.4, 0.401, 0.75, 1.0], [None, False, True], [False]))
    for given, got in zip(grid, decide(spark, grid), strict=True):
        if given[2] < 0.4:
            assert (got.label, got.source) == ("retrieval_or_parse_uncertain", "system")
        elif given[0] in D.NORMAL_LABELS:
            assert got.label in D.NORMAL_LABELS
        assert list(got.flags) == sorted(set(got.flags))


@pytest.mark.parametrize(
    "given, label, source, flag",
    [
        (("supported_exact", None, 0.8, False, False), "not_in_context", "primary", "evidence_unverified"),
        (("supported_paraphrase", "contradicted", 0.9, True, False), "contradicted", "audit_override", "audit_overridden"),
        (("contradicted", "supported_exact", 0.9, True, False), "contradicted", "primary", "audit_disagrees_softer"),
        (("supported_exact", None, 0.9, None, True), "parse_error", "system", "parse_error"),
    ],
)
def test_cases(spark, given, label, source, flag):
    [got] = decide(spark, [given])
    assert (got.label, got.source) == (label, source) and flag in got.flags


def one(spark, column, *values, ddl):
    return spark.createDataFrame([values], ddl).select(column).first()[0]


def test_rates(spark):
    got = lambda n, d: one(spark, stats.guarded_rate(F.col("n"), F.col("d")), n, d, ddl="n int, d int")
    assert (got(1, 2), got(2, 3), got(0, 0)) == (0.5, 0.667, -1.0)
    w = one(spark, stats.wilson(F.col("n"), F.col("d")), 0, 0, ddl="n int, d int")
    assert (w.lo, w.hi) == (0.0, 0.0)


def test_text(spark):
    of = lambda f, s: one(spark, f(F.col("s")), s, ddl="s string")
    assert of(text.doi, "see doi:10.1000/abc.).") == "10.1000/abc"
    assert of(text.doi, "none") is None
    assert of(text.isbn, "ISBN 978-3-16-148410-0") == "9783161484100"
    assert of(text.sentences, "Das gilt z.B. hier. Dr A. Meier kam. 3.5 Punkte.") == ["Das gilt z.B. hier.", "Dr A. Meier kam.", "3.5 Punkte."]
    assert of(text.title_key, "  Über A-B c! ") == "ber ab c"
    assert [of(text.acronym_shape, s) for s in ("ISP", "fMRT", "Technology", "least", "X")] == [True, True, False, False, False]
    assert [of(text.null_word, s) for s in ("None", " - ", "x")] == [None, None, "x"]
    assert of(text.version_key, "v4.10.2") == [4, 10, 2]
    for bad in ("../pwned", "CON", "bad\x00name", "a/b\\c", "..."):
        stem = of(text.file_stem, bad)
        assert stem and not set(stem) & set('<>:"/\\|?*\0') and stem.upper() not in text.RESERVED_STEMS
