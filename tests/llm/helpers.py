"""Small tables with the awkward cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _id string, fp long"

AWKWARD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "de", "b"),
    (5, "one two three four five six seven", "en", "a"),
    (5, "one two three four five six seven", "en", "a"),
    (None, "a text without an id", "en", None),
    (7, "word " * 30_000, "en", "b"),
    (8, "é日本😀 " * 50, "fr", "b"),
    (9, "x" * 20_000, "en", "b"),
]


def table(spark, rows=AWKWARD):
    """Rows with further columns whose names clash with those of results."""
    full = [(i, t, g, s, len(t or ""), 0.5, 1, "x", 2) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
