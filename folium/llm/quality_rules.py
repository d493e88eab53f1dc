"""Operator 10: quality rules with thresholds that adapt to language and source.

Base counts come from each whole text by column expressions.  Four ratios of the
rows that pass the base rule go into a mergeable quantile sketch per (language,
source): counts over a fixed grid, so sketches merge by adding counts, give the same
result in any order, and answer a quantile to within one cell.  The three shares of
a text have 1001 cells of a thousandth.  Word length has cells of a tenth of a character
up to 102.3 and from there 512 cells to an octave, without a top.  A group of fewer than
``MIN_GROUP`` rows takes the merged sketch of its language, and a language of
fewer takes that of the corpus.

A row is dropped if a ratio lies beyond median + max(slack, 4 * interquartile range)
of its group, or if its mean word length lies as far below the median.  The slack
keeps a group of equal values from rejecting its first different row.

Defined cases: a null or empty text has no words, so it fails the base rule; null
languages and sources form groups of their own; repeated rows and ids are rows
like any other; texts of any length are read whole; an empty table gives an empty result;
columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import durable

MIN_WORDS = 50
MIN_GROUP = 100
#: Least distance from the group's median, in cells, for each ratio.
SLACK = {"sym": 50, "dup": 300, "rep": 250, "len": 30}
SPREAD = 4
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _removed(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def base_metrics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Counts of each text. No shuffle; arrays live for one row only.

    Three-word windows are hashed and sorted with their positions, so equal windows
    stand together; the words they cover are summed over the sorted positions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), text.alias("_t")
    )
    words = F.filter(F.split("_t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    rows = rows.select(
        "_id",
        "_lang",
        "_source",
        words.alias("_w"),
        lines.alias("_l"),
        _removed(F.col("_t"), SPACES).cast("long").alias("word_chars"),
        (F.char_length("_t") - _removed(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "_id",
        "_lang",
        "_source",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("_n_lines"),
        F.when(
            F.size("_w") > 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")
                    ),
                )
            ),
        ).alias("_s"),
    )
    at = lambda i: F.get("_s", i)["h"]
    found = F.sort_array(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size("_s") - 1),
                lambda i: (at(i) == at(i - 1)) | (at(i) == at(i + 1)),
            ),
            lambda i: F.get("_s", i)["p"],
        )
    )
    covered = F.aggregate(
        found,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long")).drop("_s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    div = lambda a, b: F.call_function("div", a, F.greatest(b, F.lit(1).cast("long")))
    # The ten highest bits: exact below 1024, then to within a 512th.
    length = div(10 * F.col("word_chars"), F.col("n_words"))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(length)) - 10))
    return rows.withColumns(
        {
            "base_failed": failed,
            "_sym": div(1000 * F.col("n_symbols"), F.col("word_chars")),
            "_dup": div(1000 * F.col("n_dup_lines"), F.col("_n_lines")),
            "_rep": div(1000 * F.col("n_repeat_words"), F.col("n_words")),
            "_len": F.call_function("div", length, unit) * unit,
        }
    )


def sketch(metrics: DataFrame) -> DataFrame:
    """Cell counts per (language, source, ratio): about 4000 rows a group, and 512 more
    for each octave of mean word length."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col(f"_{k}").alias("c")) for k in SLACK]))
    return (
        metrics.where(~F.col("base_failed"))
        .select("_lang", "_source", pairs.alias("_x"))
        .groupBy("_lang", "_source", F.col("_x.m").alias("_m"), F.col("_x.c").alias("_c"))
        .agg(F.count("*").alias("_n"))
    )


def quantiles(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row per key: size of the merged sketch and the bounds it gives."""
    merged = cells.groupBy(*keys, "_m", "_c").agg(F.sum("_n").alias("_n"))
    own = Window.partitionBy(*keys, "_m")
    running = own.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("_cum", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(own))
    at = lambda p: F.min(F.when(100 * F.col("_cum") >= p * F.col("_all"), F.col("_c")))
    three = ranked.groupBy(*keys, "_m").agg(
        F.max("_all").alias("_all"), at(25).alias("_q25"), at(50).alias("_q50"), at(75).alias("_q75")
    )
    slack = F.create_map(*[F.lit(x) for k, v in SLACK.items() for x in (k, v)])[F.col("_m")]
    reach = F.greatest(slack, SPREAD * (F.col("_q75") - F.col("_q25")))
    pick = lambda k, x: F.max(F.when(F.col("_m") == k, x))
    return three.groupBy(*keys).agg(
        F.max("_all").alias(f"{prefix}_n"),
        *[pick(k, F.col("_q50") + reach).alias(f"{prefix}_{k}_hi") for k in SLACK],
        pick("len", F.col("_q50") - reach).alias(f"{prefix}_len_lo"),
    )


BOUNDS = [*(f"{k}_hi" for k in SLACK), "len_lo"]


def thresholds(cells: DataFrame) -> DataFrame:
    """Bounds per (language, source), from the smallest level with enough rows."""
    one = F.lit(1).alias("_one")
    levels = quantiles(cells, ["_lang", "_source"], "s")
    langs = quantiles(cells, ["_lang"], "l").withColumnRenamed("_lang", "_lang2")
    corpus = quantiles(cells.withColumn("_one", one), ["_one"], "c").drop("_one")
    # The corpus row is a single row by construction.
    joined = levels.join(langs, F.col("_lang").eqNullSafe(F.col("_lang2"))).crossJoin(F.broadcast(corpus))
    pick = lambda b: (
        F.when(F.col("s_n") >= MIN_GROUP, F.col(f"s_{b}")).when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{b}")).otherwise(F.col(f"c_{b}"))
    )
    return joined.select(F.col("_lang").alias("_lang3"), F.col("_source").alias("_source3"), *[pick(b).alias(f"_{b}") for b in BOUNDS])


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Base counts and the verdict of every row."""
    metrics = durable(base_metrics(docs, id_col, text_col, lang_col, source_col))
    bounds = thresholds(sketch(metrics))
    joined = metrics.join(
        bounds,
        F.col("_lang").eqNullSafe(F.col("_lang3")) & F.col("_source").eqNullSafe(F.col("_source3")),
        "left",
    )
    inside = (F.col("_len") >= F.col("_len_lo")) & (F.col("_len") <= F.col("_len_hi"))
    for k in ("sym", "dup", "rep"):
        inside = inside & (F.col(f"_{k}") <= F.col(f"_{k}_hi"))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
