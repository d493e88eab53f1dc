"""Operator 7: line deduplication by site-relative frequency.

Per host, a line's frequency is the number of pages that hold it divided by the
host's pages.  Lines above ``RATIO`` that stand on at least ``MIN_PAGES`` pages are boilerplate
and go from every page of that host; two pages, as a line of one page repeats nothing
(the only page of a host would lose its whole text).  ``host_of`` derives the host of a
URL; ``documents`` names it in ``source``.  Lines are compared by 128 bits of hash after
trimming; blank lines are never boilerplate and stay.

Counts are grouped sums of (host, line) pairs, combined before the shuffle, so a hot
host or line costs one row per task.  Few lines survive the threshold: at most
(mean lines per page) / RATIO for a host.  They return to the pages by broadcast while
there are no more than ``BROADCAST_LINES``, else by a join on the host, whose hot
partitions adaptive execution splits.  Texts are never shuffled in the first case.

Defined cases: a null text has no lines and stays null; a null host is a host of its
own; a line repeated on one page counts once; a line at exactly the ratio stays; repeated
rows are pages of their own; texts and lines of any length are read whole; an empty table
gives an empty result; ``dedup_lines`` keeps further columns of any name, ``line_dedup``
ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import durable, fresh

RATIO = 0.1
MIN_PAGES = 2
#: Boilerplate lines (16 bytes each) that may be broadcast; checked before.
BROADCAST_LINES = 100_000
_BLANK = " \t\r\x0b\x0c"
#: Columns that ``dedup_lines`` adds: lines, lines dropped, the remaining text.
ADDED = ("_line_dedup_lines", "_line_dedup_dropped", "_line_dedup_text")


def _key(line: Column) -> Column:
    line = F.btrim(line, F.lit(_BLANK))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, key) of the lines to drop."""
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")).alias("_host"), F.col(text_col).alias("_t"))
    keys = F.array_distinct(
        F.transform(F.filter(_lines(F.col("_t")), lambda x: F.btrim(x, F.lit(_BLANK)) != ""), _key)
    )
    counted = (
        pages.select("_host", F.explode(keys).alias("_k"))
        .groupBy("_host", "_k")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    return counted.join(totals, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages")).select("_host", "_k")


def dedup_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """All rows and columns, then ``ADDED`` (under longer names where the table has these)."""
    added = fresh(docs, *ADDED)
    bad = durable(boilerplate(docs, host_col, text_col, ratio, min_pages))
    by_host = bad.groupBy("_host").agg(F.collect_set("_k").alias("_bad")).withColumnRenamed("_host", "_bad_host")
    if bad.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    host = F.coalesce(F.col("_row")[host_col].cast("string"), F.lit("\0null"))
    row = row.withColumn("_lines", _lines(F.col("_row")[text_col])).join(by_host, host == F.col("_bad_host"), "left")
    kept = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains(F.col("_bad"), _key(x)))
    )
    return row.withColumn("_kept", kept).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns],
        F.coalesce(F.size("_lines"), F.lit(0)).alias(added[0]),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).alias(added[1]),
        F.array_join("_kept", "\n").alias(added[2]),
    )


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a leading www."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, number of lines, lines dropped and the remaining text of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_source"), F.col(text_col).alias("_text"))
    return dedup_lines(rows, "_source", "_text").select(
        F.col("_id").alias(id_col),
        F.col(ADDED[0]).cast("long").alias("n_lines"),
        F.col(ADDED[1]).cast("long").alias("n_dropped"),
        F.col(ADDED[2]).alias("clean_text"),
    )
