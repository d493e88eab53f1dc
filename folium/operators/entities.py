"""Entity resolution: blocked title pairs, clusters and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators.components import connected_components
from folium.operators.durable import durable

MAX_DIFFERENCE = 1


def accepted_pairs(titles: DataFrame, generic: list[str]) -> DataFrame:
    """(u, v) of titles (id, toks) of which one adds a single token to the other.

    A pair differs by one token, so the shorter set equals the longer one less a token:
    each title is listed under its own set and under each of its sets less one, and the
    join is on equality.  No block of titles is paired with itself."""
    own = F.array_join(F.array_sort("toks"), " ")
    less = F.transform("toks", lambda t: F.array_join(F.array_sort(F.array_remove(F.col("toks"), t)), " "))
    telling = F.size(F.array_except("toks", F.array(*map(F.lit, generic)))) > 0
    none = F.array().cast("array<string>")
    rows = durable(
        titles.where(F.size("toks") >= 2).select(
            "id",
            F.when(telling, own).alias("own"),
            F.concat(F.when(telling, F.array(own)).otherwise(none), F.when(F.size("toks") >= 3, less).otherwise(none)).alias("keys"),
        )
    )
    # Every row hangs on the smallest title of its own set and of each set less one.
    heads = rows.where(F.col("own").isNotNull()).groupBy(F.col("own").alias("k")).agg(F.min("id").alias("u"))
    listed = rows.select(F.col("id").alias("v"), F.explode("keys").alias("k"))
    return heads.join(listed, "k").where("u <> v").select("u", "v").distinct()


def one_token_pairs(sets: DataFrame, generic: list[str]) -> DataFrame:
    """(u, v): all pairs of token sets (id, toks; distinct, sorted) of which v has one token more.

    Joined on the shorter set, which is the longer one less a token; every pair is returned."""
    key = lambda t: F.array_join(t, " ")
    rows = sets.where(F.size("toks") >= 2)
    telling = F.size(F.array_except("toks", F.array(*map(F.lit, generic)))) > 0
    short = rows.where(telling).select(F.col("id").alias("u"), key(F.col("toks")).alias("k"))
    less = F.transform("toks", lambda t: key(F.array_remove(F.col("toks"), t)))
    long = rows.where(F.size("toks") >= 3).select(F.col("id").alias("v"), F.explode(less).alias("k"))
    return short.join(long, "k").select("u", "v")


def verdict(x: Column, y: Column, generic: list[str]) -> Column:
    """What the title rule says of two token sets: accept, or why they are skipped."""
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (
        F.when(F.size(short) < 2, "skip-mono")
        .when(F.size(F.array_except(short, long)) > 0, "skip-no-subset")
        .when(F.size(long) - F.size(short) > MAX_DIFFERENCE, "skip-token-diff")
        .when(F.size(F.array_except(short, F.array(*map(F.lit, generic)))) == 0, "skip-hub-generic")
        .otherwise("accept")
    )


def clusters(titles: DataFrame, generic: list[str]) -> DataFrame:
    """(id, cluster): the smallest id that a title is linked with over accepted pairs."""
    roots = connected_components(accepted_pairs(titles, generic))
    return titles.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))


def with_tokens(rows: DataFrame, title: str) -> DataFrame:
    return rows.withColumn("toks", T.content_tokens(F.col(title)))


def merge_clusters(drafts: DataFrame) -> DataFrame:
    """One row per cluster of drafts (id, cluster, score, body, title, aliases).

    The best (score, body length, title) survives; the others' titles become aliases."""
    best = F.max(F.struct("score", F.char_length("body").alias("n"), "title", "id", "body")).alias("s")
    names = F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("title"), "aliases")))).alias("names")
    rows = drafts.groupBy("cluster").agg(best, names)
    return rows.select("cluster", "s.id", "s.title", "s.body", F.array_sort(F.array_except("names", F.array("s.title"))).alias("aliases"))
