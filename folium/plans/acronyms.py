"""Plans over acronyms: long forms are built from a row's words and found again."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import acronyms as A
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def named(spark, sf_dir):
    """(p_partkey, short, long, text): a text with ``Long Form (LF)`` or ``LFO (long form of)``."""
    words = F.split("p_name", " ")
    other = F.size(F.filter(words, lambda w: w.rlike("^[a-z]+$"))) == F.size(words)
    long = F.when(other, F.concat_ws(" ", F.lit("Old"), "p_name", F.lower("p_type"))).otherwise(F.concat_ws(" ", F.lit("Old"), "p_name"))
    short = F.array_join(F.transform(F.split(long, " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("We found "), short, F.lit(" ("), long, F.lit(") at home (2017).")))
    text = text.otherwise(F.concat(F.lit("Here "), long, F.lit(" ("), short, F.lit(") is meant (see x).")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", long.alias("long"), short.alias("short"), text.alias("text"))
    return rows


_NAMED = """n AS (SELECT p_partkey, p_size, CASE WHEN regexp_full_match(replace(p_name, ' ', ''), '[a-z]+') THEN 'Old ' || p_name || ' ' || lower(p_type) ELSE 'Old ' || p_name END AS long FROM part),
named AS (SELECT *, array_to_string(list_transform(string_split(long, ' '), lambda w: upper(w[1])), '') AS short FROM n)"""


@query("a53_acronym_pairs", f"WITH {_NAMED} SELECT p_partkey, short, long FROM named")
def acronym_pairs(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", F.explode(A.pairs_column(F.col("text"))).alias("short", "long"))


@query("f61_letter_match", f"WITH {_NAMED} SELECT p_partkey, p_partkey % 2 = 0 AS ok FROM named")
def letter_match(spark, sf_dir):
    """The short form with and without a letter that its long form lacks."""
    short = F.concat("short", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("9"))
    return named(spark, sf_dir).select("p_partkey", A.match_column(short, F.col("long")).alias("ok"))


@query("f62_long_form", f"WITH {_NAMED} SELECT p_partkey, long FROM named")
def long_form(spark, sf_dir):
    before = F.concat(F.lit("What we call the "), "long")
    return named(spark, sf_dir).select("p_partkey", A.trim_column(before, F.col("short")).alias("long"))


@query("f63_expansion", f"WITH {_NAMED} SELECT p_partkey, 'X' || short || 'X, ' || short || ' (so) and ' || short || ' (' || long || '), then ' || short || '.' AS text FROM named")
def expansion(spark, sf_dir):
    """The first bare occurrence is expanded; a second pass changes nothing."""
    body = F.concat(F.lit("X"), "short", F.lit("X, "), "short", F.lit(" (so) and "), "short", F.lit(", then "), "short", F.lit("."))
    pairs = F.create_map("short", "long")
    rows = named(spark, sf_dir).select("p_partkey", pairs.alias("m"), body.alias("b"))
    return rows.select("p_partkey", A.expand(A.expand(F.col("b"), F.col("m")), F.col("m")).alias("text"))


@query("p48_resolved", f"WITH {_NAMED} SELECT p_partkey, p_partkey % 3 <> 1 AS resolved FROM named")
def already_resolved(spark, sf_dir):
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("so "), F.upper("long"))).when(F.col("p_partkey") % 3 == 1, F.col("short")).otherwise(F.col("long"))
    return named(spark, sf_dir).select("p_partkey", A.resolved(body, F.col("long")).alias("resolved"))


@query("f64_unresolved", f"""WITH {_NAMED} SELECT p_partkey, 'Q' || short AS acronym, right(repeat('ab ', 40) || 'USA and ' || short || ' or ', 100) || 'Q' || short || left(' or Q' || short || ' UND ZZ (zeta) end', 100) AS context FROM named""")
def unresolved(spark, sf_dir):
    """Known and common ones, and those before a parenthesis, are no candidates."""
    q = F.concat(F.lit("Q"), "short")
    body = F.concat(F.repeat(F.lit("ab "), F.lit(40)), F.lit("USA and "), "short", F.lit(" or "), q, F.lit(" or "), q, F.lit(" UND ZZ (zeta) end"))
    rows = named(spark, sf_dir).select("p_partkey", "short", body.alias("body"))
    return A.unresolved(rows.withColumn("known", F.array("short")), "p_partkey", "body", F.col("known"))
