"""Judge answers against the claims they were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.decision import NORMAL_LABELS, decide
from folium.functions.parsing import json_array

RAW = "array<struct<claim_idx:string,label:string,evidence:string,best_page:string>>"


def answers(texts: DataFrame, note: str = "note", text: str = "text") -> DataFrame:
    """(note, pos, claim_idx, label, evidence, best_page) of the JSON arrays in answers."""
    rows = texts.select(F.col(note).alias("note"), F.posexplode(json_array(F.col(text), RAW)).alias("pos", "r"))
    return rows.select("note", "pos", "r.*")


def normalise(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each expected (note, claim_idx, best_page), with flags of what was repaired.

    The first usable answer of a claim counts.  An unknown label and a missing answer are
    parse errors.  Answers that fit no claim only leave a flag on their note."""
    idx = F.expr("try_cast(claim_idx as int)")
    label, page = F.trim(F.coalesce("label", F.lit(""))), F.expr("try_cast(best_page as int)")
    known = label.isin(NORMAL_LABELS)
    typed = raw.select(
        "note",
        "pos",
        idx.alias("claim_idx"),
        F.when(known, label).otherwise("parse_error").alias("label"),
        F.nullif(F.trim("evidence"), F.lit("")).alias("evidence"),
        page.alias("page"),
        F.array_compact(
            F.array(
                F.when(~known, "judge_schema_label_invalid"),
                F.when(F.col("best_page").isNotNull() & page.isNull(), "judge_schema_best_page_invalid"),
            )
        ).alias("flags"),
    )
    first = typed.where("claim_idx is not null").groupBy("note", "claim_idx")
    first = first.agg(F.min_by(F.struct("label", "evidence", "page", "flags"), "pos").alias("a"), F.count("*").alias("n"))
    rows = expected.join(first, ["note", "claim_idx"], "left")
    missing = F.col("a").isNull()
    flags = F.concat(
        F.coalesce("a.flags", F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(missing, "judge_missing_claim"), F.when(F.col("n") > 1, "duplicate_judge_response"))),
    )
    return rows.select(
        "note",
        "claim_idx",
        F.coalesce("a.label", F.lit("parse_error")).alias("label"),
        F.col("a.evidence").alias("evidence"),
        F.when(missing, F.col("best_page")).otherwise(F.col("a.page")).alias("best_page"),
        F.array_sort(flags).alias("flags"),
    )


def strays(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """(note, flag): answers without a usable index, and answers that nobody asked for."""
    rows = raw.withColumn("claim_idx", F.expr("try_cast(claim_idx as int)"))
    none = rows.where("claim_idx is null").select("note", F.lit("judge_schema_claim_idx_invalid").alias("flag"))
    asked = expected.select("note", "claim_idx")
    other = rows.where("claim_idx is not null").join(asked, ["note", "claim_idx"], "left_anti")
    return none.unionByName(other.select("note", F.lit("judge_schema_claim_idx_unexpected").alias("flag"))).distinct()


def score(judged: DataFrame, context: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Decisions of judged claims: (note, claim_idx) joined with cosine and evidence.

    ``context`` has (note, claim_idx, cosine, verified), ``audit`` (note, claim_idx, label)."""
    rows = judged.join(context, ["note", "claim_idx"])
    if audit is None:
        rows = rows.withColumn("audit_label", F.lit(None).cast("string"))
    else:
        rows = rows.join(audit.withColumnRenamed("label", "audit_label"), ["note", "claim_idx"], "left")
    failed = F.col("label") == "parse_error"
    evidence = F.when(~failed & F.col("evidence").isNotNull(), F.col("verified"))
    made = decide(F.col("label"), F.col("audit_label"), F.col("cosine"), evidence, failed)
    return rows.select("note", "claim_idx", made.alias("d"), "flags").select(
        "note", "claim_idx", "d.label", F.array_sort(F.array_union("d.flags", "flags")).alias("flags"), "d.source"
    )
