"""Decision rules for judged claims, as one declarative expression.

The rules run in order: a parse failure and a low cosine are terminal; unverified
evidence downgrades a supporting label; a stricter audit overrides; else the primary
label passes.  Flags of all rules that fired are united, sorted and distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels from the most lenient to the strictest, then the system labels.
NORMAL_LABELS = ["supported_exact", "supported_paraphrase", "partially_supported", "not_in_context", "contradicted"]
SYSTEM_LABELS = ["parse_error", "retrieval_or_parse_uncertain"]
LABELS = NORMAL_LABELS + SYSTEM_LABELS
LOW_COSINE = 0.4
PRESENCE_COSINE = 0.75


def strictness(label: Column) -> Column:
    """Rank of a normal label from 0; null for system labels."""
    found = F.array_position(F.array(*map(F.lit, NORMAL_LABELS)), label)
    return F.when(found > 0, found - 1)


def is_system(label: Column) -> Column:
    return label.isin(SYSTEM_LABELS)


def downgraded(primary: Column, evidence: Column) -> Column:
    """The label after the evidence rule; only an explicit false counts."""
    unverified = F.coalesce(~evidence, F.lit(False))
    return (
        F.when(unverified & (primary == "supported_exact"), "not_in_context")
        .when(unverified & (primary == "supported_paraphrase"), "partially_supported")
        .otherwise(primary)
    )


def decide(primary: Column, audit: Column, cosine: Column, evidence: Column, parse_failed: Column) -> Column:
    """struct(label, flags, source) of a claim."""
    unverified = F.coalesce(~evidence, F.lit(False))
    label = downgraded(primary, evidence)
    evidence_flags = (
        F.when(unverified & (primary == "supported_exact"), F.array(F.lit("evidence_fabricated"), F.lit("evidence_unverified")))
        .when(unverified & (primary == "supported_paraphrase"), F.array(F.lit("evidence_unverified")))
        .otherwise(F.array().cast("array<string>"))
    )
    own_source = F.when(is_system(label), "system").otherwise("primary")
    differs = audit.isNotNull() & (audit != label)
    with_system = differs & (is_system(label) | is_system(audit))
    stricter = differs & (strictness(audit) > strictness(label))
    row = lambda lab, flags, src: F.struct(
        lab.alias("label"), F.array_sort(F.array_distinct(F.concat(evidence_flags, flags))).alias("flags"), src.alias("source")
    )
    terminal = lambda lab, flag: F.struct(
        F.lit(lab).alias("label"), F.array(F.lit(flag)).alias("flags"), F.lit("system").alias("source")
    )
    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    return (
        F.when(parse_failed, terminal("parse_error", "parse_error"))
        .when(cosine < LOW_COSINE, terminal("retrieval_or_parse_uncertain", "retrieval_low_cosine"))
        .when(with_system, row(label, names("audit_disagrees_with_system"), own_source))
        .when(stricter, row(audit, names("audit_overridden", "judge_uneinig"), F.lit("audit_override")))
        .when(differs, row(label, names("audit_disagrees_softer"), F.lit("primary")))
        .otherwise(row(label, names(), own_source))
    )


def valid_input(primary: Column, cosine: Column, evidence: Column, parse_failed: Column) -> Column:
    """Rows that satisfy the input rules; others belong in quarantine."""
    return (
        primary.isin(LABELS)
        & cosine.isNotNull()
        & ~F.isnan(cosine)
        & cosine.between(0.0, 1.0)
        & ~(parse_failed & evidence.isNotNull())
    )


def overrides(audit: Column, label: Column) -> Column:
    """Whether an audit label is stricter than a label; a system label on either side never is."""
    return F.coalesce(strictness(audit) > strictness(label), F.lit(False))


def parse_error_rule(parse_failed: Column) -> Column:
    """The label of the first terminal rule, null where it does not apply."""
    return F.when(parse_failed, "parse_error")


def low_cosine_rule(cosine: Column) -> Column:
    """The label of the second terminal rule, null where it does not apply."""
    return F.when(cosine < LOW_COSINE, "retrieval_or_parse_uncertain")


def default_rule(primary: Column) -> Column:
    """struct(label, source) where no other rule applies."""
    return F.struct(primary.alias("label"), F.when(is_system(primary), "system").otherwise("primary").alias("source"))


def metric_key(label: Column) -> Column:
    """The name under which a label is counted: its own; an unknown label is an error."""
    return F.when(label.isin(LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string"))


AUDIT_SHARE = 0.02


def audited(decided: DataFrame, note: str) -> DataFrame:
    """Rows (note, claim, claim_idx, label, flags, cosine) that an audit looks at, per note."""
    group = Window.partitionBy(note, "label")
    order = F.sha2(F.concat(F.col(note).cast("string"), F.lit("|"), "claim"), 256)
    k, n = F.row_number().over(group.orderBy(order, "claim_idx", "flags")), F.count("*").over(group)
    doubtful = (F.col("cosine") < LOW_COSINE) | F.array_contains("flags", "evidence_unverified")
    rows = decided.withColumns({"_pick": k <= F.greatest(F.lit(1), F.ceil(AUDIT_SHARE * n)), "_doubt": doubtful})
    return rows.where("_pick or _doubt").drop("_pick", "_doubt")


def verdict_of(label: Column) -> Column:
    """A label as a rater's verdict: s for support, h for none, ? for what could not be told."""
    supported = label.isin("supported_exact", "supported_paraphrase", "partially_supported")
    return F.when(supported, "s").when(label.isin("not_in_context", "contradicted"), "h").otherwise("?")
