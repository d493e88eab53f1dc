"""Rules on drafts and on what scores say of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, phrases of absence, markers of overviews, and generic words.
AUTO_SCORE = 4
ABSENCE = (
    "nicht behandelt|nicht vorkommt|kommt nicht vor|nicht diskutiert|nicht thematisiert|keine erwähnung|behandelt nicht|erwähnt nicht|thematisiert nicht|not discussed"
    "|not covered|not mentioned|not addressed|abwesenheit statt wissen|dokumentiert abwesenheit"
).split("|")
OVERVIEW = r"(?iu)(?<![\p{L}\p{N}_])(modell|begriffsgeschichte|framework|moc|übersicht|atlas|taxonomie)(?![\p{L}\p{N}_])"
GENERIC = (
    "analysis management mean average advantage result approach aspect concept theory issue factor element component feature problem solution area level type form role"
    " ability use need way part point case end set methods models surveys rubrics metrics factors systems concepts aspects results studies issues elements tinnitus"
).split()
GERMANIC = "de da nl af sv no lb fy".split()
EXCLUDED_TYPES = ["literature", "moc", "merge-stub"]
CONFIRMED, UNCERTAIN = (0.85, 0.70), (0.70, 0.50)  # same language, across languages


def label_of_scores(entailment: Column, contradiction: Column) -> Column:
    """The label of a claim by inference scores."""
    return F.when((contradiction >= 0.5) & (entailment < 0.4), "contradiction").when(entailment >= 0.7, "confirmed").when(entailment >= 0.4, "uncertain").otherwise("hallucinated")


def overridden(entailment: Column, contradiction: Column, label: Column) -> Column:
    """A label after a strong inference signal; else it stays."""
    return F.when(contradiction >= 0.3, "hallucinated").when(entailment >= 0.7, "confirmed").otherwise(label)


def anchor_score(fuzzy: Column, semantic: Column, across: Column, original: Column) -> Column:
    """struct(score, label): lexical and semantic parts 0.8 to 0.2; across languages, unless the
    quote is in the original, the semantic part alone with lower thresholds."""
    alone = across & ~original
    s = F.when(alone, semantic).otherwise(0.8 * fuzzy + 0.2 * semantic)
    step = lambda t: F.when(alone, t[1]).otherwise(t[0])
    label = F.when(s >= step(CONFIRMED), "confirmed").when(s >= step(UNCERTAIN), "uncertain").otherwise("hallucinated")
    return F.struct(F.round(s, 3).alias("score"), label.alias("label"))


def confidence(reviewed: Column, citations: Column, contradicted: Column, corroborated: Column, anchors: Column) -> Column:
    """struct(level, reasons): four components, each of which fails with a reason."""
    reasons = F.array_compact(
        F.array(
            F.when(~reviewed, "not peer-reviewed").when(citations < 5, F.concat(F.lit("few citations n="), citations.cast("string"))),
            F.when(contradicted, "contradicts a note"),
            F.when(~corroborated, "no second source"),
            F.when(anchors < 2, F.concat(F.lit("anchors: "), anchors.cast("string"))),
        )
    )
    n = F.size(reasons)
    return F.struct(F.when(n == 0, "high").when(n == 1, "medium").otherwise("low").alias("level"), F.array_join(reasons, "; ").alias("reasons"))


def refine(score: Column, gates: Column, hint: Column, context: Column, *, enabled=True, least=2, auto=AUTO_SCORE, two=True, three_needs_hint=True, on_gates=True) -> Column:
    """struct(attempt, trigger, reason) of a revision under a policy."""
    has = F.coalesce(hint, F.lit("")) != ""
    row = lambda a, t, r: F.struct(F.lit(a).alias("attempt"), F.lit(t).alias("trigger"), F.lit(r).alias("reason"))
    band = (score >= least) & (score < auto)
    return (
        F.when(F.lit(not enabled), row(False, "none", "refine_disabled"))
        .when(~context, row(False, "none", "missing_concept_context"))
        .when(band & (score == 2) & F.lit(not two), row(False, "none", "score2_disabled"))
        .when(band & (score == 3) & F.lit(three_needs_hint) & ~has, row(False, "none", "score3_without_hint"))
        .when(band & ~has, row(False, "none", "missing_revision_hint"))
        .when(band, row(True, "score_band", "score_band"))
        .when((score >= auto) & ~gates & F.lit(on_gates) & has, row(True, "hard_gate_failure", "hard_gate_failure"))
        .otherwise(row(False, "none", "no_trigger"))
    )


def refine_accepted(score: Column, gates: Column, auto: int = AUTO_SCORE) -> Column:
    return gates & (score >= auto)


def routing(action: Column, score: Column, gates: Column, subconcepts: Column, status: Column) -> Column:
    """struct(auto, reason): an unverified edition never, a strong hub always, else gates and score."""
    hub = (action == "hub") & (score >= 4) & (subconcepts >= 2)
    reason = (
        F.when(status == "edition-unverified", "edition unverified")
        .when(~gates & ~hub, "hard gate")
        .when(hub | (score >= AUTO_SCORE), "ok")
        .otherwise(F.concat(F.lit("score "), score.cast("string"), F.lit(f"<{AUTO_SCORE}")))
    )
    return F.struct((reason == "ok").alias("auto"), reason.alias("reason"))


def status_line(action: Column, score: Column, gates: Column, level: Column, decision: Column, flags: Column) -> Column:
    """One line on a draft: score, gates, confidence, where it goes and why."""
    status = F.when(decision["auto"], "[Vault]").otherwise(F.concat(F.lit("[Inbox: "), decision["reason"], F.lit("]")))
    status = F.when(action == "hub", F.concat(F.lit("[MoC] "), status)).otherwise(status)
    head = F.format_string("Score: %d/5 | Hard-Gates: %s | Confidence: %s %s", score.cast("int"), F.when(gates, "OK").otherwise("fail"), level, status)
    return F.concat(head, F.when(F.size(flags) > 0, F.concat(F.lit("\n        Gründe: "), F.array_join(flags, ", "))).otherwise(""))


def is_absence(action: Column, body: Column) -> Column:
    """A draft about what its source does not say; extensions are never."""
    low = F.lower(body)
    hit = F.exists(F.array(*map(F.lit, ABSENCE)), lambda p: F.contains(low, p))
    return (action != "extend") & hit


def is_overview(title: Column) -> Column:
    return title.rlike(OVERVIEW)


def is_specific(name: Column) -> Column:
    """No generic word; several words, a capital, or eight letters and more."""
    t = F.trim(name)
    several = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 2
    return ~F.lower(t).isin(GENERIC) & (several | t.rlike(r"\p{Lu}") | (F.char_length(t) >= 8))


def fits_language(text: Column, detected: Column, main: Column) -> Column:
    """Whether a text may be of the main language; short ones and failed detection pass, and
    Germanic languages stand for German, never for English."""
    short = (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < 2) & (F.char_length(text) < 10)
    kin = detected.isin(GERMANIC)
    return short | detected.isNull() | (detected == main) | F.when(main == "en", ~kin).when(main == "de", kin).otherwise(False)


def present(coverage: Column, cosine: Column, tokens: Column, least: float = 0.5, near: float = 0.5) -> Column:
    """Whether a concept's title occurs in its source: by half of its tokens, or by meaning."""
    return (tokens > 0) & ((coverage >= least) | F.coalesce(cosine >= near, F.lit(False)))


def dedup_eligible(note_type: Column) -> Column:
    """Whether a note may be a duplicate of a concept: literature, hubs and stubs never are."""
    return ~F.coalesce(F.lower(F.trim(note_type)), F.lit("")).isin(EXCLUDED_TYPES)


def source_unresolved(author: Column, year: Column, file_author: Column, file_year: Column, blocked: Column) -> Column:
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).isNotNull()
    return blocked | ~(some(author, file_author) & some(year, file_year))


def edition_unverified(verified: Column, first_page: Column) -> Column:
    """An excerpt (it begins after page 1) whose edition nothing confirms."""
    return ~verified & F.coalesce(first_page > 1, F.lit(False))


def actionable(action: Column, origin: Column) -> Column:
    return (F.coalesce(action, F.lit("")) != "skip") & (F.coalesce(origin, F.lit("")) != "secondary_mention")


def own_version(version: Column) -> Column:
    """Versions of the pipeline that calls no model."""
    return version.rlike("^(extractive-|foss-)")


def proposed_tags(tags: Column, known: Column, most: int = 2) -> Column:
    """The first proposed tags that fit the schema and are not known yet."""
    fit = F.filter(tags, lambda t: t.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*){0,2}$"))
    return F.slice(F.array_except(fit, known), 1, most)


def traffic_light(value: Column) -> Column:
    return F.when(F.isnan(value), "⚪").when(value >= 0.7, "🟢").when(value >= 0.4, "🟡").otherwise("🔴")


def label_cell(cell: Column) -> Column:
    """The verdict of a table cell: s, h or ?, alone beside its index mark."""
    return F.nullif(F.regexp_extract(F.lower(cell), r"^\s*(?:<!--claim_idx=\d+-->)?\s*([sh?])\s*$", 1), F.lit(""))


def is_header(size: Column, mean: Column, text: Column) -> Column:
    """A line well above the mean size, or of a heading's shape."""
    return (size > 1.15 * mean) | F.trim(text).rlike(r"^\d{0,2}\.?\s*[A-Z][A-Za-z\s]{3,60}$")
