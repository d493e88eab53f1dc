"""Plans over model calls, answered by offline rules, so that their results are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import acronyms as A
from folium.functions import parsing as P
from folium.functions import text as T
from folium.operators import judge
from folium.operators import models as M
from folium.plans.registry import Registry
from folium.sources.stores import cache_entries
from folium.sources.tables import table
from folium.streaming import runs as R

QUERIES = Registry()
query = QUERIES.query


def parts(spark, sf_dir, *columns):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *columns)


def upper_or_fail(prompt: str) -> str:
    if prompt.endswith("0"):
        raise ValueError("no")
    return prompt.upper()


@query("x1_cached_calls", """SELECT p_partkey AS id, p_partkey % 3 = 0 AS cached, CASE WHEN p_partkey % 3 = 0 THEN 'held' WHEN p_partkey % 10 > 0 THEN upper(p_name || ' ' || p_partkey) END AS text, p_partkey % 3 > 0 AND p_partkey % 10 = 0 AS failed FROM part""")
def cached_calls(spark, sf_dir):
    """A third of the answers is cached; a failure stays on its row (X1, X2, ST7, ST8)."""
    prompt = F.concat_ws(" ", "p_name", "p_partkey").alias("prompt")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prompt)
    key = T.cache_key(F.lit("ns"), F.lit("m"), F.lit("a"), F.col("prompt"))
    cache = cache_entries(rows.where("id % 3 = 0").select(key.alias("key"), F.lit("held").alias("text"), F.lit(1).cast("long").alias("usage")))
    out = M.ask(rows, M.Offline(upper_or_fail), "m", "a", cache, "ns")
    return out.select("id", "cached", "text", F.col("error").isNotNull().alias("failed"))


@query("st7_bounded_calls", "SELECT p_partkey AS id, upper(p_name) AS text, len(string_split(p_name, ' ')) AS tokens FROM part")
def bounded_calls(spark, sf_dir):
    rows = M.called(parts(spark, sf_dir, F.col("p_name").alias("prompt")), M.Offline(str.upper), "m", at_a_time=2)
    return rows.select("id", "text", F.col("output_tokens").alias("tokens"))


@query("st8_guarded_rows", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'ValueError: no' END AS error FROM part")
def guarded_rows(spark, sf_dir):
    rows = parts(spark, sf_dir, F.col("p_partkey").cast("string").alias("prompt"))
    return M.called(rows, M.Offline(upper_or_fail), "m").select("id", "error")


@query("st9_result_split", "SELECT p_partkey AS id FROM part WHERE p_partkey % 10 > 0")
def result_split(spark, sf_dir):
    rows = parts(spark, sf_dir, F.col("p_partkey").cast("string").alias("prompt"))
    return M.split(M.called(rows, M.Offline(upper_or_fail), "m"))[0].select("id")


@query("x5_pair_dedup", "SELECT p_brand AS \"group\", 'a' || p_partkey AS a, p_name AS b FROM part WHERE length(p_name) % 2 = 0")
def pair_dedup(spark, sf_dir):
    """Pairs are the same, to this stand-in, where the second name has an even length."""

    def rule(prompt: str) -> str:
        lines = (x.split(": ", 1) for x in prompt.split("\n"))
        return "\n".join(f"{k}: {'SAME' if len(p.split(' | ')[1]) % 2 == 0 else 'DIFFERENT'}" for k, p in lines)

    pairs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.concat(F.lit("a"), "p_partkey").alias("a"), F.col("p_name").alias("b"))
    return M.same_pairs(pairs, M.Offline(rule), "m")


@query("x6_judge", "SELECT p_partkey AS note, 1 AS claim_idx, CASE WHEN p_size % 3 = 0 THEN 'parse_error' ELSE 'contradicted' END AS label FROM part")
def judged(spark, sf_dir):
    """Answers as JSON, some with words around it and some unreadable; a second call repairs a part (X6, X19)."""

    def first(prompt: str) -> str:
        size = int(prompt)
        row = '[{"claim_idx": 1, "label": "contradicted", "evidence": "x", "best_page": 2}]'
        return "no answer" if size % 3 == 0 or size % 3 == 1 else f"Here: {row}."

    def second(prompt: str) -> str:
        return '[{"claim_idx": "1", "label": "contradicted"}]' if int(prompt) % 3 == 1 else "still none"

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note"), F.col("p_size").cast("string").alias("prompt"))
    answered = M.called(rows, M.Offline(first), "m")
    parsed = P.json_array(F.col("text"), judge.RAW)
    broken = answered.where(parsed.isNull()).select("note", "prompt")
    repaired = M.called(broken, M.Offline(second), "m")
    texts = answered.where(parsed.isNotNull()).select("note", "text").unionByName(repaired.select("note", "text"))
    asked = rows.select("note", F.lit(1).alias("claim_idx"), F.lit(2).alias("best_page"))
    return judge.normalise(judge.answers(texts), asked).select("note", "claim_idx", "label")


def by_length(a: str, b: str) -> tuple[float, float, float]:
    """A stand-in: the longer the hypothesis, the more it follows; equal lengths fail."""
    if len(a) == len(b):
        raise ValueError
    return (0.9, 0.1, 0.0) if len(b) > len(a) else (0.0, 0.2, 0.8)


_BY_LENGTH = "CASE WHEN length(p_name) = length(p_type) THEN {e} WHEN length(p_type) > length(p_name) THEN {a} ELSE {b} END"


@query("x7_inference", f"SELECT p_partkey AS id, {_BY_LENGTH.format(e='0.0', a='0.9', b='0.0')} AS entailment, {_BY_LENGTH.format(e='1.0', a='0.1', b='0.2')} AS neutral, {_BY_LENGTH.format(e='0.0', a='0.0', b='0.8')} AS contradiction FROM part")
def inference(spark, sf_dir):
    """Scores of pairs (X7, X22); a failure is neutral."""
    s = M.inference(F.col("p_name"), F.col("p_type"), by_length)
    return parts(spark, sf_dir, s.alias("s")).select("id", "s.*")


@query("x22_no_model", "SELECT p_partkey AS id, 0.0 AS entailment, 1.0 AS neutral, 0.0 AS contradiction FROM part")
def no_model(spark, sf_dir):
    return parts(spark, sf_dir, M.inference(F.col("p_name"), F.col("p_type")).alias("s")).select("id", "s.*")


@query("x8_contradictions", "SELECT p_brand AS id, bool_or(p_size >= 15 AND length(p_type) < length(p_name)) AS contradicted FROM part GROUP BY 1")
def contradictions(spark, sf_dir):
    """Excerpts far from the body (a cosine under .3) are not asked about."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("body"), F.col("p_name").alias("excerpt"), (F.col("p_size") / 50.0).alias("cosine"))
    return M.contradicted(pairs, by_length)


@query("x14_long_forms", "SELECT p_partkey AS id, 'AB' AS acronym, 'All Of ' || p_name AS long FROM part WHERE p_size % 2 = 0")
def long_forms(spark, sf_dir):
    def rule(prompt: str) -> str:
        acronym, context = prompt.split("\n", 1)
        return f"Sure.\nLONG_FORM: All Of {context.split('=')[1]}" if acronym == "AB" and "=" in context else "LONG_FORM: UNKNOWN"

    body = F.concat(F.lit("AB and CD are"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("="), "p_name")).otherwise(""))
    notes = parts(spark, sf_dir, body.alias("body"))
    found = A.unresolved(notes.withColumn("known", F.array().cast("array<string>")), "id", "body", F.col("known"))
    return M.long_forms(found.withColumn("at", F.expr("instr(context, acronym)")), M.Offline(rule), "m")


@query("x20_perturbed_claims", "SELECT p_partkey AS id, p_name AS claim, reverse(p_name) AS other FROM part WHERE length(p_name) % 3 > 0")
def perturbed_claims(spark, sf_dir):
    rule = lambda p: p[::-1] if len(p) % 3 else " NONE "
    return M.perturbed(parts(spark, sf_dir, F.col("p_name").alias("claim")), M.Offline(rule), "m")


@query("x10_planner", "SELECT p_partkey AS id, p_name AS title, 'create' AS action FROM part")
def planner(spark, sf_dir):
    rule = lambda p: f"source_title: x\n<!--CONCEPT-->\ntitle: {p}\n<!--END-->"
    rows = M.called(parts(spark, sf_dir, F.col("p_name").alias("prompt")), M.Offline(rule), "m")
    return rows.select("id", F.explode(P.concept_plan(F.col("text"))["concepts"]).alias("c")).select("id", "c.title", "c.action")


@query("x11_background", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN ['is known'] END AS claims FROM part")
def background(spark, sf_dir):
    """Facts for a concept; a failed call leaves none."""

    def rule(prompt: str) -> str:
        upper_or_fail(prompt)
        return f"<!--CONCEPT-->\ntitle: {prompt}\n<!--CLAIMS-->\n- is known\n<!--END-->"

    rows = M.called(parts(spark, sf_dir, F.col("p_partkey").cast("string").alias("prompt")), M.Offline(rule), "m")
    return rows.select("id", F.try_element_at(P.background(F.col("text")), F.col("prompt")).alias("claims"))


@query("x9_extractor", "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'whole.' ELSE 'again whole.' END AS body FROM part")
def extractor(spark, sf_dir):
    """A note per concept; one whose body breaks off is asked for once more (X9, ST10)."""
    note = lambda title, body: f"<!--NOTE-->\ntitle: {title}\n<!--BODY-->\n{body}\n<!--END-->"

    def first(prompt: str) -> str:
        title, size = prompt.split("\n")
        return note(title, "whole." if int(size) % 2 == 0 else "it breaks off in")

    prompts = parts(spark, sf_dir, F.concat_ws("\n", "p_name", F.col("p_size").cast("string")).alias("prompt"))
    got = M.called(prompts, M.Offline(first), "m").withColumn("n", P.one_note(F.col("text"))["note"])
    whole = F.right(F.rtrim("n.body"), F.lit(1)).isin(".", "!", "?", ")", '"', "”", ":")
    again = M.called(got.where(~whole).select("id", "prompt"), M.Offline(lambda p: note(p.split("\n")[0], "again whole.")), "m")
    both = got.where(whole).select("id", "n").unionByName(again.select("id", P.one_note(F.col("text"))["note"].alias("n")))
    return both.select("id", "n.title", "n.body")


def anchored(spark, sf_dir):
    """(id, quote, text, semantic_page, cosine): quotes that occur, nearly occur, mean the same, or are lost."""
    k = F.col("p_partkey") % 5
    line = F.concat(F.lit("The long sentence about "), "p_name", F.lit(" and what is said of it"))
    near = F.concat(F.lit("Thx long sentence about "), "p_name", F.lit(" and what is said of it"))
    far = F.concat(F.lit("Thx lxng sentxnce abxut "), "p_name", F.lit(" xnd what xs said of xt"))
    quote = F.when(k == 0, line).when(k == 1, near).when(k == 2, F.lit("zzzz qqqq zzzz qqqq zzzz qqqq zzzz qqqq")).when(k == 3, far).otherwise(F.lit("yyyy wwww yyyy wwww yyyy wwww"))
    text = F.concat(F.lit("[S. 4]\nBefore.\n[S. 7]\n"), line, F.lit(".\n[S. 9]\nAfter."))
    return parts(spark, sf_dir, quote.alias("quote"), text.alias("text"), F.when(k == 2, 9).alias("semantic_page"), F.when(k == 2, 0.8).otherwise(0.1).alias("cosine"))


@query("f66_anchor_tiers")
def anchor_tiers(spark, sf_dir):
    """Tests hold the tiers (F66, X13)."""
    return M.tiers(anchored(spark, sf_dir)).select("id", "tier", "page")


def run_lines(spark, sf_dir):
    """(run_id, seq, value): output lines of runs, one for each document."""
    k = F.col("n_chars") % 6
    value = (
        F.when(k == 0, F.concat(F.lit("[4.5/7] Background-Extractor: "), "doc_id")).when(k == 1, "  → vault").when(k == 2, F.concat(F.lit("-> inbox (score "), F.col("n_chars") % 5, F.lit(")")))
        .when(k == 3, "→ merge (Old Note)").otherwise(F.concat(F.lit("text "), "doc_id"))
    )
    return table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("seq"), value.alias("value"))


@query("st1_line_events", """SELECT source AS run_id, doc_id AS seq, CASE n_chars % 6 WHEN 0 THEN 'stage' WHEN 1 THEN 'vault' WHEN 2 THEN 'inbox' WHEN 3 THEN 'merge' ELSE 'log' END AS kind, CASE WHEN n_chars % 6 = 0 THEN 4.5 END::DOUBLE AS num FROM documents""")
def line_events(spark, sf_dir):
    return R.parse_lines(run_lines(spark, sf_dir)).select("run_id", "seq", "kind", "num")


@query("st3_markers", "SELECT doc_id AS seq, CASE n_chars % 6 WHEN 1 THEN 'vault' WHEN 2 THEN 'inbox' ELSE 'merge' END AS kind, CASE n_chars % 6 WHEN 2 THEN 'score ' || n_chars % 5 WHEN 3 THEN 'Old Note' END AS detail FROM documents WHERE n_chars % 6 IN (1, 2, 3)")
def markers(spark, sf_dir):
    return R.parse_lines(run_lines(spark, sf_dir)).where("kind in ('vault', 'inbox', 'merge')").select("seq", "kind", "detail")


@query("st2_blocks", """WITH l AS (SELECT source AS run_id, doc_id AS seq, n_chars % 6 >= 4 AS log, sum(CASE WHEN n_chars % 6 < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT run_id, k::BIGINT AS "at", string_agg('text ' || seq, chr(10) ORDER BY seq) AS block FROM l WHERE log GROUP BY run_id, k""")
def final_blocks(spark, sf_dir):
    """Blocks of a run's log, with those that are open at its end."""
    return R.blocks(run_lines(spark, sf_dir))


@query("s51_run_events", "SELECT source AS run_id, count(*) + 1 AS n, 'exited' AS last FROM documents GROUP BY source")
def run_events(spark, sf_dir):
    """Events of a run's output lines; the last is always the exit."""
    rows = R.run_events(run_lines(spark, sf_dir))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.max_by("kind", "place").alias("last"))


@query("st5_single_session", "SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id")
def single_session(spark, sf_dir):
    """Of runs that ask to start at once, the first is admitted."""
    return R.admitted(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id").select("user_id", F.col("event_id").alias("first"))
