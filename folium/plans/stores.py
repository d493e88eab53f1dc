"""Plans over stores: tables, logs, caches, sheets and files, whose contents are made from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import names as N
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources import files as S
from folium.sources import stores as X
from folium.sources.claims import RUNS_SQL, runs
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def parts(spark, sf_dir, *columns):
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


def note_file():
    """A note as a file: frontmatter, text before the heading, body, sources."""
    return F.concat(
        F.lit("---\ntitle: Note of "), "p_name", F.lit("\ntype: '"), "p_type", F.lit("'\naliases: [a "), F.col("p_partkey").cast("string"), F.lit(", b]\nbad line\n---\nbefore\n# Head "), "p_name",
        F.lit("\nBody. See [[a "), (F.col("p_partkey") + 1).cast("string"), F.lit("]].\n## Quellen\nafter\n"),
    )


@query("s14_frontmatter", "SELECT p_partkey, 'Note of ' || p_name AS title, p_type AS type, 3::BIGINT AS n FROM part")
def frontmatter(spark, sf_dir):
    rows = parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", S.frontmatter(note_file()).alias("m"))
    return rows.select("p_partkey", F.col("m")["title"].alias("title"), F.col("m")["type"].alias("type"), F.size("m").cast("long").alias("n"))


@query("s16_note_body", "SELECT p_partkey, '# Head ' || p_name || chr(10) || 'Body. See [[a ' || (p_partkey + 1) || ']].' || chr(10) AS body FROM part")
def note_body(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", S.note_body(note_file()).alias("body"))


@query("s15_vault_concepts", "SELECT key, max(path) AS path FROM (SELECT lower('Head ' || p_name) AS key, 'n' || p_partkey AS path FROM part UNION ALL SELECT 'a ' || p_partkey, 'n' || p_partkey FROM part UNION ALL SELECT 'b', 'n' || p_partkey FROM part) GROUP BY key")
def vault_concepts(spark, sf_dir):
    """Titles and aliases of the notes of a vault; the last path of a key counts."""
    rows = parts(spark, sf_dir, "p_name", "p_type").select(F.concat(F.lit("n"), "p_partkey").alias("path"), note_file().alias("value"))
    return S.concepts(S.note_rows(rows))


@query("s18_strict_json", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INT) AS k FROM events")
def strict_json(spark, sf_dir):
    """Lines that must parse: a bad one fails the query."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"}).alias("p"))
    return rows.select("event_id", "p.k")


def logs(spark, sf_dir):
    """(name, value): log lines of files named by source and version."""
    name = F.concat("source", F.lit("_v"), F.col("doc_id") % 3, F.lit(".1.log"))
    k = F.col("n_chars") % 4
    line = F.when(k == 0, "  → vault").when(k == 1, "-> inbox (score 3)").when(k == 2, "→ merge (x)").otherwise(F.concat("n_chars", F.lit(" words in all")))
    return table(spark, sf_dir, "documents").select(name.alias("name"), line.alias("value"))


@query("s20_run_logs", """WITH l AS (SELECT source AS key, 'v' || (doc_id % 3) || '.1' AS version, n_chars % 4 AS k, n_chars FROM documents)
SELECT key, version, count(*) FILTER (WHERE k = 0) AS n_vault, count(*) FILTER (WHERE k = 1) AS n_inbox, count(*) FILTER (WHERE k = 2) AS n_merge,
  round(100.0 * count(*) FILTER (WHERE k = 0) / nullif(count(*) FILTER (WHERE k < 3), 0), 1) AS accept_pct, min(n_chars) FILTER (WHERE k = 3) AS words FROM l GROUP BY key, version""")
def run_logs(spark, sf_dir):
    return S.routing_counts(S.log_lines(logs(spark, sf_dir)))


@query("f96_log_names", "SELECT DISTINCT source || '_v' || (doc_id % 3) || '.1.log' AS name, source AS key, 'v' || (doc_id % 3) || '.1' AS version FROM documents")
def log_names(spark, sf_dir):
    return S.log_lines(logs(spark, sf_dir).select("name", F.lit("").alias("value"))).select("name", "key", "version").distinct()


@query("s22_table_evolve", "SELECT p_partkey, p_name, NULL::BIGINT AS added, p_size FROM part")
def table_evolve(spark, sf_dir):
    return X.evolved(parts(spark, sf_dir, "p_size", "p_name"), "p_partkey long, p_name string, added long")


@query("s24_eval_rows", "SELECT l_orderkey AS eval_id, max('n' || l_orderkey) AS note_path, max(CASE WHEN l_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END) AS pipeline_version FROM lineitem GROUP BY 1")
def eval_rows(spark, sf_dir):
    """Evaluations replace older ones of their id; old names stand in for new ones."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("eval_id")).distinct()
    old = keys.select("eval_id", F.concat(F.lit("n"), "eval_id").alias("note"), F.lit("v1").alias("version"), F.lit(1).alias("at"))
    new = keys.where("eval_id % 2 = 0").select("eval_id", F.concat(F.lit("n"), "eval_id").alias("note_path"), F.lit("v2").alias("pipeline_version"), F.lit(2).alias("at"))
    return S.upsert(X.eval_rows(old), X.eval_rows(new), "eval_id", "at").select("eval_id", "note_path", "pipeline_version")


@query("s25_extractive_runs", f"WITH {RUNS_SQL} SELECT run_id, version AS pipeline_version, CAST(pdf AS VARCHAR) AS pdf_source, n_total AS n_inbox, n_total, 'none' AS model, 'extractive' AS eval_version FROM runs")
def extractive_runs(spark, sf_dir):
    rows = runs(spark, sf_dir).select("run_id", F.col("version").alias("pipeline_version"), F.col("pdf").cast("string").alias("pdf_source"), F.col("n_total").alias("n_generated"))
    return X.extractive_runs(rows)


@query("s26_extractive_evals", "SELECT l_orderkey AS run_id, l_returnflag AS note, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS anchor_rate, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS hallucination_rate FROM lineitem GROUP BY 1, 2")
def extractive_evals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("note"), "l_tax", "l_discount")
    return X.extractive_evals(rows, F.col("l_tax") > 0.04, F.col("l_discount") > 0.05)


@query("s27_migration", "SELECT 'migrated__v1__n' || l_orderkey AS eval_id, l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R'")
def migration(spark, sf_dir):
    error = F.when(F.col("l_returnflag") == "R", "failed")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), "l_orderkey").alias("note"), F.lit("v1").alias("version"), error.alias("error"), F.col("l_linenumber").alias("k"))
    return X.migrated(rows).select("eval_id", "k")


@query("s29_event_envelope", "SELECT event_id, 'call' AS type, event_type AS agent, value FROM events")
def event_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", "event_type", F.col("ts").alias("at"))
    return X.events(rows.drop("at"), "call", F.col("event_type"), F.lit("2024")).select("event_id", "type", "agent", "value")


@query("s30_remote_payloads", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def remote_payloads(spark, sf_dir):
    """Batches of events; together they hold every event once."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    bodies = X.payloads(rows, "event_type")
    return bodies.groupBy("event_type").agg(F.sum(F.size(F.from_json("body", "array<string>"))).alias("n"))


@query("s31_result_append", "SELECT doc_id AS k, CASE WHEN quality = 1 THEN 'new' ELSE 'old' END AS origin FROM labels")
def result_append(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.lit("old").alias("origin"), F.lit(1).alias("at"))
    new = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("k"), F.lit("new").alias("origin"), F.lit(2).alias("at"))
    return X.append_results(old, new, "k", "at")[1].select("k", "origin")


@query("s38_state_round_trip", "SELECT p_partkey, p_name, p_size, [p_brand, p_type] AS tags FROM part")
def state_round_trip(spark, sf_dir):
    """Drafts saved as JSON and read again with their types (S38, S39)."""
    rows = parts(spark, sf_dir, "p_name", "p_size", F.array("p_brand", "p_type").alias("tags"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "p_partkey")
    return X.restored(X.state(rows, "p_partkey"), "p_partkey", kinds)


@query("s40_crash_reports", "SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"type\":\"ValueError\",\"message\":\"' || p_brand || '\"}' AS report FROM part WHERE p_size % 5 = 0")
def crash_reports(spark, sf_dir):
    error = F.when(F.col("p_size") % 5 == 0, F.struct(F.lit("ValueError").alias("type"), F.col("p_brand").alias("message")))
    return X.crash_reports(parts(spark, sf_dir, error.alias("error")), "p_partkey")


@query("s41_cache", "SELECT p_partkey, p_partkey % 3 = 0 AS hit, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS text FROM part")
def cache(spark, sf_dir):
    """A third of the prompts has an entry, a third a corrupt one (S41, S42)."""
    key = T.cache_key(F.lit("ns"), F.col("p_partkey").cast("string"))
    prompts = parts(spark, sf_dir, key.alias("key"))
    good = X.cache_entries(table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(key.alias("key"), F.col("p_name").alias("text"), F.lit(7).cast("long").alias("usage")))
    bad = table(spark, sf_dir, "part").where("p_partkey % 3 = 1").select(key.alias("key"), F.lit('{"text": "cut').alias("entry"))
    return X.cached(prompts, good.unionByName(bad)).select("p_partkey", "hit", "text")


@query("s42_cache_entries", "SELECT p_partkey, '{\"text\":\"' || p_name || '\",\"usage\":' || p_size || '}' AS entry FROM part")
def cache_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_size").alias("usage"))
    return X.cache_entries(rows, "p_partkey")


@query("s54_tag_registry", "SELECT p_partkey, [replace(p_name, ' ', '-'), 'method/case'] AS tags FROM part")
def tag_registry(spark, sf_dir):
    text = F.concat(F.lit("rejected:\n  - no\napproved:\n  - "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('\n  - "method/case"\n  - Not Valid\nother:\n  - x\n'))
    return parts(spark, sf_dir, X.approved_tags(text).alias("tags"))


@query("s55_label_files", "SELECT doc_id::VARCHAR || '.md' AS file, 0 AS claim_idx, CASE WHEN quality = 1 THEN 's' ELSE 'h' END AS label FROM labels UNION ALL SELECT doc_id::VARCHAR || '.md', 1, NULL FROM labels")
def label_files(spark, sf_dir):
    verdict = F.when(F.col("quality") == 1, "S").otherwise("h")
    text = F.concat(F.lit("# Label\n| claim | v |\n| <!--claim_idx=0--> "), verdict, F.lit(" | |\n| <!--claim_idx=1--> maybe | |\nend"))
    lines = table(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(".md")).alias("file"), F.explode(F.split(text, "\n")).alias("value"))
    return S.cells(lines)


def dry_run(k):
    """A dry run's log of two notes, as a text."""
    goes = F.when(F.col("p_size") % k == 0, "→ Vault").otherwise("→ Inbox (score 3)")
    return F.concat(F.lit("start\n[1/2] "), "p_name", F.lit("\n  Score: 4/5\n  "), goes, F.lit("\n[2/2] "), "p_brand", F.lit("\n  x\n  → Inbox\nend\n"))


@query("s61_routing_log", "SELECT p_partkey, unnest([p_name, p_brand]) AS note, unnest([CASE WHEN p_size % 2 = 0 THEN 'vault' ELSE 'inbox' END, 'inbox']) AS routing FROM part")
def routing_log(spark, sf_dir):
    return parts(spark, sf_dir, F.explode(X.routed_notes(dry_run(2))).alias("r")).select("p_partkey", "r.note", "r.routing")


@query("s62_paired_log", "SELECT p_partkey, p_name AS note, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b FROM part WHERE (p_size % 2 = 0) <> (p_size % 3 = 0)")
def paired_log(spark, sf_dir):
    """Notes that two configurations route apart."""
    row = lambda k, name: parts(spark, sf_dir, "p_name", "p_brand", "p_size").select("p_partkey", F.explode(X.routed_notes(dry_run(k))).alias("r")).select("p_partkey", "r.note", (F.col("r.routing") == "vault").alias(name))
    return row(2, "a").join(row(3, "b"), ["p_partkey", "note"]).where("a <> b")


@query("s63_label_concepts", "SELECT p_partkey, p_name AS title FROM part WHERE lower(p_brand) LIKE '%brand#1%'")
def label_concepts(spark, sf_dir):
    """Titles of notes whose file field contains a substring, whatever its case."""
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_brand"), F.lower(F.lit("BRAND#1")))).select("p_partkey", F.col("p_name").alias("title"))


@query("s64_label_sheet")
def label_sheet(spark, sf_dir):
    """Tests hold the order and the cells."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_linenumber").alias("claim_idx"), F.concat(F.lit("claim "), "l_partkey").alias("claim"), F.col("l_shipmode" if "l_shipmode" in table(spark, sf_dir, "lineitem").columns else "l_returnflag").alias("context"))
    return X.label_sheet(rows, 1337, F.col("note") % 2 == 0)


@query("s66_proposed_tags", "SELECT 'p' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN ['kept'] ELSE [p_type] END AS tags FROM part")
def inbox_tags(spark, sf_dir):
    path = F.concat(F.lit("p"), "p_partkey").alias("path")
    found = table(spark, sf_dir, "part").select(path, F.array("p_type").alias("tags"))
    before = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(path, F.array(F.lit("kept")).alias("tags"))
    return X.kept_tags(found, before)


@query("s67_latest_results", "SELECT l_orderkey AS note, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS result FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def latest_results(spark, sf_dir):
    pos = F.col("l_linenumber") * 100000000 + F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_returnflag").alias("version"), pos.alias("pos"), F.col("l_partkey").alias("result"))
    return X.latest_results(rows, "N").select("note", "result")


@query("s36_extractive_render", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '# ' || p_name || chr(10) || chr(10) || p_type || ' ' || p_brand || chr(10) WHEN 1 THEN '{"title":"' || p_name || '","body":["' || p_type || '","' || p_brand || '"],"source":"x.pdf"}'
  ELSE '---' || chr(10) || 'title: ' || p_name || chr(10) || 'source: x.pdf' || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || p_type || ' ' || p_brand || chr(10) END AS note FROM part""")
def extractive_render(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("md"), F.lit("json"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return parts(spark, sf_dir, X.rendered(kind, F.col("p_name"), F.array("p_type", "p_brand"), F.lit("x.pdf")).alias("note"))


@query("s37_extractive_files", "SELECT p_partkey, replace(lower(p_name), ' ', '-') || '.md' AS f FROM part WHERE p_size % 2 = 0")
def extractive_files(spark, sf_dir):
    """File names of notes that stay in their folder."""
    stem = F.when(F.col("p_size") % 2 == 0, T.file_stem(F.col("p_name"))).otherwise(F.concat(F.lit("../"), "p_name"))
    name = F.concat(stem, F.lit(".md"))
    return parts(spark, sf_dir, name.alias("f")).where(N.inside_folder(F.col("f")))


@query("s52_server_events", "SELECT event_id, 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS message FROM events")
def server_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return rows.select("event_id", X.server_events(rows).alias("message"))
