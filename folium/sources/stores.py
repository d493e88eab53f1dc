"""Tables of runs, evaluations, traces and drafts: their rows, upserts, appends and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folium.sources.files import upsert


def evolved(df: DataFrame, schema: str | StructType) -> DataFrame:
    """A table with every column of a schema: missing ones are null, others stay behind them."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {c.lower(): c for c in df.columns}
    known = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    names = {f.name.lower() for f in want}
    return df.select(*known, *[c for c in df.columns if c.lower() not in names])


def run_rows(runs: DataFrame) -> DataFrame:
    """Runs with ``fully_cached``: no tokens, but some time."""
    return runs.withColumn("fully_cached", (F.col("tokens_total") == 0) & (F.col("duration_s") > 0))


def eval_rows(evals: DataFrame) -> DataFrame:
    """Evaluations under their table's names: note stands in for note_path, version for pipeline_version."""
    rows = evolved(evals, "note_path string, note string, pipeline_version string, version string")
    return rows.withColumns({"note_path": F.coalesce("note_path", "note"), "pipeline_version": F.coalesce("pipeline_version", "version")}).drop("note", "version")


def extractive_runs(runs: DataFrame) -> DataFrame:
    """Runs of the pipeline without a model: every note goes to the inbox."""
    return runs.select(
        "run_id", "pipeline_version", "pdf_source", F.col("n_generated").alias("n_inbox"), F.col("n_generated").alias("n_total"), F.lit("none").alias("model"), F.lit("extractive").alias("eval_version")
    )


def extractive_evals(sentences: DataFrame, anchored: Column, hallucinated: Column) -> DataFrame:
    """(run_id, note, anchor_rate, hallucination_rate) of notes' sentences."""
    share = lambda c: F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0))
    return sentences.groupBy("run_id", "note").agg(share(anchored).alias("anchor_rate"), share(hallucinated).alias("hallucination_rate"))


def migrated(lines: DataFrame) -> DataFrame:
    """Rows of an old log as evaluations; failed ones drop, the id says where they come from."""
    return lines.where("error is null").withColumn("eval_id", F.concat(F.lit("migrated__"), "version", F.lit("__"), "note"))


def events(rows: DataFrame, kind: str, agent: Column, ts: Column) -> DataFrame:
    """Payload rows in the envelope of an event."""
    return rows.select(ts.alias("ts"), F.lit(kind).alias("type"), agent.alias("agent"), *rows.columns)


def append_traces(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Events as JSON lines, one folder a run; an append commits all its files or none."""
    rows.write.mode("append").partitionBy(run).json(path)


def payloads(rows: DataFrame, run: str, size: int = 100) -> DataFrame:
    """(run, batch, body): JSON arrays of up to ``size`` events, for a remote sink.

    Events are numbered in buckets of a hash, so that a long run is cut before it is gathered."""
    row = F.struct(*[c for c in rows.columns if c != run])
    n = rows.groupBy(run).agg(F.ceil(F.count("*") / F.lit(size / 2)).alias("n"))
    dealt = rows.select(run, row.alias("r")).join(n, run).withColumn("batch", F.pmod(F.xxhash64(F.to_json("r")), F.col("n")).cast("int"))
    return dealt.groupBy(run, "batch").agg(F.to_json(F.array_sort(F.collect_list(F.to_json("r")))).alias("body"))


def append_results(old: DataFrame, new: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """A log with new rows at its end, and the table with the latest row of each key."""
    return old.unionByName(new, allowMissingColumns=True), upsert(old, new, key, order)


def state(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): drafts as one JSON text each."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def restored(saved: DataFrame, key: str, schema: str) -> DataFrame:
    return saved.select(key, F.from_json("json", schema).alias("s")).select(key, "s.*")


def crash_reports(results: DataFrame, key: str) -> DataFrame:
    """(key, report) of failed rows (key, error struct)."""
    return results.where("error is not null").select(key, F.to_json(F.struct(key, "error.*")).alias("report"))


def cached(prompts: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Prompts with (hit, text, usage) of the cache (key, entry JSON); a corrupt entry is a miss."""
    entry = F.from_json("entry", "text string, usage long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    held = cache.select(key, entry.alias("e")).where("e.text is not null and e._corrupt is null")
    one = held.groupBy(key).agg(F.max("e").alias("e"))
    rows = prompts.join(one, key, "left")
    return rows.withColumns({"hit": F.col("e").isNotNull(), "text": F.col("e.text"), "usage": F.col("e.usage")}).drop("e")


def cache_entries(answers: DataFrame, key: str = "key") -> DataFrame:
    """(key, entry) to be put into a cache."""
    return answers.select(key, F.to_json(F.struct("text", "usage")).alias("entry"))


def approved_tags(registry: Column, schema: str = r"^[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*){0,2}$") -> Column:
    """Valid tags of the ``approved`` list of a registry file."""
    block = F.regexp_extract(registry, r"(?m)^approved:[^\S\n]*\n((?:[^\S\n]*-[^\n]*\n?)*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[^\S\n]*-[^\S\n]*(.+)$"), F.lit(1)), lambda t: F.btrim(F.trim(t), F.lit("\"'")))
    return F.filter(items, lambda t: t.rlike(schema))


def routed_notes(lines: Column) -> Column:
    """array<struct(note, routing)> of a dry run's log: a line that names a note, then where it goes."""
    found = F.regexp_extract_all(lines, F.lit(r"(?m)^\[\d+/\d+\]\s*(.+?)\s*\n(?:(?!\[\d+/).*\n)*?.*?→\s*(?:Vault|Inbox)"), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(F.regexp_extract(m, r"^\[\d+/\d+\]\s*(.+?)\s*\n", 1).alias("note"), F.lower(F.regexp_extract(m, r"→\s*(Vault|Inbox)$", 1)).alias("routing")),
    )


def kept_tags(found: DataFrame, before: DataFrame) -> DataFrame:
    """(path, tags): proposed tags of notes; what an earlier run wrote into a note stays."""
    old = before.select("path", F.col("tags").alias("old"))
    return found.join(old, "path", "left").select("path", F.when(F.size("old") > 0, F.col("old")).otherwise(F.col("tags")).alias("tags"))


def latest_results(rows: DataFrame, version: str) -> DataFrame:
    """The last row of each note for a version, by its place in the log."""
    rest = [c for c in rows.columns if c != "note"]
    last = rows.where(F.col("version") == version).groupBy("note").agg(F.max_by(F.struct(*rest), "pos").alias("r"))
    return last.select("note", "r.*")


def label_sheet(claims: DataFrame, seed: int, blind: Column) -> DataFrame:
    """(note, sheet): claims to label, in seeded order, without verdicts; blind sheets without contexts.

    A note has as many claims as its body has sentences."""
    cell = F.concat_ws(
        " | ", F.concat(F.lit("| <!--claim_idx="), F.col("claim_idx").cast("string"), F.lit("-->")), "claim", F.when(~blind, F.col("context")), F.lit("|")
    )
    order = F.xxhash64(F.lit(seed), "note", "claim_idx")
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), cell.alias("c"))))
    return claims.groupBy("note").agg(F.array_join(F.transform(rows, lambda x: x["c"]), "\n").alias("sheet"))


def rendered(kind: Column, title: Column, body: Column, source: Column) -> Column:
    """An extractive note as obsidian, md or json; an unknown format is obsidian."""
    text = F.array_join(body, " ")
    plain = F.concat(F.lit("# "), title, F.lit("\n\n"), text, F.lit("\n"))
    json = F.to_json(F.struct(title.alias("title"), body.alias("body"), source.alias("source")))
    front = F.concat(F.lit("---\ntitle: "), title, F.lit("\nsource: "), source, F.lit("\n---\n\n"), plain)
    return F.when(kind == "md", plain).when(kind == "json", json).otherwise(front)


def server_events(rows: DataFrame) -> Column:
    """An event as a server-sent message."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*rows.columns)), F.lit("\n\n"))
