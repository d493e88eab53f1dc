"""Readers of the file formats around the tables: JSON lines, logs, markdown notes, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import first_group

TRACE_SCHEMA = (
    "ts string, agent string, type string, model string, input_tokens long, output_tokens long, cache_read_tokens long,"
    " cache_creation_tokens long, duration_ms long, cached boolean, error string, score int, destination string"
)


def json_lines(spark: SparkSession, path: str, schema: str = TRACE_SCHEMA, strict: bool = False) -> DataFrame:
    """Typed JSON lines; a bad line drops out, or fails the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(key, version, value): the lines of log files named ``<key>_<version>.log``."""
    return log_lines(spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), "value")).drop("name")


def log_lines(lines: DataFrame) -> DataFrame:
    """Lines (name, value) of log files with the key and version of the name."""
    stem = F.regexp_extract("name", r"^(.*)\.log$", 1)
    return lines.select(
        "name", F.regexp_extract(stem, r"^(.*)_(v[\d.]+)$", 1).alias("key"), F.regexp_extract(stem, r"^(.*)_(v[\d.]+)$", 2).alias("version"), "value"
    )


def routing_counts(lines: DataFrame) -> DataFrame:
    """Routed notes per log, with the acceptance share and the first word count."""
    hit = lambda p: F.count_if(F.col("value").rlike(p))
    vault, inbox, merge = hit(r"(→|->)\s*vault\b"), hit(r"(→|->)\s*inbox\b"), hit(r"(→|->)\s*merge\b")
    total = vault + inbox + merge
    return lines.groupBy("key", "version").agg(
        vault.alias("n_vault"),
        inbox.alias("n_inbox"),
        merge.alias("n_merge"),
        F.round(100 * vault / F.nullif(total, F.lit(0)), 1).alias("accept_pct"),
        F.min(first_group(F.col("value"), r"(\d+) words").cast("long")).alias("words"),
    )


def frontmatter(content: Column) -> Column:
    """Top-level ``key: value`` pairs between the first two ``---`` lines, as a map.

    Values stay text; a file without frontmatter has an empty map."""
    block = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([^:]+):", 1).alias("k"),
            F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]+:", "")), "^[\"']|[\"']$", "").alias("v"),
        ),
    )
    # A key that repeats keeps its last value.
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )


def note_body(content: Column) -> Column:
    """A note without frontmatter, from its first heading to the sources section."""
    body = F.regexp_replace(content, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    at = F.regexp_instr(body, F.lit(r"(?m)^#\s+.+$"))
    body = F.when(at > 0, F.regexp_replace(body, r"(?s)\A.*?(?=(?m:^#\s+.+$))", "")).otherwise(body)
    return F.regexp_replace(body, r"(?is)^##\s+Quellen\b.*\z".replace("(?is)", "(?ism)"), "")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, aliases, meta, body) of the markdown files below a folder."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return note_rows(files)


def note_rows(files: DataFrame) -> DataFrame:
    """(path, title, aliases, meta, body) of markdown files (path, value)."""
    meta = frontmatter(F.col("value"))
    rows = files.select("path", meta.alias("meta"), note_body(F.col("value")).alias("body"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    aliases = F.regexp_extract_all(F.coalesce(F.col("meta")["aliases"], F.lit("")), F.lit(r"[^\[\],\"']+"), F.lit(0))
    return rows.select(
        "path",
        F.coalesce(first_group(F.col("body"), r"(?m)^#\s+(.+)$"), F.col("meta")["title"], stem).alias("title"),
        F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != "").alias("aliases"),
        "meta",
        "body",
    )


def concepts(found: DataFrame) -> DataFrame:
    """(key, path): lower-case titles and aliases; the last path of a key wins."""
    keys = found.select(F.explode(F.concat(F.array("title"), "aliases")).alias("key"), "path")
    return keys.groupBy(F.lower("key").alias("key")).agg(F.max("path").alias("path"))


def link_graph(found: DataFrame) -> DataFrame:
    """Edges (src, dst) between notes whose wiki links resolve to a title or alias."""
    links = found.select(
        F.col("path").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("key")
    ).select("src", F.lower(F.trim("key")).alias("key"))
    return links.join(concepts(found).withColumnRenamed("path", "dst"), "key").where("src <> dst").select("src", "dst").distinct()


def label_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, claim_idx, label): the cells of calibration tables, s, h or ?."""
    return cells(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value"))


def cells(lines: DataFrame) -> DataFrame:
    """The label cells among lines (file, value)."""
    return lines.where(F.col("value").contains("claim_idx=")).select(
        "file",
        F.regexp_extract("value", r"<!--claim_idx=(\d+)-->", 1).cast("int").alias("claim_idx"),
        F.lower(first_group(F.col("value"), r"(?i)<!--claim_idx=\d+-->\s*([sh?])\s*\|")).alias("label"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both tables, the one of the greatest ``order`` for each key."""
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
