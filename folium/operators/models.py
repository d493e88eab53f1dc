"""Calls of language models and inference models over rows, with offline stand-ins.

A provider answers prompts; ``ask`` runs it over a table, takes what a cache holds first, and
keeps a failure on its row.  The engine ships no model: a command-line and an HTTP provider
are there to be configured, and ``Offline`` answers by a function, as tests and queries do."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import cache_key
from folium.sources.stores import cached

#: Calls that a task runs at a time, pairs of a prompt, and acronyms of a note that are asked for.
AT_A_TIME, PAIRS, ACRONYMS = 4, 25, 10
CONTRADICTS, WORTH_ASKING = 0.7, 0.3


@dataclass
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


class Provider:
    """Answers one prompt; raises where it cannot."""

    def answer(self, prompt: str, model: str) -> Answer:
        raise NotImplementedError


@dataclass
class Offline(Provider):
    """Answers by a function of the prompt; tokens are words."""

    rule: Callable[[str], str]

    def answer(self, prompt: str, model: str) -> Answer:
        text = self.rule(prompt)
        return Answer(text, len(prompt.split()), len(text.split()))


@dataclass
class CommandLine(Provider):
    """A program that reads a prompt and prints JSON with ``text`` and ``usage``."""

    command: list[str]
    seconds: int = 300
    retries: int = 1
    hints: tuple[str, ...] = ("401", "403", "api key", "unauthorized", "credential")

    def answer(self, prompt: str, model: str) -> Answer:
        for left in range(self.retries, -1, -1):
            try:
                done = subprocess.run([*self.command, model], input=prompt, capture_output=True, text=True, timeout=self.seconds, check=False)
            except subprocess.TimeoutExpired:
                if not left:
                    raise
                continue
            if done.returncode == 0:
                found = json.loads(done.stdout)
                use = found.get("usage", {})
                return Answer(found["text"], use.get("input_tokens", 0), use.get("output_tokens", 0))
            # Credentials do not come back by trying again.
            if not left or any(h in done.stderr.lower() for h in self.hints):
                raise RuntimeError(done.stderr.strip()[:500])
        raise RuntimeError("no answer")


@dataclass
class Http(Provider):
    """A service that takes and returns JSON; waits longer after each failure."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    seconds: int = 300
    retries: int = 2
    wait: float = 1.0

    def answer(self, prompt: str, model: str) -> Answer:
        body = json.dumps({"model": model, "prompt": prompt}).encode()
        request = urllib.request.Request(self.url, data=body, headers={"Content-Type": "application/json", **self.headers})
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.seconds) as response:
                    found = json.loads(response.read())
                return Answer(found["text"], found.get("input_tokens", 0), found.get("output_tokens", 0))
            except OSError:
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)
        raise RuntimeError("no answer")


def called(prompts: DataFrame, provider: Provider, model: str, at_a_time: int = AT_A_TIME) -> DataFrame:
    """Rows with a ``prompt`` and what a provider answers: text, input_tokens, output_tokens, error.

    A task runs a few calls at a time; one that fails leaves its error and no text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def one(prompt: str):
        try:
            a = provider.answer(prompt, model)
            return a.text, a.input_tokens, a.output_tokens, None
        except Exception as e:  # any failure belongs to its row
            return None, 0, 0, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_a_time) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf["prompt"]))
                yield pdf.assign(**{c: [g[k] for g in got] for k, c in enumerate(("text", "input_tokens", "output_tokens", "error"))})

    return prompts.mapInPandas(run, f"{fields}, text string, input_tokens long, output_tokens long, error string")


def ask(prompts: DataFrame, provider: Provider, model: str, agent: str, cache: DataFrame | None = None, space: str = "") -> DataFrame:
    """``called`` for what the cache (key, entry) lacks, and ``cached`` for the rest, with the key."""
    rows = prompts.withColumn("key", cache_key(F.lit(space), F.lit(model), F.lit(agent), F.col("prompt")))
    if cache is None:
        return called(rows, provider, model).withColumn("cached", F.lit(False))
    found = cached(rows, cache)
    none = F.lit(0).cast("long")
    hits = found.where("hit").select(*rows.columns, "text", none.alias("input_tokens"), none.alias("output_tokens"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    made = called(found.where("not hit").select(*rows.columns), provider, model).withColumn("cached", F.lit(False))
    return hits.unionByName(made)


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have an answer, and rows that failed."""
    return results.where("error is null"), results.where("error is not null")


def same_pairs(pairs: DataFrame, provider: Provider, model: str) -> DataFrame:
    """Pairs (group, a, b) that a model calls the same; ``PAIRS`` of a group in one prompt.

    Pairs are dealt to prompts by a hash, so no group is gathered."""
    sizes = pairs.groupBy("group").agg(F.ceil(F.count("*") / F.lit(PAIRS)).alias("n"))
    dealt = pairs.join(sizes, "group").withColumn("batch", F.pmod(F.xxhash64("a", "b"), F.col("n")))
    rows = dealt.groupBy("group", "batch").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    lines = F.transform("pairs", lambda p, i: F.concat((i + 1).cast("string"), F.lit(": "), p["a"], F.lit(" | "), p["b"]))
    answered = called(rows.withColumn("prompt", F.array_join(lines, "\n")).drop("batch"), provider, model)
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+):\s*SAME\b"), F.lit(1)), lambda x: x.cast("int"))
    picked = F.filter("pairs", lambda p, i: F.array_contains(F.col("numbers"), i + 1))
    return answered.withColumn("numbers", numbers).select("group", F.explode(picked).alias("p")).select("group", "p.*")


def inference(premise: Column, hypothesis: Column, model: Callable[[str, str], tuple[float, float, float]] | None = None) -> Column:
    """struct(entailment, neutral, contradiction) of pairs; without a model all are neutral."""
    neutral = F.struct(F.lit(0.0).alias("entailment"), F.lit(1.0).alias("neutral"), F.lit(0.0).alias("contradiction"))
    if model is None:
        return neutral

    @F.pandas_udf("entailment double, neutral double, contradiction double")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                out.append(model(x, y))
            except Exception:  # a model that fails says nothing
                out.append((0.0, 1.0, 0.0))
        return pd.DataFrame(out, columns=["entailment", "neutral", "contradiction"])

    return scored(premise, hypothesis)


def contradicted(pairs: DataFrame, model=None) -> DataFrame:
    """(id, contradicted) of (id, body, excerpt, cosine): one excerpt near enough that contradicts."""
    rows = pairs.where(F.col("cosine") >= WORTH_ASKING).withColumn("s", inference(F.col("excerpt"), F.col("body"), model))
    hit = rows.groupBy("id").agg(F.max(F.col("s.contradiction") >= CONTRADICTS).alias("hit"))
    return pairs.select("id").distinct().join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("contradicted"))


def long_forms(candidates: DataFrame, provider: Provider, model: str) -> DataFrame:
    """(id, acronym, long) for candidates (id, acronym, context, at), the first ten of a note."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("id").orderBy("at", "acronym"))
    rows = candidates.withColumn("k", k).where(F.col("k") <= ACRONYMS).select("id", "acronym", F.concat_ws("\n", "acronym", "context").alias("prompt"))
    value = F.trim(F.regexp_extract("text", r"(?m)^\s*LONG_FORM:\s*(.+)$", 1))
    found = called(rows, provider, model).withColumn("long", value)
    return found.where((F.col("long") != "") & (F.col("long") != "UNKNOWN") & (F.char_length("long") > F.char_length("acronym"))).select("id", "acronym", "long")


def perturbed(claims: DataFrame, provider: Provider, model: str) -> DataFrame:
    """(id, claim, other): claims as a model changes them; NONE and empty answers drop."""
    rows = called(claims.withColumn("prompt", F.col("claim")), provider, model).withColumn("other", F.trim("text"))
    return rows.where("other is not null and other <> '' and other <> 'NONE'").select("id", "claim", "other")


def tiers(anchors: DataFrame, model_page: Column | None = None, prepass: float = 98.0, last: float = 85.0, least: int = 30, near: float = 0.75) -> DataFrame:
    """Anchors (id, quote, text, semantic_page, cosine) with (tier, page) of the first check that holds.

    Exact occurrence, then a fuzzy one of 98, a sentence of like meaning, what a model says, and a
    fuzzy one of 85.  Fuzzy scores are computed only for anchors that nothing before resolved."""
    from folium.functions.fuzzy import partial_place_of, partial_ratio_of
    from folium.functions.text import marker_before

    quote = F.btrim(F.trim("quote"), F.lit("„“”\"'"))
    rows = anchors.withColumn("q", quote)
    exact = marker_before(F.col("text"), F.expr("instr(text, q)"))
    rows = rows.withColumn("exact", F.when(F.char_length("q") >= least, exact))
    done = rows.where("exact is not null").select("id", F.lit("exact").alias("tier"), F.col("exact").alias("page"))
    rest = rows.where("exact is null").withColumns({"r": partial_ratio_of(F.col("q"), F.col("text")), "at": partial_place_of(F.col("q"), F.col("text"))})
    fuzzy = marker_before(F.col("text"), F.col("at") + 1)
    given = F.lit(None).cast("int") if model_page is None else model_page
    named = lambda tier, page: F.struct(F.lit(tier).alias("tier"), page.cast("int").alias("page"))
    found = F.coalesce(
        F.when((F.col("r") >= prepass) & (F.char_length("q") >= least) & fuzzy.isNotNull(), named("fuzzy", fuzzy)),
        F.when((F.col("cosine") >= near) & F.col("semantic_page").isNotNull(), named("semantic", F.col("semantic_page"))),
        F.when(given.isNotNull(), named("model", given)),
        F.when((F.col("r") >= last) & fuzzy.isNotNull(), named("loose", fuzzy)),
        named("none", F.lit(None)),
    )
    return done.unionByName(rest.withColumn("f", found).select("id", "f.tier", "f.page"))
