"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. quality classifier: rows scored below the threshold go;
2. line dedup: lines frequent on their host go from every text (n_chars follows);
3. SimHash near-dedup: of each group exactly one row stays, of the smallest id; rows
   without an id are in groups like any other and stay only where no row has an id;
4. mixing: rows repeat as often as their fitted rate says, and none is lost while the
   targets shrink no domain;
5. BPE encoding: the ids' digests of what is left, the last result.

All but the last return the columns of their input, further ones of any name included.

Defined cases, of every stage: null and empty texts are scored, hashed and encoded like
any other (a null text stays null; its n_chars is null after line dedup, as it has no
text to count); null ids, languages and sources are values like any other; repeated rows
are rows of their own until stage 3 keeps one; texts of any length are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, mixing, quality_model, simhash
from folium.llm.common import documents, fresh, shared_dir, tune
from folium.llm.lines import dedup_lines


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = quality_model.train(docs, documents(spark, sf_dir, "labels"))
    return docs.where(quality_model.score_column(spark, model) >= quality_model.THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs)
    text = F.col(cleaned.columns[-1])
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cleaned.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    # Two hashes of all columns, nulls told apart, name a row; equal rows share a name.
    parts = [x for c in docs.columns for x in (F.isnull(c), F.col(c))]
    a, b = fresh(docs, "_h", "_g")
    named = docs.withColumns({a: F.xxhash64(F.lit("row"), *parts), b: F.xxhash64(F.lit("name"), *parts)})
    # The smallest key of a component is of its smallest id, and has no id only if none has.
    key = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.col(a).alias("h"), F.col(b).alias("g"))
    found = simhash.near_duplicates(named.select(key.alias("_key"), "text"), "_key")
    stays = found.select(F.col("component_id.h").alias(a), F.col("component_id.g").alias(b)).distinct()
    # Equal rows collapse before the exchange, so no key is hot in the join.
    return named.dropDuplicates([a, b]).join(stays, [a, b], "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return mixing.apply_mix(docs, documents(spark, sf_dir, "labels"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return bpe.encode_documents(docs, bpe.Codec(docs))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL expresses neither the trained models nor the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a Parquet table in the shared folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
