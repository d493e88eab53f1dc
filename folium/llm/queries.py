"""Queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm import bpe, fingerprints, quality_model, toxicity
from folium.llm.common import documents, tune
from folium.llm.lines import line_dedup
from folium.llm.mixing import mix
from folium.llm.oracles import ORACLE_SQL
from folium.llm.quality_rules import quality_rules
from folium.llm.sharding import shard
from folium.llm.simhash import near_duplicates
from folium.llm.training_order import training_order


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir)
    return quality_model.classify(docs, quality_model.train(docs, documents(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return training_order(documents(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir)
    return bpe.encode_documents(docs, bpe.Codec(docs))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mix(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_sharding": op2_sharding,
        "op3_training_order": op3_training_order,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_bpe_encoding": op5_bpe_encoding,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
