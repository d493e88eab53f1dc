"""Operator 2: reproducible shuffle and sharding by a keyed Feistel permutation.

Law ``rows``: row number g goes to place p = permute(g); its shard is p mod
``shards`` and its slot p div ``shards``, so shard sizes differ by one row at most
and slots have no gaps.  Rows are numbered by (id, size, checksum) inside hash
buckets of the three, so a null id shared by many rows spreads; rows equal in all three
collapse before the shuffle, so a row that repeats often spreads, too.  Rerunning gives
the same shards for any partitioning.

Defined cases: a null text has size 1 (no bytes plus 1) and the checksum of the
empty text; null ids are rows like any other; rows that repeat entirely are
numbered one after another, which of them comes first makes no difference; an
empty table gives an empty result; texts of any length are read whole; columns besides
the id and the text are ignored, whatever their names.

Equal texts are not kept together: the law is on row counts, and a group of
copies may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.feistel import permute
from folium.llm.numbering import number_rows

SHARDS = 8
KEY = 20_240_611


def shard(
    docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row. Two narrow shuffles (no texts) and a count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered = number_rows(rows)
    place = permute(F.col("_row"), max(n, 1), key)
    return numbered.withColumn("_place", place).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
