"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.durable import durable, shared_dir

__all__ = ["documents", "durable", "fresh", "held_out", "shared_dir", "text_of", "training_rows", "tune"]

#: Characters of a text that a model is fitted on, at most; longer ones are scored only.
LONGEST = 65_536
#: Documents of one Arrow batch; bounds what a Python worker holds at a time.
ARROW_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels no model may see: crc32 of the id, as text, mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int | tuple[int, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
) -> list[tuple[str, int]]:
    """A bounded labelled sample: at most ``per_class`` rows of either label, or of
    labels 0 and 1 where two bounds are given.  A chosen row whose text has more than
    ``longest`` characters is not learned from, so the driver's memory is bounded, too.

    Held-out ids, null labels and null ids are left out before the choice, which
    takes the smallest hashes of the id, so it is the same for any partitioning.
    A repeated label row counts once (the larger label wins).
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .withColumn("_h", F.xxhash64(F.lit("train"), "_id"))
    )
    bounds = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy("_h", "_id").limit(bounds[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    # A few thousand rows of three numbers: bounded by the parameter.
    chosen = F.broadcast(chosen)
    rows = (
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
        .where(F.char_length("_t") <= longest)
        .join(chosen, "_id")
        .orderBy("_h", "_id", F.xxhash64("_t"))
        .limit(sum(bounds))
        .select("_t", "_y")
        .collect()
    )
    return [(r[0], r[1]) for r in rows]
