"""Dense global row numbers without a single-task sort, in DataFrame operations.

Rows that repeat entirely are interchangeable, so they collapse to one row with a count
before the shuffle: neither a hot key nor a hot row meets in one task.  Distinct rows are
dealt to a fixed number of buckets by a hash, each bucket adds its counts up in a
window, and the buckets' running totals (``BUCKETS`` rows at most) are joined back by
broadcast.  A row that stands for many is then spread in blocks and repeated.  Numbers
depend on the rows alone, not on partitions or task order, so a lost task recomputes to
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the numbering; their totals are the only broadcast.
BUCKETS = 4096
#: Copies of a repeated row that one row of the exchange stands for, at most.
BLOCK = 1 << 16


def number_rows(rows: DataFrame, out: str = "_row", block: int = BLOCK) -> DataFrame:
    """Every row with ``out``, its number from 0 in the order of bucket and columns."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int"))
    inside = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = counted.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), zero))
    totals = counted.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_n").over(earlier), zero).alias("_before"))
    placed = placed.join(F.broadcast(totals), "_bucket").withColumn("_first", F.col("_before") + F.col("_inside"))
    placed = placed.select(*columns, "_n", "_first")
    step = F.lit(block).cast("long")
    # Rows that stand for more than a block are cut into blocks, which are dealt anew.
    many = placed.where(F.col("_n") > step).withColumn("_k", F.explode(F.sequence(zero, F.call_function("div", F.col("_n") - 1, step))))
    many = many.select(
        *columns, F.least(step, F.col("_n") - F.col("_k") * step).alias("_n"), (F.col("_first") + F.col("_k") * step).alias("_first")
    ).repartition("_first")
    blocks = placed.where(F.col("_n") <= step).unionByName(many)
    return blocks.select(*columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias(out))
