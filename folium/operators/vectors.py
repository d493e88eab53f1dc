"""Links between unit vectors by cosine, in blocks; per-row counts and spanning edges, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def block_pairs(vectors: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(group, i, a, j, b): ids and vectors of every two blocks of a group, a block with itself once.

    Vectors are dealt to blocks by a hash, so a group of any size is cut; a pair of blocks is a row."""
    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    dealt = vectors.join(sizes, group).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    held = dealt.groupBy(group, "n", "k").agg(F.collect_list("id").alias("i"), F.collect_list("embedding").alias("a"))
    left = held.select(group, "k", "i", "a", F.explode(F.sequence("k", F.col("n") - 1)).alias("m"))
    right = held.select(group, F.col("k").alias("m"), F.col("i").alias("j"), F.col("a").alias("b"))
    return left.join(right, [group, "m"]).select(group, "k", "m", "i", "a", "j", "b")


def _near(row, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.asarray(row.i), np.asarray(row.j)
    cosine = np.round(np.stack(row.a).astype(float) @ np.stack(row.b).astype(float).T, 9)
    hit = cosine >= threshold
    if row.k == row.m:
        hit &= i[:, None] < j[None, :]
    x, y = np.nonzero(hit)
    return i, j, x, y


def link_counts(vectors: DataFrame, threshold: float, group: str = "run", block: int = BLOCK) -> DataFrame:
    """(id, links): how many others of its group each vector (id, group, embedding) is near to."""
    kind = vectors.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                i, j, x, y = _near(row, threshold)
                ids = np.concatenate([i[x], j[y]])
                found, n = np.unique(ids, return_counts=True)
                yield pd.DataFrame({"id": found, "links": n})

    parts = block_pairs(vectors, group, block).mapInPandas(count, f"id {kind}, links long")
    return vectors.select("id").join(parts.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def spanning_links(vectors: DataFrame, threshold: float, group: str = "run", block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect what all links of a group connect; a pair of blocks gives fewer
    edges than it has rows."""
    kind = vectors.schema["id"].dataType.simpleString()

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                i, j, x, y = _near(row, threshold)
                up: dict = {}

                def find(n, up=up):
                    while up.get(n, n) != n:
                        up[n] = up.get(up[n], up[n])
                        n = up[n]
                    return n

                out = []
                for a, b in zip(i[x].tolist(), j[y].tolist(), strict=True):
                    p, q = find(a), find(b)
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        out.append((a, b))
                if out:
                    yield pd.DataFrame(out, columns=["u", "v"])

    return block_pairs(vectors, group, block).mapInPandas(forest, f"u {kind}, v {kind}")
