"""Operator 6: SimHash near-duplicates, linked through pivot distance tables.

Fingerprint.  Bit j of a text is set if it is set in over half of the XXH64 hashes
(seed 42) of its four-word shingles, repeats included, after lower-casing A-Z.

Links.  Equal fingerprints collapse first, so a group of copies is one row.  Two
fingerprints that differ in at most ``MAX_BITS`` of 64 bits agree on at least b - 4 of
any b bands, hence meet under one key of b - 4 bands; this deals them to tasks and loses
no pair.  The number of distinct fingerprints chooses b, so that a key holds about
``PER_KEY`` of them at any size (b = 6: 15 keys of 21 bits; 7: 35 of 27; 8: 70 of 32).
Inside a task every fingerprint has a table of its
Hamming distances to ``PIVOTS`` reference fingerprints.  By the triangle inequality
two fingerprints whose distances to any pivot differ by more than ``MAX_BITS`` are
themselves further apart, so pairs are discarded by their maximum coordinate
difference and only survivors are compared bit by bit.  Each key's rows are sorted
by the first pivot distance, which closes the search window.

Skew.  Keys with more than ``BLOCK`` fingerprints are cut into blocks, and each pair
of blocks is a unit of its own, so a hot key spreads over tasks.  A unit returns a
spanning forest of its links (fewer edges than rows), never all its pairs; the
forests together connect exactly what all links connect.

Defined cases: null and empty texts have fingerprint zero and link like any other; a
null id is ignored when the smallest id of a component is taken, and a component
without ids has a null one; repeated rows share a fingerprint; a text of any length is
read whole; an empty table gives an empty result; columns besides the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import durable, text_of
from folium.operators.components import connected_components

MAX_BITS = 4
SEED = 42
#: Distinct fingerprints that a key holds on average, at most, where they are spread evenly.
PER_KEY = 64
PIVOTS = 16
BLOCK = 2048
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text (0 for one without words)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 4:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words of 64 bits."""
    return np.random.default_rng(64).integers(0, 1 << 64, size=n, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot, one row per pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in refs]).astype(np.int8)


def near_pairs(fps: np.ndarray, table: np.ndarray, group: np.ndarray, side: np.ndarray):
    """Index pairs within ``MAX_BITS`` bits and one group, as batches of two arrays.

    Rows are sorted by group and first pivot distance.  Row i meets i + d for growing d
    while both are of one group and within the window of the first coordinate;
    the remaining coordinates discard, the survivors are verified.  ``side`` is 0
    for groups that are compared with themselves; where two blocks meet it is 1 and
    2, and only pairs across them count (each block is compared with itself
    in its own unit).
    """
    order = np.lexsort((table[0], group))
    fps, table, group, side = fps[order], table[:, order], group[order], side[order]
    live = np.arange(len(fps))
    d = 1
    while len(live):
        live = live[live + d < len(fps)]
        live = live[(group[live] == group[live + d]) & (table[0, live + d] - table[0, live] <= MAX_BITS)]
        i, j = live, live + d
        across = (side[i] == 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        for row in table[1:]:
            ok = np.abs(row[i] - row[j]) <= MAX_BITS
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
        if ok.any():
            yield order[i[ok]], order[j[ok]]
        d += 1


class Forest:
    """Union-find over indices; ``join`` returns the links that were new."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        up, new = self.up, []
        while len(i):
            while (up[up] != up).any():  # every index points at its root
                up = up[up]
            a, b = np.minimum(up[i], up[j]), np.maximum(up[i], up[j])
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # One link for each larger root hangs it on a smaller one; the rest are seen again.
            _, first = np.unique(b, return_index=True)
            new += zip(i[first].tolist(), j[first].tolist(), strict=True)
            up = up.copy()
            up[b[first]] = a[first]
        self.up = up
        return new


def _link_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole units (sorted by unit, key, block pair) -> spanning forest edges (u, v)."""
    refs = pivots()

    def solve(part: pd.DataFrame) -> pd.DataFrame | None:
        fps = part["fp"].to_numpy().view(np.uint64)
        unit = part[["band", "value", "lo", "hi"]].to_numpy()
        new = np.ones(len(part), dtype=bool)
        new[1:] = (unit[1:] != unit[:-1]).any(axis=1)
        group = np.cumsum(new)
        side = part["side"].to_numpy()
        forest, out = Forest(len(part)), []
        for i, j in near_pairs(fps, distance_table(fps, refs), group, side):
            out += forest.join(i, j)
        if not out:
            return None
        ends = part["fp"].to_numpy()
        a, b = np.array(out).T
        return pd.DataFrame({"u": ends[a], "v": ends[b]})

    held, rows = [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < 1 << 16:
            continue
        part = pd.concat(held, ignore_index=True)
        last = part.iloc[-1]
        same = np.ones(len(part), dtype=bool)
        for c in ("band", "value", "lo", "hi"):
            same &= (part[c] == last[c]).to_numpy()
        held, rows = [part[same]], int(same.sum())
        done = solve(part[~same].reset_index(drop=True)) if not same.all() else None
        if done is not None:
            yield done
    if held:
        done = solve(pd.concat(held, ignore_index=True))
        if done is not None:
            yield done


def band_count(n: int) -> int:
    """The least number of bands whose keys hold ``PER_KEY`` of n fingerprints or fewer."""
    b = MAX_BITS + 1
    while b < 12 and n > PER_KEY * 2 ** (64 * (b - MAX_BITS) / b):
        b += 1
    return b


def band_keys(distinct: DataFrame, b: int) -> DataFrame:
    """(fp, band, value): the bits of every choice of b - ``MAX_BITS`` of b bands."""
    edges = [64 * k // b for k in range(b + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(b), b - MAX_BITS)):
        bits = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        keys.append(F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(bits)).cast("long")).alias("value")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.value")


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect what all links of distinct fingerprints connect."""
    keyed = band_keys(distinct, band_count(distinct.count()))
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["band", "value"])
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("parts")).cast("int")
    keyed = keyed.withColumn("parts", parts).withColumn("own", own)
    # A row of block b joins the units (min(b, c), max(b, c)) of all blocks c of its key.
    units = keyed.select(
        "fp", "band", "value", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "fp",
        "band",
        "value",
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
    )
    return (
        units.repartition("band", "value", "lo", "hi")
        .sortWithinPartitions("band", "value", "lo", "hi")
        .mapInPandas(_link_units, "u long, v long")
    )


#: A fingerprint held by over one in so many rows is joined by broadcast, so the
#: broadcast has fewer than this many rows at any size.
HOT_SHARE = 2000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row."""
    rows = durable(fingerprints(docs, id_col, text_col))
    groups = durable(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(groups.select("fp")))
    placed = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = durable(placed)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    # Components of many fingerprints are joined by broadcast as well, so they stay spread.
    many = F.lit(groups.count() / HOT_SHARE)
    large = F.broadcast(smallest.where(F.col("k") > many).drop("k"))
    rest = placed.join(large, "root", "left_anti").join(smallest.where(F.col("k") <= many).drop("k"), "root")
    named = durable(placed.join(large, "root").unionByName(rest).select("fp", "n", "component_id"))
    hot_rows = F.lit(rows.count() / HOT_SHARE)
    hot = named.where(F.col("n") > hot_rows).select("fp", F.col("component_id").alias("c"), F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), "fp", "left")
    rest = marked.where(F.col("is_hot").isNull()).drop("c", "is_hot").join(
        named.where(F.col("n") <= hot_rows).select("fp", F.col("component_id").alias("c")), "fp"
    )
    out = marked.where("is_hot").select("_id", "fp", "c").unionByName(rest.select("_id", "fp", "c"))
    return out.select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("c").alias("component_id"),
    )
