"""Operator 4: document fingerprints by consistent weighted sampling.

A text is a set of words weighted 1 + ln(count).  For sample k and term x a hash gives
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the sample is the
(x, t) of the least c / exp(r (t - b) + r).  Two texts draw the same sample with
probability equal to the generalised Jaccard similarity of their weights, so the
share of equal samples estimates it.  A fingerprint has ``SAMPLES`` samples of 16 bits,
in hex; unequal samples agree by chance once in 65,536.

What a word of some count draws depends on nothing else, so a worker keeps the draws of
the words it has met as 64 whole numbers (the value above the sample), and a text's
fingerprint is their least, column by column.

``with_next`` pairs each row with its successor in id order without a global sort in one
task.  Rows are ordered by (id, hash of the text).  Quantiles of the ids cut ranges of
similar size, and an id that fills several quantiles is cut by its rows' hashes.  Rows
that repeat entirely (id and text) more often than once in ``HOT_SHARE`` rows send one
row to their range; the others are followed by their like, so they take the result of
that one row by broadcast.  Texts are shuffled once to their range, and the first row of
each range goes to the end of the range before it as well.  Ranges are streamed, holding
one earlier row.

Defined cases: a null text is empty; a text without words has one term of its own, so
empty texts are equal to each other and unlike all others; null ids come first; rows of
one id are ordered by a hash of their text; the last row is followed by the first (a
single row by itself); a text of any length is read whole; an empty table gives an empty
result; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import text_of

SAMPLES = 64
#: Terms drawn at a time, and draws that a worker keeps (512 bytes each).
CHUNK, KEPT = 256, 1 << 16
#: Id ranges at most; the driver holds two numbers for each.
MAX_RANGES = 10_000
#: Fewer than this many repeated rows are so frequent that they are sent by broadcast.
HOT_SHARE = 2000
#: Copies of a repeated row that a task writes at a time.
BLOCK = 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from the halves of each 64-bit word."""
    scale = np.float32(2.0**-24)
    return (
        ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale,
        ((x & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale,
    )


_LANES = np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * _STEP


def _draw(terms: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """Draws (terms, ``SAMPLES``) of weighted terms; the least of a column is the sample's.

    The upper half orders as the value does, the lowest 16 bits name (term, t)."""
    words = _mix(terms[:, None] + _LANES)
    a, b = _uniform(words[:, :SAMPLES])
    r = -np.log(a * b)
    a, b = _uniform(words[:, SAMPLES : 2 * SAMPLES])
    log_c = np.log(-np.log(a * b))
    beta, _ = _uniform(words[:, 2 * SAMPLES :])
    t = np.floor(log_weight[:, None] / r + beta)
    value = np.ascontiguousarray(log_c - r * (t - beta) - r).view(np.uint32)
    # The bits of a float order as whole numbers once negative ones are turned round.
    order = np.where(value >> 31, ~value, value | np.uint32(1 << 31))
    drawn = _mix(terms[:, None] ^ (t.astype(np.int64).astype(np.uint64) * _STEP + np.uint64(1)))
    return (order.astype(np.uint64) << np.uint64(32)) | (drawn >> np.uint64(48))


class Draws:
    """Draws of words by their counts, kept in a bounded table."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, SAMPLES), dtype=np.uint64)

    def _learn(self, keys: list[str]) -> None:
        import xxhash

        base = len(self.place)
        while base + len(keys) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        word = [k.rsplit(" ", 1) for k in keys]  # a word holds no space
        terms = np.fromiter((xxhash.xxh64_intdigest(w[0].encode("utf-8", "surrogatepass"), 4) for w in word), np.uint64, len(keys))
        log_weight = np.log1p(np.log(np.array([float(w[1]) if len(w) > 1 else 1.0 for w in word], dtype=np.float32)))
        for at in range(0, len(keys), CHUNK):
            self.table[base + at : base + min(at + CHUNK, len(keys))] = _draw(terms[at : at + CHUNK], log_weight[at : at + CHUNK])
        self.place.update(zip(keys, range(base, base + len(keys)), strict=True))

    def least(self, keys: list[str]) -> np.ndarray:
        """The samples of one text, whose words come as keys of word and count."""
        out = None
        for at in range(0, len(keys), KEPT // 2):
            part = keys[at : at + KEPT // 2]
            new = [k for k in part if k not in self.place]
            if len(self.place) + len(new) > KEPT:
                self.place.clear()
                new = part
            if new:
                self._learn(new)
            found = self.table[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))].min(axis=0)
            out = found if out is None else np.minimum(out, found)
        return (out & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None, draws: Draws) -> np.ndarray:
    """The samples of one whole text."""
    counts = Counter((text or "").split()) or {"": 1}
    return draws.least([w if n == 1 else f"{w} {n}" for w, n in counts.items()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the following text's first as many."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def cut_points(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (id, hash) from sorted quantiles: an id that is m of them gets m bounds, the
    first below all hashes, the others at even steps between them."""
    keys = np.array(cuts, dtype=np.int64)
    distinct, n = np.unique(keys, return_counts=True)
    step = [np.array([(j << 64) // (m + 1) - (1 << 63) if m > 1 else -(1 << 63) for j in range(m)], dtype=np.int64) for m in n.tolist()]
    return np.repeat(distinct, n), np.concatenate(step) if step else keys


def range_of(keys: np.ndarray, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds are at or below each (id, hash)."""
    at, by = bounds
    out = np.searchsorted(at, keys, side="left")
    end = np.searchsorted(at, keys, side="right")
    for k in np.unique(keys[end > out]):
        mine = keys == k
        low, high = np.searchsorted(at, k, side="left"), np.searchsorted(at, k, side="right")
        out[mine] += np.searchsorted(by[low:high], hashes[mine], side="right")
    return out.astype(np.int32)


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (_id, _key, _h, _t) as (_id, _key, _h, _tail, _t) in sorted ranges; tail rows end a range."""
    low = -(1 << 63)
    n = max(1, min(MAX_RANGES, rows.rdd.getNumPartitions()))
    shares = [k / n for k in range(1, n)] or [0.5]
    cuts = rows.agg(F.percentile_approx("_key", shares, 20 * n + 1000).alias("q")).first()["q"] or []
    bounds = cut_points(sorted(cuts) if n > 1 else [])
    total = len(bounds[0]) + 1

    @F.arrow_udf("int")
    def ranged(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(range_of(*(x.to_numpy(zero_copy_only=False) for x in (keys, hashes)), bounds))

    # One row for each range, MAX_RANGES at most: its smallest row.
    least = F.min(F.struct("_key", "_h")).alias("m")
    heads = {r["r"]: (r["m"]["_key"], r["m"]["_h"]) for r in rows.groupBy(ranged("_key", "_h").alias("r")).agg(least).collect()}
    head = np.full((2, total), low, dtype=np.int64)
    before = np.full(total, -1, dtype=np.int32)
    filled = sorted(heads)
    for k, r in enumerate(filled):
        head[:, r], before[r] = heads[r], filled[k - 1]

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        k, h = (x.to_numpy(zero_copy_only=False) for x in (keys, hashes))
        r = range_of(k, h, bounds)
        first = (head[0, r] == k) & (head[1, r] == h)
        sizes = 1 + first.astype(np.int32)
        ends = np.cumsum(sizes)
        flat = np.repeat(r, sizes)
        flat[ends[first] - 1] = before[r][first]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))

    return (
        rows.select("_id", "_key", "_h", "_t", F.posexplode(places("_key", "_h")).alias("_tail", "_range"))
        .repartitionById(total, "_range")
        .sortWithinPartitions("_tail", "_key", "_h")
        .select("_id", "_key", "_h", "_tail", "_t")
    )


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _results(text: str, own: np.ndarray, following: str, after: np.ndarray, draws: Draws) -> tuple:
    """The result columns of a text that is followed by another."""
    changed = edited(text, following)
    other = fingerprint(changed, draws)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    word = lambda x: x.astype(">u2").tobytes().hex()
    return len(text), digest, word(own), word(other), likeness(own, other), likeness(own, after)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range (_id, _key, _h, _tail, _t) -> (_id, _key, _h) and the results."""
    draws, held, done = Draws(), None, False
    for batch in batches:
        out, kinds = [], [batch.schema.field(k).type for k in range(3)]
        for *name, tail, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if done:
                continue
            own = fingerprint(text, draws)
            if held is not None:
                last, last_text, last_own = held
                out.append((*last, *_results(last_text, last_own, text, own, draws)))
            held, done = (name, text, own), bool(tail)
        if out:
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds, *TYPES], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "_key", "_h", *NAMES])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (_key, _h, _t) that are followed by themselves."""
    draws = Draws()
    for batch in batches:
        out = []
        for key, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = fingerprint(text, draws)
            out.append((key, h, *_results(text, own, text, own, draws)))
        if out:
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *TYPES], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "_h", *NAMES])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and three likenesses."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"),
        text_of(text_col).alias("_t"),
    ).withColumn("_h", F.xxhash64("_t"))
    rows = rows.select("_id", "_key", "_h", "_t")
    # Fewer than hot_share groups hold more than a hot_share-th of all rows each.
    counted = rows.groupBy("_key", "_h").agg(F.count("*").alias("_n")).where("_n > 1")
    hot = counted.where(F.col("_n") > F.lit(docs.count() / hot_share)).collect()
    if not hot:
        return with_next(rows).mapInArrow(_pairs, f"_id {kind}, _key long, _h long, {columns}").select(F.col("_id").alias(id_col), *NAMES)
    names = F.broadcast(docs.sparkSession.createDataFrame([(r["_key"], r["_h"], r["_n"]) for r in hot], "_key long, _h long, _n long"))
    # Copies combine before the exchange, one text for a group and task.
    shared = rows.join(names, ["_key", "_h"]).groupBy("_key", "_h").agg(F.first("_id").alias("_id"), F.first("_t").alias("_t"), F.first("_n").alias("_n"))
    one = rows.join(names, ["_key", "_h"], "left_anti").unionByName(shared.select(rows.columns))
    paired = with_next(one).mapInArrow(_pairs, f"_id {kind}, _key long, _h long, {columns}")
    same = F.broadcast(shared.select("_key", "_h", "_t").mapInArrow(_alone, f"_key long, _h long, {columns}"))
    # A group's rows but one, spread as they lie in the input.
    part = rows.select("_id", "_key", "_h").join(names, ["_key", "_h"]).withColumn("_p", F.spark_partition_id())
    per_part = part.groupBy("_key", "_h", "_p").agg(F.first("_id").alias("_id"), F.count("*").alias("_c"))
    first = Window.partitionBy("_key", "_h").orderBy("_p")
    left = per_part.withColumn("_c", F.col("_c") - (F.row_number().over(first) == 1).cast("int"))
    spread = left.where("_c > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / BLOCK))))
    spread = spread.withColumn("_c", F.least(F.lit(BLOCK), F.col("_c") - F.col("_k") * BLOCK)).repartition("_key", "_h", "_p", "_k")
    copies = spread.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c")))).select("_id", "_key", "_h").join(same, ["_key", "_h"])
    return paired.select("_id", *NAMES).unionByName(copies.select("_id", *NAMES)).withColumnRenamed("_id", id_col)


def expected_likeness(a: str, b: str) -> float:
    """Generalised Jaccard similarity of two texts' weights, which samples estimate."""
    wa = {k: 1 + math.log(v) for k, v in (Counter(a.split()) or {"": 1}).items()}
    wb = {k: 1 + math.log(v) for k, v in (Counter(b.split()) or {"": 1}).items()}
    keys = wa.keys() | wb.keys()
    return sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
