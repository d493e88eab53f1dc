"""Keyed Feistel permutation with cycle walking over row numbers 0..n-1.

The domain is the grid a x b with a = ceil(sqrt(n)) and b = ceil(n / a), so at
most a - 1 of its cells lie outside 0..n-1.  A round adds a hash of one half to
the other half, modulo that half's size; an even number of rounds alternates.
A value outside 0..n-1 walks on through the permutation until it falls inside:
at most ``a*b - n`` steps, because a walk never meets an outside cell twice.

``permute`` builds the Spark expression (JVM only); ``permute_number`` is the
same function on Python integers, for readers that locate a row without Spark, and
``permute_array`` on arrays, for workers that number rows.
"""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of the walk that are unrolled before the full proven bound is taken.
NEAR_STEPS = 6


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n))
    if a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _mix(value: Column, rnd: int, key: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), F.lit(rnd), value), F.lit(size).cast("long"))


def _round(rnd: int, a: int, b: int, key: int):
    """Round ``rnd`` on a struct of the halves; even rounds change the left half."""
    size = a if rnd % 2 == 0 else b

    def change(half: Column, other: Column) -> Column:
        return F.pmod(half + _mix(other, rnd, key, size), F.lit(size).cast("long"))

    if rnd % 2 == 0:
        return lambda s: F.struct(change(s["l"], s["r"]).alias("l"), s["r"].alias("r"))
    return lambda s: F.struct(s["l"].alias("l"), change(s["r"], s["l"]).alias("r"))


def _once(x: Column, a: int, b: int, key: int) -> Column:
    """One pass of the network; halves are packed as left * b + right.

    Each round is a ``transform`` over a one-element array, which binds the
    halves to a variable, so the expression grows linearly with the rounds.
    """
    state = F.array(F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r")))
    for rnd in range(ROUNDS):
        state = F.transform(state, _round(rnd, a, b, key))
    return F.element_at(F.transform(state, lambda s: s["l"] * F.lit(b).cast("long") + s["r"]), 1)


def permute(number: Column, n: int, key: int) -> Column:
    """The place of row ``number`` in the keyed order of ``n`` rows."""
    a, b = _sides(n)

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            start,
            lambda acc, _: F.when(acc < n, acc).otherwise(_once(acc, a, b, key)),
        )

    number = number.cast("long")
    out = walk(_once(number, a, b, key), NEAR_STEPS)
    if a * b - n > NEAR_STEPS:
        bound = a * b - n
        out = F.element_at(
            F.transform(F.array(out), lambda v: F.when(v < n, v).otherwise(walk(v, bound))), 1
        )
    return out


def _hash(key: int, rnd: int, value: int) -> int:
    """xxhash64(int key, int round, long value) as Spark chains it, signed."""
    import xxhash

    seed = 42
    for kind, x in (("<i", key), ("<i", rnd), ("<q", value)):
        seed = xxhash.xxh64_intdigest(struct.pack(kind, x), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hash_array(key: int, rnd: int, values: np.ndarray) -> np.ndarray:
    """``_hash`` of whole numbers from 0, as signed 64-bit integers."""
    import xxhash

    seed = 42
    for x in (key, rnd):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=seed)
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    start = np.uint64((seed + int(_P[4]) + 8) & 0xFFFFFFFFFFFFFFFF)
    h = start ^ (turn(values.astype(np.uint64) * _P[1], 31) * _P[0])
    h = turn(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def permute_array(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """``permute`` for an array of row numbers."""
    a, b = _sides(n)
    out = np.asarray(numbers, dtype=np.int64).copy()
    live = np.arange(len(out))
    while len(live):
        left, right = np.divmod(out[live], b)
        for rnd in range(ROUNDS):
            if rnd % 2 == 0:
                left = (left + _hash_array(key, rnd, right) % a) % a
            else:
                right = (right + _hash_array(key, rnd, left) % b) % b
        out[live] = left * b + right
        live = live[out[live] >= n]
    return out


def permute_number(number: int, n: int, key: int) -> int:
    """``permute`` for one Python integer."""
    a, b = _sides(n)
    x = number
    while True:
        left, right = divmod(x, b)
        for rnd in range(ROUNDS):
            if rnd % 2 == 0:
                left = (left + _hash(key, rnd, right) % a) % a
            else:
                right = (right + _hash(key, rnd, left) % b) % b
        x = left * b + right
        if x < n:
            return x


def unpermute_number(place: int, n: int, key: int) -> int:
    """The row number that stands at ``place``: the inverse of ``permute_number``."""
    a, b = _sides(n)
    x = place
    while True:
        left, right = divmod(x, b)
        for rnd in reversed(range(ROUNDS)):
            if rnd % 2 == 0:
                left = (left - _hash(key, rnd, right) % a) % a
            else:
                right = (right - _hash(key, rnd, left) % b) % b
        x = left * b + right
        if x < n:
            return x
