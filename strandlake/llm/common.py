"""Shared helpers: ASCII lower-casing, salted group statistics, byte hashing; tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.iteration import discard, stored
from strandlake.session import workers_find_package

__all__ = ["BYTES", "LOWER", "UPPER", "ascii_lower", "discard", "hashed_sample", "is_marked", "marked", "mix64", "powers", "salted_groups", "small_batches", "span_hashes", "spread_join", "stored", "tidy"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows in an Arrow batch, so that a Python worker holds few long texts at once."""
    workers_find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(f):
    """A generator over batches that gives the worker's free memory back to the system at its end.

    Workers stay alive between tasks and stages; what their allocators keep
    would add up beside the JVM's heap.
    """

    @functools.wraps(f)
    def run(batches, *args):
        yield from f(batches, *args)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def salted_groups(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], salt: str, keep: Column | None = None
) -> DataFrame:
    """Statistics of each group of ``keys``, one row per (keys, salt) that occurs.

    ``aggs`` maps an output name to (function, input column), the function one
    of sum, min, max. A first aggregation by (keys, salt) spreads a group that
    holds a large part of the rows over the salts; the second sees at most one
    row per salt, and the result joins back to the rows on (keys, salt)
    without any task receiving the whole group.
    """
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    part = df.groupBy(*keys, salt).agg(*[fn[f](c).alias(n) for n, (f, c) in aggs.items()])
    total = part.groupBy(*keys).agg(
        *[fn[f](n).alias(n) for n, (f, _) in aggs.items()], F.collect_list(salt).alias("_salts")
    )
    if keep is not None:
        total = total.where(keep)
    return total.select(*keys, *aggs, F.explode("_salts").alias(salt))


def hashed_sample(rows: DataFrame, most: int, of: int, key: str = "_id") -> DataFrame:
    """At most ``most`` of ``of`` rows by hash of ``key``, in its order.

    Rows are cut by their hash to about 1.5 times ``most`` first, so what
    tasks hand over does not grow with the rows or the partitions.
    """
    share = min(1.0, 1.5 * most / max(of, 1) + 64 / max(of, 1))
    dice = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(dice < share).orderBy(dice, *rows.columns).limit(most)


HOT = 10_000  # a key with more than one in so many of all rows is joined in parts
PARTS = 64


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per key; ``count`` says how many rows it has) without ``count``, with ``_part``.

    Keys with more than one in HOT of all counted rows, so HOT of them at
    most, are broadcast to mark their rows; their rows are dealt over PARTS by
    a hash of ``spread`` and their groups repeated for each part. ``_part`` is
    the part, 0 for other keys: rows of one key that agree in ``spread`` meet.
    """
    bound = max((groups.agg(F.sum(count)).first()[0] or 0) // HOT, PARTS)
    hot = F.broadcast(groups.where(F.col(count) > bound).select(*keys, F.lit(True).alias("_hot")))
    parts = F.when(F.col(count) > bound, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")).otherwise(0)
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_hot")
    return dealt.join(groups.withColumn("_part", F.explode(parts)).drop(count), [*keys, "_part"])


MAPS, MAP_BITS = 8192, 1 << 15  # bitmaps that mark hashes: 32 MB in all, whatever they mark


def marked(hashes: DataFrame, column: str) -> np.ndarray:
    """Bytes of MAPS * MAP_BITS bits in which each of the hashes has its bit; :func:`is_marked` reads them."""
    at, bit = F.shiftrightunsigned(column, 15).bitwiseAND(F.lit(MAPS - 1)), F.col(column).bitwiseAND(F.lit(MAP_BITS - 1))
    maps = hashes.groupBy(at.alias("at")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    out = np.zeros((MAPS, MAP_BITS // 8), np.uint8)
    for r in maps.toLocalIterator():
        out[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def is_marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned hash is set: always for a marked one, rarely for others unless marks are many."""
    at = (hashes & np.uint64(MAPS * MAP_BITS - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ---- byte hashing in numpy -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


STRETCH = 1 << 18  # bytes hashed at a time, so that a very long text needs no more memory
BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))  # what a byte counts in a second, independent hash


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each ``data[start:end]`` (uint8, spans in rising order): equal bytes, equal hash, wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, side="right")))
        part = data[base : int(ends[j - 1])]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        worth = part.astype(np.uint64) + np.uint64(1) if values is None else values[part]
        np.cumsum(worth * up[: len(part)], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out
