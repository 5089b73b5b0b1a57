"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with `stem` that `df` does not have, compared without case."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def hash_sample(df: DataFrame, by: Column, most: int) -> DataFrame:
    """At most `most` rows of `df`, those whose hash of `by` is smallest; the same rows however `df` is partitioned.

    Only about as many rows as asked for are sorted: the rest is filtered out by its hash first.
    """
    n = df.count()
    h = fresh(df, "_hash")
    rows = df.withColumn(h, F.xxhash64(by))
    if n > 2 * most:
        share = min(1.0, (1.5 * most + 100) / n)
        rows = rows.where(F.col(h) < int(-(2**63) + share * 2**64) if share < 1 else F.lit(True))
    return rows.orderBy(h).limit(most).drop(h)


def best_rows(df: DataFrame, score: str, most: int, steps: int = 16) -> DataFrame:
    """The rows with the largest `score`, at most `most`: whole steps of 1/`steps`, so that a count of steps is all the driver sees."""
    step = F.floor(F.col(score) * steps)
    counts = df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    total, last = 0, None
    for r in counts:
        total += r["n"]
        if total > most:
            break
        last = r["s"]
    return df.where(step >= last) if last is not None else df.where(F.lit(False))


def without(rows: DataFrame, others: DataFrame, key: str, most_bits: int = 1 << 31) -> DataFrame:
    """`rows` whose `key` (not null) is not among those of `others`; most rows are not shuffled.

    The keys of `others` are marked by hash in bitmaps of 32768 bits, 64 bits a key and `most_bits` (256 MB) in
    all at most, which are broadcast. Rows whose bit is not set stay where they are; the rest is joined exactly.
    """
    others = others.select(key).distinct()
    bits = min(most_bits, -(-max(1, 64 * others.count()) // 32768) * 32768)
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    bucket, bitmap = fresh(rows, "_bucket"), fresh(rows, "_bitmap")
    marks = others.groupBy(F.floor(slot / 32768).alias(bucket)).agg(F.bitmap_construct_agg((slot % 32768).cast("long")).alias(bitmap))
    place = (slot % 32768).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) > 0, F.lit(False))
    told = rows.withColumn(bucket, F.floor(slot / 32768)).join(F.broadcast(marks), bucket, "left").withColumn(bitmap, marked)
    same = [F.col(f"`{c}`") for c in rows.columns]
    return told.where(~F.col(bitmap)).select(*same).unionByName(told.where(bitmap).select(*same).join(others, key, "left_anti").select(*same))


def give_back() -> None:
    """Return freed memory to the system; called where a task ends, as Python workers live on for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass
