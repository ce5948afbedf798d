"""Reproducible shuffle of all rows into shards of equal counts (law ``rows``).

Method: the rows get global numbers in the order of (doc_id, checksum, size);
a Feistel network permutes the numbers, and a result beyond the last number is
sent through the network again until it falls inside (cycle walking).  The
permuted number p gives shard ``p mod shards`` and slot ``p div shards``, so
that shard counts differ by one at most and slots have no gaps.  Given the
key, the shard and slot of any row number can be computed, and the other way.

The network works on pairs of residues (a, b) with a * b just above the number
of rows, so a step rarely leaves the range.  How often it must be repeated is
found exactly beforehand by following the numbers beyond the range, about the
square root of the row count of them.

A null text has 0 bytes and checksum 0.  Equal rows get numbers next to each
other; which of them comes first makes no difference to the result.  Rows with
a null doc_id come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stage

ROUNDS = 4
KEY = 20240229


def numbered(rows: DataFrame, order: list[str], label: str = "numbered") -> tuple[DataFrame, int]:
    """``rows`` with their global number ``row`` from 0 in the given order, and their count.

    The rows are range-sorted and written with their place in their task's
    part; only the count of each part is added up centrally.  A place in the
    input breaks ties, so equal rows spread over several parts.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = stage(placed, label)
    sizes = [(r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]
    starts, total = [], 0
    for part, n in sizes:  # one entry for each task, not for each row
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    out = placed.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_start") + F.col("_place"))
    return out.drop("_part", "_place", "_start"), total


def halves(n: int) -> tuple[int, int]:
    """Residues (a, b) whose pairs number at least n, and fewer than n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole quotient of a number not below 0, without going through doubles."""
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def feistel(x: Column, n: int, key: int = KEY) -> Column:
    """One pass of the network over 0 <= x < a * b."""
    a, b = halves(n)
    left = F.pmod(x, F.lit(a))
    right = _div(x, a)
    for r in range(ROUNDS):
        left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key), F.lit(2 * r)), F.lit(a)), F.lit(a))
        right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key), F.lit(2 * r + 1)), F.lit(b)), F.lit(b))
    return right * F.lit(a) + left


def walk_length(spark: SparkSession, n: int, key: int = KEY) -> int:
    """The most passes any number below n needs to come out below n."""
    a, b = halves(n)
    beyond, steps = spark.range(n, a * b).select(F.col("id").alias("x")), 1
    while True:
        beyond = stage(beyond.select(feistel(F.col("x"), n, key).alias("x")).where(F.col("x") >= n), "walk")
        if beyond.isEmpty():
            return steps + 1 if a * b > n else 1
        steps += 1


def permuted(df: DataFrame, n: int, steps: int, key: int = KEY) -> DataFrame:
    """``df`` (row) with the permuted number ``p``."""
    df = df.withColumn("p", feistel(F.col("row"), n, key))
    for _ in range(steps - 1):
        df = df.withColumn("p", F.when(F.col("p") < n, F.col("p")).otherwise(feistel(F.col("p"), n, key)))
    return df


def feistel_shards(docs: DataFrame, shards: int = 16, key: int = KEY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    with_row, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    out = permuted(with_row, n, walk_length(docs.sparkSession, n, key) if n else 1, key)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("p"), F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
