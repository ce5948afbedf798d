"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions import staging
from cartloom.functions.staging import shuffles_go

__all__ = ["stage", "shuffles_go", "table", "small_batches", "text_rows", "connected_components", "sha256_of_sorted", "is_small"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again; the shuffle files behind it go at once.

    The driver's collector is asked to look as well, for what queries other than written ones have left.
    """
    written = staging.stage(df, label)
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def small_batches(spark: SparkSession) -> None:
    """Python workers get batches bounded in rows and in bytes, so that long texts don't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_rows(batches: Iterable[pa.RecordBatch], size: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their ``text`` as bytes (null: empty), of about ``size`` bytes or one row."""
    for batch in batches:
        column = batch.column("text")
        lengths = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
        begin, total = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > size:
                yield _slice(batch, begin, i)
                begin, total = i, 0
            total += n
        if begin < len(lengths):
            yield _slice(batch, begin, len(lengths))


def _slice(batch: pa.RecordBatch, begin: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(begin, end - begin)
    text = part.column("text")
    kind = pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()
    return part, [b"" if t is None else t for t in text.cast(kind).to_pylist()]


def is_small(df: DataFrame, most_rows: int = 100_000) -> bool:
    """Whether ``df`` has at most so many rows, counted before anything is broadcast."""
    return df.limit(most_rows + 1).count() <= most_rows


def sha256_of_sorted(ids: Column) -> Column:
    """Hex digest of the ids as strings, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ","), 256)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(v, component) of all vertices in ``edges`` (a, b); the component is its smallest vertex.

    Alternating large and small stars: every round is two grouped minima and
    two joins, of as many rows as edges at most, and is written to the shared
    folder.  The number of rounds follows the logarithm of the longest path.
    It ends when every vertex has one edge to a smaller one and the large star
    moves none of them: then all of them lead to a smallest vertex.
    """
    found = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), label)
    rows = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")]
    before = None
    while True:
        both = found.select("u", "v").unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), label)
        after = large.agg(*rows, F.lit(False).alias("moved")).first()
        if not after["n"] or after == before:
            break
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        moved = large.join(least.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        both = least.withColumn("moved", F.lit(False)).unionByName(moved.withColumn("moved", F.lit(True)))
        found = stage(both.groupBy("u", "v").agg(F.max("moved").alias("moved")), label)
        before = found.agg(*rows, F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
    roots = found.select(F.col("v").alias("u"), "v").distinct()
    return found.select("u", "v").unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("component"))
