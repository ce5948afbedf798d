"""CSV sources: scanning, sniffing, catalogue and load figures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.scalars import with_row

#: Separators in order of preference.
SEPARATORS = [",", ";", "\t", "|"]
CORRUPT = "_corrupt_record"
CSV_HEADER = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


class NamedSources:
    """Registry of the folders and files a deployment reads."""

    # Folder and file names.
    FOLDERS = {"raw": "raw", "processed": "processed", "external": "external"}
    FILES = {
        "main": "ecommerce_data.csv",
        "customers": "customers.csv",
        "products": "products.csv",
        "orders": "orders.csv",
    }

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def folder(self, name: str) -> str:
        return f"{self.root}/{self.FOLDERS[name]}"

    def path(self, name: str, folder: str = "raw") -> str:
        return f"{self.folder(folder)}/{self.FILES[name]}"

    def read(self, spark: SparkSession, name: str, **options) -> DataFrame:
        return csv_scan(spark, self.path(name), **options)


def detect_separator(spark: SparkSession, path: str) -> str:
    """The candidate seen most often in the first line; ties go to the earlier one."""
    first = spark.read.text(path).limit(1)
    counts = [(F.length("value") - F.length(F.replace(F.col("value"), F.lit(s), F.lit("")))).alias(f"n{i}") for i, s in enumerate(SEPARATORS)]
    row = first.select(*counts).first()
    if row is None:
        return SEPARATORS[0]
    return SEPARATORS[max(range(len(SEPARATORS)), key=lambda i: (row[i], -i))]


#: Lines at the start of each split that the encoding is judged by.
SAMPLE_LINES = 10_000
#: What a reader puts where bytes fit no character.
UNREADABLE = "\ufffd"


def _first_lines(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows and bad rows among the first ``limit`` of a split; the rest of it is not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = bad = 0
        for batch in batches:
            part = batch.slice(0, limit - lines)
            lines += part.num_rows
            bad += int(part.column("bad").to_numpy(zero_copy_only=False).sum())
            if lines >= limit:
                break
        yield pa.record_batch({"lines": pa.array([lines], pa.int64()), "bad": pa.array([bad], pa.int64())})

    return run


def detect_encoding(spark: SparkSession, path: str, sample_lines: int | None = SAMPLE_LINES) -> str:
    """utf-8 when the sampled lines are valid utf-8, else iso-8859-1.

    Each split of the files is read up to ``sample_lines``, so the bytes
    looked at are bounded by the number of splits; None reads every line and stops at the first
    bad one.  Name the encoding to skip it; :func:`unreadable_lines` tells
    afterwards what an encoding did not fit.
    """
    lines = spark.read.text(path).select((~F.is_valid_utf8("value")).alias("bad"))
    if sample_lines is None:
        return "utf-8" if lines.where("bad").isEmpty() else "iso-8859-1"
    found = lines.mapInArrow(_first_lines(sample_lines), "lines bigint, bad bigint").agg(F.sum("bad").alias("bad"))
    return "iso-8859-1" if found.first()["bad"] else "utf-8"


def unreadable_lines(scanned: DataFrame) -> Column:
    """Number of lines with bytes that the encoding they were read with has no character for."""
    bad = F.lit(False)
    for c in scanned.columns:
        bad = bad | F.coalesce(F.col(c).contains(UNREADABLE), F.lit(False))
    return F.count(F.when(bad, 1))


def csv_scan(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    separator: str | None = None,
    keep_corrupt: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """All columns as text, exactly as written; short or long lines are kept.

    A doubled quote inside quotes is a quote.  ``multi_line`` allows line
    breaks inside quotes; a file is then read by one task.
    """
    try:
        encoding = encoding or detect_encoding(spark, path)
        separator = separator or detect_separator(spark, path)
        reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding)
        reader = reader.option("escape", '"').option("multiLine", multi_line)
        names = reader.csv(path).columns
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    fields = [T.StructField(n, T.StringType()) for n in names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("mode", "PERMISSIVE").option("enforceSchema", True).schema(T.StructType(fields)).csv(path)


def typed_invoice_lines(raw: DataFrame) -> DataFrame:
    """Cast scanned text to the invoice-line types; what does not fit becomes null."""
    casts: dict[str, Column] = {
        "Quantity": F.col("Quantity").try_cast("int"),
        "Price": F.col("Price").try_cast("decimal(18,4)"),
        "CustomerID": F.col("Customer ID").try_cast("double").try_cast("bigint"),
    }
    names = ["CustomerID" if c == "Customer ID" else c for c in CSV_HEADER]
    return raw.select(*[casts.get(c, F.col(c)).alias(c) for c in names])


def write_csv(lines: DataFrame, path: str, separator: str = ",", encoding: str = "utf-8") -> None:
    named = lines.withColumnRenamed("CustomerID", "Customer ID")
    writer = named.write.option("header", True).option("sep", separator).option("encoding", encoding).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def file_catalog(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Files below a folder, by name; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "path", "length", "modificationTime").orderBy("path")


def file_preview(spark: SparkSession, path: str, n: int = 5, **options) -> DataFrame:
    """Size and time of the source next to its first rows in the order of all columns."""
    info = file_catalog(spark, path).agg(
        F.round(F.sum("length") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"), F.max("modificationTime").alias("modified")
    )
    scanned = csv_scan(spark, path, **options)
    return scanned.orderBy(*[F.col(c).asc_nulls_first() for c in scanned.columns]).limit(n).transform(with_row, info)


def load_metrics(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """Rows, columns, megabytes, seconds and encoding of one load.

    The load parses every line and column; it is timed from the first look at
    the files to the last row, and counts its rows on the way.
    """
    began = time.perf_counter()
    encoding = encoding or detect_encoding(spark, path)
    # observed in a session of its own: one that has observed can no longer ship models it has fitted
    scanned = csv_scan(spark.newSession(), path, encoding, separator)
    seen = Observation()
    counted = scanned.observe(seen, F.count(F.lit(1)).alias("rows"), unreadable_lines(scanned).alias("unreadable"))
    counted.write.format("noop").mode("overwrite").save()
    seconds, found = time.perf_counter() - began, seen.get
    size = file_catalog(spark, path).agg((F.sum("length") / F.lit(1024.0 * 1024.0)).alias("file_size_mb"))
    return size.select(
        F.lit(found["rows"]).cast("bigint").alias("rows"),
        F.lit(len(scanned.columns)).alias("columns"),
        "file_size_mb",
        F.lit(seconds).alias("loading_seconds"),
        F.lit(encoding).alias("encoding"),
        F.lit(found["unreadable"]).cast("bigint").alias("unreadable_lines"),
    )


def listing(spark: SparkSession, path: str) -> tuple:
    """What tells one state of the files below ``path`` from another: how many, their length, latest time and a hash of all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")),
    )
    return tuple(row.first())


class ScanCache:
    """Scans kept per (path, encoding, separator) as long as the files stay as they are; ``force`` drops and rereads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kept: dict[tuple[str, str | None, str | None], tuple[tuple, DataFrame]] = {}

    def load(self, path: str, encoding: str | None = None, separator: str | None = None, force: bool = False) -> DataFrame:
        key = (path, encoding, separator)
        try:
            now = listing(self.spark, path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(path) from error
            raise
        if key in self._kept and (force or self._kept[key][0] != now):
            self._kept.pop(key)[1].unpersist()
        if key not in self._kept:
            self._kept[key] = now, csv_scan(self.spark, path, encoding, separator).persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[key][1]
