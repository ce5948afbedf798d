"""Source and sink queries; every file they read is written from the given tables."""

from functools import reduce

from pyspark.sql import functions as F

from cartloom.functions.scalars import with_row
from cartloom.functions.staging import new_path
from cartloom.operators import customers
from cartloom.plans.catalog import query
from cartloom.plans.queries_cleaning import _plain
from cartloom.plans.queries_customers import score_bands
from cartloom.sources import files, tables
from cartloom.sources.fixtures import INVOICE_COLUMNS


@query("csv_scan", 'SELECT * REPLACE ("Price"::DOUBLE AS "Price") FROM raw')
def csv_scan(m):
    return _plain(files.typed_invoice_lines(files.csv_scan(m.spark, m.csv_folder(";"))))


_CELLS = "+".join(f'count("{c}")' for c in INVOICE_COLUMNS)


@query("csv_detect_separator", f"SELECT s AS written_with, s AS detected, lines, 8 AS columns, cells FROM (VALUES (','),(';'),(chr(9)),('|')) v(s), (SELECT count(*) AS lines, {_CELLS} AS cells FROM raw)")
def csv_detect_separator(m):
    """What each file was written with, what was detected, and what a scan with it finds."""
    parts = []
    for written in files.SEPARATORS:
        found = files.detect_separator(m.spark, m.csv_folder(written))
        scanned = files.csv_scan(m.spark, m.csv_folder(written), "utf-8", found)
        cells = sum((F.count(c) for c in scanned.columns), F.lit(0))
        parts.append(scanned.agg(F.count(F.lit(1)).alias("lines"), cells.alias("cells")).select(
            F.lit(written).alias("written_with"), F.lit(found).alias("detected"), "lines", F.lit(len(scanned.columns)).alias("columns"), "cells"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("csv_detect_encoding", "SELECT s AS written_with, s AS detected, lines, lines AS decoded_lines FROM (VALUES ('utf-8'),('iso-8859-1')) v(s), (SELECT count(*) AS lines FROM raw)")
def csv_detect_encoding(m):
    """What each file was written in, what was detected, and how many lines that decodes."""
    parts = []
    for written, path in {"utf-8": m.csv_folder(","), "iso-8859-1": m.latin_folder}.items():
        found = files.detect_encoding(m.spark, path)
        scanned = files.csv_scan(m.spark, path, found)
        lines, bad = F.count(F.lit(1)), files.unreadable_lines(scanned)
        parts.append(scanned.agg(lines.alias("lines"), (lines - bad).alias("decoded_lines")).select(
            F.lit(written).alias("written_with"), F.lit(found).alias("detected"), "lines", "decoded_lines"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("file_catalog_values")
def file_catalog_values(m):
    return files.file_catalog(m.spark, m.csv_folder(",")).select("file", "length")


@query("file_catalog", "SELECT count(*) AS lines, true AS every_byte_listed, true AS names_ordered FROM raw")
def file_catalog(m):
    """The listed files hold all lines, each with a header line, and their bytes are those listed."""
    listed = files.file_catalog(m.spark, m.csv_folder(","))
    text = m.spark.read.text(m.csv_folder(","))
    bytes_read = text.agg(F.count(F.lit(1)).alias("_lines"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    names = F.collect_list("path")
    return listed.agg(F.count(F.lit(1)).alias("_files"), F.sum("length").alias("_length"), names.alias("_names")).transform(with_row, bytes_read).select(
        (F.col("_lines") - F.col("_files")).alias("lines"),
        (F.col("_length") == F.col("_bytes")).alias("every_byte_listed"),
        (F.col("_names") == F.array_sort("_names")).alias("names_ordered"),
    )


_AS_TEXT = ",".join(f'"{c}"::VARCHAR AS "{"Customer ID" if c == "CustomerID" else c}"' for c in INVOICE_COLUMNS)
_TEXT_ORDER = ",".join(f'"{"Customer ID" if c == "CustomerID" else c}" NULLS FIRST' for c in INVOICE_COLUMNS)


@query("file_info_preview", f"SELECT *, true AS has_size, true AS has_time FROM (SELECT {_AS_TEXT} FROM raw) ORDER BY {_TEXT_ORDER} LIMIT 5")
def file_info_preview(m):
    """The first rows of the file, and whether its size and time are there."""
    shown = files.file_preview(m.spark, m.csv_folder(","))
    return shown.select(*[c for c in shown.columns if c not in ("size_mb", "modified")], (F.col("size_mb") >= 0).alias("has_size"), F.col("modified").isNotNull().alias("has_time"))


@query("load_metrics_values")
def load_metrics_values(m):
    return files.load_metrics(m.spark, m.csv_folder("\t"))


@query("load_metrics", "SELECT count(*) AS rows, 8 AS columns, 'utf-8' AS encoding, 0 AS unreadable_lines, true AS size_is_listed, true AS time_taken FROM raw")
def load_metrics(m):
    """The figures of a load that SQL knows, and whether the others hold."""
    size = files.file_catalog(m.spark, m.csv_folder("\t")).agg((F.sum("length") / F.lit(1024.0 * 1024.0)).alias("_listed"))
    return files.load_metrics(m.spark, m.csv_folder("\t")).transform(with_row, size).select(
        "rows", "columns", "encoding", "unreadable_lines", (F.col("file_size_mb") == F.col("_listed")).alias("size_is_listed"), (F.col("loading_seconds") > 0).alias("time_taken")
    )


@query("scan_cache", 'SELECT "Country", count(*) AS lines, true AS served_from_cache FROM raw GROUP BY 1')
def scan_cache(m):
    """Lines per country from a cached scan, read twice and reloaded once."""
    cache = files.ScanCache(m.spark)
    first = cache.load(m.csv_folder("|"))
    again = cache.load(m.csv_folder("|"))
    reloaded = cache.load(m.csv_folder("|"), force=True)
    same = F.lit(first is again)
    return reloaded.groupBy("Country").agg(F.count(F.lit(1)).alias("lines")).withColumn("served_from_cache", same)


@query(
    "named_sources",
    """SELECT 'main' AS source, count(*) AS rows FROM raw UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'products', count(*) FROM part
UNION ALL SELECT 'orders', count(*) FROM orders""",
)
def named_sources(m):
    """Files of the raw folder read by their registered names."""
    registry = m.named_sources
    parts = [
        registry.read(m.spark, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name in registry.FILES
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "table_sink_clean",
    """SELECT coalesce(year("InvoiceDate"),-1) AS year, coalesce(month("InvoiceDate"),-1) AS month, count(*) AS lines, sum("Total_Amount")::DOUBLE AS amount FROM cleaned GROUP BY 1,2""",
)
def table_sink_clean(m):
    """Lines and amount of every partition that was written."""
    parts = [F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("year", "month")]
    return (
        tables.read_clean(m.spark, m.clean_table)
        .groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("Total_Amount").cast("double").alias("amount"))
    )


@query(
    "table_scan_clean",
    """SELECT * REPLACE (strftime("InvoiceDate",'%Y-%m-%d %H:%M:%S') AS "InvoiceDate", "Price"::DOUBLE AS "Price", "Total_Amount"::DOUBLE AS "Total_Amount"),
 year("InvoiceDate") AS year, month("InvoiceDate") AS month FROM cleaned""",
)
def table_scan_clean(m):
    return _plain(tables.read_clean(m.spark, m.clean_table))


@query("segment_sink", "SELECT customer_id, recency, frequency, monetary, target FROM targets")
def segment_sink(m):
    path = new_path(m.spark, "segments")
    tables.write_segments(customers.priority_segments(score_bands(m)), path)
    return m.spark.read.parquet(path)


@query("segment_scan_tolerant", "SELECT customer_id, recency, frequency, monetary, target FROM targets WHERE target IN ('CHAMPIONS','HIGH_VALUE')")
def segment_scan_tolerant(m):
    path = new_path(m.spark, "segments")
    tables.write_segments(customers.priority_segments(score_bands(m)), path)
    return tables.read_segments(m.spark, path, ["CHAMPIONS", "HIGH_VALUE", "NEVER_WRITTEN"])
