"""Daily cleaning as a file stream.

The same cleaning functions run on the files that arrived since the last
run.  Each run takes what is there and stops, as a nightly job would; the
stream's own checkpoint remembers which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cartloom.operators import cleaning


def clean_arrivals(lines: DataFrame) -> DataFrame:
    """The row-wise part of the cleaning: no state, so it runs the same on a stream."""
    return (
        lines.transform(cleaning.clean_missing)
        .transform(cleaning.parse_dates)
        .transform(cleaning.detect_returns)
        .transform(cleaning.apply_business_rules)
        .transform(cleaning.narrow_types)
    )


def start_cleaning(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Clean all files not seen before and append them to ``target``."""
    arrivals = spark.readStream.schema(schema).parquet(source)
    return (
        clean_arrivals(arrivals)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_cleaned(spark: SparkSession, target: str) -> DataFrame:
    """The appended lines without repeats, which may have arrived in different files."""
    return cleaning.drop_duplicates(spark.read.parquet(target))
