"""One-row results as scalar subqueries.

Totals, dates and fences are aggregates of one row.  Spark evaluates them
once as an uncorrelated subquery and treats the result as a constant, so the
large side is neither joined nor moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.staging import stage

_ROW = "_one_row"


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame to every row of ``df``."""
    packed = one_row.select(F.struct(*one_row.columns).alias(_ROW)).scalar()
    names = one_row.columns
    return df.withColumn(_ROW, packed).select(
        *df.columns, *[F.col(_ROW).getField(c).alias(c) for c in names]
    )


def with_distinct_counts(per: DataFrame, rows: DataFrame, counted: dict[str, Column], key: str = "customer_id") -> DataFrame:
    """Add the distinct values of ``rows`` that each key of ``per`` has, null aside.

    A distinct count in one aggregate with sums makes Spark keep every sum once for each (key, value),
    and send every row once more for each further count.  Here each goes by itself, two columns wide,
    and is written, so that the shuffle files of no two counts lie on the disks together.
    """
    for name, value in counted.items():
        per = per.join(stage(rows.groupBy(key).agg(F.count_distinct(value).alias(name)), "distinct"), key)
    return per
