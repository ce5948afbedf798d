"""The retail views the operators read, derived from the given tables.

The tables hold clean orders; the invoice-line view injects the faults a raw
export has (missing ids, return invoices, zero prices, unreadable dates,
repeated rows) by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVOICE_COLUMNS = [
    "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines as exported: eight columns, dates still text."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    headers = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    order = F.col("o_orderkey")
    is_return = (F.col("l_returnflag") == "R") & (order % 3 == 0)
    minutes = F.make_dt_interval(mins=((order * 37) % 1440).cast("int"))
    once = joined.select(
        F.when(order % 1009 == 0, F.lit(None))
        .when(is_return, F.concat(F.lit("C"), order.cast("string")))
        .otherwise(order.cast("string"))
        .alias("Invoice"),
        F.when(F.col("p_partkey") % 200 == 0, F.lit("POST"))
        .otherwise(F.col("p_partkey").cast("string"))
        .alias("StockCode"),
        F.when(order % 97 != 0, F.col("p_name")).alias("Description"),
        F.when(is_return, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
        F.when(order % 211 == 0, F.lit("not a date"))
        .otherwise(F.date_format(F.col("o_orderdate") + minutes, "M/d/yyyy H:mm"))
        .alias("InvoiceDate"),
        F.when((order + F.col("l_linenumber")) % 83 == 0, F.lit(0))
        .otherwise(F.col("l_extendedprice"))
        .cast("decimal(18,2)")
        .alias("Price"),
        F.when(order % 5 != 0, F.col("c_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )
    # One pass emits the repeated rows, so the join runs once.
    copies = F.when(F.col("CustomerID") % 31 == 0, 2).otherwise(1)
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
    )


def orders_lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one row per product line (adds product_id and quantity)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("view", "click", "signup"))
        .select(
            F.col("event_id").alias("touch_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("channel"),
        )
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("conversion_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").cast("decimal(18,2)").alias("revenue"),
        )
    )
