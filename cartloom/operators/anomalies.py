"""Unusual orders, products, customers and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.numeric import dbl, pct, ratio, round_even, total
from cartloom.functions.ordering import exact_quantiles
from cartloom.functions.scalars import with_distinct_counts, with_row
from cartloom.functions.staging import stage
from cartloom.operators.sales import AT, buyers, dated, invoices, revenue

FENCE = 1.5
Z_LIMIT = 2.0
FOREST_FEATURES = ["total_spent", "avg_transaction", "transactions", "products", "items_per_order"]


def order_values(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("Invoice").isNotNull())
        .groupBy("Invoice")
        .agg(
            total("Total_Amount").cast("double").alias("order_value"),
            F.sum("Quantity").alias("items"),
            F.count_distinct("StockCode").alias("products"),
        )
    )


def order_fences(orders: DataFrame) -> DataFrame:
    q = exact_quantiles(orders, {"v": F.col("order_value")}, [0.25, 0.75])
    iqr = F.col("v_q1") - F.col("v_q0")
    return q.select(
        (F.col("v_q0") - F.lit(FENCE) * iqr).alias("lower_fence"),
        (F.col("v_q1") + F.lit(FENCE) * iqr).alias("upper_fence"),
    )


def order_value_anomalies(lines: DataFrame) -> DataFrame:
    """Invoices outside the quartile fences on either side."""
    orders = stage(order_values(lines), "orders")
    value = F.col("order_value")
    return (
        orders.transform(with_row, order_fences(orders))
        .where((value < F.col("lower_fence")) | (value > F.col("upper_fence")))
        .select(
            "Invoice",
            "order_value",
            "items",
            "products",
            round_even("lower_fence", 4).alias("lower_fence"),
            round_even("upper_fence", 4).alias("upper_fence"),
        )
    )


def order_value_statistics(anomalies: DataFrame) -> DataFrame:
    """Count, mean, median and spread of the unusual orders."""
    median = exact_quantiles(anomalies, {"v": F.col("order_value")}, [0.5])
    sums = anomalies.agg(
        F.count(F.lit(1)).alias("orders"),
        round_even(F.avg("order_value"), 2).alias("mean_value"),
        round_even(F.stddev_samp("order_value"), 2).alias("std_value"),
    )
    return sums.transform(with_row, median).select(
        "orders", "mean_value", round_even("v_q0", 2).alias("median_value"), "std_value"
    )


def product_price_anomalies(lines: DataFrame) -> DataFrame:
    """Products whose price varies by more than its mean, or ranges over twice its mean."""
    price = dbl("Price")
    per = (
        lines.where(F.col("StockCode").isNotNull())
        .groupBy("StockCode")
        .agg(
            total("Total_Amount").cast("double").alias("total_revenue"),
            F.sum("Quantity").alias("total_quantity"),
            ratio(F.sum("Price"), F.count("Price")).alias("_mean"),
            F.stddev_samp(price).alias("_std"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
            buyers().alias("unique_customers"),
        )
        .withColumn("_variation", ratio("_std", "_mean"))
        .withColumn("price_range", F.col("max_price") - F.col("min_price"))
    )
    return per.where((F.col("_variation") > 1.0) | (F.col("price_range") > F.col("_mean") * 2)).select(
        "StockCode",
        "total_revenue",
        "total_quantity",
        round_even("_mean", 4).alias("avg_price"),
        round_even("_std", 3).alias("price_std"),
        "min_price",
        "max_price",
        "unique_customers",
        round_even("_variation", 4).alias("price_variation"),
        round_even("price_range", 2).alias("price_range"),
    )


def customer_anomaly_features(lines: DataFrame) -> DataFrame:
    known = lines.where(F.col("CustomerID").isNotNull())
    per = known.groupBy("CustomerID").agg(
        total("Total_Amount").cast("double").alias("total_spent"),
        round_even(ratio(F.sum("Total_Amount"), F.count("Total_Amount")), 4).alias("avg_transaction"),
        F.count("Total_Amount").alias("transactions"),
        F.sum("Quantity").alias("items"),
    )
    counted = with_distinct_counts(per, known, {"orders": F.col("Invoice"), "products": F.col("StockCode")}, "CustomerID")
    return (
        counted.select("CustomerID", "total_spent", "avg_transaction", "transactions", "orders", "products", "items")
        .withColumn("items_per_order", round_even(ratio("items", "orders"), 4))
        .withColumn("products_per_order", round_even(ratio("products", "orders"), 4))
    )


def daily_anomalies(facts: DataFrame) -> DataFrame:
    """Days whose revenue or order count lies over two population deviations from the mean."""
    days = (
        dated(facts)
        .groupBy(F.to_date(AT).alias("_day"))
        .agg(revenue().alias("revenue"), invoices().alias("orders"), buyers().alias("customers"))
    )
    spread = days.agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("revenue", "orders") for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    )
    z = {c: F.abs(ratio(F.col(c) - F.col(f"_avg_{c}"), f"_std_{c}")) for c in ("revenue", "orders")}
    return (
        days.transform(with_row, spread)
        .where((z["revenue"] > Z_LIMIT) | (z["orders"] > Z_LIMIT))
        .select(
            F.date_format("_day", "yyyy-MM-dd").alias("day"),
            "revenue",
            "orders",
            "customers",
            round_even(z["revenue"], 4).alias("revenue_z"),
            round_even(z["orders"], 4).alias("orders_z"),
        )
    )


def anomaly_revenue_impact(lines: DataFrame) -> DataFrame:
    unusual = order_value_anomalies(lines).agg(
        F.count(F.lit(1)).alias("anomalous_orders"),
        total(F.col("order_value").cast("decimal(28,2)")).cast("double").alias("anomalous_revenue"),
    )
    everything = lines.agg(total("Total_Amount").cast("double").alias("_all"))
    return unusual.transform(with_row, everything).select(
        "anomalous_orders", "anomalous_revenue", pct("anomalous_revenue", "_all").alias("revenue_pct")
    )


def anomaly_summary(lines: DataFrame, facts: DataFrame, scored_customers: DataFrame) -> DataFrame:
    """Count and share of each family of anomalies."""

    def family(name: str, found: DataFrame, base: DataFrame) -> DataFrame:
        counts = found.agg(F.count(F.lit(1)).alias("anomalies"))
        return counts.transform(with_row, base.agg(F.count(F.lit(1)).alias("total"))).select(
            F.lit(name).alias("family"), "anomalies", "total", pct("anomalies", "total").alias("share_pct")
        )

    parts = [
        family("orders", order_value_anomalies(lines), lines.select("Invoice").dropna().distinct()),
        family("products", product_price_anomalies(lines), lines.select("StockCode").dropna().distinct()),
        family("customers", scored_customers.where(F.col("anomaly") == -1), scored_customers),
        family("days", daily_anomalies(facts), dated(facts).select(F.to_date(AT)).distinct()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
