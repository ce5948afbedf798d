"""What keeps large tables within a task's memory, and that results stay whole."""

import datetime
import re
from decimal import Decimal

from pyspark.sql import functions as F

from cartloom.operators import anomalies, churn, customers, sales
from cartloom.plans.mart import Mart
from cartloom.session import SCAN_BYTES


def _wide_distincts(df):
    """Aggregates by more keys than one that carry sums along: how Spark plans a distinct count beside sums."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[([^\n]*?)\](?:, output|\)|\n|$)", plan)
    return [p for p in found if p[0].count("#") > 1 and p[1].strip()] + re.findall("Expand", plan)


def _retail_lines(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(inv, code, 2, day + datetime.timedelta(days=d), Decimal("1.50"), who, "X", Decimal("3.00"), kind) for inv, code, d, who, kind in [
        ("1", "a", 0, "7", "SALE"), ("1", "b", 0, "7", "SALE"), ("2", "a", 1, "7", "SALE"), (None, "a", 1, "8", "SALE"), (None, None, 2, "8", "SALE"),
        ("3", None, 0, "9", "SALE"), ("4", "c", 9, "9", "SALE"), ("5", "c", 9, "9", "SALE"), ("C6", "d", 9, "10", "RETURN"), ("7", "e", 9, None, "SALE"),
    ]]
    return spark.createDataFrame(rows, "Invoice string, StockCode string, Quantity int, InvoiceDate timestamp, Price decimal(18,2), CustomerID string, Country string, Total_Amount decimal(18,2), Transaction_Type string")


def test_distinct_counts_go_apart_from_sums_and_keep_every_customer(spark):
    lines = _retail_lines(spark)
    orders = lines.select(F.col("CustomerID").alias("customer_id"), F.col("InvoiceDate").alias("order_date"), F.col("Total_Amount").alias("total_amount"), F.col("StockCode").alias("product_id"))
    features = customers.customer_features(orders)
    assert {r["customer_id"]: (r["frequency"], r["product_diversity"]) for r in features.collect()} == {"7": (3, 2), "8": (2, 1), "9": (3, 1), "10": (1, 1)}
    odd = anomalies.customer_anomaly_features(lines)
    assert {r["CustomerID"]: (r["transactions"], r["orders"], r["products"]) for r in odd.collect()} == {"7": (3, 2, 2), "8": (2, 0, 1), "9": (3, 3, 1), "10": (1, 1, 1)}
    temporal = churn.temporal_base(lines)
    assert {r["customer_id"]: (r["purchase_lines"], r["invoices"], r["product_diversity"], r["is_churned"]) for r in temporal.collect()} == {
        "7": (3, 2, 2, 1), "8": (2, 0, 1, 1), "9": (1, 1, 0, 0),
    }
    kpis = sales.global_kpis(lines)
    assert kpis.select("orders", "customers", "products").collect() == [(7, 4, 5)]
    for frame in (features, odd, temporal, kpis):
        assert _wide_distincts(frame) == []
    assert sales.global_kpis(lines.limit(0)).select("orders", "customers", "products").collect() == [(0, 0, 0)]


def test_scan_tasks_are_bounded(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for asked, got in (("134217728b", SCAN_BYTES), ("128m", SCAN_BYTES), ("1g", SCAN_BYTES), ("200MB", SCAN_BYTES), ("1048576", "1048576"), ("64k", "64k")):
            spark.conf.set(key, asked)
            Mart(spark, "/nowhere")
            assert spark.conf.get(key) in (str(got), f"{got}b")
    finally:
        spark.conf.set(key, before)
