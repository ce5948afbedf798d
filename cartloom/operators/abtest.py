"""A/B assignment and evaluation over observed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.numeric import normal_cdf, ratio, round_even
from cartloom.functions.scalars import with_row
from cartloom.operators.campaigns import PROFIT_MARGIN

MIN_CUSTOMERS = 10
ALPHA = 0.05


def variant(test_id: str, key: Column | str = "customer_id") -> Column:
    """Half of all ids go to A, half to B, the same way in every run."""
    name = F.concat(F.lit(f"{test_id}:"), F.col(key).cast("string") if isinstance(key, str) else key)
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.when(number % 2 == 0, "A").otherwise("B")


def assign(customers: DataFrame, test_id: str = "t1") -> DataFrame:
    """Customers with their variant; a segment under ten customers gives no test."""
    size = customers.agg(F.count(F.lit(1)).alias("_size"))
    return (
        customers.transform(with_row, size)
        .where(F.col("_size") >= MIN_CUSTOMERS)
        .drop("_size")
        .withColumn("variant", variant(test_id))
    )


def observed_responses(conversions: DataFrame) -> DataFrame:
    return conversions.groupBy("customer_id").agg(F.sum("revenue").alias("response_revenue"))


def metrics(assigned: DataFrame, responses: DataFrame, config: dict[str, dict[str, float]] | None = None, margin: float = PROFIT_MARGIN) -> DataFrame:
    """Per variant: customers, responders, revenue, cost, return, and the figures the plan expected."""
    config = config or {}

    def setting(name: str, default: float) -> Column:
        out = F.lit(default)
        for v in ("A", "B"):
            value = config.get(v, {}).get(name)
            if value is not None:
                out = F.when(F.col("variant") == v, F.lit(float(value))).otherwise(out)
        return out

    per = (
        assigned.join(responses, "customer_id", "left")
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count("response_revenue").alias("responders"),
            F.coalesce(F.sum("response_revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
            F.avg("recommended_budget_per_customer").alias("_cost"),
            F.avg("expected_response_rate").alias("_rate"),
            ratio(F.sum(F.col("revenue_potential").cast("decimal(28,3)")), F.count(F.lit(1))).alias("_potential"),
        )
    )
    n, income = F.col("customers"), F.col("total_revenue")
    cost = n * F.col("_cost") * setting("cost_modifier", 1.0)
    profit = income * F.lit(margin) - F.col("total_cost")
    return (
        per.withColumn("total_cost", cost)
        .withColumn("response_rate", ratio("responders", n))
        .withColumn("roi", F.coalesce(ratio(profit, "total_cost") * 100, F.lit(0.0)))
        .select(
            "variant",
            "customers",
            "responders",
            round_even("response_rate", 4).alias("response_rate"),
            "total_revenue",
            round_even(F.coalesce(ratio(income, "responders"), F.lit(0.0)), 4).alias("revenue_per_responder"),
            round_even("total_cost", 4).alias("total_cost"),
            round_even("roi", 4).alias("roi_percent"),
            round_even(profit, 4).alias("profit"),
            round_even(F.col("_rate") * (setting("response_lift", 0.0) + 1), 4).alias("expected_response_rate"),
            round_even(F.col("_potential") * (setting("conversion_lift", 0.0) + 1), 2).alias("expected_revenue_per_customer"),
        )
    )


def _side_by_side(per_variant: DataFrame, columns: list[str]) -> DataFrame:
    return per_variant.agg(
        *[
            F.coalesce(F.max(F.when(F.col("variant") == v, F.col(c))), F.lit(0)).alias(f"{c}_{v.lower()}")
            for c in columns
            for v in ("A", "B")
        ]
    )


def significance(per_variant: DataFrame) -> DataFrame:
    """Two-sided pooled z test of the response rates."""
    row = _side_by_side(per_variant, ["customers", "responders"])
    n1, n2 = F.col("customers_a"), F.col("customers_b")
    x1, x2 = F.col("responders_a"), F.col("responders_b")
    diff = F.coalesce(ratio(x2, n2), F.lit(0.0)) - F.coalesce(ratio(x1, n1), F.lit(0.0))
    pooled = ratio(x1 + x2, n1 + n2)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    usable = (x1 > 0) & (x2 > 0)
    z = F.when(usable & (error > 0), F.try_divide(diff, error)).otherwise(0.0)
    p = F.when(usable, F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(F.col("_z"))))).otherwise(1.0)
    return (
        row.withColumn("_z", z)
        .withColumn("_p", p)
        .select(
            round_even(diff, 4).alias("response_rate_diff"),
            round_even("_z", 3).alias("z_score"),
            round_even("_p", 4).alias("p_value"),
            (usable & (F.col("_p") < ALPHA)).alias("is_significant"),
            F.when(usable, 95).otherwise(0).alias("confidence_level"),
        )
    )


def winner(per_variant: DataFrame) -> DataFrame:
    """Variant with the better return; recommended only when the difference is significant."""
    row = _side_by_side(per_variant, ["roi_percent", "total_revenue"]).transform(
        with_row, significance(per_variant).select("is_significant")
    )
    a, b = F.col("roi_percent_a"), F.col("roi_percent_b")

    def lift(best: Column, other: Column) -> Column:
        return F.when(other > 0, ratio(best - other, other) * 100).otherwise(0.0)

    name = F.when(b > a, "B").when(a > b, "A").otherwise("tie")
    gained = F.when(b > a, lift(b, a)).when(a > b, lift(a, b)).otherwise(0.0)
    return row.select(
        name.alias("winner"),
        round_even(gained, 1).alias("winner_lift_percent"),
        round_even(b - a, 1).alias("roi_difference"),
        round_even(F.col("total_revenue_b") - F.col("total_revenue_a"), 2).alias("revenue_difference"),
        F.when(F.col("is_significant"), name).otherwise("A").alias("recommend_variant"),
        F.when(F.col("is_significant"), "Significant").otherwise("Not Significant").alias("statistical_significance"),
    )
