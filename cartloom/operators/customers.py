"""Customer features, lifetime value, segment reports and target lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.functions import rules
from cartloom.functions.numeric import DAYS_PER_MONTH, dbl, pct, ratio, round_even, whole_days
from cartloom.functions.ordering import exact_quantiles
from cartloom.functions.scalars import with_distinct_counts, with_row
from cartloom.functions.staging import stage
from cartloom.operators.sales import AT, top_share

GROSS_MARGIN = 0.20
PREDICTION_MONTHS = 12
NEW_CUSTOMER_LIFE = 0.3
BEHAVIOUR = ["recency", "frequency", "monetary", "avg_basket", "product_diversity"]


def customer_features(orders: DataFrame) -> DataFrame:
    """One row per customer with positive spend; every missing figure is 0."""
    has_quantity, has_product = "quantity" in orders.columns, "product_id" in orders.columns
    n = F.count(F.lit(1))
    quantity = (
        [F.sum("quantity").alias("total_quantity"), ratio(F.sum("quantity"), F.count("quantity")).alias("avg_quantity")]
        if has_quantity
        else [n.alias("total_quantity"), F.lit(1.0).alias("avg_quantity")]
    )
    known = orders.where(F.col("customer_id").isNotNull())
    per = (
        known.groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            n.alias("frequency"),
            F.sum("total_amount").cast("double").alias("monetary"),
            ratio(F.sum("total_amount"), F.count("total_amount")).alias("avg_order_value"),
            F.coalesce(F.stddev_samp(dbl("total_amount")), F.lit(0.0)).alias("monetary_std"),
            *quantity,
        )
        .where(F.col("monetary") > 0)
    )
    if has_product:
        per = with_distinct_counts(per, known, {"product_diversity": F.col("product_id")})
    else:
        per = per.withColumn("product_diversity", F.lit(1).cast("bigint"))
    anchor = orders.agg(F.max("order_date").alias("_reference"))
    lifetime = F.coalesce(whole_days("last_order", "first_order"), F.lit(0))
    gap = F.when(F.col("frequency") > 1, ratio("customer_lifetime", F.col("frequency") - 1)).otherwise(0.0)
    return (
        per.transform(with_row, anchor)
        .withColumn("recency", F.coalesce(whole_days("_reference", "last_order"), F.lit(0)))
        .withColumn("customer_lifetime", lifetime)
        .withColumn("avg_days_between_orders", gap)
        .drop("_reference")
    )


def behaviour_features(lines: DataFrame) -> DataFrame:
    """Per customer over SALE lines, recency counted from the day after the last line of any type."""
    at, price, quantity = F.col(AT), dbl("Price"), dbl("Quantity")
    snapshot = lines.agg((F.max(AT) + F.expr("INTERVAL 1 DAY")).alias("_snapshot"))
    sold = lines.where((F.col("Transaction_Type") == "SALE") & F.col("CustomerID").isNotNull()).withColumnRenamed("CustomerID", "customer_id")
    per = (
        sold.groupBy("customer_id")
        .agg(
            F.sum("Total_Amount").cast("double").alias("monetary"),
            F.sum("Quantity").alias("quantity_sum"),
            ratio(F.sum("Quantity"), F.count("Quantity")).alias("quantity_mean"),
            F.stddev_samp(quantity).alias("quantity_std"),
            ratio(F.sum("Price"), F.count("Price")).alias("price_mean"),
            F.stddev_samp(price).alias("price_std"),
            F.min(price).alias("price_min"),
            F.max(price).alias("price_max"),
            F.min(at).alias("first_date"),
            F.max(at).alias("last_date"),
        )
    )
    sums = per.columns[1:]
    at = sums.index("first_date")
    # the country of the first line drags that line's keys along: it goes by itself, like the distinct counts
    country = stage(sold.groupBy("customer_id").agg(F.min_by("Country", F.struct(AT, "Invoice", "StockCode")).alias("country")), "country")
    counted = with_distinct_counts(per, sold, {"frequency": F.col("Invoice"), "product_diversity": F.col("StockCode")}).join(country, "customer_id")
    whole = counted.select("customer_id", "frequency", *sums[:at], "product_diversity", "country", *sums[at:])
    return (
        whole.transform(with_row, snapshot)
        .withColumn("recency", whole_days("_snapshot", "last_date"))
        .withColumn("customer_lifetime", whole_days("last_date", "first_date"))
        .withColumn("avg_days_between_orders", ratio("customer_lifetime", "frequency"))
        .withColumn("avg_basket", ratio("monetary", "frequency"))
        .drop("_snapshot")
    )


def lifetime_value(features: DataFrame, months: int = PREDICTION_MONTHS, margin: float = GROSS_MARGIN) -> DataFrame:
    """Estimated and historical customer lifetime value."""
    life, n = F.col("customer_lifetime"), F.col("frequency")
    monthly = F.when(life > 0, ratio(n, life / F.lit(DAYS_PER_MONTH))).otherwise(n / F.lit(float(months)))
    span = F.when(n > 1, F.lit(float(months))).otherwise(F.lit(months * NEW_CUSTOMER_LIFE))
    return features.withColumn(
        "clv_estimated", F.col("avg_order_value") * monthly * span * F.lit(margin)
    ).withColumn("clv_historical", F.col("monetary") * F.lit(margin))


def segmented_customers(rfm: DataFrame, valued: DataFrame) -> DataFrame:
    scores = rfm.select("customer_id", "rfm_segment", "rfm_score", "R_score", "F_score", "M_score")
    return scores.join(valued, "customer_id")


def segment_analysis(customers: DataFrame, by: str, with_diversity: bool = False) -> DataFrame:
    n = F.count(F.lit(1))
    extra = [round_even(ratio(F.sum("product_diversity"), n), 2).alias("product_diversity_mean")] if with_diversity else []
    return customers.groupBy(by).agg(
        n.alias("customers"),
        round_even(ratio(F.sum(F.col("monetary").cast("decimal(28,2)")), n), 2).alias("monetary_mean"),
        F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("monetary_sum"),
        round_even(ratio(F.sum("frequency"), n), 2).alias("frequency_mean"),
        round_even(ratio(F.sum("recency"), n), 2).alias("recency_mean"),
        round_even(F.avg("avg_order_value"), 2).alias("avg_order_value_mean"),
        *extra,
        round_even(F.avg("clv_estimated"), 2).alias("clv_mean"),
        round_even(F.sum("clv_estimated"), 2).alias("clv_sum"),
    )


def segment_insights(customers: DataFrame) -> DataFrame:
    """Best segment by revenue, share of the top fifth, share of one-order customers, and the best cluster where there are clusters."""
    per = customers.groupBy("rfm_segment").agg(F.sum(F.col("monetary").cast("decimal(28,2)")).alias("_revenue"))
    best = per.agg(F.max_by("rfm_segment", F.struct("_revenue", "rfm_segment")).alias("top_segment"))
    share = top_share(customers, F.col("monetary"))
    once = customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        round_even(ratio(F.count(F.when(F.col("frequency") == 1, 1)), F.count(F.lit(1))) * 100, 1).alias("one_shot_pct"),
    )
    found = best.transform(with_row, share).transform(with_row, once)
    names = ["top_segment", pct("top_total", "grand_total", 1).alias("top_20_revenue_share"), "one_shot_pct", "total_customers", F.col("grand_total").alias("total_revenue")]
    if "cluster" in customers.columns:
        found, names = found.transform(with_row, cluster_insight(customers)), [*names, "highest_value_cluster"]
    return found.select(*names)


def cluster_insight(customers: DataFrame) -> DataFrame:
    per = customers.groupBy("cluster").agg(F.avg("monetary").alias("mean_monetary"))
    return per.agg(F.max_by("cluster", F.struct("mean_monetary", "cluster")).alias("highest_value_cluster"))


def segment_recommendations(customers: DataFrame) -> DataFrame:
    """Advice of the customer's segment."""
    advice = rules.frame(customers.sparkSession, rules.SEGMENT_ADVICE, rules.SEGMENT_ADVICE_SCHEMA)
    return customers.select("customer_id", "rfm_segment").join(F.broadcast(advice), "rfm_segment")


def segment_summary_nb(customers: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    money = F.col("monetary").cast("decimal(28,2)")
    sums = customers.groupBy("rfm_segment").agg(
        round_even(ratio(F.sum("recency"), n), 2).alias("recency_mean"),
        round_even(ratio(F.sum("frequency"), n), 2).alias("frequency_mean"),
        round_even(ratio(F.sum(money), n), 2).alias("monetary_mean"),
        F.sum(money).cast("double").alias("monetary_sum"),
        round_even(ratio(F.sum("rfm_score"), n), 2).alias("score_mean"),
        n.alias("customers"),
    )
    metrics = {c: F.col(c) for c in ("recency", "frequency", "monetary")}
    medians = exact_quantiles(customers, metrics, [0.5], by=["rfm_segment"])
    everyone = sums.agg(F.sum("customers").alias("_all"))
    return (
        sums.join(F.broadcast(medians), "rfm_segment")
        .transform(with_row, everyone)
        .select(
            *sums.columns,
            *[round_even(f"{c}_q0", 4).alias(f"{c}_median") for c in metrics],
            pct("customers", "_all", 1).alias("share_pct"),
        )
    )


def cluster_summary_nb(customers: DataFrame) -> DataFrame:
    """One row for each cluster, over the customers that are in one."""
    names = [*BEHAVIOUR, "customer_lifetime"]
    stats = [
        round_even(f(c), 2).alias(f"{c}_{s}") for c in names for s, f in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    per = customers.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), round_even(F.sum("monetary"), 2).alias("monetary_sum"), *stats
    )
    everyone = per.agg(F.sum("customers").alias("_all"))
    return per.transform(with_row, everyone).withColumn("share_pct", pct("customers", "_all", 1)).drop("_all")


def feature_correlation(customers: DataFrame, names: list[str] = BEHAVIOUR) -> DataFrame:
    """Pearson correlation of every pair of features, from one aggregate."""
    cells = [
        F.struct(
            F.lit(a).alias("feature_a"),
            F.lit(b).alias("feature_b"),
            round_even(F.corr(dbl(a), dbl(b)), 4).alias("correlation"),
        )
        for a in names
        for b in names
    ]
    return customers.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def revenue_by_segment(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("rfm_segment")
        .agg(F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("revenue"))
        .orderBy("revenue", "rfm_segment")
    )


def cluster_ranks(customers: DataFrame) -> DataFrame:
    """Clusters ordered by mean spend, richest first; cluster ids themselves mean nothing."""
    per = customers.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.avg("monetary").alias("_mean"))
    # One row per cluster: bounded.
    order = Window.orderBy(F.desc("_mean"), "cluster")
    count = Window.partitionBy()
    return per.select(
        "cluster", F.row_number().over(order).alias("cluster_rank"), F.count(F.lit(1)).over(count).alias("clusters")
    )


def priority_segments(customers: DataFrame) -> DataFrame:
    """Rows (customer, target); a customer may be on several of the five lists, one without a cluster on those of its segment."""
    segment, rank = F.col("rfm_segment"), F.col("cluster_rank")
    named = F.translate(segment, "_", " ")

    def member(condition: Column, target: str) -> Column:
        return F.when(condition, F.lit(target))

    targets = F.array_compact(
        F.array(
            member(named == "Champions", "CHAMPIONS"),
            member(rank == 1, "SUPER_WHALES"),
            member(rank == 2, "HIGH_VALUE"),
            member(named == "Potential Loyalists", "POTENTIAL_LOYALISTS"),
            member(rank > F.col("clusters") - 2, "ONE_SHOT_PROBLEM"),
        )
    )
    return customers.join(F.broadcast(cluster_ranks(customers)), "cluster", "left").select(
        "customer_id", F.explode(targets).alias("target"), "recency", "frequency", "monetary"
    )


def target_rules(df: DataFrame) -> DataFrame:
    return rules.frame(df.sparkSession, rules.TARGETS, rules.TARGET_SCHEMA)


def campaign_strategy_summary(targets: DataFrame) -> DataFrame:
    sizes = targets.groupBy("target").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("revenue"),
    )
    return target_rules(targets).join(sizes, "target").select("target", "customers", "revenue", "priority", "key_action")


def business_impact(targets: DataFrame, customers: DataFrame) -> DataFrame:
    """Expected extra revenue of each growth scenario, and its share of all revenue."""
    base = targets.groupBy("target").agg(F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("base_revenue"))
    everything = customers.agg(F.sum(F.col("monetary").cast("decimal(28,2)")).cast("double").alias("_all"))
    gain = F.col("base_revenue") * F.col("uplift")
    return (
        target_rules(targets)
        .where(F.col("uplift").isNotNull())
        .join(base, "target")
        .transform(with_row, everything)
        .select(
            "target",
            "base_revenue",
            "uplift",
            round_even(gain, 2).alias("additional_revenue"),
            round_even(ratio(gain, "_all") * 100, 4).alias("growth_pct"),
        )
    )
