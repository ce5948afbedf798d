"""Campaign segments, economics, budget, calendar and target planning.

After the per-segment aggregate everything works on at most eight rows, so
its windows and sorts are bounded by the rule tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.functions import rules
from cartloom.functions.numeric import ratio, round_even
from cartloom.functions.scalars import with_row
from cartloom.operators.customers import target_rules

PROFIT_MARGIN = 0.25
UPLIFT = 1.2
MIN_ROI = 15
DEFAULT_PROBABILITY, DEFAULT_RISK = 0.1, "Low"


def with_churn_risk(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    risk = predictions.select("customer_id", "churn_probability", "risk_category")
    return customers.join(risk, "customer_id", "left").fillna(
        {"churn_probability": DEFAULT_PROBABILITY, "risk_category": DEFAULT_RISK}
    )


def campaign_segment(with_risk: bool) -> Column:
    """Rules in order; segment names are compared with spaces for underscores."""
    segment = F.translate(F.col("rfm_segment"), "_", " ")
    vip = (F.col("monetary") >= 1000) & (F.col("frequency") >= 8)
    growth = segment.isin("Potential Loyalists", "New Customers") & (F.col("monetary") >= 200)
    at_risk = F.col("churn_probability") > 0.7 if with_risk else F.lit(False)
    urgent = F.col("risk_category").isin("High", "Critical") if with_risk else F.lit(False)
    return (
        F.when(vip & at_risk, "VIP_AtRisk")
        .when(vip, "VIP_Whales")
        .when((segment == "Champions") & (F.col("recency") <= 30), "Champions_Active")
        .when(growth, "Growth_Potential")
        .when(urgent, "Winback_Urgent")
        .when((segment == "At Risk") & (F.col("recency") <= 90), "Reactivation_Soft")
        .when(segment == "New Customers", "New_Development")
        .otherwise("Maintenance_LowCost")
    )


def campaign_segments(customers: DataFrame) -> DataFrame:
    with_risk = "churn_probability" in customers.columns
    return customers.withColumn("campaign_segment", campaign_segment(with_risk))


def campaign_rules(df: DataFrame) -> DataFrame:
    return rules.frame(df.sparkSession, rules.CAMPAIGNS, rules.CAMPAIGN_SCHEMA)


def campaign_attributes(segmented: DataFrame) -> DataFrame:
    attributes = campaign_rules(segmented).select(
        "campaign_segment",
        "campaign_priority",
        "recommended_channels",
        "recommended_budget_per_customer",
        "expected_response_rate",
    )
    return segmented.join(F.broadcast(attributes), "campaign_segment", "left")


def campaign_roi(customers: DataFrame, margin: float = PROFIT_MARGIN) -> DataFrame:
    cost = F.col("recommended_budget_per_customer")
    gain = F.col("revenue_potential") * F.lit(margin) * F.col("expected_response_rate") - F.col("campaign_cost")
    return (
        customers.withColumn("revenue_potential", F.col("monetary") * F.lit(UPLIFT))
        .withColumn("campaign_cost", cost)
        .withColumn("estimated_roi", round_even(ratio(gain, "campaign_cost") * 100, 1))
        .withColumn("is_profitable_segment", (F.col("estimated_roi") > MIN_ROI).cast("int"))
    )


def create_campaign_segments(customers: DataFrame, predictions: DataFrame | None = None, margin: float = PROFIT_MARGIN) -> DataFrame:
    enriched = customers if predictions is None else with_churn_risk(customers, predictions)
    return campaign_roi(campaign_attributes(campaign_segments(enriched)), margin)


def channel_costs(customers: DataFrame) -> DataFrame:
    """Cost of contacting each customer once through every recommended channel."""
    costs = rules.frame(customers.sparkSession, rules.CHANNEL_COSTS, rules.CHANNEL_COST_SCHEMA)
    per_segment = (
        campaign_rules(customers)
        .select("campaign_segment", F.explode("recommended_channels").alias("channel"))
        .join(F.broadcast(costs), "channel")
        .groupBy("campaign_segment")
        .agg(round_even(F.sum("cost"), 2).alias("contact_cost"), F.count(F.lit(1)).alias("channels"))
    )
    return customers.select("customer_id", "campaign_segment").join(F.broadcast(per_segment), "campaign_segment")


def campaign_segment_analysis(customers: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    roi = F.col("estimated_roi").cast("decimal(28,1)")
    per = customers.groupBy("campaign_segment").agg(
        n.alias("customers_count"),
        round_even(F.avg("recommended_budget_per_customer"), 2).alias("avg_cost_per_customer"),
        round_even(F.avg("expected_response_rate"), 2).alias("response_rate"),
        round_even(ratio(F.sum(roi), n), 2).alias("roi_percent"),
        round_even(F.sum(F.col("revenue_potential").cast("decimal(28,3)")), 2).alias("total_revenue_potential"),
        round_even(F.avg("campaign_priority"), 2).alias("priority"),
    )
    return per.withColumn(
        "total_budget_needed", F.col("customers_count") * F.col("avg_cost_per_customer")
    ).withColumn("combined_score", F.col("priority") * 0.4 + F.col("roi_percent") * 0.6)


def budget_allocation(analysis: DataFrame, budget: float) -> DataFrame:
    """Serve segments by score until the budget is used up; the last one may be cut."""
    order = Window.orderBy(F.desc("combined_score"), "campaign_segment")
    spent = F.coalesce(
        F.sum("total_budget_needed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    left, need = F.col("_left"), F.col("total_budget_needed")
    status = (
        F.when(left <= 0, "insufficient_budget").when(need <= left, "fully_funded").otherwise("partially_funded")
    )
    reached = (
        F.when(F.col("status") == "fully_funded", F.col("customers_count"))
        .when(F.col("status") == "partially_funded", F.floor(ratio(left, "avg_cost_per_customer")))
        .otherwise(0)
        .cast("bigint")
    )
    expected = (
        F.col("customers_targeted") * F.col("total_revenue_potential") / F.col("customers_count") * F.col("response_rate")
    )
    return (
        analysis.withColumn("allocation_order", F.row_number().over(order))
        .withColumn("_left", F.lit(float(budget)) - spent)
        .withColumn("status", status)
        .withColumn("allocated_budget", round_even(F.least(need, F.greatest(F.lit(0.0), left)), 2))
        .withColumn("customers_targeted", reached)
        .withColumn("expected_revenue", round_even(expected, 2))
        .select(
            "allocation_order",
            "campaign_segment",
            "allocated_budget",
            "customers_targeted",
            "roi_percent",
            "priority",
            "expected_revenue",
            "status",
        )
    )


def budget_summary(allocation: DataFrame, budget: float, margin: float = PROFIT_MARGIN) -> DataFrame:
    spent, gain = F.col("total_allocated"), F.col("total_expected_revenue")
    roi = F.coalesce(ratio(gain * F.lit(margin) - spent, spent) * 100, F.lit(0.0))
    return (
        allocation.agg(
            round_even(F.sum("allocated_budget"), 2).alias("total_allocated"),
            F.sum("customers_targeted").alias("total_customers_targeted"),
            round_even(F.sum("expected_revenue"), 2).alias("total_expected_revenue"),
        )
        .withColumn("total_budget", F.lit(float(budget)))
        .withColumn("remaining_budget", round_even(F.lit(float(budget)) - spent, 2))
        .withColumn("overall_roi_percent", round_even(roi, 1))
        .withColumn("budget_utilization_percent", round_even(spent / F.lit(float(budget)) * 100, 1))
    )


def campaign_calendar(allocation: DataFrame, start_date: str, weeks: int = 12) -> DataFrame:
    """One row per planned campaign of every funded segment."""
    plans = campaign_rules(allocation).select(
        "campaign_segment", "start_week", "every_weeks", "duration_weeks", "campaign_type", "recommended_channels"
    )
    every = F.col("every_weeks")
    most = F.floor(F.least(F.col("duration_weeks"), F.lit(weeks)) / every).cast("int")
    share = F.floor(F.col("customers_targeted") / F.col("_most")).cast("bigint")
    budget = F.col("customers_targeted") * (F.col("_allocated") / F.col("_targeted"))
    numbered = Window.orderBy("allocation_order", "week_number")
    return (
        allocation.where(F.col("customers_targeted") > 0)
        .join(F.broadcast(plans), "campaign_segment", "left")
        .fillna({"start_week": 4, "every_weeks": 4, "duration_weeks": 6, "campaign_type": "standard_campaign"})
        .withColumn("recommended_channels", F.coalesce("recommended_channels", F.array(F.lit("email"))))
        .withColumn("_most", most)
        .where(F.col("_most") > 0)
        .withColumn("_targeted", F.col("customers_targeted"))
        .withColumn("_allocated", F.col("allocated_budget"))
        .withColumn("customers_targeted", share)
        .where(F.col("customers_targeted") > 0)
        .withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_most") - 1)))
        .withColumn("week_number", F.col("start_week") + F.col("_nth") * every)
        .where(F.col("week_number") <= weeks)
        .withColumn("_no", F.row_number().over(numbered))
        .select(
            F.format_string("CAMP_%04d", F.col("_no")).alias("campaign_id"),
            F.concat("campaign_segment", F.lit("_Week"), F.col("week_number").cast("string")).alias("campaign_name"),
            F.col("campaign_segment").alias("segment"),
            F.date_format(
                F.date_add(F.lit(start_date).cast("date"), (F.col("week_number") - 1) * 7), "yyyy-MM-dd"
            ).alias("start_date"),
            "week_number",
            F.array_join(F.slice("recommended_channels", 1, 2), ", ").alias("channels"),
            "customers_targeted",
            round_even(budget, 2).alias("budget_allocated"),
            F.col("roi_percent").alias("expected_roi_percent"),
            F.col("priority").alias("priority_level"),
            "campaign_type",
            F.lit("planned").alias("status"),
        )
    )


def calendar_metrics(calendar: DataFrame) -> DataFrame:
    week = F.col("week_number")
    income = F.col("customers_targeted") * F.col("budget_allocated") * F.col("expected_roi_percent") / 100
    quarter = F.concat(F.lit("Q"), (F.floor((week - 1) / 13) + 1).cast("string"))
    return (
        calendar.withColumn("expected_revenue", round_even(income, 2))
        .withColumn("quarter", F.when(week <= 52, quarter).otherwise("Q1"))
        .withColumn("month", F.substring("start_date", 1, 7))
        .orderBy("week_number", F.desc("priority_level"), "campaign_id")
    )


def calendar_summary(calendar: DataFrame, top: int = 3) -> DataFrame:
    """Per-month rows, one total row, and the segments with most campaigns."""
    figures = [
        F.count(F.lit(1)).alias("campaigns"),
        F.sum("customers_targeted").alias("customers"),
        round_even(F.sum("budget_allocated"), 2).alias("budget"),
        round_even(F.sum("expected_revenue"), 2).alias("revenue"),
        round_even(F.avg("budget_allocated"), 2).alias("mean_budget"),
        F.max("week_number").alias("last_week"),
    ]
    months = calendar.groupBy("month").agg(*figures).withColumnRenamed("month", "item")
    totals = calendar.agg(*figures).withColumn("item", F.lit("all"))
    segments = calendar.groupBy("segment").agg(*figures).withColumnRenamed("segment", "item")
    segments = segments.orderBy(F.desc("campaigns"), "item").limit(top)
    parts = [(months, "month"), (totals, "total"), (segments, "top_segment")]
    columns = ["item", "campaigns", "customers", "budget", "revenue", "mean_budget", "last_week"]
    out = None
    for part, kind in parts:
        part = part.select(F.lit(kind).alias("kind"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


# -- target lists --------------------------------------------------------------------
def campaign_potential(targets: DataFrame) -> DataFrame:
    """Cost, conversions, revenue and return of a campaign to each target list."""
    n = F.count(F.lit(1))
    money = F.col("monetary").cast("decimal(28,2)")
    sizes = targets.groupBy("target").agg(
        n.alias("customers"),
        F.sum(money).cast("double").alias("revenue_sum"),
        ratio(F.sum(money), n).alias("_mean"),
        round_even(ratio(F.sum("frequency"), n), 4).alias("mean_frequency"),
        round_even(ratio(F.sum("recency"), n), 4).alias("mean_recency"),
    )
    clients = F.col("customers")
    conversions = clients * F.col("conversion_rate")
    cost = clients * F.col("cost_per_customer")
    income = conversions * F.col("_mean")
    roi = (income - cost) / cost * 100
    return (
        target_rules(targets)
        .join(sizes, "target")
        .select(
            "target",
            "customers",
            "revenue_sum",
            round_even("_mean", 4).alias("revenue_mean"),
            "mean_frequency",
            "mean_recency",
            "cost_per_customer",
            "conversion_rate",
            F.floor(conversions).cast("bigint").alias("conversions"),
            cost.cast("double").alias("campaign_cost"),
            round_even(income, 2).alias("expected_revenue"),
            round_even(roi, 4).alias("roi"),
            "campaign_type",
            round_even(roi * F.ln(clients), 3).alias("priority_score"),
        )
    )


def campaign_planning(potential: DataFrame, start_date: str) -> DataFrame:
    plans = target_rules(potential).select("target", "start_week", "duration_weeks")
    start = F.date_add(F.lit(start_date).cast("date"), (F.col("start_week") - 1) * 7)
    rank = F.row_number().over(Window.orderBy(F.desc("roi"), "target"))
    return potential.join(plans, "target").select(
        "target",
        F.date_format(start, "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.date_add(start, F.col("duration_weeks") * 7), "yyyy-MM-dd").alias("end_date"),
        "start_week",
        "duration_weeks",
        F.col("campaign_cost").alias("budget"),
        "roi",
        "expected_revenue",
        "customers",
        "campaign_type",
        rank.alias("execution_rank"),
    )


def effort_impact(potential: DataFrame) -> DataFrame:
    """Quadrant of each target by cost and revenue against the medians of the five targets."""
    medians = potential.agg(
        F.median("campaign_cost").alias("_cost"), F.median("expected_revenue").alias("_revenue")
    )
    effort = F.when(F.col("campaign_cost") > F.col("_cost"), "high").otherwise("low")
    impact = F.when(F.col("expected_revenue") > F.col("_revenue"), "high").otherwise("low")
    return potential.transform(with_row, medians).select(
        "target",
        round_even(F.col("campaign_cost") / 1000, 4).alias("effort_k"),
        round_even(F.col("expected_revenue") / 1000, 4).alias("impact_k"),
        effort.alias("effort"),
        impact.alias("impact"),
    )


def message_assignment(targets: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The message of each (customer, target).

    ``templates`` is the caller's table of texts, one row for each target with
    whatever columns it has; without it the built-in offers are sent.  Targets
    without a template get no message.
    """
    messages = rules.frame(targets.sparkSession, rules.MESSAGES, rules.MESSAGE_SCHEMA) if templates is None else templates
    chosen = targets.select("customer_id", "target")
    # the built-in table has a row for each target; Spark sizes a caller's
    return chosen.join(F.broadcast(messages) if templates is None else messages, "target")


def message_costs(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("target").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("message_cost").alias("total_cost")
    )
