"""Churn features, labels, risk bands and retention actions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import rules
from cartloom.functions.numeric import (
    DAYS_PER_MONTH,
    MICROS_PER_DAY,
    dbl,
    pct,
    ratio,
    right_closed_band,
    round_even,
    whole_days,
)
from cartloom.functions.ordering import exact_quantiles
from cartloom.functions.scalars import with_distinct_counts, with_row
from cartloom.operators.modelling import prepared
from cartloom.sources.tables import ModelRegistry

CHURN_DAYS = 90
RECENT_DAYS = 90
ONE_ORDER_GAP = 999.0
OBSERVATION_SHARE, CUTOFF_SHARE = 0.6, 0.8
MIN_INVOICES = 3

#: Inputs of the churn models, in order.
MODEL_FEATURES = [
    "recency_days", "total_orders", "avg_order_value", "total_spent", "customer_lifetime_days",
    "avg_days_between_orders", "recent_spent", "recent_orders", "spending_trend",
    "order_frequency_trend", "spending_volatility", "engagement_score", "is_one_time_customer",
]
OPTIONAL_FEATURES = ["product_diversity", "clv_estimated"]
#: The model that scores unless another is named.
DEFAULT_MODEL = "random_forest"


def model_features(frame: DataFrame) -> list[str]:
    """Inputs of the churn models, the optional ones where the frame has them."""
    return MODEL_FEATURES + [c for c in OPTIONAL_FEATURES if c in frame.columns]


def churn_features(orders: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Base, recent, trend and risk features from one aggregate per customer."""
    anchor = orders.agg(F.max("order_date").alias("_reference"))
    recent = F.col("order_date") >= F.col("_reference") - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    amount = F.col("total_amount")
    per = (
        orders.where(F.col("customer_id").isNotNull())
        .transform(with_row, anchor)
        .groupBy("customer_id")
        .agg(
            F.max("_reference").alias("_reference"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            F.count(F.lit(1)).alias("total_orders"),
            F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("total_spent"),
            F.coalesce(ratio(F.sum(amount), F.count(amount)), F.lit(0.0)).alias("avg_order_value"),
            F.coalesce(F.stddev_samp(dbl(amount)), F.lit(0.0)).alias("spending_std"),
            F.coalesce(F.sum(F.when(recent, amount)).cast("double"), F.lit(0.0)).alias("recent_spent"),
            F.coalesce(
                ratio(F.sum(F.when(recent, amount)), F.count(F.when(recent, amount))), F.lit(0.0)
            ).alias("recent_aov"),
            F.count(F.when(recent, amount)).alias("recent_orders"),
        )
    )
    lifetime, orders_n = F.col("customer_lifetime_days"), F.col("total_orders")
    out = (
        per.withColumn("recency_days", F.coalesce(whole_days("_reference", "last_order_date"), F.lit(0)))
        .withColumn("customer_lifetime_days", F.coalesce(whole_days("last_order_date", "first_order_date"), F.lit(0)))
        .withColumn(
            "avg_days_between_orders",
            F.when(orders_n > 1, ratio(lifetime, orders_n - 1)).otherwise(F.lit(ONE_ORDER_GAP)),
        )
        .withColumn("spending_trend", _trend("recent_spent", "total_spent"))
        .withColumn("order_frequency_trend", _trend("recent_orders", "total_orders"))
        .withColumn(
            "spending_volatility",
            F.when(F.col("avg_order_value") > 0, ratio("spending_std", "avg_order_value")).otherwise(0.0),
        )
        .withColumn(
            "engagement_score",
            F.when(lifetime > 0, ratio(orders_n, lifetime / F.lit(DAYS_PER_MONTH))).otherwise(dbl(orders_n)),
        )
        .withColumn("is_one_time_customer", (orders_n == 1).cast("int"))
        .drop("_reference")
    )
    return out if external is None else add_external(out, external)


def _trend(recent: str, whole: str) -> Column:
    """Recent amount over what the lifetime average would give for the recent window."""
    expected = dbl(whole) / (F.col("customer_lifetime_days") + 1) * RECENT_DAYS
    return F.when(F.col(whole) > 0, F.coalesce(ratio(recent, expected), F.lit(0.0))).otherwise(0.0)


def add_external(features: DataFrame, external: DataFrame) -> DataFrame:
    """Left join of product diversity and lifetime value; missing is 0."""
    extra = external.select("customer_id", *OPTIONAL_FEATURES)
    return features.join(extra, "customer_id", "left").fillna(0, subset=OPTIONAL_FEATURES)


def churn_labels(features: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    """1 for customers who went quiet, bought once long ago, or sharply slowed down."""
    quiet = (F.col("recency_days") > churn_days) & (F.col("customer_lifetime_days") > 30)
    once = (F.col("is_one_time_customer") == 1) & (F.col("recency_days") > 60)
    slowed = (
        (F.col("spending_trend") < 0.3) & (F.col("order_frequency_trend") < 0.3) & (F.col("total_orders") > 2)
    )
    return features.withColumn("is_churned", (quiet | once | slowed).cast("int"))


def churn_patterns(labelled: DataFrame) -> DataFrame:
    """Churn rate and the contrast of churned and active customers, one row."""
    churned, active = F.col("is_churned") == 1, F.col("is_churned") == 0

    def mean(c: str, who: Column, digits: int) -> Column:
        return round_even(ratio(F.sum(F.when(who, F.col(c))), F.count(F.when(who, F.col(c)))), digits)

    money = F.col("total_spent").cast("decimal(28,2)")
    return labelled.withColumn("_money", money).agg(
        pct(F.count(F.when(churned, 1)), F.count(F.lit(1)), 1).alias("churn_rate"),
        F.count(F.when(churned, 1)).alias("churned_customers"),
        F.count(F.when(active, 1)).alias("active_customers"),
        mean("recency_days", churned, 1).alias("avg_recency_churned"),
        mean("recency_days", active, 1).alias("avg_recency_active"),
        mean("total_orders", churned, 1).alias("avg_orders_churned"),
        mean("total_orders", active, 1).alias("avg_orders_active"),
        mean("_money", churned, 2).alias("avg_value_churned"),
        mean("_money", active, 2).alias("avg_value_active"),
        F.coalesce(
            pct(
                F.sum(F.when(churned, F.col("is_one_time_customer"))), F.sum("is_one_time_customer"), 1
            ),
            F.lit(0.0),
        ).alias("one_time_customer_churn_rate"),
        F.coalesce(F.sum(F.when(churned, F.col("_money"))).cast("double"), F.lit(0.0)).alias("revenue_at_risk"),
    )


# -- label by absence from a later period -------------------------------------------
def period_cuts(lines: DataFrame) -> DataFrame:
    """End of the observation period and of the label period, in microseconds."""
    q = exact_quantiles(lines, {"t": F.unix_micros("InvoiceDate")}, [OBSERVATION_SHARE, CUTOFF_SHARE])
    return q.select(F.col("t_q0").alias("_observed"), F.col("t_q1").alias("_cutoff"))


def temporal_base(lines: DataFrame) -> DataFrame:
    """Per customer active in the observation period: rounded features and absence afterwards."""
    micros = F.unix_micros("InvoiceDate").cast("double")
    observed = F.col("_t") <= F.col("_observed")
    dated = (
        lines.where(F.col("InvoiceDate").isNotNull() & F.col("CustomerID").isNotNull())
        .withColumn("_t", micros)
        .transform(with_row, period_cuts(lines))
        .where(F.col("_t") <= F.col("_cutoff"))
    )

    def seen(c: str) -> Column:
        return F.when(observed, F.col(c))

    def mean(c: str) -> Column:
        return round_even(ratio(F.sum(seen(c)), F.count(seen(c))), 2)

    def spread(c: str) -> Column:
        return round_even(F.stddev_samp(dbl(seen(c))), 2)

    dated = dated.withColumnRenamed("CustomerID", "customer_id")
    per = dated.groupBy("customer_id").agg(
        F.count(seen("InvoiceDate")).alias("purchase_lines"),
        F.sum(seen("Quantity")).alias("quantity_sum"),
        mean("Quantity").alias("quantity_mean"),
        spread("Quantity").alias("quantity_std"),
        mean("Price").alias("price_mean"),
        spread("Price").alias("price_std"),
        F.sum(seen("Total_Amount")).cast("double").alias("amount_sum"),
        mean("Total_Amount").alias("amount_mean"),
        spread("Total_Amount").alias("amount_std"),
        F.min(seen("_t")).alias("_first"),
        F.max(seen("_t")).alias("_last"),
        F.max("_observed").alias("_observed"),
        F.max((~observed).cast("int")).alias("_returned"),
    )
    sums = per.columns
    at = sums.index("_first")
    seen_rows = dated.where(observed)
    whole = with_distinct_counts(
        per.where(F.col("purchase_lines") > 0), seen_rows, {"invoices": F.col("Invoice"), "product_diversity": F.col("StockCode")}
    ).select(*sums[:at], "invoices", "product_diversity", *sums[at:])
    day = F.lit(float(MICROS_PER_DAY))
    return (
        whole
        .withColumn("days_active", F.floor((F.col("_last") - F.col("_first")) / day))
        .withColumn("time_since_first_purchase", F.floor((F.col("_observed") - F.col("_first")) / day))
        .withColumn("is_churned", F.lit(1) - F.col("_returned"))
        .drop("_first", "_last", "_observed", "_returned")
    )


def temporal_features(lines: DataFrame, min_invoices: int = MIN_INVOICES) -> DataFrame:
    base = temporal_base(lines)
    out = (
        base.withColumn("purchase_frequency", dbl("purchase_lines") / (F.col("days_active") + 1) * 30)
        .withColumn("avg_order_value", ratio("amount_sum", "invoices"))
        .withColumn("spending_volatility", ratio("amount_std", F.col("amount_mean") + 1))
    )
    numbers = [c for c in out.columns if c not in ("customer_id", "is_churned")]
    return out.fillna(0, subset=numbers).where(F.col("invoices") >= min_invoices)


def temporal_model_features(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("customer_id", "is_churned")]


# -- scores and actions ----------------------------------------------------------------
def risk_category(probability: Column) -> Column:
    out = F.lit(rules.RISK_REST)
    for limit, name in reversed(rules.RISK_CATEGORIES):
        out = F.when(probability >= limit, name).otherwise(out)
    return out


def risk_band(probability: Column | str) -> Column:
    return right_closed_band(probability, rules.RISK_BAND_EDGES, rules.RISK_BANDS)


def recency_score(labelled: DataFrame) -> DataFrame:
    """A score without a model: recency over the longest recency."""
    longest = labelled.agg(F.max("recency_days").alias("_longest"))
    return labelled.transform(with_row, longest).select(
        "customer_id",
        F.col("is_churned").alias("label"),
        ratio("recency_days", "_longest").alias("score"),
    )


def as_predictions(scores: DataFrame, model: str, on: str | Column) -> DataFrame:
    """Score rows in the shape later steps expect."""
    return scores.select(
        "customer_id",
        F.col("score").alias("churn_probability"),
        risk_category(F.col("score")).alias("risk_category"),
        F.lit(model).alias("model_used"),
        (F.lit(on) if isinstance(on, str) else on).alias("prediction_date"),
    )


def predict_risk(registry: ModelRegistry, customers: DataFrame, model_name: str = DEFAULT_MODEL, on: str | None = None) -> DataFrame:
    """Risk of every customer by a saved model, looked up by name; an unknown name is a ValueError.

    The model's own feature list is used.  The date is that of the latest order the
    customers have, where none is given.
    """
    model, info = registry.load(customers.sparkSession, model_name)
    ready = prepared(customers, info["feature_names"])
    latest = customers.agg(F.date_format(F.max("last_order_date"), "yyyy-MM-dd").alias("_on"))
    dated = ready.withColumn("_on", F.lit(on)) if on else ready.transform(with_row, latest)
    scores = model.transform(dated).select("customer_id", vector_to_array("probability")[1].alias("score"), "_on")
    return as_predictions(scores, model_name, F.col("_on"))


def risk_band_analysis(features: DataFrame, probability: str = "churn_probability") -> DataFrame:
    n, p = F.count(F.lit(1)), F.col(probability)
    return (
        features.withColumn("risk_band", risk_band(p))
        .where(F.col("risk_band").isNotNull())
        .groupBy("risk_band")
        .agg(
            n.alias("customers"),
            F.sum("is_churned").alias("churned"),
            round_even(ratio(F.sum("is_churned"), n), 3).alias("churn_rate"),
            round_even(F.avg("amount_sum"), 3).alias("mean_spend"),
            round_even(F.avg("purchase_frequency"), 3).alias("mean_frequency"),
            round_even(F.avg("avg_order_value"), 3).alias("mean_order_value"),
            round_even(F.avg(p), 3).alias("mean_probability"),
            round_even(F.min(p), 3).alias("min_probability"),
            round_even(F.max(p), 3).alias("max_probability"),
        )
    )


def retention_impact(features: DataFrame, cost_per_client: float = 50.0, success_rate: float = 0.3) -> DataFrame:
    """Clients above 0.7, the loss they stand for, and the return of a retention campaign."""
    at_risk = F.col("clients_at_risk")
    sums = features.agg(
        F.count(F.lit(1)).alias("clients"),
        F.avg("amount_sum").alias("_value"),
        F.count(F.when(F.col("churn_probability") > 0.7, 1)).alias("clients_at_risk"),
    )
    cost, saved = at_risk * F.lit(cost_per_client), at_risk * F.lit(success_rate) * F.col("_value")
    return sums.select(
        "clients",
        "clients_at_risk",
        round_even("_value", 2).alias("mean_client_value"),
        round_even(at_risk * F.col("_value"), 2).alias("potential_loss"),
        round_even(cost, 2).alias("retention_cost"),
        round_even(at_risk * F.lit(success_rate), 2).alias("clients_saved"),
        round_even(saved, 2).alias("value_saved"),
        round_even(ratio(saved - cost, cost) * 100, 1).alias("roi_pct"),
    )


def churn_dashboard(features: DataFrame) -> DataFrame:
    n, p = F.count(F.lit(1)), F.col("churn_probability")
    high = F.count(F.when(p > 0.7, 1))
    medium = F.count(F.when((p > 0.3) & (p <= 0.7), 1))
    return features.agg(
        n.alias("clients"),
        F.sum("is_churned").alias("churned"),
        pct(F.sum("is_churned"), n, 1).alias("churn_rate"),
        high.alias("high_risk"),
        pct(high, n, 1).alias("high_risk_pct"),
        medium.alias("medium_risk"),
        pct(medium, n, 1).alias("medium_risk_pct"),
    )


def retention_actions(predictions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Action plan of each customer by risk, segment and value."""
    if segments is None:
        joined = predictions.withColumn("rfm_segment", F.lit("Unknown")).withColumn("monetary", F.lit(0.0))
    else:
        joined = predictions.join(segments.select("customer_id", "rfm_segment", "monetary"), "customer_id", "left")
    risk = F.col("risk_category")
    rule = (
        F.when((risk == "Critical") & (F.col("monetary") > 1000), "critical_high_value")
        .when(risk == "Critical", "critical")
        .when((risk == "High") & (F.col("rfm_segment") == "Champions"), "high_champion")
        .when(risk == "High", "high")
        .when(risk == "Medium", "medium")
        .otherwise("low")
    )
    plans = rules.frame(predictions.sparkSession, rules.RETENTION, rules.RETENTION_SCHEMA)
    return joined.withColumn("rule", rule).join(F.broadcast(plans), "rule").drop("rule")


def retention_roi(actions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Estimated return when a saved customer comes back with one mean order."""
    rates = F.create_map(*[x for k, v in rules.SUCCESS_RATES.items() for x in (F.lit(k), F.lit(v))])
    rated = actions.withColumn("estimated_success_rate", rates[F.col("risk_category")])
    if segments is None:
        rated = rated.withColumn("_mean", F.lit(100.0))
    else:
        money = F.col("monetary").cast("decimal(28,2)")
        mean = segments.agg(ratio(F.sum(money), F.count(money)).alias("_mean"))
        rated = rated.transform(with_row, mean)
    gain = F.col("estimated_success_rate") * F.col("_mean") * F.lit(0.2)
    roi = ratio(gain - F.col("estimated_budget"), "estimated_budget") * 100
    return rated.withColumn("estimated_roi", round_even(roi, 1)).drop("_mean")
