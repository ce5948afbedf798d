"""Churn queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.numeric import round_even, stamp_text
from cartloom.functions.scalars import with_row
from cartloom.operators import churn
from cartloom.plans.catalog import query


def _rounded(df, *columns, digits=4):
    return df.withColumns({c: round_even(c, digits) for c in columns})


def _select(columns: str, source: str = "churn_features") -> str:
    return f"SELECT customer_id, {columns} FROM {source}"


@query(
    "churn_features_base",
    _select(
        """strftime(first_order_date,'%Y-%m-%d %H:%M:%S') AS first_order_date, strftime(last_order_date,'%Y-%m-%d %H:%M:%S') AS last_order_date, total_orders, total_spent,
 round_even(avg_order_value,4) AS avg_order_value, round_even(spending_std,3) AS spending_std, recency_days, customer_lifetime_days, round_even(avg_days_between_orders,4) AS avg_days_between_orders"""
    ),
)
def churn_features_base(m):
    out = m.churn_features.select(
        "customer_id", "first_order_date", "last_order_date", "total_orders", "total_spent", "avg_order_value", "spending_std",
        "recency_days", "customer_lifetime_days", "avg_days_between_orders",
    ).withColumns({c: stamp_text(c) for c in ("first_order_date", "last_order_date")})
    return _rounded(_rounded(out, "avg_order_value", "avg_days_between_orders"), "spending_std", digits=3)


@query("churn_features_recent", _select("recent_spent, round_even(recent_aov,4) AS recent_aov, recent_orders"))
def churn_features_recent(m):
    return _rounded(m.churn_features.select("customer_id", "recent_spent", "recent_aov", "recent_orders"), "recent_aov")


@query("churn_features_trend", _select("round_even(spending_trend,4) AS spending_trend, round_even(order_frequency_trend,4) AS order_frequency_trend"))
def churn_features_trend(m):
    return _rounded(m.churn_features.select("customer_id", "spending_trend", "order_frequency_trend"), "spending_trend", "order_frequency_trend")


@query("churn_features_risk", _select("round_even(spending_volatility,4) AS spending_volatility, round_even(engagement_score,4) AS engagement_score, is_one_time_customer"))
def churn_features_risk(m):
    return _rounded(
        m.churn_features.select("customer_id", "spending_volatility", "engagement_score", "is_one_time_customer"), "spending_volatility", "engagement_score"
    )


@query(
    "churn_features_external",
    """SELECT customer_id, total_orders, coalesce(product_diversity,0) AS product_diversity, round_even(coalesce(clv_estimated,0),2) AS clv_estimated
FROM churn_features LEFT JOIN clv USING (customer_id)""",
)
def churn_features_external(m):
    out = churn.add_external(m.churn_features, m.clv)
    return _rounded(out.select("customer_id", "total_orders", "product_diversity", "clv_estimated"), "clv_estimated", digits=2)


@query("churn_labels", _select("recency_days, total_orders, is_churned", "churn_labels"))
def churn_labels(m):
    return m.churn_labels.select("customer_id", "recency_days", "total_orders", "is_churned")


_TEMPORAL = "coalesce(quantity_std,0) AS quantity_std, coalesce(price_std,0) AS price_std, coalesce(amount_std,0) AS amount_std"


@query(
    "churn_features_temporal",
    f"""SELECT * EXCLUDE (quantity_std, price_std, amount_std) REPLACE (quantity_sum::BIGINT AS quantity_sum), {_TEMPORAL},
 round_even(purchase_lines::DOUBLE/(days_active+1)*30,4) AS purchase_frequency,
 round_even(amount_sum/invoices,4) AS avg_order_value, round_even(coalesce(amount_std/(amount_mean+1),0),4) AS spending_volatility FROM temporal_base WHERE invoices>=3""",
)
def churn_features_temporal(m):
    return _rounded(m.churn_temporal, "purchase_frequency", "avg_order_value", "spending_volatility")


@query("churn_labels_temporal", "SELECT customer_id, is_churned FROM temporal_base")
def churn_labels_temporal(m):
    return churn.temporal_base(m.cleaned).select("customer_id", "is_churned")


@query(
    "risk_bands",
    """SELECT customer_id, round_even(churn_probability,4) AS churn_probability, CASE WHEN churn_probability>0 AND churn_probability<=0.3 THEN 'low' WHEN churn_probability>0.3 AND churn_probability<=0.7 THEN 'medium'
 WHEN churn_probability>0.7 AND churn_probability<=1 THEN 'high' END AS risk_band, risk_category FROM predictions""",
)
def risk_bands(m):
    return m.predictions.select(
        "customer_id",
        round_even("churn_probability", 4).alias("churn_probability"),
        churn.risk_band("churn_probability").alias("risk_band"),
        "risk_category",
    )


_ACTIONS = """SELECT p.customer_id, p.risk_category, s.rfm_segment, s.monetary, a.* EXCLUDE (rule), round_even(p.churn_probability,4) AS churn_probability FROM predictions p LEFT JOIN rfm_lib s USING (customer_id)
JOIN retention_rules a ON a.rule = CASE WHEN risk_category='Critical' AND monetary>1000 THEN 'critical_high_value' WHEN risk_category='Critical' THEN 'critical'
 WHEN risk_category='High' AND rfm_segment='Champions' THEN 'high_champion' WHEN risk_category='High' THEN 'high' WHEN risk_category='Medium' THEN 'medium' ELSE 'low' END"""


@query("retention_actions", _ACTIONS)
def retention_actions(m):
    return _rounded(churn.retention_actions(m.predictions, m.rfm_lib).drop("model_used", "prediction_date"), "churn_probability")


@query(
    "retention_roi",
    f"""SELECT customer_id, risk_category, estimated_budget, r AS estimated_success_rate, round_even((r*(SELECT sum(monetary::DECIMAL(28,2))::DOUBLE/count(*) FROM rfm_lib)*0.2::DOUBLE-estimated_budget)/estimated_budget*100,1) AS estimated_roi FROM (
SELECT *, CASE risk_category WHEN 'Critical' THEN 0.15::DOUBLE WHEN 'High' THEN 0.25 WHEN 'Medium' THEN 0.35 WHEN 'Low' THEN 0.45 ELSE 0.6 END AS r FROM ({_ACTIONS}))""",
)
def retention_roi(m):
    out = churn.retention_roi(churn.retention_actions(m.predictions, m.rfm_lib), m.rfm_lib)
    return out.select("customer_id", "risk_category", "estimated_budget", "estimated_success_rate", "estimated_roi")


_MONEY = "total_spent::DECIMAL(28,2)"


@query(
    "churn_patterns",
    f"""SELECT round_even(sum(is_churned)::DOUBLE/count(*)*100,1) AS churn_rate, sum(is_churned)::BIGINT AS churned_customers, (count(*)-sum(is_churned))::BIGINT AS active_customers,
 round_even((sum(recency_days) FILTER (is_churned=1))::DOUBLE/count(*) FILTER (is_churned=1),1) AS avg_recency_churned, round_even((sum(recency_days) FILTER (is_churned=0))::DOUBLE/count(*) FILTER (is_churned=0),1) AS avg_recency_active,
 round_even((sum(total_orders) FILTER (is_churned=1))::DOUBLE/count(*) FILTER (is_churned=1),1) AS avg_orders_churned, round_even((sum(total_orders) FILTER (is_churned=0))::DOUBLE/count(*) FILTER (is_churned=0),1) AS avg_orders_active,
 round_even((sum({_MONEY}) FILTER (is_churned=1))::DOUBLE/count(*) FILTER (is_churned=1),2) AS avg_value_churned, round_even((sum({_MONEY}) FILTER (is_churned=0))::DOUBLE/count(*) FILTER (is_churned=0),2) AS avg_value_active,
 coalesce(round_even((sum(is_one_time_customer) FILTER (is_churned=1))::DOUBLE/nullif(sum(is_one_time_customer),0)*100,1),0) AS one_time_customer_churn_rate,
 coalesce((sum({_MONEY}) FILTER (is_churned=1))::DOUBLE,0) AS revenue_at_risk FROM churn_labels""",
)
def churn_patterns(m):
    return churn.churn_patterns(m.churn_labels)


# -- with fitted models -----------------------------------------------------------------
# Values depend on the fits and are registered as ``*_values``; the query of the operator's own name says what must hold of them.
_TEST = "('0x'||substr(md5('split:'||customer_id),1,8))::BIGINT % 100 >= 80"
_TEMPORAL_ROWS = "(SELECT * FROM temporal_base WHERE invoices>=3)"


@query("churn_train_select_values")
def churn_train_select_values(m):
    """The three models with their test AUC; the best one is marked."""
    return m.model_scores


@query(
    "churn_train_select",
    f"""SELECT model, count(*) FILTER ({_TEST}) AS test_rows, 15 AS features, true AS auc_in_range, true AS one_best FROM churn_labels, (VALUES ('logistic'),('random_forest'),('gradient_boosting')) v(model) GROUP BY 1""",
)
def churn_train_select(m):
    """Every model with its test rows and features, that its AUC is one, and that exactly one model is best."""
    best = m.model_scores.agg((F.count(F.when(F.col("is_best"), 1)) == 1).alias("one_best"))
    sizes = [
        m.trained(name).test.agg(F.count(F.lit(1)).alias("test_rows")).select(F.lit(name).alias("model"), "test_rows", F.lit(len(m.trained(name).features)).alias("features"))
        for name in m.MODELS
    ]
    return m.model_scores.join(F.broadcast(reduce(DataFrame.unionByName, sizes)), "model").transform(with_row, best).select(
        "model", "test_rows", "features", F.col("auc").between(0, 1).alias("auc_in_range"), "one_best"
    )


@query("churn_score_values")
def churn_score_values(m):
    return m.model_predictions


_LATEST = "(SELECT strftime(max(order_date),'%Y-%m-%d') FROM orders_view)"


@query("churn_score", f"SELECT customer_id, 'random_forest' AS model_used, {_LATEST} AS prediction_date, true AS in_range, true AS category_fits FROM churn_labels")
def churn_score(m):
    """Every customer once: the model and date of its score, and that the category is the probability's."""
    p = F.col("churn_probability")
    fits = F.lit(False)
    for name, low, high in (("Very Low", -1.0, 0.2), ("Low", 0.2, 0.4), ("Medium", 0.4, 0.6), ("High", 0.6, 0.8), ("Critical", 0.8, 2.0)):
        fits = fits | ((F.col("risk_category") == name) & (p >= low) & (p < high))
    return m.model_predictions.select("customer_id", "model_used", "prediction_date", p.between(0, 1).alias("in_range"), fits.alias("category_fits"))


@query("risk_band_analysis_values")
def risk_band_analysis_values(m):
    return churn.risk_band_analysis(m.temporal_scored)


@query(
    "risk_band_analysis",
    f"""SELECT count(*) AS customers, sum(is_churned)::BIGINT AS churned, true AS rates_fit, true AS bands_apart FROM {_TEMPORAL_ROWS}""",
)
def risk_band_analysis(m):
    """What the bands add up to, that each rate is its counts', and that no band's probabilities lie outside its limits."""
    edges = F.create_map(*[x for name, low, high in (("low", 0.0, 0.3), ("medium", 0.3, 0.7), ("high", 0.7, 1.0)) for x in (F.lit(name), F.array(F.lit(low), F.lit(high)))])
    band, half = edges[F.col("risk_band")], 5e-4  # probabilities are rounded to three digits
    return risk_band_analysis_values(m).agg(
        F.sum("customers").alias("customers"), F.sum("churned").alias("churned"),
        F.every(F.abs(F.col("churn_rate") - F.col("churned") / F.col("customers")) <= half).alias("rates_fit"),
        F.every((F.col("min_probability") >= band[0] - half) & (F.col("max_probability") <= band[1] + half) & (F.col("mean_probability").between(F.col("min_probability") - half, F.col("max_probability") + half))).alias("bands_apart"),
    )


@query("retention_impact_values")
def retention_impact_values(m):
    return churn.retention_impact(m.temporal_scored)


@query(
    "retention_impact",
    f"""SELECT count(*) AS clients, round_even(avg(amount_sum),2) AS mean_client_value, true AS risk_is_a_share, true AS figures_fit FROM {_TEMPORAL_ROWS}""",
)
def retention_impact(m):
    """Clients and their mean value, and that loss, cost, savings and return follow from the clients at risk."""
    n, value = F.col("clients_at_risk"), F.col("mean_client_value")
    cent = F.lit(0.011) * (n + 1)
    return retention_impact_values(m).select(
        "clients", "mean_client_value", n.between(0, F.col("clients")).alias("risk_is_a_share"),
        (
            (F.abs(F.col("potential_loss") - n * value) <= cent) & (F.abs(F.col("retention_cost") - n * 50) < 0.01)
            & (F.abs(F.col("value_saved") - n * 0.3 * value) <= cent) & (F.abs(F.col("clients_saved") - n * 0.3) < 0.01)
            & F.coalesce(F.abs(F.col("roi_pct") - (F.col("value_saved") / F.col("retention_cost") - 1) * 100) < 0.2, n == 0)
        ).alias("figures_fit"),
    )


@query("churn_dashboard_values")
def churn_dashboard_values(m):
    return churn.churn_dashboard(m.temporal_scored)


@query(
    "churn_dashboard",
    f"""SELECT count(*) AS clients, sum(is_churned)::BIGINT AS churned, round_even(sum(is_churned)::DOUBLE/count(*)*100,1) AS churn_rate, true AS shares_fit, true AS as_the_bands FROM {_TEMPORAL_ROWS}""",
)
def churn_dashboard(m):
    """Clients and churn, that the risk shares are those of the counts, and that the counts are those of the bands."""
    bands = churn.risk_band_analysis(m.temporal_scored).agg(*[F.coalesce(F.max(F.when(F.col("risk_band") == b, F.col("customers"))), F.lit(0)).alias(f"_{b}") for b in ("medium", "high")])
    share = lambda c: F.abs(F.col(f"{c}_risk_pct") - F.col(f"{c}_risk") / F.col("clients") * 100) <= 0.0501
    return churn_dashboard_values(m).transform(with_row, bands).select(
        "clients", "churned", "churn_rate", (share("high") & share("medium")).alias("shares_fit"),
        ((F.col("high_risk") == F.col("_high")) & (F.col("medium_risk") == F.col("_medium"))).alias("as_the_bands"),
    )


@query("churn_analysis_full_values")
def churn_analysis_full_values(m):
    """Features, labels, scores and actions of every customer."""
    actions = churn.retention_roi(churn.retention_actions(m.model_predictions, m.rfm_lib), m.rfm_lib)
    return actions.join(m.churn_labels.select("customer_id", "is_churned"), "customer_id")


@query(
    "churn_analysis_full",
    f"""SELECT customer_id, is_churned, rfm_segment, monetary, 'random_forest' AS model_used, {_LATEST} AS prediction_date, true AS action_fits, true AS return_fits
FROM churn_labels LEFT JOIN rfm_lib USING (customer_id)""",
)
def churn_analysis_full(m):
    """Every customer with label, segment and spend, that its action is the one for its risk, and the return that of the action."""
    risk, money, segment = F.col("risk_category"), F.coalesce(F.col("monetary"), F.lit(0.0)), F.coalesce(F.col("rfm_segment"), F.lit(""))
    budget = (
        F.when((risk == "Critical") & (money > 1000), 100).when(risk == "Critical", 50).when((risk == "High") & (segment == "Champions"), 75)
        .when(risk == "High", 30).when(risk == "Medium", 20).otherwise(10)
    )
    mean = m.rfm_lib.agg(F.avg("monetary").alias("_mean"))
    gain = F.col("estimated_success_rate") * F.col("_mean") * 0.2
    return churn_analysis_full_values(m).transform(with_row, mean).select(
        "customer_id", "is_churned", "rfm_segment", "monetary", "model_used", "prediction_date", (F.col("estimated_budget") == budget).alias("action_fits"),
        (F.abs(F.col("estimated_roi") - (gain / F.col("estimated_budget") - 1) * 100) <= 0.06).alias("return_fits"),
    )
