"""Campaign rules, greedy budget, calendar and A/B test on small frames."""

import math
import random

import pytest

from cartloom.operators import abtest, campaigns, churn, customers


def test_enrichment_defaults(spark):
    who = spark.createDataFrame([(1, "At_Risk"), (2, "Champions")], "customer_id int, rfm_segment string")
    risk = spark.createDataFrame([(1, 0.9, "Critical")], "customer_id int, churn_probability double, risk_category string")
    got = {r["customer_id"]: (r["churn_probability"], r["risk_category"]) for r in campaigns.with_churn_risk(who, risk).collect()}
    assert got == {1: (0.9, "Critical"), 2: (0.1, "Low")}


def test_segment_rules_in_order(spark):
    schema = "customer_id int, monetary double, frequency int, rfm_segment string, recency int, churn_probability double, risk_category string"
    rows = [
        (1, 2000.0, 9, "Lost_Customers", 99, 0.8, "Critical"), (2, 2000.0, 9, "Champions", 1, 0.1, "Low"),
        (3, 500.0, 2, "Champions", 30, 0.1, "Low"), (4, 200.0, 2, "Potential_Loyalists", 5, 0.9, "Critical"),
        (5, 100.0, 1, "Potential_Loyalists", 5, 0.7, "High"), (6, 100.0, 1, "At_Risk", 90, 0.1, "Low"),
        (7, 100.0, 1, "New Customers", 5, 0.1, "Low"), (8, 100.0, 1, "Lost_Customers", 300, 0.1, "Low"),
    ]
    out = campaigns.campaign_segments(spark.createDataFrame(rows, schema)).orderBy("customer_id").collect()
    assert [r["campaign_segment"] for r in out] == [
        "VIP_AtRisk", "VIP_Whales", "Champions_Active", "Growth_Potential", "Winback_Urgent", "Reactivation_Soft",
        "New_Development", "Maintenance_LowCost",
    ]


@pytest.mark.parametrize("seed", range(5))
def test_budget_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [
        (f"s{i}", rng.randint(1, 50), float(rng.choice([2, 5, 8, 12])), 0.2, float(rng.randint(-50, 900)), float(rng.randint(100, 9000)), float(rng.randint(30, 100)))
        for i in range(6)
    ]
    schema = "campaign_segment string, customers_count long, avg_cost_per_customer double, response_rate double, roi_percent double, total_revenue_potential double, priority double"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "*", "customers_count * avg_cost_per_customer AS total_budget_needed", "priority * 0.4 + roi_percent * 0.6 AS combined_score"
    )
    budget = rng.randint(50, 900)
    got = {r["campaign_segment"]: (r["allocated_budget"], r["customers_targeted"], r["status"]) for r in campaigns.budget_allocation(df, budget).collect()}
    left, want = float(budget), {}
    for name, n, cost, _, roi, _, priority in sorted(rows, key=lambda r: (-(r[6] * 0.4 + r[4] * 0.6), r[0])):
        if left <= 0:
            want[name] = (0.0, 0, "insufficient_budget")
            continue
        spend = min(n * cost, left)
        want[name] = (spend, n if spend == n * cost else int(left / cost), "fully_funded" if spend == n * cost else "partially_funded")
        left -= spend
    assert got == want


def test_calendar_of_one_segment(spark):
    df = spark.createDataFrame(
        [(1, "VIP_AtRisk", 400.0, 10, 50.0, 100.0, 0.0, "fully_funded"), (2, "Maintenance_LowCost", 20.0, 10, 5.0, 30.0, 0.0, "fully_funded")],
        "allocation_order int, campaign_segment string, allocated_budget double, customers_targeted long, roi_percent double, priority double, expected_revenue double, status string",
    )
    out = campaigns.campaign_calendar(df, "2024-01-01").orderBy("campaign_id").collect()
    assert [(r["week_number"], r["start_date"], r["customers_targeted"], r["budget_allocated"]) for r in out] == [
        (1, "2024-01-01", 2, 80.0), (3, "2024-01-15", 2, 80.0), (5, "2024-01-29", 2, 80.0), (7, "2024-02-12", 2, 80.0),
    ]
    assert out[0]["channels"] == "personal_call, email" and out[0]["campaign_id"] == "CAMP_0001"


def test_significance_matches_the_formula(spark):
    df = spark.createDataFrame(
        [("A", 200, 20, 100.0, 10.0), ("B", 210, 45, 300.0, 40.0)],
        "variant string, customers long, responders long, total_revenue double, roi_percent double",
    )
    row = abtest.significance(df).first()
    pooled = 65 / 410
    z = (45 / 210 - 20 / 200) / math.sqrt(pooled * (1 - pooled) * (1 / 200 + 1 / 210))
    assert row["z_score"] == pytest.approx(z, abs=1e-3)
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-4)
    best = abtest.winner(df).first()
    assert (best["winner"], best["winner_lift_percent"], best["recommend_variant"]) == ("B", 300.0, "B")


def test_no_responses_is_not_significant(spark):
    df = spark.createDataFrame([("A", 20, 0, 0.0, 0.0), ("B", 20, 3, 9.0, 0.0)], "variant string, customers long, responders long, total_revenue double, roi_percent double")
    row = abtest.significance(df).first()
    assert (row["p_value"], row["is_significant"], row["confidence_level"]) == (1.0, False, 0)
    assert abtest.winner(df).first()["winner"] == "tie"


def test_small_groups_are_not_tested(spark):
    assert abtest.assign(spark.range(9).withColumnRenamed("id", "customer_id")).count() == 0
    parts = abtest.assign(spark.range(2000).withColumnRenamed("id", "customer_id")).groupBy("variant").count().collect()
    assert all(900 < r["count"] < 1100 for r in parts)


def test_retention_rules(spark):
    risk = spark.createDataFrame([(1, 0.9, "Critical"), (2, 0.9, "Critical"), (3, 0.7, "High"), (4, 0.7, "High"), (5, 0.1, "Very Low")], "customer_id int, churn_probability double, risk_category string")
    who = spark.createDataFrame([(1, "At_Risk", 2000.0), (2, "At_Risk", 10.0), (3, "Champions", 10.0), (4, "At_Risk", 10.0)], "customer_id int, rfm_segment string, monetary double")
    out = churn.retention_roi(churn.retention_actions(risk, who), who).orderBy("customer_id").collect()
    assert [r["estimated_budget"] for r in out] == [100, 50, 75, 30, 10]
    mean = 2030 / 4
    assert out[0]["estimated_roi"] == round((0.15 * mean * 0.2 - 100) / 100 * 100, 1)


def test_customers_without_a_cluster_stay_on_the_lists_of_their_segment(spark):
    rows = [(1, "Champions", 0, 1, 2, 900.0), (2, "Champions", None, 3, 0, 50.0), (3, "At Risk", 1, 9, 1, 20.0), (4, "At Risk", 2, 9, 1, 10.0),
            (5, "Potential Loyalists", None, 4, 0, 30.0), (6, "At Risk", 3, 9, 1, 5.0)]
    df = spark.createDataFrame(rows, "customer_id int, rfm_segment string, cluster int, recency int, frequency int, monetary double")
    lists = {(r["customer_id"], r["target"]) for r in customers.priority_segments(df).collect()}
    assert lists == {
        (1, "CHAMPIONS"), (2, "CHAMPIONS"), (5, "POTENTIAL_LOYALISTS"), (1, "SUPER_WHALES"), (3, "HIGH_VALUE"), (4, "ONE_SHOT_PROBLEM"), (6, "ONE_SHOT_PROBLEM"),
    }
    assert {r["cluster"]: r["clusters"] for r in customers.cluster_ranks(df).collect()} == {0: 4, 1: 4, 2: 4, 3: 4}


def test_behaviour_sends_each_line_at_full_width_once(spark):
    rows = [("7", "1", "A", 2, 3.0, "SALE"), ("7", "1", "B", 1, 1.0, "SALE"), ("7", "2", "A", 1, 2.0, "SALE"), ("8", None, None, 5, 1.0, "SALE"), ("9", "C3", "A", -1, 1.0, "RETURN")]
    df = spark.createDataFrame(rows, "CustomerID string, Invoice string, StockCode string, Quantity int, Price double, Transaction_Type string").selectExpr(
        "*", "timestamp'2010-01-01' AS InvoiceDate", "CAST(Quantity * Price AS decimal(18,2)) AS Total_Amount", "'France' AS Country")
    out = customers.behaviour_features(df)
    found = {r["customer_id"]: (r["frequency"], r["product_diversity"], r["monetary"], r["avg_basket"]) for r in out.collect()}
    assert found == {"7": (2, 2, 9.0, 4.5), "8": (0, 0, 5.0, None)}
    assert out.columns[:3] == ["customer_id", "frequency", "monetary"]
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
