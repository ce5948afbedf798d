"""Campaign, A/B test and attribution queries."""

from pyspark.sql import functions as F

from cartloom.functions import rules
from cartloom.functions.numeric import round_even
from cartloom.operators import abtest, attribution, campaigns, customers
from cartloom.plans.catalog import query
from cartloom.plans.queries_customers import score_bands

BUDGET = 5000.0
START = "2024-01-01"
AB_CONFIG = {"B": {"response_lift": 0.1, "conversion_lift": 0.05, "cost_modifier": 1.2}}


def _allocation(m):
    return campaigns.budget_allocation(campaigns.campaign_segment_analysis(m.campaign_customers), BUDGET)


def _calendar(m):
    return campaigns.campaign_calendar(_allocation(m), START)


@query(
    "campaign_churn_enrich",
    """SELECT r.customer_id, rfm_segment, round_even(coalesce(churn_probability,0.1),4) AS churn_probability, coalesce(risk_category,'Low') AS risk_category
FROM rfm_lib r LEFT JOIN predictions p USING (customer_id)""",
)
def campaign_churn_enrich(m):
    out = campaigns.with_churn_risk(m.rfm_lib, m.predictions)
    return out.select("customer_id", "rfm_segment", round_even("churn_probability", 4).alias("churn_probability"), "risk_category")


@query("campaign_segments", "SELECT customer_id, rfm_segment, campaign_segment FROM campaign_customers")
def campaign_segments(m):
    return m.campaign_customers.select("customer_id", "rfm_segment", "campaign_segment")


@query(
    "campaign_attributes",
    """SELECT customer_id, campaign_segment, campaign_priority, array_to_string(channels,', ') AS recommended_channels, recommended_budget_per_customer, expected_response_rate FROM campaign_customers""",
)
def campaign_attributes(m):
    return m.campaign_customers.select(
        "customer_id", "campaign_segment", "campaign_priority", F.array_join("recommended_channels", ", ").alias("recommended_channels"),
        "recommended_budget_per_customer", "expected_response_rate",
    )


@query(
    "campaign_roi",
    "SELECT customer_id, round_even(revenue_potential,2) AS revenue_potential, campaign_cost, estimated_roi, (estimated_roi>15)::INTEGER AS is_profitable_segment FROM campaign_customers",
)
def campaign_roi(m):
    return m.campaign_customers.select(
        "customer_id", round_even("revenue_potential", 2).alias("revenue_potential"), "campaign_cost", "estimated_roi", "is_profitable_segment"
    )


@query(
    "channel_costs",
    """SELECT customer_id, campaign_segment, round_even(sum(cost),2) AS contact_cost, count(*) AS channels FROM (SELECT customer_id, campaign_segment, unnest(channels) AS channel FROM campaign_customers)
JOIN (VALUES ('email',0.10::DOUBLE),('sms',0.20),('social_media',2.0),('google_ads',5.0),('display_ads',3.0),('personal_call',25.0),('direct_mail',8.0)) c(channel,cost) USING (channel) GROUP BY 1,2""",
)
def channel_costs(m):
    return campaigns.channel_costs(m.campaign_customers)


@query("campaign_segment_analysis", "SELECT * REPLACE (round_even(total_budget_needed,2) AS total_budget_needed, round_even(combined_score,4) AS combined_score) FROM campaign_analysis")
def campaign_segment_analysis(m):
    return campaigns.campaign_segment_analysis(m.campaign_customers).withColumns(
        {"total_budget_needed": round_even("total_budget_needed", 2), "combined_score": round_even("combined_score", 4)}
    )


@query("budget_allocation", "SELECT * FROM allocation")
def budget_allocation(m):
    return _allocation(m)


@query(
    "budget_summary",
    """SELECT round_even(sum(allocated_budget),2) AS total_allocated, sum(customers_targeted)::BIGINT AS total_customers_targeted, round_even(sum(expected_revenue),2) AS total_expected_revenue,
 5000.0::DOUBLE AS total_budget, round_even(5000-sum(allocated_budget),2) AS remaining_budget, round_even((round_even(sum(expected_revenue),2)*0.25::DOUBLE-round_even(sum(allocated_budget),2))/round_even(sum(allocated_budget),2)*100,1) AS overall_roi_percent,
 round_even(sum(allocated_budget)/5000*100,1) AS budget_utilization_percent FROM allocation""",
)
def budget_summary(m):
    return campaigns.budget_summary(_allocation(m), BUDGET)


@query("campaign_calendar", "SELECT * FROM calendar")
def campaign_calendar(m):
    return _calendar(m)


@query("calendar_metrics", "SELECT * FROM calendar_full")
def calendar_metrics(m):
    return campaigns.calendar_metrics(_calendar(m))


_FIGURES = """count(*) AS campaigns, sum(customers_targeted)::BIGINT AS customers, round_even(sum(budget_allocated),2) AS budget, round_even(sum(expected_revenue),2) AS revenue,
 round_even(avg(budget_allocated),2) AS mean_budget, max(week_number) AS last_week FROM calendar_full"""


@query(
    "calendar_summary",
    f"""SELECT 'month' AS kind, month AS item, {_FIGURES} GROUP BY month UNION ALL SELECT 'total','all', {_FIGURES}
UNION ALL SELECT * FROM (SELECT 'top_segment', segment, {_FIGURES} GROUP BY segment ORDER BY campaigns DESC, segment LIMIT 3)""",
)
def calendar_summary(m):
    return campaigns.calendar_summary(campaigns.calendar_metrics(_calendar(m)))


# -- A/B test ----------------------------------------------------------------------------
def _ab(m):
    assigned = abtest.assign(m.campaign_customers, "t1")
    return abtest.metrics(assigned, abtest.observed_responses(m.conversions), AB_CONFIG)


@query("ab_assign", "SELECT customer_id, variant FROM ab_population")
def ab_assign(m):
    return abtest.assign(m.campaign_customers, "t1").select("customer_id", "variant")


@query("ab_metrics", "SELECT * FROM ab_metrics_view")
def ab_metrics(m):
    return _ab(m)


_SIG = """WITH w AS (SELECT max(customers) FILTER (variant='A') AS n1, max(customers) FILTER (variant='B') AS n2, max(responders) FILTER (variant='A') AS x1, max(responders) FILTER (variant='B') AS x2,
 max(roi_percent) FILTER (variant='A') AS a, max(roi_percent) FILTER (variant='B') AS b, max(total_revenue) FILTER (variant='A') AS ra, max(total_revenue) FILTER (variant='B') AS rb FROM ab_metrics_view),
 z AS (SELECT *, (x2::DOUBLE/n2-x1::DOUBLE/n1) AS d, (x1+x2)::DOUBLE/(n1+n2) AS p FROM w),
 y AS (SELECT *, CASE WHEN x1>0 AND x2>0 THEN d/sqrt(p*(1-p)*(1.0::DOUBLE/n1+1.0::DOUBLE/n2)) ELSE 0 END AS zs FROM z),
 t AS (SELECT *, abs(zs)/sqrt(2.0::DOUBLE) AS x, 1/(1+0.3275911::DOUBLE*abs(zs)/sqrt(2.0::DOUBLE)) AS k FROM y),
 v AS (SELECT *, CASE WHEN x1>0 AND x2>0 THEN 2*(1-0.5::DOUBLE*(1+(1-((((1.061405429::DOUBLE*k-1.453152027)*k+1.421413741)*k-0.284496736)*k+0.254829592)*k*exp(-x*x)))) ELSE 1 END AS pv FROM t)
"""


@query(
    "ab_significance",
    _SIG
    + """SELECT round_even(d,4) AS response_rate_diff, round_even(zs,3) AS z_score, round_even(pv,4) AS p_value, (x1>0 AND x2>0 AND pv<0.05) AS is_significant,
 CASE WHEN x1>0 AND x2>0 THEN 95 ELSE 0 END AS confidence_level FROM v""",
)
def ab_significance(m):
    return abtest.significance(_ab(m))


@query(
    "ab_winner",
    _SIG
    + """SELECT w AS winner, round_even(CASE WHEN b>a AND a>0 THEN (b-a)/a*100 WHEN a>b AND b>0 THEN (a-b)/b*100 ELSE 0 END,1) AS winner_lift_percent, round_even(b-a,1) AS roi_difference,
 round_even(rb-ra,2) AS revenue_difference, CASE WHEN s THEN w ELSE 'A' END AS recommend_variant, CASE WHEN s THEN 'Significant' ELSE 'Not Significant' END AS statistical_significance
FROM (SELECT *, (x1>0 AND x2>0 AND pv<0.05) AS s, CASE WHEN b>a THEN 'B' WHEN a>b THEN 'A' ELSE 'tie' END AS w FROM v)""",
)
def ab_winner(m):
    return abtest.winner(_ab(m))


# -- attribution ----------------------------------------------------------------------------
def _credits(m, model):
    out = attribution.attribute(m.touches, m.conversions, model)
    return out.withColumn("credit", round_even("credit", 4))


@query(
    "attribution_last_touch",
    "SELECT conversion_id, customer_id, channel, round_even(revenue,4) AS credit FROM (SELECT *, row_number() OVER (PARTITION BY conversion_id ORDER BY ts DESC, touch_id DESC) AS k FROM journeys) WHERE k=1",
)
def attribution_last_touch(m):
    return _credits(m, "last_touch")


@query(
    "attribution_first_touch",
    "SELECT conversion_id, customer_id, channel, round_even(revenue,4) AS credit FROM (SELECT *, row_number() OVER (PARTITION BY conversion_id ORDER BY ts, touch_id) AS k FROM journeys) WHERE k=1",
)
def attribution_first_touch(m):
    return _credits(m, "first_touch")


@query(
    "attribution_linear",
    """SELECT conversion_id, customer_id, channel, round_even(max(revenue)*count(*)/max(n),4) AS credit FROM (SELECT *, count(*) OVER (PARTITION BY conversion_id) AS n FROM journeys) GROUP BY 1,2,3""",
)
def attribution_linear(m):
    return _credits(m, "linear")


@query(
    "attribution_time_decay",
    """SELECT conversion_id, customer_id, channel, round_even(max(revenue)*sum(w)/max(s),4) AS credit FROM (SELECT *, sum(w) OVER (PARTITION BY conversion_id) AS s FROM (
 SELECT *, pow(2.0::DOUBLE, -(epoch_us(converted_at)-epoch_us(ts))/(86400000000*7.0::DOUBLE)) AS w FROM journeys)) GROUP BY 1,2,3""",
)
def attribution_time_decay(m):
    return _credits(m, "time_decay")


@query(
    "attribution_summary",
    """WITH c AS (SELECT conversion_id, channel, max(revenue)*count(*)/max(n) AS credit FROM (SELECT *, count(*) OVER (PARTITION BY conversion_id) AS n FROM journeys) GROUP BY 1,2)
SELECT channel, round_even(sum(credit),2) AS credit, count(*) AS conversions, round_even(sum(credit)/(SELECT sum(credit) FROM c)*100,3) AS share_pct FROM c GROUP BY 1""",
)
def attribution_summary(m):
    return attribution.attribution_summary(attribution.attribute(m.touches, m.conversions, "linear"))


# -- target lists -----------------------------------------------------------------------------
def _targets(m):
    return customers.priority_segments(score_bands(m))


@query("campaign_potential", "SELECT * FROM potential")
def campaign_potential(m):
    return campaigns.campaign_potential(_targets(m))


@query(
    "campaign_planning",
    """SELECT p.target, strftime(DATE '2024-01-01'+((t.start_week-1)*7)::INTEGER,'%Y-%m-%d') AS start_date, strftime(DATE '2024-01-01'+((t.start_week-1+t.duration_weeks)*7)::INTEGER,'%Y-%m-%d') AS end_date, t.start_week, t.duration_weeks,
 campaign_cost AS budget, roi, expected_revenue, customers, p.campaign_type, row_number() OVER (ORDER BY roi DESC, p.target) AS execution_rank FROM potential p JOIN target_rules t ON t.target = p.target""",
)
def campaign_planning(m):
    return campaigns.campaign_planning(campaigns.campaign_potential(_targets(m)), START)


@query(
    "effort_impact_quadrants",
    """SELECT target, round_even(campaign_cost/1000,4) AS effort_k, round_even(expected_revenue/1000,4) AS impact_k, CASE WHEN campaign_cost>(SELECT median(campaign_cost) FROM potential) THEN 'high' ELSE 'low' END AS effort,
 CASE WHEN expected_revenue>(SELECT median(expected_revenue) FROM potential) THEN 'high' ELSE 'low' END AS impact FROM potential""",
)
def effort_impact_quadrants(m):
    return campaigns.effort_impact(campaigns.campaign_potential(_targets(m)))


_MESSAGES = """(VALUES ('SUPER_WHALES','Offre Exclusive VIP - Compte dédié activé','Contactez votre Account Manager',200,'Email + Appel téléphonique'),
 ('CHAMPIONS','Club Champions - Vos privilèges vous attendent!','Profiter de mes -30%',50,'Email + SMS de rappel'),
 ('HIGH_VALUE','Collection Premium - Accès anticipé activé','Découvrir la collection',80,'Email premium + Retargeting'),
 ('POTENTIAL_LOYALISTS','On vous a préparé quelque chose...','Utiliser mon code MERCI15',30,'Email + SMS + Social Media'),
 ('ONE_SHOT_PROBLEM','On vous offre une 2ème chance!','Revenir avec -25%',15,'Email + Pub Facebook/Instagram')) x(target,subject,call_to_action,message_cost,main_channel)"""
_BODIES = "(VALUES " + ",".join(f"('{row[0]}','{row[5]}')" for row in rules.MESSAGES) + ") b(target,body)"


@query("message_assignment", f"SELECT customer_id, x.*, b.body FROM targets t JOIN {_MESSAGES} ON x.target = t.target JOIN {_BODIES} ON b.target = t.target")
def message_assignment(m):
    return campaigns.message_assignment(_targets(m))


@query("message_costs", f"SELECT t.target, count(*) AS messages, sum(message_cost)::BIGINT AS total_cost FROM targets t JOIN {_MESSAGES} ON x.target = t.target GROUP BY 1")
def message_costs(m):
    return campaigns.message_costs(campaigns.message_assignment(_targets(m)))
