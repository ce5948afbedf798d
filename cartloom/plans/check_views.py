"""The shared views of the check SQL, in DuckDB's dialect.

They restate the fixture views and the intermediate tables from the given
tables alone, independently of the Spark code.
"""

RULE_ROWS = {
    "campaign_rules": """
SELECT * FROM (VALUES
 ('VIP_AtRisk',100,50.0::DOUBLE,0.25::DOUBLE,1,2,8,'retention_urgent',['personal_call','email','direct_mail']),
 ('VIP_Whales',95,30.0,0.35,2,4,12,'loyalty_premium',['email','personal_call','direct_mail']),
 ('Champions_Active',90,15.0,0.40,3,4,10,'engagement_loyalty',['email','sms','social_media']),
 ('Winback_Urgent',85,20.0,0.15,1,3,6,'winback_aggressive',['sms','email','display_ads']),
 ('Growth_Potential',80,12.0,0.20,4,3,8,'upsell_cross_sell',['email','social_media','google_ads']),
 ('New_Development',70,8.0,0.18,5,2,6,'onboarding_nurture',['email','social_media','google_ads']),
 ('Reactivation_Soft',60,5.0,0.12,6,5,8,'reactivation_gentle',['email','display_ads']),
 ('Maintenance_LowCost',30,2.0,0.08,8,8,4,'maintenance_basic',['email'])
) t(campaign_segment,campaign_priority,recommended_budget_per_customer,expected_response_rate,start_week,every_weeks,duration_weeks,campaign_type,channels)""",
    "target_rules": """
SELECT * FROM (VALUES
 ('SUPER_WHALES',200,0.40::DOUBLE,1,4,'Approche B2B premium','ULTRA','Approche B2B dédiée',0.15::DOUBLE),
 ('CHAMPIONS',50,0.25,2,3,'Programme VIP','ABSOLUE','Programme VIP exclusif',0.05),
 ('HIGH_VALUE',80,0.20,3,2,'Fidélisation premium','PREMIUM','Fidélisation premium',NULL),
 ('POTENTIAL_LOYALISTS',30,0.15,5,6,'Nurturing séquentiel','CONVERSION','Séquences nurturing',0.30),
 ('ONE_SHOT_PROBLEM',15,0.08,8,4,'Réactivation massive','CRITIQUE','Campagnes réactivation',0.20)
) t(target,cost_per_customer,conversion_rate,start_week,duration_weeks,campaign_type,priority,key_action,uplift)""",
    "retention_rules": """
SELECT * FROM (VALUES
 ('critical_high_value','P0 - Immediate','Personal call + Email','Exclusive 30% discount + VIP benefits','High ($100+)','24-48h','Personal outreach, Custom offer, Account manager contact',100),
 ('critical','P1 - Urgent','Email + SMS','25% discount + Free shipping','Medium ($50)','3-7 days','Win-back email series, Limited time offer, Product recommendations',50),
 ('high_champion','P1 - Urgent','Email + Phone','VIP early access + 20% off','High ($75)','1 week','VIP re-engagement, Loyalty program promotion, New arrivals preview',75),
 ('high','P2 - Important','Email sequence','20% discount on favorites','Medium ($30)','2 weeks','Personalized recommendations, Browsing behavior triggers, Social proof',30),
 ('medium','P3 - Monitor','Automated email','15% off next purchase','Low ($20)','1 month','Newsletter engagement, Product education, Community building',20),
 ('low','P4 - Maintain','Regular marketing','Standard promotions','Standard ($10)','Ongoing','Regular newsletter, Seasonal campaigns, Cross-selling',10)
) t(rule,retention_priority,retention_channel,retention_offer,retention_budget,retention_timeline,retention_actions,estimated_budget)""",
}

VIEWS: dict[str, str] = {
    **RULE_ROWS,
    "raw_once": """
SELECT CASE WHEN o_orderkey % 1009 = 0 THEN NULL
            WHEN l_returnflag = 'R' AND o_orderkey % 3 = 0 THEN 'C' || o_orderkey
            ELSE o_orderkey::VARCHAR END AS "Invoice",
  CASE WHEN p_partkey % 200 = 0 THEN 'POST' ELSE p_partkey::VARCHAR END AS "StockCode",
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE p_name END AS "Description",
  CAST(CASE WHEN l_returnflag = 'R' AND o_orderkey % 3 = 0 THEN -l_quantity ELSE l_quantity END AS INTEGER) AS "Quantity",
  CASE WHEN o_orderkey % 211 = 0 THEN 'not a date'
       ELSE strftime(o_orderdate + to_minutes((o_orderkey * 37) % 1440), '%-m/%-d/%Y %-H:%M') END AS "InvoiceDate",
  CAST(CASE WHEN (o_orderkey + l_linenumber) % 83 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS "Price",
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_custkey END AS "CustomerID",
  n_name AS "Country"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "raw": """SELECT * FROM raw_once UNION ALL SELECT * FROM raw_once WHERE "CustomerID" % 31 = 0""",
    "raw_counted": """SELECT *, count(*) AS copies FROM raw GROUP BY ALL""",
    "raw_parsed": """SELECT *, try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') AS parsed_at FROM raw""",
    "kept_lib": """
SELECT * FROM raw WHERE "Description" IS NOT NULL AND "Invoice" IS NOT NULL AND "StockCode" IS NOT NULL
 AND "Price" IS NOT NULL AND "Price" <> 0 AND "Quantity" IS NOT NULL""",
    "cleaned_lib": """
SELECT "Invoice","StockCode","Description","Quantity", parsed_at AS "InvoiceDate","Price","CustomerID","Country",
 year(parsed_at) AS "Year", month(parsed_at) AS "Month", isodow(parsed_at)-1 AS "DayOfWeek", hour(parsed_at) AS "Hour",
 starts_with("Invoice",'C') AS "IsReturn", regexp_replace("Invoice",'^C','') AS "InvoiceClean",
 "Price"*"Quantity" AS "TotalAmount"
FROM (SELECT DISTINCT *, try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') AS parsed_at FROM kept_lib)
WHERE "CustomerID" IS NULL OR "CustomerID" > 0""",
    "typed_nb": """
SELECT "Invoice","StockCode","Description","Quantity", parsed_at AS "InvoiceDate","Price",
 "CustomerID"::BIGINT::VARCHAR AS "CustomerID","Country" FROM raw_parsed""",
    "guested": """
SELECT "Invoice","StockCode","Description","Quantity","InvoiceDate","Price",
 printf('GUEST_%06d', row_number() OVER (ORDER BY "Country" NULLS FIRST,"Description" NULLS FIRST,"Invoice" NULLS FIRST,
  "InvoiceDate" NULLS FIRST,"Price" NULLS FIRST,"Quantity" NULLS FIRST,"StockCode" NULLS FIRST) - 1) AS "CustomerID","Country"
FROM typed_nb WHERE "CustomerID" IS NULL
UNION ALL SELECT * FROM typed_nb WHERE "CustomerID" IS NOT NULL""",
    "logic_nb": """
SELECT *, CASE WHEN coalesce(starts_with("Invoice",'C'),false) THEN 'RETURN' ELSE 'SALE' END AS "Transaction_Type",
 "Quantity"*"Price" AS "Total_Amount",
 coalesce("Price"<=0 OR "Quantity"=0 OR "Quantity"*"Price"=0, false) AS "Suspicious"
FROM (SELECT DISTINCT * FROM guested)""",
    "fences": """
SELECT p3 + 1.5*(p3-p1) AS pf, q3 + 1.5*(q3-q1) AS qf FROM (SELECT
 quantile_cont("Price"::DOUBLE,0.25) FILTER ("Price">0) AS p1, quantile_cont("Price"::DOUBLE,0.75) FILTER ("Price">0) AS p3,
 quantile_cont("Quantity"::DOUBLE,0.25) FILTER ("Quantity">0) AS q1, quantile_cont("Quantity"::DOUBLE,0.75) FILTER ("Quantity">0) AS q3
 FROM logic_nb)""",
    "cleaned": """
SELECT l.*, coalesce("Price"::DOUBLE > pf AND "Price">0,false) AS "Price_Outlier",
 coalesce("Quantity"::DOUBLE > qf AND "Quantity">0,false) AS "Quantity_Outlier" FROM logic_nb l, fences""",
    "sale": """SELECT * FROM logic_nb WHERE "Transaction_Type"='SALE'""",
    "orders_view": """
SELECT o_custkey AS customer_id, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount FROM orders""",
    "orders_lines_view": """
SELECT o_custkey AS customer_id, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
 l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "rfm_base": """
SELECT customer_id, floor((epoch_us((SELECT max(order_date) FROM orders_view)) - epoch_us(max(order_date)))/86400000000)::BIGINT AS recency,
 count(*) AS frequency, sum(total_amount)::DOUBLE AS monetary, sum(total_amount)::DOUBLE/count(total_amount) AS avg_order_value
FROM orders_view WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING sum(total_amount) > 0""",
    "rfm_ranks": """
SELECT *, row_number() OVER (ORDER BY recency, customer_id) AS rr, row_number() OVER (ORDER BY frequency, customer_id) AS fr,
 row_number() OVER (ORDER BY monetary, customer_id) AS mr, count(*) OVER () AS n FROM rfm_base""",
    "rfm_lib": """
SELECT *, CASE WHEN rfm_score>=13 THEN 'Champions' WHEN rfm_score>=10 THEN 'Loyal_Customers' WHEN rfm_score>=7 THEN 'Potential_Loyalists'
 WHEN rfm_score>=5 THEN 'At_Risk' ELSE 'Lost_Customers' END AS rfm_segment FROM (
 SELECT *, "R_score"+"F_score"+"M_score" AS rfm_score FROM (
 SELECT customer_id, recency, frequency, monetary, avg_order_value,
  (6-greatest(1, ceil(5.0*(rr-1)/(n-1))))::INTEGER AS "R_score", greatest(1, ceil(5.0*(fr-1)/(n-1)))::INTEGER AS "F_score",
  greatest(1, ceil(5.0*(mr-1)/(n-1)))::INTEGER AS "M_score" FROM rfm_ranks))""",
    "features_lib": """
SELECT *, CASE WHEN frequency>1 THEN customer_lifetime::DOUBLE/(frequency-1) ELSE 0 END AS avg_days_between_orders FROM (
SELECT customer_id, min(order_date) AS first_order, max(order_date) AS last_order, count(*) AS frequency,
 sum(total_amount)::DOUBLE AS monetary, sum(total_amount)::DOUBLE/count(total_amount) AS avg_order_value,
 coalesce(stddev_samp(total_amount::DOUBLE),0) AS monetary_std, sum(quantity) AS total_quantity,
 sum(quantity)::DOUBLE/count(quantity) AS avg_quantity, count(DISTINCT product_id) AS product_diversity,
 floor((epoch_us((SELECT max(order_date) FROM orders_lines_view))-epoch_us(max(order_date)))/86400000000)::BIGINT AS recency,
 floor((epoch_us(max(order_date))-epoch_us(min(order_date)))/86400000000)::BIGINT AS customer_lifetime
FROM orders_lines_view GROUP BY customer_id HAVING sum(total_amount)>0)""",
    "clv": """
SELECT *, avg_order_value * (CASE WHEN customer_lifetime>0 THEN frequency/(customer_lifetime/30.44::DOUBLE) ELSE frequency/12.0::DOUBLE END)
 * (CASE WHEN frequency>1 THEN 12.0::DOUBLE ELSE 3.6::DOUBLE END) * 0.2::DOUBLE AS clv_estimated, monetary*0.2::DOUBLE AS clv_historical FROM features_lib""",
    "segmented": """
SELECT r.rfm_segment, r.rfm_score, r."R_score", r."F_score", r."M_score", c.* FROM rfm_lib r JOIN clv c USING (customer_id)""",
    "features_nb": """
SELECT *, customer_lifetime::DOUBLE/nullif(frequency,0) AS avg_days_between_orders, monetary/nullif(frequency,0) AS avg_basket FROM (
SELECT "CustomerID" AS customer_id, count(DISTINCT "Invoice") AS frequency, sum("Total_Amount")::DOUBLE AS monetary,
 sum("Quantity") AS quantity_sum, sum("Quantity")::DOUBLE/count("Quantity") AS quantity_mean, stddev_samp("Quantity"::DOUBLE) AS quantity_std,
 sum("Price")::DOUBLE/count("Price") AS price_mean, stddev_samp("Price"::DOUBLE) AS price_std, min("Price")::DOUBLE AS price_min, max("Price")::DOUBLE AS price_max,
 count(DISTINCT "StockCode") AS product_diversity,
 first("Country" ORDER BY "InvoiceDate" NULLS FIRST,"Invoice" NULLS FIRST,"StockCode" NULLS FIRST) AS country,
 min("InvoiceDate") AS first_date, max("InvoiceDate") AS last_date,
 floor((epoch_us((SELECT max("InvoiceDate") + INTERVAL 1 DAY FROM logic_nb))-epoch_us(max("InvoiceDate")))/86400000000)::BIGINT AS recency,
 floor((epoch_us(max("InvoiceDate"))-epoch_us(min("InvoiceDate")))/86400000000)::BIGINT AS customer_lifetime
FROM sale GROUP BY "CustomerID")""",
    "rfm_nb": """
SELECT *, "R_score"::VARCHAR||"F_score"::VARCHAR||"M_score"::VARCHAR AS rfm_code,
 CASE WHEN rfm_score>=13 THEN 'Champions' WHEN rfm_score>=11 THEN 'Loyal Customers' WHEN rfm_score>=9 THEN 'Potential Loyalists'
 WHEN rfm_score>=7 THEN 'New Customers' WHEN rfm_score>=5 THEN 'At Risk' ELSE 'Lost Customers' END AS rfm_segment FROM (
 SELECT *, "R_score"+"F_score"+"M_score" AS rfm_score FROM (
 SELECT *, (6-greatest(1, ceil(5.0*(rr-1)/(n-1))))::INTEGER AS "R_score", greatest(1, ceil(5.0*(fr-1)/(n-1)))::INTEGER AS "F_score",
  greatest(1, ceil(5.0*(mr-1)/(n-1)))::INTEGER AS "M_score" FROM (
  SELECT *, row_number() OVER (ORDER BY recency, customer_id) AS rr, row_number() OVER (ORDER BY frequency, customer_id) AS fr,
   row_number() OVER (ORDER BY monetary, customer_id) AS mr, count(*) OVER () AS n
  FROM features_nb WHERE recency IS NOT NULL AND monetary>0)))""",
    "band_ranks": """
SELECT cluster, row_number() OVER (ORDER BY avg(monetary) DESC, cluster) AS cluster_rank, count(*) OVER () AS clusters
FROM (SELECT "M_score" AS cluster, monetary FROM rfm_nb) GROUP BY cluster""",
    "targets": """
SELECT customer_id, recency, frequency, monetary, unnest(list_filter([
 CASE WHEN rfm_segment='Champions' THEN 'CHAMPIONS' END, CASE WHEN cluster_rank=1 THEN 'SUPER_WHALES' END,
 CASE WHEN cluster_rank=2 THEN 'HIGH_VALUE' END, CASE WHEN rfm_segment='Potential Loyalists' THEN 'POTENTIAL_LOYALISTS' END,
 CASE WHEN cluster_rank>clusters-2 THEN 'ONE_SHOT_PROBLEM' END], lambda x: x IS NOT NULL)) AS target
FROM rfm_nb JOIN band_ranks ON cluster = "M_score" """,
    "churn_features": """
SELECT *, CASE WHEN total_spent>0 THEN recent_spent/(total_spent/(customer_lifetime_days+1)*90) ELSE 0 END AS spending_trend,
 CASE WHEN total_orders>0 THEN recent_orders/(total_orders::DOUBLE/(customer_lifetime_days+1)*90) ELSE 0 END AS order_frequency_trend,
 CASE WHEN avg_order_value>0 THEN spending_std/avg_order_value ELSE 0 END AS spending_volatility,
 CASE WHEN customer_lifetime_days>0 THEN total_orders/(customer_lifetime_days/30.44::DOUBLE) ELSE total_orders END AS engagement_score,
 CASE WHEN total_orders>1 THEN customer_lifetime_days::DOUBLE/(total_orders-1) ELSE 999 END AS avg_days_between_orders,
 CASE WHEN total_orders=1 THEN 1 ELSE 0 END AS is_one_time_customer FROM (
SELECT customer_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) AS total_orders,
 coalesce(sum(total_amount)::DOUBLE,0) AS total_spent, sum(total_amount)::DOUBLE/count(total_amount) AS avg_order_value,
 coalesce(stddev_samp(total_amount::DOUBLE),0) AS spending_std,
 coalesce((sum(total_amount) FILTER (order_date >= ref - INTERVAL 90 DAY))::DOUBLE,0) AS recent_spent,
 coalesce((sum(total_amount) FILTER (order_date >= ref - INTERVAL 90 DAY))::DOUBLE/nullif(count(*) FILTER (order_date >= ref - INTERVAL 90 DAY),0),0) AS recent_aov,
 count(*) FILTER (order_date >= ref - INTERVAL 90 DAY) AS recent_orders,
 floor((epoch_us(max(ref))-epoch_us(max(order_date)))/86400000000)::BIGINT AS recency_days,
 floor((epoch_us(max(order_date))-epoch_us(min(order_date)))/86400000000)::BIGINT AS customer_lifetime_days
FROM orders_view, (SELECT max(order_date) AS ref FROM orders_view) GROUP BY customer_id)""",
    "churn_labels": """
SELECT *, ((recency_days>90 AND customer_lifetime_days>30) OR (is_one_time_customer=1 AND recency_days>60)
 OR (spending_trend<0.3 AND order_frequency_trend<0.3 AND total_orders>2))::INTEGER AS is_churned FROM churn_features""",
    "score_view": """
SELECT customer_id, is_churned AS label, recency_days::DOUBLE/(SELECT max(recency_days) FROM churn_labels) AS score,
 (recency_days::DOUBLE/(SELECT max(recency_days) FROM churn_labels) >= 0.5)::INTEGER AS prediction FROM churn_labels""",
    "predictions": """
SELECT customer_id, score AS churn_probability, CASE WHEN score>=0.8 THEN 'Critical' WHEN score>=0.6 THEN 'High'
 WHEN score>=0.4 THEN 'Medium' WHEN score>=0.2 THEN 'Low' ELSE 'Very Low' END AS risk_category FROM score_view""",
    "period_cuts": """
SELECT quantile_cont(epoch_us("InvoiceDate")::DOUBLE,0.6) AS o, quantile_cont(epoch_us("InvoiceDate")::DOUBLE,0.8) AS c
FROM logic_nb WHERE "InvoiceDate" IS NOT NULL""",
    "temporal_base": """
SELECT customer_id, purchase_lines, quantity_sum, quantity_mean, quantity_std, price_mean, price_std, amount_sum, amount_mean, amount_std,
 invoices, product_diversity, floor((l-f)/86400000000)::BIGINT AS days_active, floor((o-f)/86400000000)::BIGINT AS time_since_first_purchase,
 1-returned AS is_churned FROM (
SELECT "CustomerID" AS customer_id, count(*) FILTER (t<=o) AS purchase_lines, sum("Quantity") FILTER (t<=o) AS quantity_sum,
 round_even((sum("Quantity") FILTER (t<=o))::DOUBLE/nullif(count(*) FILTER (t<=o),0),2) AS quantity_mean,
 round_even(stddev_samp("Quantity"::DOUBLE) FILTER (t<=o),2) AS quantity_std,
 round_even((sum("Price") FILTER (t<=o))::DOUBLE/nullif(count(*) FILTER (t<=o),0),2) AS price_mean,
 round_even(stddev_samp("Price"::DOUBLE) FILTER (t<=o),2) AS price_std,
 (sum("Total_Amount") FILTER (t<=o))::DOUBLE AS amount_sum,
 round_even((sum("Total_Amount") FILTER (t<=o))::DOUBLE/nullif(count(*) FILTER (t<=o),0),2) AS amount_mean,
 round_even(stddev_samp("Total_Amount"::DOUBLE) FILTER (t<=o),2) AS amount_std,
 count(DISTINCT "Invoice") FILTER (t<=o) AS invoices, count(DISTINCT "StockCode") FILTER (t<=o) AS product_diversity,
 min(t) FILTER (t<=o) AS f, max(t) FILTER (t<=o) AS l, max(o) AS o, max((t>o)::INTEGER) AS returned
FROM (SELECT *, epoch_us("InvoiceDate")::DOUBLE AS t FROM logic_nb WHERE "InvoiceDate" IS NOT NULL), period_cuts
WHERE t<=c GROUP BY "CustomerID") WHERE purchase_lines>0""",
    "campaign_customers": """
SELECT *, monetary*1.2::DOUBLE AS revenue_potential, recommended_budget_per_customer AS campaign_cost,
 round_even((monetary*1.2::DOUBLE*0.25::DOUBLE*expected_response_rate-recommended_budget_per_customer)/recommended_budget_per_customer*100,1) AS estimated_roi
FROM (SELECT *, CASE WHEN monetary>=1000 AND frequency>=8 AND churn_probability>0.7 THEN 'VIP_AtRisk'
  WHEN monetary>=1000 AND frequency>=8 THEN 'VIP_Whales' WHEN rfm_segment='Champions' AND recency<=30 THEN 'Champions_Active'
  WHEN rfm_segment IN ('Potential_Loyalists') AND monetary>=200 THEN 'Growth_Potential'
  WHEN risk_category IN ('High','Critical') THEN 'Winback_Urgent' WHEN rfm_segment='At_Risk' AND recency<=90 THEN 'Reactivation_Soft'
  ELSE 'Maintenance_LowCost' END AS campaign_segment FROM (
  SELECT r.*, coalesce(churn_probability,0.1) AS churn_probability, coalesce(risk_category,'Low') AS risk_category
  FROM rfm_lib r LEFT JOIN predictions p USING (customer_id)))
LEFT JOIN campaign_rules USING (campaign_segment)""",
    "campaign_analysis": """
SELECT *, customers_count*avg_cost_per_customer AS total_budget_needed, priority*0.4::DOUBLE+roi_percent*0.6::DOUBLE AS combined_score FROM (
SELECT campaign_segment, count(*) AS customers_count, round_even(avg(recommended_budget_per_customer),2) AS avg_cost_per_customer,
 round_even(avg(expected_response_rate),2) AS response_rate, round_even(sum(estimated_roi::DECIMAL(28,1))::DOUBLE/count(*),2) AS roi_percent,
 round_even(sum(revenue_potential::DECIMAL(28,3))::DOUBLE,2) AS total_revenue_potential, round_even(avg(campaign_priority),2) AS priority
FROM campaign_customers GROUP BY campaign_segment)""",
    "allocation": """
SELECT allocation_order, campaign_segment, round_even(least(total_budget_needed, greatest(0, l)),2) AS allocated_budget, customers_targeted,
 roi_percent, priority, round_even(customers_targeted*total_revenue_potential/customers_count*response_rate,2) AS expected_revenue, status FROM (
SELECT *, CASE WHEN status='fully_funded' THEN customers_count WHEN status='partially_funded' THEN floor(l/avg_cost_per_customer)::BIGINT ELSE 0 END AS customers_targeted FROM (
SELECT *, CASE WHEN l<=0 THEN 'insufficient_budget' WHEN total_budget_needed<=l THEN 'fully_funded' ELSE 'partially_funded' END AS status FROM (
SELECT *, row_number() OVER (ORDER BY combined_score DESC, campaign_segment) AS allocation_order,
 {budget} - coalesce(sum(total_budget_needed) OVER (ORDER BY combined_score DESC, campaign_segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS l
FROM campaign_analysis)))""".replace("{budget}", "5000.0::DOUBLE"),
    "calendar": """
SELECT 'CAMP_'||lpad(row_number() OVER (ORDER BY allocation_order, week_number)::VARCHAR,4,'0') AS campaign_id,
 campaign_segment||'_Week'||week_number AS campaign_name, campaign_segment AS segment,
 strftime(DATE '2024-01-01' + ((week_number-1)*7)::INTEGER, '%Y-%m-%d') AS start_date, week_number,
 array_to_string(channels[1:2], ', ') AS channels, share AS customers_targeted,
 round_even(share*(allocated_budget/customers_targeted),2) AS budget_allocated, roi_percent AS expected_roi_percent,
 priority AS priority_level, campaign_type, 'planned' AS status FROM (
SELECT *, start_week + nth*every_weeks AS week_number FROM (
SELECT *, unnest(range(most)) AS nth FROM (
SELECT *, customers_targeted // most AS share FROM (
SELECT a.*, start_week, every_weeks, campaign_type, channels, least(duration_weeks,12)//every_weeks AS most
FROM allocation a JOIN campaign_rules USING (campaign_segment) WHERE customers_targeted>0) WHERE most>0) WHERE share>0))
WHERE week_number<=12""",
    "calendar_full": """
SELECT *, round_even(customers_targeted*budget_allocated*expected_roi_percent/100,2) AS expected_revenue,
 'Q'||((week_number-1)//13+1) AS quarter, start_date[1:7] AS month FROM calendar""",
    "potential": """
SELECT target, customers, revenue_sum, round_even(m,4) AS revenue_mean, mean_frequency, mean_recency, cost_per_customer, conversion_rate,
 floor(customers*conversion_rate)::BIGINT AS conversions, (customers*cost_per_customer)::DOUBLE AS campaign_cost,
 round_even(customers*conversion_rate*m,2) AS expected_revenue,
 round_even((customers*conversion_rate*m-customers*cost_per_customer)/(customers*cost_per_customer)*100,4) AS roi, campaign_type,
 round_even((customers*conversion_rate*m-customers*cost_per_customer)/(customers*cost_per_customer)*100*ln(customers),3) AS priority_score
FROM target_rules JOIN (SELECT target, count(*) AS customers, sum(monetary::DECIMAL(28,2))::DOUBLE AS revenue_sum,
 sum(monetary::DECIMAL(28,2))::DOUBLE/count(*) AS m, round_even(sum(frequency)::DOUBLE/count(*),4) AS mean_frequency,
 round_even(sum(recency)::DOUBLE/count(*),4) AS mean_recency FROM targets GROUP BY target) USING (target)""",
    "touches": """
SELECT event_id AS touch_id, user_id AS customer_id, ts, event_type AS channel FROM events WHERE event_type IN ('view','click','signup')""",
    "conversions": """
SELECT event_id AS conversion_id, user_id AS customer_id, ts, CAST(value AS DECIMAL(18,2)) AS revenue FROM events WHERE event_type='purchase'""",
    "journeys": """
SELECT c.conversion_id, c.customer_id, c.ts AS converted_at, c.revenue::DOUBLE AS revenue, t.ts, t.touch_id, t.channel
FROM conversions c JOIN touches t ON t.customer_id = c.customer_id AND t.ts <= c.ts WHERE c.revenue > 0""",
    "ab_population": """
SELECT *, CASE WHEN ('0x'||substr(md5('t1:'||customer_id),1,8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM campaign_customers""",
    "ab_metrics_view": """
SELECT variant, customers, responders, round_even(responders::DOUBLE/customers,4) AS response_rate, total_revenue,
 round_even(coalesce(total_revenue/nullif(responders,0),0),4) AS revenue_per_responder, round_even(total_cost,4) AS total_cost,
 round_even((total_revenue*0.25::DOUBLE-total_cost)/total_cost*100,4) AS roi_percent, round_even(total_revenue*0.25::DOUBLE-total_cost,4) AS profit,
 round_even(rate*(CASE WHEN variant='B' THEN 0.1::DOUBLE ELSE 0 END+1),4) AS expected_response_rate,
 round_even(pot*(CASE WHEN variant='B' THEN 0.05::DOUBLE ELSE 0 END+1),2) AS expected_revenue_per_customer FROM (
SELECT variant, count(*) AS customers, count(r) AS responders, coalesce(sum(r)::DOUBLE,0) AS total_revenue,
 count(*)*avg(recommended_budget_per_customer)*(CASE WHEN variant='B' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS total_cost,
 avg(expected_response_rate) AS rate, sum(revenue_potential::DECIMAL(28,3))::DOUBLE/count(*) AS pot
FROM ab_population LEFT JOIN (SELECT customer_id, sum(revenue) AS r FROM conversions GROUP BY customer_id) USING (customer_id) GROUP BY variant)""",
}
