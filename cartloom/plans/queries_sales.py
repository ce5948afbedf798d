"""Sales, product, country, season and anomaly queries."""

from pyspark.sql import functions as F

from cartloom.functions.numeric import stamp_text
from cartloom.functions.scalars import with_row
from cartloom.operators import anomalies, sales
from cartloom.plans.catalog import query

_REV = 'sum("Total_Amount")::DOUBLE'
_INV = 'count(DISTINCT "Invoice")'
_CUS = 'count(DISTINCT "CustomerID")'
_MEAN = 'sum("Total_Amount")::DOUBLE/count("Total_Amount")'


@query(
    "financial_performance",
    f"""SELECT gross_revenue, returns_amount, gross_revenue-returns_amount AS net_revenue, round_even(returns_amount/gross_revenue*100,4) AS return_rate,
 round_even(gross_revenue/sale_lines,4) AS mean_line_amount, median_line_amount, sale_lines, items_sold, round_even(items_sold::DOUBLE/sale_lines,4) AS mean_items FROM (
SELECT (sum("Total_Amount") FILTER (s))::DOUBLE AS gross_revenue, abs((sum("Total_Amount") FILTER (NOT s))::DOUBLE) AS returns_amount,
 round_even(quantile_cont("Total_Amount"::DOUBLE,0.5) FILTER (s),4) AS median_line_amount, count(*) FILTER (s) AS sale_lines, (sum("Quantity") FILTER (s))::BIGINT AS items_sold
FROM (SELECT *, "Transaction_Type"='SALE' AS s FROM logic_nb))""",
)
def financial_performance(m):
    return sales.financial_performance(m.cleaned)


@query(
    "sales_daily",
    f"""WITH d AS (SELECT strftime("InvoiceDate",'%Y-%m-%d') AS day, {_REV} AS revenue, {_INV} AS invoices, {_CUS} AS customers FROM sale WHERE "InvoiceDate" IS NOT NULL GROUP BY 1)
SELECT *, (SELECT round_even(sum(revenue::DECIMAL(28,2))::DOUBLE/count(*),2) FROM d) AS mean_daily_revenue FROM d""",
)
def sales_daily(m):
    return sales.sales_daily(m.sales_facts)


@query(
    "sales_hourly",
    f"""WITH h AS (SELECT hour("InvoiceDate") AS hour, {_REV} AS revenue FROM sale WHERE "InvoiceDate" IS NOT NULL GROUP BY 1)
SELECT *, hour=(SELECT hour FROM h ORDER BY revenue DESC, hour LIMIT 1) AS is_peak FROM h""",
)
def sales_hourly(m):
    return sales.sales_hourly(m.sales_facts)


@query("sales_by_month_name", f"""SELECT monthname("InvoiceDate") AS month_name, {_REV} AS revenue, {_INV} AS invoices FROM sale WHERE "InvoiceDate" IS NOT NULL GROUP BY 1""")
def sales_by_month_name(m):
    return sales.sales_by_month_name(m.sales_facts)


_DAYS = "(VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) w(day_no,day)"


@query(
    "sales_by_weekday",
    f"""SELECT day_no, day, revenue FROM {_DAYS} LEFT JOIN (SELECT isodow("InvoiceDate")-1 AS day_no, {_REV} AS revenue FROM sale GROUP BY 1) USING (day_no)""",
)
def sales_by_weekday(m):
    return sales.sales_by_weekday(m.sales_facts)


_TIER = "CASE WHEN {v}>0 AND {v}<=100 THEN 'Bronze' WHEN {v}>100 AND {v}<=500 THEN 'Silver' WHEN {v}>500 AND {v}<=1000 THEN 'Gold' WHEN {v}>1000 THEN 'Platinum' END"
_CUSTOMERS_SALES = f"""SELECT *, floor((epoch_us(l)-epoch_us(f))/86400000000)::BIGINT AS days_active, {_TIER.replace("{v}", "total_spent")} AS tier,
 CASE WHEN starts_with("CustomerID",'GUEST_') THEN 'Guest' ELSE 'Registered' END AS customer_type FROM (
SELECT "CustomerID", {_REV} AS total_spent, count("Total_Amount") AS total_orders, round_even({_MEAN},2) AS avg_order_value, {_INV} AS unique_invoices,
 min("InvoiceDate") AS f, max("InvoiceDate") AS l, sum("Quantity")::BIGINT AS items_bought FROM sale GROUP BY 1)"""
_STAMPS = "strftime(f,'%Y-%m-%d %H:%M:%S') AS first_purchase, strftime(l,'%Y-%m-%d %H:%M:%S') AS last_purchase"


def _stamped(df):
    return df.withColumns({c: stamp_text(c) for c in ("first_purchase", "last_purchase")})


@query("customer_metrics_sales", f"SELECT * EXCLUDE (f,l), {_STAMPS} FROM ({_CUSTOMERS_SALES})")
def customer_metrics_sales(m):
    return _stamped(sales.customer_metrics_sales(m.sales_facts))


@query(
    "customer_tier_distribution",
    f"""WITH c AS ({_CUSTOMERS_SALES}) SELECT tier, count(*) AS customers, round_even(count(*)::DOUBLE/(SELECT count(*) FROM c)*100,4) AS share_pct FROM c WHERE tier IS NOT NULL GROUP BY 1""",
)
def customer_tier_distribution(m):
    return sales.tier_distribution(sales.customer_metrics_sales(m.sales_facts))


@query(
    "top_customers",
    f"""SELECT "CustomerID", total_spent, total_orders, avg_order_value, tier FROM ({_CUSTOMERS_SALES}) ORDER BY total_spent DESC, "CustomerID" LIMIT 5""",
)
def top_customers(m):
    best = sales.top_rows(sales.customer_metrics_sales(m.sales_facts), "total_spent", ["CustomerID"], 5)
    return best.select("CustomerID", "total_spent", "total_orders", "avg_order_value", "tier")


_PRODUCTS_SALES = f"""SELECT *, round_even(total_revenue/nullif(total_quantity,0),4) AS avg_price FROM (SELECT "StockCode","Description", sum("Quantity")::BIGINT AS total_quantity,
 {_REV} AS total_revenue, {_INV} AS unique_orders, {_CUS} AS unique_customers FROM sale WHERE "StockCode" IS NOT NULL AND "Description" IS NOT NULL GROUP BY 1,2)"""
_SHORT = """CASE WHEN length("Description")>50 THEN "Description"[1:50]||'...' ELSE "Description" END AS description"""


@query("product_metrics_sales", _PRODUCTS_SALES)
def product_metrics_sales(m):
    return sales.product_metrics_sales(m.sales_lines)


@query("top_products_revenue", f"""SELECT "StockCode", {_SHORT}, total_revenue FROM ({_PRODUCTS_SALES}) ORDER BY total_revenue DESC, "StockCode", "Description" LIMIT 10""")
def top_products_revenue(m):
    return sales.top_products(sales.product_metrics_sales(m.sales_lines), "total_revenue")


@query("top_products_quantity", f"""SELECT "StockCode", {_SHORT}, total_quantity FROM ({_PRODUCTS_SALES}) ORDER BY total_quantity DESC, "StockCode", "Description" LIMIT 10""")
def top_products_quantity(m):
    return sales.top_products(sales.product_metrics_sales(m.sales_lines), "total_quantity")


_COUNTRIES = f"""SELECT *, round_even(total_revenue/total_orders,4) AS avg_order_value, round_even(total_revenue/unique_customers,4) AS revenue_per_customer FROM (
 SELECT "Country", {_REV} AS total_revenue, {_INV} AS total_orders, {_CUS} AS unique_customers, sum("Quantity")::BIGINT AS items_sold FROM sale WHERE "Country" IS NOT NULL GROUP BY 1)"""


@query("country_metrics", _COUNTRIES)
def country_metrics(m):
    return sales.country_metrics(m.sales_facts)


@query(
    "top_countries_share",
    f"""WITH c AS ({_COUNTRIES}), t AS (SELECT {_REV} AS a FROM sale)
SELECT r.*, round_even(total_revenue/(SELECT a FROM t)*100,4) AS revenue_pct FROM (
 SELECT * FROM (SELECT 'revenue' AS ranking,"Country",total_revenue,unique_customers FROM c ORDER BY total_revenue DESC,"Country" LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'customers',"Country",total_revenue,unique_customers FROM c ORDER BY unique_customers DESC,"Country" LIMIT 10)) r""",
)
def top_countries_share(m):
    return sales.top_countries_share(m.sales_facts)


@query("monthly_trend", f"""SELECT strftime("InvoiceDate",'%Y-%m') AS month, {_REV} AS revenue, {_INV} AS invoices, {_CUS} AS customers FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1""")
def monthly_trend(m):
    return sales.monthly_trend(m.facts)


@query("top_countries_all", f"""SELECT "Country", {_REV} AS revenue FROM logic_nb WHERE "Country" IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_countries_all(m):
    return sales.top_countries_all(m.facts)


@query(
    "heatmap_day_hour",
    f"""SELECT w.day_no, w.day, {", ".join(f"h{h:02d}" for h in range(24))} FROM {_DAYS} LEFT JOIN (SELECT isodow("InvoiceDate")-1 AS day_no,
 {", ".join(f'(sum("Total_Amount") FILTER (hour("InvoiceDate")={h}))::DOUBLE AS h{h:02d}' for h in range(24))} FROM logic_nb GROUP BY 1) g ON g.day_no = w.day_no""",
)
def heatmap_day_hour(m):
    return sales.heatmap_day_hour(m.facts)


_CUSTOMERS_ALL = f"""SELECT *, floor((epoch_us(l)-epoch_us(f))/86400000000)::BIGINT AS lifetime_days,
 floor((epoch_us((SELECT max("InvoiceDate") FROM logic_nb))-epoch_us(l))/86400000000)::BIGINT AS recency_days, {_TIER.replace("{v}", "total_revenue")} AS tier FROM (
SELECT "CustomerID", {_REV} AS total_revenue, round_even({_MEAN},4) AS avg_order_value, count("Total_Amount") AS total_orders, sum("Quantity")::BIGINT AS total_items,
 {_INV} AS unique_invoices, min("InvoiceDate") AS f, max("InvoiceDate") AS l FROM logic_nb GROUP BY 1)"""


@query("customer_metrics_all", f"SELECT * EXCLUDE (f,l), {_STAMPS} FROM ({_CUSTOMERS_ALL})")
def customer_metrics_all(m):
    return _stamped(sales.customer_metrics_all(m.facts))


@query(
    "tier_stats",
    f"""SELECT tier, count(*) AS customers, round_even(sum(total_revenue::DECIMAL(28,2))::DOUBLE,2) AS revenue, round_even(sum(total_revenue::DECIMAL(28,2))::DOUBLE/count(*),2) AS mean_revenue,
 round_even(avg(avg_order_value),2) AS mean_order_value, round_even(sum(total_orders)::DOUBLE/count(*),2) AS mean_orders FROM ({_CUSTOMERS_ALL}) WHERE tier IS NOT NULL GROUP BY 1""",
)
def tier_stats(m):
    return sales.tier_stats(sales.customer_metrics_all(m.facts))


@query(
    "customer_revenue_histogram",
    f"""WITH c AS (SELECT {_REV} AS v FROM logic_nb GROUP BY "CustomerID"), e AS (SELECT min(v) AS lo, max(v) AS hi FROM c)
SELECT bin, round_even(lo+(hi-lo)*bin/50.0,4) AS bin_from, count(*) AS rows FROM (SELECT least(49,coalesce(floor((v-lo)*50.0/nullif(hi-lo,0)),0))::INTEGER AS bin, lo, hi FROM c, e) GROUP BY bin, lo, hi""",
)
def customer_revenue_histogram(m):
    per = m.facts.groupBy("CustomerID").agg(sales.revenue().alias("revenue"))
    return sales.histogram(per, F.col("revenue"))


_PRODUCTS_ALL = f"""SELECT *, round_even(total_revenue/unique_customers,4) AS revenue_per_customer, round_even(unique_orders::DOUBLE/unique_customers,4) AS repeat_rate FROM (
SELECT "StockCode","Description", {_REV} AS total_revenue, round_even({_MEAN},4) AS avg_revenue_per_sale, sum("Quantity")::BIGINT AS total_quantity,
 round_even(sum("Quantity")::DOUBLE/count("Quantity"),4) AS avg_quantity_per_sale, {_CUS} AS unique_customers, {_INV} AS unique_orders
FROM logic_nb WHERE "StockCode" IS NOT NULL AND "Description" IS NOT NULL GROUP BY 1,2)"""


@query("product_metrics_all", _PRODUCTS_ALL)
def product_metrics_all(m):
    return sales.product_metrics_all(m.cleaned)


@query(
    "top_products_popularity",
    f"""SELECT * FROM (SELECT 'popularity' AS ranking,"StockCode","Description",total_revenue,total_quantity,unique_customers FROM ({_PRODUCTS_ALL}) ORDER BY unique_customers DESC,"StockCode","Description" LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'revenue',"StockCode","Description",total_revenue,total_quantity,unique_customers FROM ({_PRODUCTS_ALL}) ORDER BY total_revenue DESC,"StockCode","Description" LIMIT 100)""",
)
def top_products_popularity(m):
    products = sales.product_metrics_all(m.cleaned)
    columns = ["StockCode", "Description", "total_revenue", "total_quantity", "unique_customers"]
    popular = sales.top_rows(products, "unique_customers", sales.PRODUCT, 10).select(F.lit("popularity").alias("ranking"), *columns)
    richest = sales.top_rows(products, "total_revenue", sales.PRODUCT, 100).select(F.lit("revenue").alias("ranking"), *columns)
    return popular.unionByName(richest)


@query(
    "calendar_features",
    """SELECT * REPLACE (strftime("InvoiceDate",'%Y-%m-%d %H:%M:%S') AS "InvoiceDate", "Price"::DOUBLE AS "Price", "Total_Amount"::DOUBLE AS "Total_Amount"),
 year("InvoiceDate") AS "Year", month("InvoiceDate") AS "Month", monthname("InvoiceDate") AS "MonthName", quarter("InvoiceDate") AS "Quarter",
 isodow("InvoiceDate")-1 AS "DayOfWeek", dayname("InvoiceDate") AS "DayName", hour("InvoiceDate") AS "Hour", weekofyear("InvoiceDate") AS "Week" FROM cleaned""",
)
def calendar_features(m):
    out = sales.calendar_features(m.cleaned)
    return out.withColumns({"InvoiceDate": stamp_text("InvoiceDate"), **{c: F.col(c).cast("double") for c in ("Price", "Total_Amount")}})


_MONTHLY = f"""SELECT *, round_even(revenue/invoices,4) AS revenue_per_order, round_even(revenue/customers,4) AS revenue_per_customer FROM (
SELECT year("InvoiceDate") AS year, month("InvoiceDate") AS month, monthname("InvoiceDate") AS month_name, {_REV} AS revenue, round_even({_MEAN},2) AS mean_amount,
 count("Total_Amount") AS lines, {_INV} AS invoices, {_CUS} AS customers, sum("Quantity")::BIGINT AS quantity FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1,2,3)"""


@query("monthly_summary", _MONTHLY)
def monthly_summary(m):
    return sales.monthly_summary(m.facts)


@query(
    "month_seasonality",
    f"""SELECT month, round_even(sum(revenue::DECIMAL(28,2))::DOUBLE/count(*),2) AS mean_revenue, round_even(avg(invoices),4) AS mean_invoices, round_even(avg(customers),4) AS mean_customers,
 round_even(avg(revenue/invoices),3) AS mean_revenue_per_order FROM ({_MONTHLY}) GROUP BY 1""",
)
def month_seasonality(m):
    return sales.month_seasonality(m.facts)


@query(
    "quarterly_growth",
    f"""SELECT *, 'Q'||quarter||' '||year AS label, round_even((revenue-p)/p*100,4) AS growth_pct FROM (SELECT * , lag(revenue) OVER (ORDER BY year, quarter) AS p FROM (
 SELECT year("InvoiceDate") AS year, quarter("InvoiceDate") AS quarter, {_REV} AS revenue, {_INV} AS invoices, {_CUS} AS customers FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1,2))""".replace(
        "SELECT *, 'Q'", "SELECT * EXCLUDE (p), 'Q'"
    ),
)
def quarterly_growth(m):
    return sales.quarterly_growth(m.facts)


_PATTERN = f"{_REV} AS revenue, round_even({_MEAN},4) AS mean_amount, {_INV} AS invoices, {_CUS} AS customers"


@query("weekday_pattern", f"""SELECT isodow("InvoiceDate")-1 AS day_no, dayname("InvoiceDate") AS day, {_PATTERN} FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1,2""")
def weekday_pattern(m):
    return sales.weekday_pattern(m.facts)


_HOURLY = f"""SELECT hour("InvoiceDate") AS hour, {_PATTERN} FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1"""


@query("hourly_pattern", _HOURLY)
def hourly_pattern(m):
    return sales.hourly_pattern(m.facts)


@query("peak_hours", f"SELECT * FROM ({_HOURLY}) ORDER BY revenue DESC, hour LIMIT 5")
def peak_hours(m):
    return sales.peak_hours(m.facts)


def _extreme(kind: str, expression: str) -> str:
    base = f"""(SELECT {expression} AS b, {_REV} AS r FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1)"""
    return f"""SELECT '{kind}' AS kind, (SELECT b FROM {base} ORDER BY r DESC, b LIMIT 1) AS best, (SELECT max(r) FROM {base}) AS best_revenue,
 (SELECT b FROM {base} ORDER BY r, b LIMIT 1) AS worst, (SELECT min(r) FROM {base}) AS worst_revenue"""


_WEEKDAY, _HOUR = 'isodow("InvoiceDate")-1', 'hour("InvoiceDate")'


@query("seasonal_extremes", " UNION ALL ".join([_extreme("month", 'year("InvoiceDate")*100+month("InvoiceDate")'), _extreme("weekday", _WEEKDAY), _extreme("hour", _HOUR)]))
def seasonal_extremes(m):
    return sales.seasonal_extremes(m.facts)


@query("best_month_weekday", " UNION ALL ".join([_extreme("calendar_month", 'month("InvoiceDate")'), _extreme("weekday", _WEEKDAY)]))
def best_month_weekday(m):
    return sales.best_month_weekday(m.facts)


_ORDERS = """SELECT "Invoice", sum("Total_Amount")::DOUBLE AS order_value, sum("Quantity")::BIGINT AS items, count(DISTINCT "StockCode") AS products FROM logic_nb WHERE "Invoice" IS NOT NULL GROUP BY 1"""
_ORDER_ANOMALIES = f"""SELECT "Invoice", order_value, items, products, round_even(lo,4) AS lower_fence, round_even(hi,4) AS upper_fence FROM ({_ORDERS}),
 (SELECT q[1]-1.5*(q[2]-q[1]) AS lo, q[2]+1.5*(q[2]-q[1]) AS hi FROM (SELECT quantile_cont(order_value,[0.25,0.75]) AS q FROM ({_ORDERS}))) WHERE order_value<lo OR order_value>hi"""


@query("order_value_anomalies", _ORDER_ANOMALIES)
def order_value_anomalies(m):
    return anomalies.order_value_anomalies(m.cleaned)


@query(
    "order_value_statistics",
    f"""SELECT count(*) AS orders, round_even(avg(order_value),2) AS mean_value, round_even(quantile_cont(order_value,0.5),2) AS median_value,
 round_even(stddev_samp(order_value),2) AS std_value FROM ({_ORDER_ANOMALIES})""",
)
def order_value_statistics(m):
    return anomalies.order_value_statistics(anomalies.order_value_anomalies(m.cleaned))


_PRODUCT_ANOMALIES = f"""SELECT "StockCode", total_revenue, total_quantity, round_even(a,4) AS avg_price, round_even(s,3) AS price_std, min_price, max_price, unique_customers,
 round_even(s/nullif(a,0),4) AS price_variation, round_even(max_price-min_price,2) AS price_range FROM (SELECT "StockCode", {_REV} AS total_revenue, sum("Quantity")::BIGINT AS total_quantity,
 sum("Price")::DOUBLE/count("Price") AS a, stddev_samp("Price"::DOUBLE) AS s, min("Price")::DOUBLE AS min_price, max("Price")::DOUBLE AS max_price, {_CUS} AS unique_customers
 FROM logic_nb WHERE "StockCode" IS NOT NULL GROUP BY 1) WHERE s/nullif(a,0)>1.0 OR max_price-min_price>a*2"""


@query("product_price_anomalies", _PRODUCT_ANOMALIES)
def product_price_anomalies(m):
    return anomalies.product_price_anomalies(m.cleaned)


@query(
    "customer_anomaly_features",
    f"""SELECT *, round_even(items::DOUBLE/nullif(orders,0),4) AS items_per_order, round_even(products::DOUBLE/nullif(orders,0),4) AS products_per_order FROM (SELECT "CustomerID", {_REV} AS total_spent,
 round_even({_MEAN},4) AS avg_transaction, count("Total_Amount") AS transactions, {_INV} AS orders, count(DISTINCT "StockCode") AS products, sum("Quantity")::BIGINT AS items FROM logic_nb GROUP BY 1)""",
)
def customer_anomaly_features(m):
    return anomalies.customer_anomaly_features(m.cleaned)


# The forest depends on its seed: values are registered as ``*_values``, and the query of the operator's own name says what must hold of them.
@query("customer_anomalies_iforest_values")
def customer_anomalies_iforest_values(m):
    return m.customer_anomalies.select("CustomerID", "anomaly", "anomaly_score")


@query("customer_anomalies_iforest", """SELECT DISTINCT "CustomerID", true AS label_fits, true AS twentieth FROM logic_nb""")
def customer_anomalies_iforest(m):
    """Every customer: that its label is its score's sign, and that one in twenty is below the limit, ties on it aside."""
    rows, score = F.count(F.lit(1)), F.col("anomaly_score")
    below, at = F.count(F.when(score < 0, 1)), F.count(F.when(score <= 0, 1))
    share = m.customer_anomalies.agg(((below <= 0.05 * rows + 1) & (at >= 0.05 * (rows - 1))).alias("twentieth"))
    fits = (F.col("anomaly") == -1) == (score < 0)
    return m.customer_anomalies.select("CustomerID", fits.alias("label_fits")).transform(with_row, share)


_DAY_ANOMALIES = f"""WITH d AS (SELECT strftime("InvoiceDate",'%Y-%m-%d') AS day, {_REV} AS revenue, {_INV} AS orders, {_CUS} AS customers FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1),
 s AS (SELECT avg(revenue) AS ra, stddev_pop(revenue) AS rs, avg(orders) AS oa, stddev_pop(orders) AS os FROM d)
SELECT day, revenue, orders, customers, round_even(abs((revenue-ra)/rs),4) AS revenue_z, round_even(abs((orders-oa)/os),4) AS orders_z FROM d, s WHERE abs((revenue-ra)/rs)>2 OR abs((orders-oa)/os)>2"""


@query("daily_anomalies_zscore", _DAY_ANOMALIES)
def daily_anomalies_zscore(m):
    return anomalies.daily_anomalies(m.facts)


@query("anomaly_summary_values")
def anomaly_summary_values(m):
    return m.anomaly_summary


_SHARE = "round_even(anomalies::DOUBLE/total*100,4)"


@query(
    "anomaly_summary",
    f"""SELECT family, anomalies, total, CASE WHEN family<>'customers' THEN {_SHARE} END AS share_pct, true AS fits FROM (
 SELECT 'orders' AS family, (SELECT count(*) FROM ({_ORDER_ANOMALIES})) AS anomalies, (SELECT count(DISTINCT "Invoice") FROM logic_nb) AS total
 UNION ALL SELECT 'products', (SELECT count(*) FROM ({_PRODUCT_ANOMALIES})), (SELECT count(DISTINCT "StockCode") FROM logic_nb)
 UNION ALL SELECT 'customers', NULL, (SELECT count(DISTINCT "CustomerID") FROM logic_nb)
 UNION ALL SELECT 'days', (SELECT count(*) FROM ({_DAY_ANOMALIES})), (SELECT count(DISTINCT "InvoiceDate"::DATE) FROM logic_nb))""",
)
def anomaly_summary(m):
    """Every family of anomalies; of the customers' the total, and that one in twenty is marked."""
    forest = F.col("family") == "customers"
    fits = (F.col("anomalies") <= 0.05 * F.col("total") + 1) & (F.abs(F.col("share_pct") - F.col("anomalies") / F.col("total") * 100) < 1e-4)
    return m.anomaly_summary.select(
        "family", F.when(~forest, F.col("anomalies")).alias("anomalies"), "total", F.when(~forest, F.col("share_pct")).alias("share_pct"), (~forest | fits).alias("fits")
    )


@query(
    "global_kpis",
    f"""SELECT revenue, orders, customers, products, round_even(revenue/orders,4) AS avg_order_value, period_days FROM (SELECT {_REV} AS revenue, {_INV} AS orders, {_CUS} AS customers,
 count(DISTINCT "StockCode") AS products, floor((epoch_us(max("InvoiceDate"))-epoch_us(min("InvoiceDate")))/86400000000)::BIGINT AS period_days FROM logic_nb)""",
)
def global_kpis(m):
    return sales.global_kpis(m.cleaned)


@query(
    "pareto_customers",
    f"""WITH c AS (SELECT "CustomerID", {_REV} AS v, {_INV} AS o FROM logic_nb GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, "CustomerID") AS k, count(*) OVER () AS n FROM c)
SELECT max(n) AS customers, max(floor(n*0.2::DOUBLE))::BIGINT AS top_customers, round_even((sum(v::DECIMAL(28,2)) FILTER (k<=floor(n*0.2::DOUBLE)))::DOUBLE/sum(v::DECIMAL(28,2))::DOUBLE*100,4) AS top_20_share_pct,
 max(v) AS largest_customer, round_even(sum(o)::DOUBLE/count(*),4) AS mean_orders FROM r""",
)
def pareto_customers(m):
    return sales.pareto_customers(m.facts)


@query(
    "pareto_products",
    f"""WITH p AS (SELECT "StockCode", {_REV} AS v FROM logic_nb WHERE "StockCode" IS NOT NULL GROUP BY 1)
SELECT round_even((SELECT sum(v::DECIMAL(28,2))::DOUBLE FROM (SELECT v FROM p ORDER BY v DESC, "StockCode" LIMIT 10))/(SELECT sum(v::DECIMAL(28,2))::DOUBLE FROM p)*100,4) AS top_10_share_pct,
 max(v) AS best_product_revenue, count(*) FILTER (v>(SELECT quantile_cont(v,0.8) FROM p)) AS products_above_p80 FROM p""",
)
def pareto_products(m):
    return sales.pareto_products(m.cleaned)


@query("anomaly_revenue_impact", f"""SELECT count(*) AS anomalous_orders, coalesce(sum(order_value::DECIMAL(28,2))::DOUBLE,0) AS anomalous_revenue,
 round_even(coalesce(sum(order_value::DECIMAL(28,2))::DOUBLE,0)/(SELECT {_REV} FROM logic_nb)*100,4) AS revenue_pct FROM ({_ORDER_ANOMALIES})""")
def anomaly_revenue_impact(m):
    return anomalies.anomaly_revenue_impact(m.cleaned)


@query("recap_top_customers", f"""SELECT "CustomerID", {_REV} AS revenue FROM logic_nb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def recap_top_customers(m):
    return sales.top_rows(m.facts.groupBy("CustomerID").agg(sales.revenue().alias("revenue")), "revenue", ["CustomerID"], 10)


@query("recap_top_products", f"""SELECT "StockCode", {_REV} AS revenue FROM logic_nb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def recap_top_products(m):
    per = m.cleaned.groupBy("StockCode").agg(F.sum("Total_Amount").cast("double").alias("revenue"))
    return sales.top_rows(per, "revenue", ["StockCode"], 10)


@query(
    "kpi_growth",
    f"""WITH m AS (SELECT strftime("InvoiceDate",'%Y-%m') AS month, {_REV} AS revenue FROM logic_nb WHERE "InvoiceDate" IS NOT NULL GROUP BY 1), g AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS p FROM m),
 s AS (SELECT {_INV} AS o, {_CUS} AS c, floor((epoch_us(max("InvoiceDate"))-epoch_us(min("InvoiceDate")))/86400000000)::BIGINT AS d FROM logic_nb)
SELECT (SELECT round_even(sum(revenue::DECIMAL(28,2))::DOUBLE/count(*),2) FROM m) AS mean_monthly_revenue, (SELECT round_even(coalesce((revenue-p)/p,0)*100,4) FROM g ORDER BY month DESC LIMIT 1) AS last_month_growth_pct,
 round_even(c/(d/30.0::DOUBLE),4) AS customers_per_month, round_even(o::DOUBLE/d,4) AS orders_per_day FROM s""",
)
def kpi_growth(m):
    return sales.kpi_growth(m.facts)
