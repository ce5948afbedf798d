"""Sales, product, country and season reports.

Reports that need no product detail read the invoice facts: lines rolled up
to (invoice, customer, date, country, type).  The rollup is combined before
its shuffle and is far smaller than the lines, so each report's distinct
counts run over invoices, not lines.  Totals stay decimal until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.functions.numeric import dbl, pct, ratio, right_closed_band, round_even, total, whole_days
from cartloom.functions.ordering import exact_quantiles, running_total, value_frequencies
from cartloom.functions.scalars import with_row

# Weekday order, tier edges and labels.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIER_EDGES = [0, 100, 500, 1000, float("inf")]
TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
DESCRIPTION_WIDTH = 50

AT = "InvoiceDate"
FACT_KEYS = ["Invoice", "CustomerID", "Country", AT, "Transaction_Type"]


def invoice_facts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*FACT_KEYS).agg(
        F.sum("Total_Amount").cast("decimal(28,2)").alias("amount"),
        F.count("Total_Amount").alias("lines"),
        F.sum("Quantity").alias("quantity"),
    )


def revenue() -> Column:
    return total("amount").cast("double")


def invoices() -> Column:
    return F.count_distinct("Invoice")


def buyers() -> Column:
    return F.count_distinct("CustomerID")


def mean_amount() -> Column:
    return ratio(F.sum("amount"), F.sum("lines"))


def mean_money(c: str) -> Column:
    """Mean of an amount, added up exactly so that it does not depend on the order of rows."""
    return ratio(F.sum(F.col(c).cast("decimal(28,2)")), F.count(c))


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def dated(facts: DataFrame) -> DataFrame:
    """Groupings by date drop lines whose date is unreadable."""
    return facts.where(F.col(AT).isNotNull())


def tier(c: Column | str) -> Column:
    return right_closed_band(c, TIER_EDGES, TIERS)


def shorten(c: Column | str) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    cut = F.concat(F.substring(text, 1, DESCRIPTION_WIDTH), F.lit("..."))
    return F.when(F.length(text) > DESCRIPTION_WIDTH, cut).otherwise(text)


def weekday_frame(facts: DataFrame) -> DataFrame:
    """The seven weekdays as a lookup of fixed size."""
    days = F.array(*[F.struct(F.lit(i).alias("day_no"), F.lit(d).alias("day")) for i, d in enumerate(WEEKDAYS)])
    return facts.sparkSession.range(1).select(F.inline(days))


# -- finance -------------------------------------------------------------------
def financial_performance(lines: DataFrame) -> DataFrame:
    sale, back = F.col("Transaction_Type") == "SALE", F.col("Transaction_Type") == "RETURN"
    amount = F.col("Total_Amount")
    median = exact_quantiles(lines.where(sale), {"amount": amount}, [0.5])
    sums = lines.agg(
        total(F.when(sale, amount)).cast("double").alias("gross_revenue"),
        F.abs(total(F.when(back, amount)).cast("double")).alias("returns_amount"),
        F.count(F.when(sale, F.lit(1))).alias("sale_lines"),
        total(F.when(sale, F.col("Quantity"))).alias("items_sold"),
    )
    return sums.transform(with_row, median).select(
        "gross_revenue",
        "returns_amount",
        (F.col("gross_revenue") - F.col("returns_amount")).alias("net_revenue"),
        pct("returns_amount", "gross_revenue").alias("return_rate"),
        round_even(ratio("gross_revenue", "sale_lines"), 4).alias("mean_line_amount"),
        round_even("amount_q0", 4).alias("median_line_amount"),
        "sale_lines",
        "items_sold",
        round_even(ratio("items_sold", "sale_lines"), 4).alias("mean_items"),
    )


# -- time ------------------------------------------------------------------------
def sales_daily(sales: DataFrame) -> DataFrame:
    days = (
        dated(sales)
        .groupBy(F.to_date(AT).alias("_day"))
        .agg(revenue().alias("revenue"), invoices().alias("invoices"), buyers().alias("customers"))
    )
    mean = days.agg(round_even(mean_money("revenue"), 2).alias("mean_daily_revenue"))
    return days.transform(with_row, mean).select(
        F.date_format("_day", "yyyy-MM-dd").alias("day"), "revenue", "invoices", "customers", "mean_daily_revenue"
    )


def sales_hourly(sales: DataFrame) -> DataFrame:
    hours = dated(sales).groupBy(F.hour(AT).alias("hour")).agg(revenue().alias("revenue"))
    best = hours.agg(F.max_by("hour", F.struct("revenue", -F.col("hour"))).alias("_peak"))
    return hours.transform(with_row, best).select(
        "hour", "revenue", (F.col("hour") == F.col("_peak")).alias("is_peak")
    )


def sales_by_month_name(sales: DataFrame) -> DataFrame:
    """Calendar months of all years together."""
    return (
        dated(sales)
        .groupBy(month_name(F.col(AT)).alias("month_name"))
        .agg(revenue().alias("revenue"), invoices().alias("invoices"))
    )


def sales_by_weekday(sales: DataFrame) -> DataFrame:
    """Monday to Sunday; a day without sales stays, with null revenue."""
    days = dated(sales).groupBy(F.weekday(AT).alias("day_no")).agg(revenue().alias("revenue"))
    return weekday_frame(sales).join(days, "day_no", "left").select("day_no", "day", "revenue")


def monthly_trend(facts: DataFrame) -> DataFrame:
    return (
        dated(facts)
        .groupBy(F.date_format(AT, "yyyy-MM").alias("month"))
        .agg(revenue().alias("revenue"), invoices().alias("invoices"), buyers().alias("customers"))
    )


def heatmap_day_hour(facts: DataFrame) -> DataFrame:
    grid = (
        dated(facts)
        .groupBy(F.weekday(AT).alias("day_no"))
        .agg(*[F.sum(F.when(F.hour(AT) == h, F.col("amount"))).cast("double").alias(f"h{h:02d}") for h in range(24)])
    )
    return weekday_frame(facts).join(grid, "day_no", "left")


def calendar_features(lines: DataFrame) -> DataFrame:
    at = F.col(AT)
    return lines.withColumns(
        {
            "Year": F.year(at),
            "Month": F.month(at),
            "MonthName": month_name(at),
            "Quarter": F.quarter(at),
            "DayOfWeek": F.weekday(at),
            "DayName": day_name(at),
            "Hour": F.hour(at),
            "Week": F.weekofyear(at),
        }
    )


def monthly_summary(facts: DataFrame) -> DataFrame:
    months = (
        dated(facts)
        .groupBy(F.year(AT).alias("year"), F.month(AT).alias("month"), month_name(F.col(AT)).alias("month_name"))
        .agg(
            revenue().alias("revenue"),
            round_even(mean_amount(), 2).alias("mean_amount"),
            F.sum("lines").alias("lines"),
            invoices().alias("invoices"),
            buyers().alias("customers"),
            F.sum("quantity").alias("quantity"),
        )
    )
    return months.withColumn("revenue_per_order", round_even(ratio("revenue", "invoices"), 4)).withColumn(
        "revenue_per_customer", round_even(ratio("revenue", "customers"), 4)
    )


def month_seasonality(facts: DataFrame) -> DataFrame:
    per_order = ratio("revenue", "invoices")
    return (
        monthly_summary(facts)
        .groupBy("month")
        .agg(
            round_even(mean_money("revenue"), 2).alias("mean_revenue"),
            round_even(F.avg("invoices"), 4).alias("mean_invoices"),
            round_even(F.avg("customers"), 4).alias("mean_customers"),
            round_even(F.avg(per_order), 3).alias("mean_revenue_per_order"),
        )
    )


def quarterly_growth(facts: DataFrame) -> DataFrame:
    quarters = (
        dated(facts)
        .groupBy(F.year(AT).alias("year"), F.quarter(AT).alias("quarter"))
        .agg(revenue().alias("revenue"), invoices().alias("invoices"), buyers().alias("customers"))
    )
    # One row per calendar quarter: the ordered window has a bounded input.
    earlier = F.lag("revenue").over(Window.orderBy("year", "quarter"))
    growth = ratio(F.col("revenue") - earlier, earlier) * 100
    label = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
    return quarters.withColumn("label", label).withColumn("growth_pct", round_even(growth, 4))


def weekday_pattern(facts: DataFrame) -> DataFrame:
    return (
        dated(facts)
        .groupBy(F.weekday(AT).alias("day_no"), day_name(F.col(AT)).alias("day"))
        .agg(
            revenue().alias("revenue"),
            round_even(mean_amount(), 4).alias("mean_amount"),
            invoices().alias("invoices"),
            buyers().alias("customers"),
        )
        .orderBy("day_no")
    )


def hourly_pattern(facts: DataFrame) -> DataFrame:
    return (
        dated(facts)
        .groupBy(F.hour(AT).alias("hour"))
        .agg(
            revenue().alias("revenue"),
            round_even(mean_amount(), 4).alias("mean_amount"),
            invoices().alias("invoices"),
            buyers().alias("customers"),
        )
    )


def peak_hours(facts: DataFrame, n: int = 5) -> DataFrame:
    return hourly_pattern(facts).orderBy(F.desc("revenue"), "hour").limit(n)


def _calendar_revenue(facts: DataFrame) -> DataFrame:
    """Revenue per year-month, weekday, hour and calendar month from one scan."""
    parts = dated(facts).select(
        (F.year(AT) * 100 + F.month(AT)).alias("ym"),
        F.weekday(AT).alias("weekday"),
        F.hour(AT).alias("hour"),
        F.month(AT).alias("month"),
        "amount",
    )
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in ("ym", "weekday", "hour", "month")]
    # Partial sums collapse the four copies of a row before the shuffle.
    return (
        parts.groupBy("ym", "weekday", "hour", "month")
        .agg(F.sum("amount").alias("amount"))
        .select(F.explode(F.array(*kinds)).alias("_k"), "amount")
        .groupBy("_k.kind", "_k.bucket")
        .agg(F.sum("amount").cast("double").alias("revenue"))
    )


def _best_and_worst(facts: DataFrame, wanted: dict[str, str]) -> DataFrame:
    buckets = _calendar_revenue(facts).where(F.col("kind").isin(list(wanted)))
    names = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
    return buckets.groupBy("kind").agg(
        F.max_by("bucket", F.struct("revenue", -F.col("bucket"))).alias("best"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("bucket", F.struct("revenue", F.col("bucket"))).alias("worst"),
        F.min("revenue").alias("worst_revenue"),
    ).withColumn("kind", names[F.col("kind")])


def seasonal_extremes(facts: DataFrame) -> DataFrame:
    """Best and worst year-month (yyyymm), weekday (Monday 0) and hour."""
    return _best_and_worst(facts, {"ym": "month", "weekday": "weekday", "hour": "hour"})


def best_month_weekday(facts: DataFrame) -> DataFrame:
    """Best and worst calendar month and weekday, all years together."""
    return _best_and_worst(facts, {"month": "calendar_month", "weekday": "weekday"})


# -- customers -------------------------------------------------------------------
def customer_metrics_sales(sales: DataFrame) -> DataFrame:
    per = (
        sales.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(
            revenue().alias("total_spent"),
            F.sum("lines").alias("total_orders"),
            round_even(mean_amount(), 2).alias("avg_order_value"),
            invoices().alias("unique_invoices"),
            F.min(AT).alias("first_purchase"),
            F.max(AT).alias("last_purchase"),
            F.sum("quantity").alias("items_bought"),
        )
    )
    return per.withColumns(
        {
            "days_active": whole_days("last_purchase", "first_purchase"),
            "tier": tier("total_spent"),
            "customer_type": F.when(F.col("CustomerID").startswith("GUEST_"), "Guest").otherwise("Registered"),
        }
    )


def tier_distribution(customers: DataFrame) -> DataFrame:
    counts = customers.groupBy("tier").agg(F.count(F.lit(1)).alias("customers"))
    everyone = counts.agg(F.sum("customers").alias("_all"))
    return (
        counts.where(F.col("tier").isNotNull())
        .transform(with_row, everyone)
        .select("tier", "customers", pct("customers", "_all").alias("share_pct"))
    )


def top_rows(df: DataFrame, measure: str, key: list[str], n: int) -> DataFrame:
    """The n largest, ties by key."""
    return df.orderBy(F.desc(measure), *key).limit(n)


def customer_metrics_all(facts: DataFrame) -> DataFrame:
    per = (
        facts.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(
            revenue().alias("total_revenue"),
            round_even(mean_amount(), 4).alias("avg_order_value"),
            F.sum("lines").alias("total_orders"),
            F.sum("quantity").alias("total_items"),
            invoices().alias("unique_invoices"),
            F.min(AT).alias("first_purchase"),
            F.max(AT).alias("last_purchase"),
        )
    )
    last = facts.agg(F.max(AT).alias("_last"))
    return per.transform(with_row, last).withColumns(
        {
            "lifetime_days": whole_days("last_purchase", "first_purchase"),
            "recency_days": whole_days("_last", "last_purchase"),
            "tier": tier("total_revenue"),
        }
    ).drop("_last")


def tier_stats(customers: DataFrame) -> DataFrame:
    return (
        customers.where(F.col("tier").isNotNull())
        .groupBy("tier")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            round_even(F.sum(F.col("total_revenue").cast("decimal(28,2)")), 2).alias("revenue"),
            round_even(ratio(F.sum(F.col("total_revenue").cast("decimal(28,2)")), F.count(F.lit(1))), 2).alias("mean_revenue"),
            round_even(F.avg("avg_order_value"), 2).alias("mean_order_value"),
            round_even(ratio(F.sum("total_orders"), F.count(F.lit(1))), 2).alias("mean_orders"),
        )
    )


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes; the largest value falls in the last bin."""
    values = df.select(dbl(value).alias("_v")).where(F.col("_v").isNotNull())
    ends = values.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * F.lit(float(bins)), F.col("_hi") - F.col("_lo")))
    return (
        values.transform(with_row, ends)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy("bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "bin",
            round_even(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(float(bins)), 4).alias("bin_from"),
            "rows",
        )
    )


# -- products --------------------------------------------------------------------
PRODUCT = ["StockCode", "Description"]


def product_metrics_sales(lines: DataFrame) -> DataFrame:
    per = (
        lines.dropna(subset=PRODUCT)
        .groupBy(*PRODUCT)
        .agg(
            F.sum("Quantity").alias("total_quantity"),
            total("Total_Amount").cast("double").alias("total_revenue"),
            invoices().alias("unique_orders"),
            buyers().alias("unique_customers"),
        )
    )
    return per.withColumn("avg_price", round_even(ratio("total_revenue", "total_quantity"), 4))


def top_products(products: DataFrame, measure: str, n: int = 10) -> DataFrame:
    best = top_rows(products, measure, PRODUCT, n)
    return best.select("StockCode", shorten("Description").alias("description"), measure)


def product_metrics_all(lines: DataFrame) -> DataFrame:
    per = (
        lines.dropna(subset=PRODUCT)
        .groupBy(*PRODUCT)
        .agg(
            total("Total_Amount").cast("double").alias("total_revenue"),
            round_even(ratio(F.sum("Total_Amount"), F.count("Total_Amount")), 4).alias("avg_revenue_per_sale"),
            F.sum("Quantity").alias("total_quantity"),
            round_even(ratio(F.sum("Quantity"), F.count("Quantity")), 4).alias("avg_quantity_per_sale"),
            buyers().alias("unique_customers"),
            invoices().alias("unique_orders"),
        )
    )
    return per.withColumn(
        "revenue_per_customer", round_even(ratio("total_revenue", "unique_customers"), 4)
    ).withColumn("repeat_rate", round_even(ratio("unique_orders", "unique_customers"), 4))


# -- countries -------------------------------------------------------------------
def country_metrics(sales: DataFrame) -> DataFrame:
    per = (
        sales.where(F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(
            revenue().alias("total_revenue"),
            invoices().alias("total_orders"),
            buyers().alias("unique_customers"),
            F.sum("quantity").alias("items_sold"),
        )
    )
    return per.withColumn("avg_order_value", round_even(ratio("total_revenue", "total_orders"), 4)).withColumn(
        "revenue_per_customer", round_even(ratio("total_revenue", "unique_customers"), 4)
    )


def top_countries_share(sales: DataFrame, n: int = 10) -> DataFrame:
    """Top countries by revenue with their share, and top countries by customers."""
    countries = country_metrics(sales)
    # A country table has one row per country, so its total is a small aggregate.
    everything = sales.agg(revenue().alias("_all"))
    by_revenue = top_rows(countries, "total_revenue", ["Country"], n).select(
        F.lit("revenue").alias("ranking"), "Country", "total_revenue", "unique_customers"
    )
    by_customers = top_rows(countries, "unique_customers", ["Country"], n).select(
        F.lit("customers").alias("ranking"), "Country", "total_revenue", "unique_customers"
    )
    return (
        by_revenue.unionByName(by_customers)
        .transform(with_row, everything)
        .withColumn("revenue_pct", pct("total_revenue", "_all"))
        .drop("_all")
    )


def top_countries_all(facts: DataFrame, n: int = 10) -> DataFrame:
    per = facts.where(F.col("Country").isNotNull()).groupBy("Country").agg(revenue().alias("revenue"))
    return top_rows(per, "revenue", ["Country"], n)


# -- overall ---------------------------------------------------------------------
def global_kpis(lines: DataFrame) -> DataFrame:
    sums = lines.agg(
        total("Total_Amount").cast("double").alias("revenue"),
        F.min(AT).alias("_first"),
        F.max(AT).alias("_last"),
    )
    # Counted together, every line would go out once for each count; Spark also puts distinct counts that are scalar subqueries together.
    for c, name in (("Invoice", "orders"), ("CustomerID", "customers"), ("StockCode", "products")):
        values = lines.where(F.col(c).isNotNull()).select(c).distinct()
        sums = sums.transform(with_row, values.agg(F.count(F.lit(1)).alias(name)))
    return sums.select(
        "revenue",
        "orders",
        "customers",
        "products",
        round_even(ratio("revenue", "orders"), 4).alias("avg_order_value"),
        whole_days("_last", "_first").alias("period_days"),
    )


def top_share(df: DataFrame, value: Column, top: float = 0.2) -> DataFrame:
    """One row: rows, rows in the top int(top*n), their sum, the grand total.

    Rows with the same value are interchangeable in a sum, so ranks are
    needed only over distinct values.
    """
    counted = value_frequencies(df, {"v": value}, value_type="decimal(28,2)")
    placed = running_total(counted, [F.col("value").desc()], "copies", "before")
    n = placed.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.sum(F.col("value") * F.col("copies")).alias("grand_total"))
    n = n.withColumn("top_rows", F.floor(F.col("rows").cast("double") * F.lit(float(top))).cast("bigint"))
    taken = F.least(F.col("copies"), F.greatest(F.lit(0), F.col("top_rows") - F.col("before")))
    return (
        placed.transform(with_row, n)
        .groupBy("rows", "top_rows", "grand_total")
        .agg(F.sum(F.col("value") * taken).cast("double").alias("top_total"), F.max("value").cast("double").alias("largest"))
        .withColumn("grand_total", dbl("grand_total"))
    )


def pareto_customers(facts: DataFrame) -> DataFrame:
    per = (
        facts.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.sum("amount").alias("amount"), invoices().alias("orders"))
    )
    share = top_share(per, F.col("amount"))
    orders = per.agg(round_even(ratio(F.sum("orders"), F.count(F.lit(1))), 4).alias("mean_orders"))
    return share.transform(with_row, orders).select(
        F.col("rows").alias("customers"),
        F.col("top_rows").alias("top_customers"),
        pct("top_total", "grand_total").alias("top_20_share_pct"),
        F.col("largest").alias("largest_customer"),
        "mean_orders",
    )


def pareto_products(lines: DataFrame) -> DataFrame:
    per = (
        lines.where(F.col("StockCode").isNotNull())
        .groupBy("StockCode")
        .agg(total("Total_Amount").cast("double").alias("revenue"))
    )
    cut = exact_quantiles(per, {"revenue": F.col("revenue")}, [0.8])
    ten = top_rows(per, "revenue", ["StockCode"], 10).agg(
        F.sum(F.col("revenue").cast("decimal(28,2)")).cast("double").alias("_ten")
    )
    sums = per.transform(with_row, cut).agg(
        F.sum(F.col("revenue").cast("decimal(28,2)")).cast("double").alias("_all"),
        F.max("revenue").alias("best_product_revenue"),
        F.count(F.when(F.col("revenue") > F.col("revenue_q0"), 1)).alias("products_above_p80"),
    )
    return sums.transform(with_row, ten).select(
        pct("_ten", "_all").alias("top_10_share_pct"), "best_product_revenue", "products_above_p80"
    )


def kpi_growth(facts: DataFrame) -> DataFrame:
    """Mean monthly revenue, growth of the last month, customers per month, orders per day."""
    months = monthly_trend(facts).select("month", "revenue")
    # One row per month: bounded.
    earlier = F.lag("revenue").over(Window.orderBy("month"))
    growth = months.withColumn("_earlier", earlier).agg(
        round_even(mean_money("revenue"), 2).alias("mean_monthly_revenue"),
        F.max_by(ratio(F.col("revenue") - F.col("_earlier"), "_earlier"), "month").alias("_growth"),
    )
    sums = facts.agg(
        invoices().alias("_orders"), buyers().alias("_customers"), whole_days(F.max(AT), F.min(AT)).alias("_days")
    )
    return growth.transform(with_row, sums).select(
        "mean_monthly_revenue",
        round_even(F.coalesce(F.col("_growth"), F.lit(0.0)) * 100, 4).alias("last_month_growth_pct"),
        round_even(ratio("_customers", F.col("_days") / F.lit(30.0)), 4).alias("customers_per_month"),
        round_even(ratio("_orders", "_days"), 4).alias("orders_per_day"),
    )
