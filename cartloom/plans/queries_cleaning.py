"""Cleaning queries."""

from pyspark.sql import functions as F

from cartloom.functions.numeric import stamp_text
from cartloom.functions.scalars import with_row
from cartloom.operators import cleaning
from cartloom.plans.catalog import query


def _plain(df):
    """Money as double and times as text, so both engines print them alike."""
    casts = {}
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            casts[name] = F.col(name).cast("double")
        elif kind.startswith("timestamp"):
            casts[name] = stamp_text(name)
    return df.withColumns(casts) if casts else df


_AT = """strftime("InvoiceDate",'%Y-%m-%d %H:%M:%S') AS "InvoiceDate" """
_P = '"Price"::DOUBLE AS "Price"'


@query("clean_missing_lib", f"SELECT * REPLACE ({_P}) FROM kept_lib")
def clean_missing_lib(m):
    return _plain(cleaning.clean_missing(m.raw))


@query("clean_dedup", f"SELECT * REPLACE ({_P}) FROM (SELECT DISTINCT * FROM raw)")
def clean_dedup(m):
    return _plain(cleaning.drop_duplicates(m.raw))


@query(
    "clean_parse_dates",
    f"""SELECT * EXCLUDE (parsed_at) REPLACE (strftime(parsed_at,'%Y-%m-%d %H:%M:%S') AS "InvoiceDate", {_P}),
 year(parsed_at) AS "Year", month(parsed_at) AS "Month", isodow(parsed_at)-1 AS "DayOfWeek", hour(parsed_at) AS "Hour" FROM raw_parsed""",
)
def clean_parse_dates(m):
    return _plain(cleaning.parse_dates(m.raw))


@query(
    "clean_detect_returns",
    f"""SELECT * REPLACE ({_P}), coalesce(starts_with("Invoice",'C'),false) AS "IsReturn", regexp_replace("Invoice",'^C','') AS "InvoiceClean" FROM raw""",
)
def clean_detect_returns(m):
    return _plain(cleaning.detect_returns(m.raw))


@query(
    "clean_business_rules",
    f"""SELECT r.* REPLACE ({_P}), ("Price"*"Quantity")::DOUBLE AS "TotalAmount", n.* FROM raw r,
 (SELECT count(*) FILTER (starts_with("Invoice",'C') AND "Quantity">0) AS returns_with_positive_quantity, count(*) FILTER ("Price">1000) AS expensive_lines,
  count(*) FILTER ("CustomerID"<=0) AS invalid_customers FROM raw) n WHERE "CustomerID" IS NULL OR "CustomerID">0""",
)
def clean_business_rules(m):
    notes = cleaning.business_rule_notes(cleaning.detect_returns(m.raw))
    return _plain(cleaning.apply_business_rules(m.raw)).transform(with_row, notes)


@query(
    "clean_optimize_types",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(DISTINCT "{c}") AS distinct_values, round_even(count(DISTINCT "{c}")::DOUBLE/count(*),4) AS distinct_share,
 count(DISTINCT "{c}")::DOUBLE/count(*)<0.5 AS to_category FROM cleaned_lib"""
        for c in ("StockCode", "Country", "Invoice", "InvoiceClean")
    ),
)
def clean_optimize_types(m):
    return cleaning.category_candidates(cleaning.narrow_types(m.cleaned_lib))


@query(
    "clean_quality_score",
    """SELECT *, round_even(least(100,greatest(0,(1-missing_cells::DOUBLE/(rows*5))*30+(1-(rows-distinct_rows)::DOUBLE/rows)*20+(1-bad_prices::DOUBLE/rows)*25+(1-bad_dates::DOUBLE/rows)*25)),4) AS quality_score FROM (
 SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned_lib)) AS distinct_rows,
 sum(("Invoice" IS NULL)::INTEGER+("StockCode" IS NULL)::INTEGER+("Description" IS NULL)::INTEGER+("Price" IS NULL)::INTEGER+("Quantity" IS NULL)::INTEGER)::BIGINT AS missing_cells,
 count(*) FILTER ("Price"<=0) AS bad_prices, count(*) FILTER ("InvoiceDate" IS NULL) AS bad_dates FROM cleaned_lib)""",
)
def clean_quality_score(m):
    return cleaning.cleaned_quality_score(m.cleaned_lib)


@query("clean_dataset_lib", f"""SELECT * REPLACE ({_AT}, {_P}, "TotalAmount"::DOUBLE AS "TotalAmount") FROM cleaned_lib""")
def clean_dataset_lib(m):
    return _plain(m.cleaned_lib)


@query(
    "clean_report_lib",
    """SELECT (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM cleaned_lib) AS rows_after, 8 AS columns_before, 15 AS columns_after,
 array_to_string(list_filter(['customer_id_nulls_preserved', CASE WHEN count(*)>count("Description") THEN 'missing_descriptions_removed' END,
 CASE WHEN count(*)>count("Invoice") THEN 'missing_invoices_removed' END, CASE WHEN count(*)>count("StockCode") THEN 'missing_stockcodes_removed' END,
 CASE WHEN count(*) FILTER ("Price" IS NULL OR "Price"=0)>0 THEN 'invalid_prices_removed' END, CASE WHEN count(*)>count("Quantity") THEN 'missing_quantities_removed' END,
 'missing_values_handled', CASE WHEN (SELECT count(*) FROM kept_lib)>(SELECT count(*) FROM (SELECT DISTINCT * FROM kept_lib)) THEN 'duplicates_removed' END,
 'date_parsing','temporal_features_created','returns_detected','invoice_cleaned',
 CASE WHEN (SELECT count(*) FROM kept_lib WHERE starts_with("Invoice",'C') AND "Quantity">0)>0 THEN 'return_quantity_inconsistency_noted' END,
 CASE WHEN (SELECT count(*) FROM kept_lib WHERE "Price">1000)>0 THEN 'expensive_items_flagged' END,
 CASE WHEN (SELECT count(*) FROM kept_lib WHERE "CustomerID"<=0)>0 THEN 'invalid_customer_ids_removed' END,
 'total_amount_calculated','business_rules_validated','data_types_optimized'], lambda x: x IS NOT NULL), ', ') AS steps FROM raw""",
)
def clean_report_lib(m):
    return cleaning.cleaning_report(m.raw)


@query("clean_types_nb", f"""SELECT * REPLACE ({_AT}, {_P}) FROM typed_nb""")
def clean_types_nb(m):
    return _plain(cleaning.infer_types(m.raw))


@query("clean_guest_ids", f"""SELECT * REPLACE ({_AT}, {_P}) FROM guested""")
def clean_guest_ids(m):
    return _plain(cleaning.assign_guests(cleaning.infer_types(m.raw)))


_LOGIC = f"""* REPLACE ({_AT}, {_P}, "Total_Amount"::DOUBLE AS "Total_Amount")"""


@query("clean_business_logic_nb", f"SELECT {_LOGIC} FROM logic_nb")
def clean_business_logic_nb(m):
    return _plain(m.cleaned.drop("Price_Outlier", "Quantity_Outlier"))


@query(
    "clean_outliers_nb",
    """SELECT count(*) AS rows, round_even(min(pf),4) AS price_fence, round_even(min(qf),4) AS quantity_fence, count(*) FILTER ("Price_Outlier") AS price_outliers,
 count(*) FILTER ("Quantity_Outlier") AS quantity_outliers FROM cleaned, fences""",
)
def clean_outliers_nb(m):
    from cartloom.functions.numeric import flag_count, round_even

    counts = m.cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        flag_count(F.col("Price_Outlier")).alias("price_outliers"),
        flag_count(F.col("Quantity_Outlier")).alias("quantity_outliers"),
    )
    fences = cleaning.outlier_fences(m.cleaned).select(
        round_even("Price_fence", 4).alias("price_fence"), round_even("Quantity_fence", 4).alias("quantity_fence")
    )
    return counts.transform(with_row, fences)


@query("clean_composite_nb", f"SELECT {_LOGIC} FROM cleaned")
def clean_composite_nb(m):
    return _plain(m.cleaned)


@query(
    "clean_summary",
    """SELECT *, original_rows-final_rows AS rows_removed, 5 AS new_columns, round_even(price_outliers::DOUBLE/final_rows*100,4) AS price_outlier_pct,
 round_even(quantity_outliers::DOUBLE/final_rows*100,4) AS quantity_outlier_pct, round_even(suspicious_lines::DOUBLE/final_rows*100,4) AS suspicious_pct FROM (
SELECT (SELECT count(*) FROM raw) AS original_rows, count(*) AS final_rows, count(*) FILTER (starts_with("CustomerID",'GUEST_')) AS guest_customers,
 count(DISTINCT "CustomerID") FILTER (NOT starts_with("CustomerID",'GUEST_')) AS registered_customers, count(*) FILTER ("Transaction_Type"='SALE') AS sales_lines,
 count(*) FILTER ("Transaction_Type"='RETURN') AS return_lines, (sum("Total_Amount") FILTER ("Transaction_Type"='SALE'))::DOUBLE AS gross_sales,
 (sum("Total_Amount") FILTER ("Transaction_Type"='RETURN'))::DOUBLE AS returns_amount, sum("Total_Amount")::DOUBLE AS net_revenue,
 count(*) FILTER ("Price_Outlier") AS price_outliers, count(*) FILTER ("Quantity_Outlier") AS quantity_outliers, count(*) FILTER ("Suspicious") AS suspicious_lines FROM cleaned)""",
)
def clean_summary(m):
    return cleaning.cleaning_summary(m.raw, m.cleaned)


@query(
    "clean_control",
    """SELECT count(*)-count("Invoice") AS "null_Invoice", count(*)-count("Description") AS "null_Description", count(*)-count("InvoiceDate") AS "null_InvoiceDate",
 count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS remaining_duplicates, count("InvoiceDate") AS valid_dates, count("CustomerID") AS valid_customers,
 count(*) FILTER ("Total_Amount"="Quantity"*"Price") AS amounts_consistent FROM cleaned""",
)
def clean_control(m):
    return cleaning.cleaning_control(m.cleaned)
