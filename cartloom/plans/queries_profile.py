"""Queries over the raw invoice lines: profile and issue counts."""

from pyspark.sql import functions as F

from cartloom.functions.numeric import stamp_text
from cartloom.functions.scalars import with_row
from cartloom.operators import profile
from cartloom.plans.catalog import query
from cartloom.sources.fixtures import INVOICE_COLUMNS

TEXT = ["Invoice", "StockCode", "Description", "InvoiceDate", "Country"]
NUMBERS = ["Quantity", "Price", "CustomerID"]


def _price_as_number(df):
    return df.withColumn("Price", F.col("Price").cast("double")) if "Price" in df.columns else df


def _per_column(template: str, columns=INVOICE_COLUMNS) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query(
    "profile_shape",
    """
WITH e AS (SELECT *, 'head' AS part FROM (SELECT * FROM raw ORDER BY "Invoice" NULLS FIRST,"StockCode" NULLS FIRST,"Description" NULLS FIRST,
  "Quantity" NULLS FIRST,"InvoiceDate" NULLS FIRST,"Price" NULLS FIRST,"CustomerID" NULLS FIRST,"Country" NULLS FIRST LIMIT 5)
 UNION ALL SELECT *, 'tail' AS part FROM (SELECT * FROM raw ORDER BY "Invoice" DESC NULLS LAST,"StockCode" DESC NULLS LAST,"Description" DESC NULLS LAST,
  "Quantity" DESC NULLS LAST,"InvoiceDate" DESC NULLS LAST,"Price" DESC NULLS LAST,"CustomerID" DESC NULLS LAST,"Country" DESC NULLS LAST LIMIT 5))
SELECT e.* REPLACE ("Price"::DOUBLE AS "Price"), (SELECT count(*) FROM raw) AS rows, 8 AS columns FROM e""",
)
def profile_shape(m):
    return _price_as_number(profile.ends(m.raw).transform(with_row, profile.shape(m.raw)))


@query(
    "profile_columns",
    _per_column(
        """SELECT '{c}' AS column_name, 'text' AS kind, count(*)-count("{c}") AS nulls, round_even((count(*)-count("{c}"))::DOUBLE/count(*)*100,4) AS null_pct,
 count(DISTINCT "{c}") AS distinct_values, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value,
 (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT "{c}" AS v FROM raw WHERE "{c}" IS NOT NULL ORDER BY v LIMIT 3)) AS examples FROM raw""",
        TEXT,
    )
    + " UNION ALL "
    + _per_column(
        """SELECT '{c}' AS column_name, 'number' AS kind, count(*)-count("{c}") AS nulls, round_even((count(*)-count("{c}"))::DOUBLE/count(*)*100,4) AS null_pct,
 count(DISTINCT "{c}") AS distinct_values, min("{c}")::DOUBLE AS min_value, max("{c}")::DOUBLE AS max_value, NULL AS examples FROM raw""",
        NUMBERS,
    ),
)
def profile_columns(m):
    return profile.column_profile(m.raw, pairs=m.raw_values)


@query(
    "profile_missing",
    _per_column(
        """SELECT '{c}' AS column_name, count(*)-count("{c}") AS nulls, round_even((count(*)-count("{c}"))::DOUBLE/count(*)*100,4) AS null_pct FROM raw"""
    ),
)
def profile_missing(m):
    return profile.missing_values(m.raw)


@query(
    "profile_dtypes",
    _per_column("""SELECT '{c}' AS column_name, count("{c}") AS filled, 'text' AS kind, 5 AS columns_of_kind FROM raw""", TEXT)
    + " UNION ALL "
    + _per_column("""SELECT '{c}' AS column_name, count("{c}") AS filled, 'number' AS kind, 3 AS columns_of_kind FROM raw""", NUMBERS),
)
def profile_dtypes(m):
    return profile.column_types(m.raw)


@query(
    "profile_exact_duplicates",
    """SELECT sum(copies)::BIGINT AS rows, count(*) AS distinct_rows, (sum(copies)-count(*))::BIGINT AS duplicates,
 round_even((sum(copies)-count(*))::DOUBLE/sum(copies)*100,4) AS duplicate_pct FROM raw_counted""",
)
def profile_exact_duplicates(m):
    return profile.exact_duplicates(m.raw)


@query(
    "profile_key_duplicates",
    """SELECT (SELECT sum(n-1)::BIGINT FROM (SELECT count(*) AS n FROM raw GROUP BY "Invoice")) AS invoice_repeats,
 (SELECT sum(n-1)::BIGINT FROM (SELECT count(*) AS n FROM raw GROUP BY "Invoice","StockCode")) AS pair_repeats""",
)
def profile_key_duplicates(m):
    return profile.key_duplicates(m.raw)


@query(
    "duplicate_rows_listing",
    """SELECT r.* REPLACE (r."Price"::DOUBLE AS "Price") FROM raw r JOIN (SELECT * FROM raw_counted WHERE copies>1) c
 ON r."Invoice" IS NOT DISTINCT FROM c."Invoice" AND r."StockCode" IS NOT DISTINCT FROM c."StockCode" AND r."Description" IS NOT DISTINCT FROM c."Description"
 AND r."Quantity" IS NOT DISTINCT FROM c."Quantity" AND r."InvoiceDate" IS NOT DISTINCT FROM c."InvoiceDate" AND r."Price" IS NOT DISTINCT FROM c."Price"
 AND r."CustomerID" IS NOT DISTINCT FROM c."CustomerID" AND r."Country" IS NOT DISTINCT FROM c."Country" """,
)
def duplicate_rows_listing(m):
    return _price_as_number(profile.duplicate_rows(m.raw))


@query(
    "profile_numeric_summary",
    _per_column(
        """SELECT '{c}' AS column_name, min("{c}")::DOUBLE AS min_value, max("{c}")::DOUBLE AS max_value,
 round_even(quantile_cont("{c}"::DOUBLE,0.5),4) AS median_value, round_even(sum("{c}")::DOUBLE/count("{c}"),4) AS mean_value FROM raw""",
        ["Quantity", "Price"],
    ),
)
def profile_numeric_summary(m):
    return profile.numeric_summary(m.raw)


@query(
    "profile_sign_counts",
    """SELECT count(*) AS rows, count(*) FILTER ("Quantity"<0) AS negative_quantities, count(*) FILTER ("Price"<0) AS negative_prices,
 count(*) FILTER ("Price"=0) AS zero_prices FROM raw""",
)
def profile_sign_counts(m):
    return profile.sign_counts(m.raw)


@query(
    "profile_box_stats",
    _per_column(
        """SELECT '{c}' AS column_name, round_even(q[1],4) AS q1, round_even(q[2],4) AS median_value, round_even(q[3],4) AS q3,
 min(v) FILTER (v>=q[1]-1.5*(q[3]-q[1])) AS whisker_low, max(v) FILTER (v<=q[3]+1.5*(q[3]-q[1])) AS whisker_high,
 count(*) FILTER (v<q[1]-1.5*(q[3]-q[1]) OR v>q[3]+1.5*(q[3]-q[1])) AS outliers
FROM (SELECT "{c}"::DOUBLE AS v FROM raw), (SELECT quantile_cont("{c}"::DOUBLE,[0.25,0.5,0.75]) AS q FROM raw) GROUP BY q""",
        ["Quantity", "Price"],
    ),
)
def profile_box_stats(m):
    return profile.box_stats(m.raw)


@query(
    "profile_returns_coherence",
    """SELECT count(*) FILTER ("Quantity"<0) AS negative_quantity_lines, count(*) FILTER (starts_with("Invoice",'C')) AS cancelled_lines,
 count(*) FILTER (starts_with("Invoice",'C') AND "Quantity"<0) AS cancelled_and_negative FROM raw""",
)
def profile_returns_coherence(m):
    return profile.returns_coherence(m.raw)


@query(
    "profile_special_codes",
    """SELECT "StockCode", count(*) AS lines FROM raw WHERE regexp_matches("StockCode",'^[A-Z]+$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def profile_special_codes(m):
    return profile.special_codes(m.raw)


@query(
    "profile_sign_quadrants",
    """SELECT count(*) FILTER ("Price">0 AND "Quantity">0) AS both_positive, count(*) FILTER ("Price"<0 AND "Quantity"<0) AS both_negative FROM raw""",
)
def profile_sign_quadrants(m):
    return profile.sign_quadrants(m.raw)


@query(
    "profile_cardinality",
    _per_column(
        """SELECT '{c}' AS column_name, count(DISTINCT "{c}") AS distinct_values, round_even(count(DISTINCT "{c}")::DOUBLE/count(*)*100,4) AS distinct_pct FROM raw"""
    ),
)
def profile_cardinality(m):
    return profile.cardinality(m.raw, pairs=m.raw_values)


@query(
    "profile_top_countries",
    """SELECT "Country", count(*) AS lines FROM raw WHERE "Country" IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def profile_top_countries(m):
    return profile.top_countries(m.raw)


@query(
    "profile_entity_counts",
    """SELECT count(DISTINCT "CustomerID") AS customers, count(DISTINCT "StockCode") AS products, count(DISTINCT "Invoice") AS invoices,
 count(DISTINCT "Country") AS countries FROM raw""",
)
def profile_entity_counts(m):
    return profile.entity_counts(m.raw)


@query(
    "profile_time_range",
    """SELECT strftime(min(parsed_at),'%Y-%m-%d %H:%M:%S') AS first, strftime(max(parsed_at),'%Y-%m-%d %H:%M:%S') AS last,
 floor((epoch_us(max(parsed_at))-epoch_us(min(parsed_at)))/86400000000)::BIGINT AS span_days FROM raw_parsed""",
)
def profile_time_range(m):
    return profile.time_range(m.raw).withColumns({c: stamp_text(c) for c in ("first", "last")})


@query(
    "profile_monthly_rows",
    """SELECT strftime(parsed_at,'%Y-%m') AS month, count(*) AS lines FROM raw_parsed WHERE parsed_at IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def profile_monthly_rows(m):
    return profile.monthly_rows(m.raw)


_HIST = """SELECT '{c}' AS column_name, bin, round_even(lo+(hi-lo)*bin/50.0,4) AS bin_from, count(*) AS rows FROM (
 SELECT least(49, coalesce(floor((v-lo)*50.0/nullif(hi-lo,0)),0))::INTEGER AS bin, lo, hi FROM (SELECT "{c}"::DOUBLE AS v FROM raw WHERE "{c}">0 AND "{c}"<{top}),
 (SELECT min("{c}")::DOUBLE AS lo, max("{c}")::DOUBLE AS hi FROM raw WHERE "{c}">0 AND "{c}"<{top})) GROUP BY bin, lo, hi"""


@query(
    "profile_histograms",
    _HIST.replace("{c}", "Quantity").replace("{top}", "100") + " UNION ALL " + _HIST.replace("{c}", "Price").replace("{top}", "60000"),
)
def profile_histograms(m):
    # The default limits fit unit prices; the given prices are line totals, so the price limit is wider.
    return profile.bounded_histogram(m.raw, "Quantity").unionByName(profile.bounded_histogram(m.raw, "Price", high=60000))


_SNAPSHOT = """SELECT sum(copies)::BIGINT AS rows, coalesce(sum(copies) FILTER ("CustomerID" IS NULL),0)::BIGINT AS missing_customer_id,
 coalesce(sum(copies) FILTER ("Description" IS NULL),0)::BIGINT AS missing_description, (sum(copies)-count(*))::BIGINT AS total_duplicates,
 coalesce(sum(copies) FILTER ("Quantity"<0),0)::BIGINT AS negative_quantities, coalesce(sum(copies) FILTER ("Price"=0),0)::BIGINT AS zero_prices,
 coalesce(sum(copies) FILTER ("Price"<0),0)::BIGINT AS negative_prices FROM raw_counted"""
_ISSUE_SUM = "missing_customer_id+missing_description+total_duplicates+negative_quantities+zero_prices+negative_prices"


@query("profile_clean_rate", f"""SELECT rows, {_ISSUE_SUM} AS issues, round_even((rows-({_ISSUE_SUM}))::DOUBLE/rows*100,4) AS clean_rate_pct FROM ({_SNAPSHOT})""")
def profile_clean_rate(m):
    return profile.clean_rate(profile.issue_snapshot(m.raw))


@query("issue_snapshot", f"""SELECT *, 2 AS wrong_dtypes, {_ISSUE_SUM}+2 AS total_issues FROM ({_SNAPSHOT})""")
def issue_snapshot(m):
    return profile.issue_total(profile.issue_snapshot(m.raw))


@query(
    "profile_transaction_types",
    """SELECT "Transaction_Type", count(*) AS lines, count(*) FILTER ("InvoiceDate" IS NULL) AS null_dates, count(*) FILTER ("Total_Amount" IS NULL) AS null_amounts,
 min("Total_Amount")::DOUBLE AS min_amount, max("Total_Amount")::DOUBLE AS max_amount, round_even(sum("Total_Amount")::DOUBLE/count("Total_Amount"),4) AS mean_amount
FROM logic_nb GROUP BY 1""",
)
def profile_transaction_types(m):
    return profile.transaction_types(m.cleaned)
