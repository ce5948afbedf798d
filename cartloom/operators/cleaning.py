"""Cleaning of invoice lines, in two variants.

``*_lib`` keeps missing customers, drops lines without a product or a price
and parses one fixed date format.  The guest variant (``*_nb``) keeps every
line, gives each anonymous line its own guest customer and flags suspicious
amounts and outliers.  They differ on purpose and are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.numeric import flag_count, ratio, round_even
from cartloom.functions.ordering import exact_quantiles, global_rank
from cartloom.functions.scalars import with_row

RAW_DATE_FORMAT = "M/d/yyyy H:mm"
#: Formats tried in turn by the inferring parser.
INFERRED_FORMATS = [RAW_DATE_FORMAT, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy"]
KEY_COLUMNS = ["Description", "Invoice", "StockCode"]
HIGH_PRICE = 1000
CATEGORY_COLUMNS = ["StockCode", "Country", "Invoice", "InvoiceClean"]
CATEGORY_RATIO = 0.5
SCORE_COLUMNS = ["Invoice", "StockCode", "Description", "Price", "Quantity"]
GUEST_FORMAT = "GUEST_%06d"
FENCE = 1.5


# -- variant with dropped lines ----------------------------------------------
def clean_missing(lines: DataFrame) -> DataFrame:
    """Drop lines without product, invoice, quantity or a non-zero price; keep null customers.

    Like every step of this variant it passes over columns that are absent.
    """
    present = [c for c in [*KEY_COLUMNS, "Price", "Quantity"] if c in lines.columns]
    kept = lines.na.drop(subset=present) if present else lines
    return kept.where(F.col("Price") != 0) if "Price" in present else kept


def drop_duplicates(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates()


def parse_dates(lines: DataFrame, fmt: str = RAW_DATE_FORMAT) -> DataFrame:
    """Parse the fixed format (unreadable dates become null) and add the calendar parts."""
    if "InvoiceDate" not in lines.columns:
        return lines
    at = F.col("InvoiceDate")
    return lines.withColumn("InvoiceDate", F.try_to_timestamp(at, F.lit(fmt))).withColumns(
        {
            "Year": F.year(at).cast("smallint"),
            "Month": F.month(at).cast("tinyint"),
            "DayOfWeek": F.weekday(at).cast("tinyint"),
            "Hour": F.hour(at).cast("tinyint"),
        }
    )


def detect_returns(lines: DataFrame) -> DataFrame:
    if "Invoice" not in lines.columns:
        return lines
    return lines.withColumns(
        {
            "IsReturn": F.coalesce(F.col("Invoice").startswith("C"), F.lit(False)),
            "InvoiceClean": F.regexp_replace("Invoice", "^C", ""),
        }
    )


def line_amount(lines: DataFrame) -> Column:
    """Price times quantity with all decimals of the price."""
    kind, amount = lines.schema["Price"].dataType, F.col("Price") * F.col("Quantity")
    # up to 18 digits a decimal is one machine word
    return amount.cast(T.DecimalType(18, kind.scale)) if isinstance(kind, T.DecimalType) and kind.precision <= 18 else amount


def apply_business_rules(lines: DataFrame) -> DataFrame:
    """Drop non-positive customer ids (null stays) and add the line amount."""
    customer = F.col("CustomerID")
    out = lines.where(customer.isNull() | (customer > 0)) if "CustomerID" in lines.columns else lines
    if not {"Price", "Quantity"} <= set(lines.columns):
        return out
    return out.withColumn("TotalAmount", line_amount(out))


def business_rule_notes(lines: DataFrame) -> DataFrame:
    """What the business rules noticed, as one row of counts."""
    customer = F.col("CustomerID")
    return lines.agg(
        flag_count(F.col("IsReturn") & (F.col("Quantity") > 0)).alias("returns_with_positive_quantity"),
        flag_count(F.col("Price") > HIGH_PRICE).alias("expensive_lines"),
        flag_count(customer <= 0).alias("invalid_customers"),
    )


def narrow_types(lines: DataFrame) -> DataFrame:
    wanted = {
        "CustomerID": "bigint",
        "Quantity": "int",
        "Year": "smallint",
        "Month": "tinyint",
        "DayOfWeek": "tinyint",
        "Hour": "tinyint",
        "IsReturn": "boolean",
    }
    present = {c: F.col(c).cast(t) for c, t in wanted.items() if c in lines.columns}
    return lines.withColumns(present) if present else lines


def category_candidates(lines: DataFrame) -> DataFrame:
    """Text columns whose distinct share is low enough to be worth encoding."""
    names = [c for c in CATEGORY_COLUMNS if c in lines.columns]
    stats = lines.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(F.col(c)).alias(c) for c in names]
    )
    share = ratio("distinct_values", "_rows")
    return (
        stats.unpivot("_rows", names, "column_name", "distinct_values")
        .withColumn("distinct_share", round_even(share, 4))
        .withColumn("to_category", F.coalesce(share < CATEGORY_RATIO, F.lit(False)))
        .drop("_rows")
    )


def cleaned_quality_score(lines: DataFrame) -> DataFrame:
    """Score of cleaned lines: completeness 30, uniqueness 20, prices 25, dates 25."""
    copies = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_copies"))
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in SCORE_COLUMNS), F.lit(0))

    def weighted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_copies")).otherwise(0))

    stats = copies.agg(
        F.sum("_copies").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(missing * F.col("_copies")).alias("missing_cells"),
        weighted(F.col("Price") <= 0).alias("bad_prices"),
        weighted(F.col("InvoiceDate").isNull()).alias("bad_dates"),
    )
    rows = F.col("rows")
    score = (
        (F.lit(1.0) - ratio("missing_cells", rows * len(SCORE_COLUMNS))) * 30
        + (F.lit(1.0) - ratio(rows - F.col("distinct_rows"), rows)) * 20
        + (F.lit(1.0) - ratio("bad_prices", rows)) * 25
        + (F.lit(1.0) - ratio("bad_dates", rows)) * 25
    )
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))
    return stats.withColumn("quality_score", round_even(F.coalesce(bounded, F.lit(0.0)), 4))


def clean_dataset_lib(
    lines: DataFrame,
    handle_missing: bool = True,
    remove_duplicates: bool = True,
    parse: bool = True,
    returns: bool = True,
) -> DataFrame:
    """The whole variant as one lazy chain with its four switches."""
    out = lines
    if handle_missing:
        out = out.transform(clean_missing)
    if remove_duplicates:
        out = out.transform(drop_duplicates)
    if parse:
        out = out.transform(parse_dates)
    if returns:
        out = out.transform(detect_returns)
    return out.transform(apply_business_rules).transform(narrow_types)


def cleaning_report(
    lines: DataFrame,
    handle_missing: bool = True,
    remove_duplicates: bool = True,
    parse: bool = True,
    returns: bool = True,
) -> DataFrame:
    """Rows and columns before and after :func:`clean_dataset_lib` with the same switches, and the steps that had something to do.

    One pass over grouped rows.  Steps over absent columns are left out, as in the cleaning.
    """
    copies = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_copies"))
    has = set(lines.columns).__contains__
    always, never = F.lit(True), F.lit(False)
    nulls = {c: F.col(c).isNull() for c in [*KEY_COLUMNS, "Quantity"] if has(c)}
    if has("Price"):
        nulls["Price"] = F.col("Price").isNull() | (F.col("Price") == 0)
    kept = always
    if handle_missing:
        for gap in nulls.values():
            kept = kept & ~gap
    kept = F.coalesce(kept, never)
    valid = F.col("CustomerID").isNull() | (F.col("CustomerID") > 0) if has("CustomerID") else always
    returned = F.coalesce(F.col("Invoice").startswith("C"), never) if has("Invoice") else never
    returned = returned & (F.col("Quantity") > 0) if has("Quantity") else never
    expensive = F.col("Price") > HIGH_PRICE if has("Price") else never
    # copies of a row count once when duplicates go
    weight = F.lit(1) if remove_duplicates else F.col("_copies")

    def rows_where(condition: Column, each: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, each)), F.lit(0))

    stats = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        rows_where(kept & valid, weight).alias("rows_after"),
        *[rows_where(gap, F.col("_copies")).alias(f"null_{c}") for c, gap in nulls.items()],
        rows_where(kept, F.col("_copies") - 1).alias("duplicates"),
        rows_where(kept & returned, weight).alias("odd_returns"),
        rows_where(kept & expensive, weight).alias("expensive"),
        rows_where(kept & ~valid, weight).alias("bad_customers"),
    )
    any_gap = sum((F.col(f"null_{c}") for c in nulls), F.lit(0)) > 0
    # Step tags are fixed values.
    gaps = {
        "Description": "missing_descriptions_removed",
        "Invoice": "missing_invoices_removed",
        "StockCode": "missing_stockcodes_removed",
        "Price": "invalid_prices_removed",
        "Quantity": "missing_quantities_removed",
    }
    tags = []
    if handle_missing:
        tags += [(always, "customer_id_nulls_preserved")] * has("CustomerID")
        tags += [(F.col(f"null_{c}") > 0, tag) for c, tag in gaps.items() if c in nulls]
        tags += [(always if has("CustomerID") else any_gap, "missing_values_handled")]
    tags += [(F.col("duplicates") > 0, "duplicates_removed")] * remove_duplicates
    tags += [(always, "date_parsing"), (always, "temporal_features_created")] * (parse and has("InvoiceDate"))
    tags += [(always, "returns_detected"), (always, "invoice_cleaned"), (F.col("odd_returns") > 0, "return_quantity_inconsistency_noted")] * (returns and has("Invoice"))
    tags += [(F.col("expensive") > 0, "expensive_items_flagged"), (F.col("bad_customers") > 0, "invalid_customer_ids_removed")]
    tags += [(always, "total_amount_calculated")] * (has("Price") and has("Quantity"))
    tags += [(always, "business_rules_validated"), (always, "data_types_optimized")]
    added = 4 * (parse and has("InvoiceDate")) + 2 * (returns and has("Invoice")) + (has("Price") and has("Quantity"))
    steps = F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for cond, tag in tags]))
    return stats.select(
        "rows_before",
        "rows_after",
        F.lit(len(lines.columns)).alias("columns_before"),
        F.lit(len(lines.columns) + added).alias("columns_after"),
        F.array_join(steps, ", ").alias("steps"),
    )


# -- guest variant -------------------------------------------------------------
def infer_types(lines: DataFrame) -> DataFrame:
    """Dates by the first format that fits; customer id as integer text."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.col("InvoiceDate"), F.lit(f)) for f in INFERRED_FORMATS])
    return lines.withColumns(
        {"InvoiceDate": parsed, "CustomerID": F.col("CustomerID").cast("bigint").cast("string")}
    )


def guest_lines(lines: DataFrame) -> DataFrame:
    """Anonymous lines only, each with its own guest id.

    Guests are numbered from 0 in the order of all columns (nulls first).
    The lines move once, into sorted files; a guest's number is the line's
    position in its file and the length of the files before.  Where a line
    was read comes last in the order, so a hot group of equal lines is split like any other range.
    """
    rest = sorted(c for c in lines.columns if c != "CustomerID")
    anonymous = lines.where(F.col("CustomerID").isNull()).drop("CustomerID").withColumn("_read", F.monotonically_increasing_id())
    keys = [*(F.col(c).asc_nulls_first() for c in rest), F.col("_read")]
    numbered = global_rank(anonymous, keys, "_number")
    return numbered.withColumn("CustomerID", F.format_string(GUEST_FORMAT, F.col("_number") - 1)).select(*lines.columns)


def assign_guests(lines: DataFrame) -> DataFrame:
    registered = lines.where(F.col("CustomerID").isNotNull())
    return registered.unionByName(guest_lines(lines))


def business_logic(lines: DataFrame) -> DataFrame:
    amount = line_amount(lines)
    is_return = F.coalesce(F.col("Invoice").startswith("C"), F.lit(False))
    doubtful = (F.col("Price") <= 0) | (F.col("Quantity") == 0) | (F.col("Total_Amount") == 0)
    return lines.withColumns(
        {"Transaction_Type": F.when(is_return, "RETURN").otherwise("SALE"), "Total_Amount": amount}
    ).withColumn("Suspicious", F.coalesce(doubtful, F.lit(False)))


def outlier_fences(lines: DataFrame) -> DataFrame:
    """Upper fences of the positive prices and quantities, one row."""
    positive = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("Price", "Quantity")}
    q = exact_quantiles(lines, positive, [0.25, 0.75])
    return q.select(
        *[
            (F.col(f"{c}_q1") + F.lit(FENCE) * (F.col(f"{c}_q1") - F.col(f"{c}_q0"))).alias(f"{c}_fence")
            for c in positive
        ]
    )


def flag_outliers(lines: DataFrame) -> DataFrame:
    fenced = lines.transform(with_row, outlier_fences(lines))
    for c in ("Price", "Quantity"):
        above = (F.col(c).cast("double") > F.col(f"{c}_fence")) & (F.col(c) > 0)
        fenced = fenced.withColumn(f"{c}_Outlier", F.coalesce(above, F.lit(False)))
    return fenced.drop("Price_fence", "Quantity_fence")


def clean_until_logic(lines: DataFrame) -> DataFrame:
    """Types, guests, duplicates and business logic.

    A guest line is unique by its id, so only registered lines go through
    the duplicate shuffle.
    """
    typed = infer_types(lines)
    registered = typed.where(F.col("CustomerID").isNotNull()).dropDuplicates()
    return business_logic(registered.unionByName(guest_lines(typed)))


def clean_dataset_nb(lines: DataFrame) -> DataFrame:
    return flag_outliers(clean_until_logic(lines))


def cleaning_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    amount, kind = F.col("Total_Amount"), F.col("Transaction_Type")
    guest = F.col("CustomerID").startswith("GUEST_")
    before = raw.agg(F.count(F.lit(1)).alias("original_rows"))
    after = cleaned.agg(
        F.count(F.lit(1)).alias("final_rows"),
        flag_count(guest).alias("guest_customers"),
        F.count_distinct(F.when(~guest, F.col("CustomerID"))).alias("registered_customers"),
        flag_count(kind == "SALE").alias("sales_lines"),
        flag_count(kind == "RETURN").alias("return_lines"),
        F.coalesce(F.sum(F.when(kind == "SALE", amount)), F.lit(0)).cast("double").alias("gross_sales"),
        F.coalesce(F.sum(F.when(kind == "RETURN", amount)), F.lit(0)).cast("double").alias("returns_amount"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("net_revenue"),
        flag_count(F.col("Price_Outlier")).alias("price_outliers"),
        flag_count(F.col("Quantity_Outlier")).alias("quantity_outliers"),
        flag_count(F.col("Suspicious")).alias("suspicious_lines"),
    )
    share = lambda c: round_even(ratio(c, "final_rows") * 100, 4)
    return (
        before.transform(with_row, after)
        .withColumn("rows_removed", F.col("original_rows") - F.col("final_rows"))
        .withColumn("new_columns", F.lit(len(cleaned.columns) - len(raw.columns)))
        .withColumn("price_outlier_pct", share("price_outliers"))
        .withColumn("quantity_outlier_pct", share("quantity_outliers"))
        .withColumn("suspicious_pct", share("suspicious_lines"))
    )


def cleaning_control(cleaned: DataFrame) -> DataFrame:
    """Final control: remaining nulls and duplicates, valid keys, amount identity."""
    copies = cleaned.groupBy(*cleaned.columns).agg(F.count(F.lit(1)).alias("_copies"))

    def lines_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_copies"))), F.lit(0))

    same = F.col("Total_Amount") == F.col("Quantity") * F.col("Price")
    return copies.agg(
        *[lines_where(F.col(c).isNull()).alias(f"null_{c}") for c in ("Invoice", "Description", "InvoiceDate")],
        (F.sum("_copies") - F.count(F.lit(1))).alias("remaining_duplicates"),
        lines_where(F.col("InvoiceDate").isNotNull()).alias("valid_dates"),
        lines_where(F.col("CustomerID").isNotNull()).alias("valid_customers"),
        lines_where(same).alias("amounts_consistent"),
    )
