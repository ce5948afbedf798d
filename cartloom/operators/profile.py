"""Profile of raw invoice lines.

Duplicate figures come from one grouping of equal rows, whose copies are
counted before the shuffle; column figures come from one grouping of
(column, value) pairs.  No figure needs a row-by-row comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from cartloom.functions.numeric import dbl, flag_count, pct, ratio, round_even, whole_days
from cartloom.functions.ordering import exact_quantiles, expand_copies
from cartloom.functions.scalars import with_row
from cartloom.functions.staging import stage
from cartloom.operators.cleaning import RAW_DATE_FORMAT
from cartloom.operators.sales import histogram

WHISKER = 1.5
COPIES = "_copies"


def equal_rows(lines: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies (nulls compare equal)."""
    return lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias(COPIES))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def shape(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(lines.columns)))


def ends(lines: DataFrame, n: int = 5) -> DataFrame:
    """First and last rows in the order of all columns."""
    up = [F.col(c).asc_nulls_first() for c in lines.columns]
    down = [F.col(c).desc_nulls_last() for c in lines.columns]
    head = lines.orderBy(*up).limit(n).withColumn("part", F.lit("head"))
    return head.unionByName(lines.orderBy(*down).limit(n).withColumn("part", F.lit("tail")))


def value_pairs(lines: DataFrame) -> DataFrame:
    """(column, value, copies) of every column, nulls included, staged.

    Each column is counted in its own type by a scan that reads nothing else;
    rows are not multiplied by the number of columns.
    """
    counted = [
        lines.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias(COPIES)).select(F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), COPIES)
        for c in lines.columns
    ]
    return stage(reduce(DataFrame.unionByName, counted), "values")


def column_profile(lines: DataFrame, examples: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """Per column: type, nulls, distinct values, extremes of numbers, examples of texts.

    ``pairs`` are the value counts of ``lines``, where they exist already.
    """
    numeric = [f.name for f in lines.schema.fields if is_numeric(f)]
    pairs = value_pairs(lines) if pairs is None else pairs
    number = F.when(F.col("column_name").isin(numeric), F.col("value").cast("double"))
    stats = pairs.groupBy("column_name").agg(
        F.sum(COPIES).alias("_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col(COPIES)).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    )
    # The rank filter is applied inside each task first, so a column sends on a few rows per task.
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    sample = (
        pairs.where(F.col("value").isNotNull() & ~F.col("column_name").isin(numeric))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= examples)
        .groupBy("column_name")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples"))
    )
    kinds = F.create_map(*[x for f in lines.schema.fields for x in (F.lit(f.name), F.lit("number" if is_numeric(f) else "text"))])
    return stats.join(F.broadcast(sample), "column_name", "left").select(
        "column_name",
        kinds[F.col("column_name")].alias("kind"),
        "nulls",
        pct("nulls", "_rows").alias("null_pct"),
        "distinct_values",
        "min_value",
        "max_value",
        "examples",
    )


def missing_values(lines: DataFrame) -> DataFrame:
    stats = lines.agg(F.count(F.lit(1)).alias("_rows"), *[flag_count(F.col(c).isNull()).alias(c) for c in lines.columns])
    return stats.unpivot("_rows", lines.columns, "column_name", "nulls").select(
        "column_name", "nulls", pct("nulls", "_rows").alias("null_pct")
    )


def column_types(lines: DataFrame) -> DataFrame:
    """Kind of each column, its filled cells, and how many columns share the kind."""
    kinds = {f.name: "number" if is_numeric(f) else "text" for f in lines.schema.fields}
    filled = lines.agg(*[F.count(c).alias(c) for c in lines.columns])
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    shared = F.create_map(
        *[x for v in sorted(set(kinds.values())) for x in (F.lit(v), F.lit(list(kinds.values()).count(v)))]
    )
    return (
        filled.unpivot([], lines.columns, "column_name", "filled")
        .withColumn("kind", kind[F.col("column_name")])
        .withColumn("columns_of_kind", shared[F.col("kind")])
    )


def exact_duplicates(lines: DataFrame) -> DataFrame:
    return (
        equal_rows(lines)
        .agg(F.sum(COPIES).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
        .withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))
        .withColumn("duplicate_pct", pct("duplicates", "rows"))
    )


def key_duplicates(lines: DataFrame) -> DataFrame:
    """Repeated invoices and repeated (invoice, product) pairs, from one grouping."""
    pairs = lines.groupBy("Invoice", "StockCode").agg(F.count(F.lit(1)).alias(COPIES))
    invoices = pairs.groupBy("Invoice").agg(
        F.sum(COPIES).alias(COPIES), F.sum(F.col(COPIES) - 1).alias("_pair_repeats")
    )
    return invoices.agg(
        F.sum(F.col(COPIES) - 1).alias("invoice_repeats"), F.sum("_pair_repeats").alias("pair_repeats")
    )


def duplicate_rows(lines: DataFrame) -> DataFrame:
    """Every copy of every repeated row."""
    repeated = equal_rows(lines).where(F.col(COPIES) > 1)
    return expand_copies(repeated, COPIES, "_nth").drop("_nth")


def numeric_summary(lines: DataFrame, columns: tuple[str, ...] = ("Quantity", "Price")) -> DataFrame:
    cells = lambda f: {c: f(c) for c in columns}
    medians = exact_quantiles(lines, cells(F.col), [0.5])
    sums = lines.agg(
        *[e.alias(f"{c}_{n}") for c in columns for n, e in (
            ("min", F.min(dbl(c))), ("max", F.max(dbl(c))), ("mean", ratio(F.sum(c), F.count(c))),
        )]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}_min").alias("min_value"),
            F.col(f"{c}_max").alias("max_value"),
            round_even(f"{c}_q0", 4).alias("median_value"),
            round_even(f"{c}_mean", 4).alias("mean_value"),
        )
        for c in columns
    ]
    return sums.transform(with_row, medians).select(F.inline(F.array(*rows)))


def sign_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("rows"),
        flag_count(F.col("Quantity") < 0).alias("negative_quantities"),
        flag_count(F.col("Price") < 0).alias("negative_prices"),
        flag_count(F.col("Price") == 0).alias("zero_prices"),
    )


def box_stats(lines: DataFrame, columns: tuple[str, ...] = ("Quantity", "Price")) -> DataFrame:
    """Quartiles, whisker ends and outlier count of each column."""
    cells = {c: F.col(c) for c in columns}
    q = exact_quantiles(lines, cells, [0.25, 0.5, 0.75])
    pairs = [F.struct(F.lit(c).alias("column_name"), dbl(c).alias("v"), *[F.col(f"{c}_q{i}").alias(f"q{i}") for i in range(3)]) for c in columns]
    spread = lines.transform(with_row, q).select(F.inline(F.array(*pairs)))
    low = F.col("q0") - F.lit(WHISKER) * (F.col("q2") - F.col("q0"))
    high = F.col("q2") + F.lit(WHISKER) * (F.col("q2") - F.col("q0"))
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    return spread.groupBy("column_name", "q0", "q1", "q2").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    ).select(
        "column_name",
        round_even("q0", 4).alias("q1"),
        round_even("q1", 4).alias("median_value"),
        round_even("q2", 4).alias("q3"),
        "whisker_low",
        "whisker_high",
        "outliers",
    )


def _cancelled() -> Column:
    return F.coalesce(F.col("Invoice").startswith("C"), F.lit(False))


def returns_coherence(lines: DataFrame) -> DataFrame:
    negative = F.col("Quantity") < 0
    return lines.agg(
        flag_count(negative).alias("negative_quantity_lines"),
        flag_count(_cancelled()).alias("cancelled_lines"),
        flag_count(_cancelled() & negative).alias("cancelled_and_negative"),
    )


def special_codes(lines: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent product codes made of letters only."""
    return (
        lines.where(F.col("StockCode").rlike("^[A-Z]+$"))
        .groupBy("StockCode")
        .agg(F.count(F.lit(1)).alias("lines"))
        .orderBy(F.desc("lines"), "StockCode")
        .limit(n)
    )


def sign_quadrants(lines: DataFrame) -> DataFrame:
    price, quantity = F.col("Price"), F.col("Quantity")
    return lines.agg(
        flag_count((price > 0) & (quantity > 0)).alias("both_positive"),
        flag_count((price < 0) & (quantity < 0)).alias("both_negative"),
    )


def cardinality(lines: DataFrame, approximate: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Distinct values per column, exact by default."""
    if approximate:
        stats = lines.agg(
            F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(c).alias(c) for c in lines.columns]
        ).unpivot("_rows", lines.columns, "column_name", "distinct_values")
    else:
        stats = (value_pairs(lines) if pairs is None else pairs).groupBy("column_name").agg(
            F.sum(COPIES).alias("_rows"), F.count("value").alias("distinct_values")
        )
    return stats.select("column_name", "distinct_values", pct("distinct_values", "_rows").alias("distinct_pct"))


def top_countries(lines: DataFrame, n: int = 10) -> DataFrame:
    return (
        lines.where(F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(F.count(F.lit(1)).alias("lines"))
        .orderBy(F.desc("lines"), "Country")
        .limit(n)
    )


def entity_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count_distinct("CustomerID").alias("customers"),
        F.count_distinct("StockCode").alias("products"),
        F.count_distinct("Invoice").alias("invoices"),
        F.count_distinct("Country").alias("countries"),
    )


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select(F.try_to_timestamp(F.col("InvoiceDate"), F.lit(RAW_DATE_FORMAT)).alias("at"))


def time_range(lines: DataFrame) -> DataFrame:
    return (
        _parsed(lines)
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .withColumn("span_days", whole_days("last", "first"))
    )


def monthly_rows(lines: DataFrame) -> DataFrame:
    return (
        _parsed(lines)
        .where(F.col("at").isNotNull())
        .groupBy(F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .orderBy("month")
    )


def bounded_histogram(lines: DataFrame, column: str, low: float = 0, high: float = 100, bins: int = 50) -> DataFrame:
    """Histogram of the values strictly between two limits."""
    kept = lines.where((dbl(column) > low) & (dbl(column) < high))
    return histogram(kept, F.col(column), bins).select(F.lit(column).alias("column_name"), "bin", "bin_from", "rows")


def issue_snapshot(lines: DataFrame) -> DataFrame:
    """Counts of the known faults before cleaning; two columns have a wrong type."""
    def where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(COPIES)).otherwise(0))

    return (
        equal_rows(lines)
        .agg(
            F.sum(COPIES).alias("rows"),
            where(F.col("CustomerID").isNull()).alias("missing_customer_id"),
            where(F.col("Description").isNull()).alias("missing_description"),
            (F.sum(COPIES) - F.count(F.lit(1))).alias("total_duplicates"),
            where(F.col("Quantity") < 0).alias("negative_quantities"),
            where(F.col("Price") == 0).alias("zero_prices"),
            where(F.col("Price") < 0).alias("negative_prices"),
        )
        .withColumn("wrong_dtypes", F.lit(2))
    )


ISSUES = [
    "missing_customer_id", "missing_description", "total_duplicates", "negative_quantities", "zero_prices",
    "negative_prices",
]


def issue_total(snapshot: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in (*ISSUES, "wrong_dtypes")), F.lit(0))
    return snapshot.withColumn("total_issues", total)


def clean_rate(snapshot: DataFrame) -> DataFrame:
    """Share of rows that would remain if every fault hit a row of its own."""
    issues = sum((F.col(c) for c in ISSUES), F.lit(0))
    return snapshot.select(
        "rows", issues.alias("issues"), pct(F.col("rows") - issues, "rows").alias("clean_rate_pct")
    )


def transaction_types(cleaned: DataFrame) -> DataFrame:
    amount = F.col("Total_Amount")
    return cleaned.groupBy("Transaction_Type").agg(
        F.count(F.lit(1)).alias("lines"),
        flag_count(F.col("InvoiceDate").isNull()).alias("null_dates"),
        flag_count(amount.isNull()).alias("null_amounts"),
        F.min(amount).cast("double").alias("min_amount"),
        F.max(amount).cast("double").alias("max_amount"),
        round_even(ratio(F.sum(amount), F.count(amount)), 4).alias("mean_amount"),
    )
