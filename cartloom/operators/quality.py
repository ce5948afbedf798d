"""Validation rules, quality score and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.numeric import ratio, round_even
from cartloom.operators.profile import COPIES, equal_rows

REQUIRED_COLUMNS = ["customer_id", "order_date", "total_amount"]
DATE_WORDS = ["date", "time", "created", "updated"]
SAMPLE_VALUES = 100
NUMERIC_SHARE = 0.8
MIN_SCORE = 60
RULE_COLUMNS = ["rule", "level", "value", "threshold", "passed"]


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def schema_rules(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per problem-prone column: required but absent, or present and entirely null."""
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    absent = [c for c in required if c not in df.columns]
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit("missing_required_column").alias("rule"), F.lit("error").alias("level"), F.lit(False).alias("passed"))
        for c in absent
    ] + [
        F.struct(F.lit(c).alias("column_name"), F.lit("empty_column").alias("rule"), F.lit("warning").alias("level"), (F.col(c) > 0).alias("passed"))
        for c in df.columns
    ]
    return filled.select(F.inline(F.array(*cells)))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Row, cell, duplicate and emptiness figures from one grouping of equal rows."""
    holes = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    stats = equal_rows(df).agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        F.coalesce(F.sum(holes * F.col(COPIES)), F.lit(0)).alias("missing_values_count"),
        F.coalesce(F.sum(F.when(holes == len(df.columns), F.col(COPIES))), F.lit(0)).alias("empty_rows"),
        *[F.count(c).alias(f"_filled_{i}") for i, c in enumerate(df.columns)],
    )
    n = F.col("total_rows")
    empty = sum((F.when(F.col(f"_filled_{i}") == 0, 1).otherwise(0) for i in range(len(df.columns))), F.lit(0))
    width = len(df.columns)
    return stats.select(
        "total_rows",
        F.lit(width).alias("total_columns"),
        "missing_values_count",
        (ratio("missing_values_count", n * width) * 100).alias("missing_values_pct"),
        (n - F.col("_distinct")).alias("duplicate_rows"),
        (ratio(n - F.col("_distinct"), n) * 100).alias("duplicate_rows_pct"),
        "empty_rows",
        (ratio("empty_rows", n) * 100).alias("empty_rows_pct"),
        empty.alias("empty_columns"),
        (ratio("_distinct", n) * 100).alias("unique_rows_pct"),
    )


def score_of(metrics: DataFrame) -> Column:
    score = (
        F.lit(100.0)
        - F.col("missing_values_pct") * 1.5
        - F.col("duplicate_rows_pct")
        - ratio("empty_columns", "total_columns") * 20
        + F.when(F.col("total_rows") >= 1000, 10.0).otherwise(0.0)
        + F.when(F.col("total_columns") >= 5, 5.0).otherwise(0.0)
    )
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), F.lit(0.0))


def quality_score(metrics: DataFrame) -> DataFrame:
    return metrics.select("total_rows", round_even(score_of(metrics), 4).alias("quality_score"))


def recommendations(metrics: DataFrame, megabytes: float | None = None) -> DataFrame:
    """Advice that the metrics call for, one row each."""
    size = F.lit(megabytes if megabytes is not None else 0.0)
    # Advice texts.
    advice = [
        (F.col("missing_values_pct") > 10, "Considérer imputation des valeurs manquantes"),
        (F.col("duplicate_rows_pct") > 5, "Supprimer les doublons identifiés"),
        (F.col("empty_columns") > 0, "Supprimer les colonnes entièrement vides"),
        (size > 100, "Optimiser les types de données pour réduire la mémoire"),
    ]
    given = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in advice]))
    return metrics.select(F.explode(given).alias("recommendation"))


def _rule(rule: str, level: str, value: Column, threshold: float, failed: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(level).alias("level"),
        round_even(value, 4).alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        (~F.coalesce(failed, F.lit(False))).alias("passed"),
    )


def integrity_rules(metrics: DataFrame, kinds: tuple[str, ...] = ("rows", "empty", "missing", "duplicates")) -> DataFrame:
    rows, empty = F.col("total_rows"), F.col("empty_rows_pct")
    missing, duplicate = F.col("missing_values_pct"), F.col("duplicate_rows_pct")
    all_rules = {
        "rows": [_rule("dataset_not_empty", "error", rows, 1, rows < 1)],
        "empty": [_rule("empty_rows_pct", "warning", empty, 10, empty > 10)],
        "missing": [
            _rule("missing_pct_critical", "error", missing, 50, missing > 50),
            _rule("missing_pct_high", "warning", missing, 20, (missing > 20) & (missing <= 50)),
        ],
        "duplicates": [_rule("duplicate_pct", "warning", duplicate, 20, duplicate > 20)],
    }
    chosen = [r for k in kinds for r in all_rules[k]]
    return metrics.select(F.inline(F.array(*chosen)))


def numeric_text_columns(df: DataFrame, sample: int = SAMPLE_VALUES) -> DataFrame:
    """Text columns whose first values, in the order of all columns, are mostly digits.

    One top-``sample`` search a column: each task keeps a heap of that many
    rows while it scans, and nothing is sorted or moved as a whole.
    """
    order = [F.col(c).asc_nulls_first() for c in df.columns]
    first = [
        df.where(F.col(c).isNotNull()).orderBy(*order).limit(sample).select(F.lit(c).alias("column_name"), F.col(c).alias("value"))
        for c in _text_columns(df)
    ]
    if not first:
        first = [df.limit(0).select(F.lit("").alias("column_name"), F.lit("").alias("value"))]
    digits = F.translate("value", ".,-", "").rlike("^[0-9]+$")
    return (
        reduce(DataFrame.unionByName, first).groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("sampled"), F.count(F.when(digits, 1)).alias("numeric_values"))
        .withColumn("numeric_share", round_even(ratio("numeric_values", "sampled"), 4))
        .withColumn("looks_numeric", ratio("numeric_values", "sampled") > NUMERIC_SHARE)
    )


def date_like_columns(df: DataFrame) -> DataFrame:
    """Text columns whose name speaks of a date, with their filled cells."""
    names = [c for c in _text_columns(df) if any(w in c.lower() for w in DATE_WORDS)]
    filled = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in names])
    if not names:
        return filled.select(F.lit(None).cast("string").alias("column_name"), "rows", F.lit(0).alias("filled")).limit(0)
    return filled.unpivot("rows", names, "column_name", "filled")


def validate_dataset(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """All rules as rows, closed by the score and the verdict."""
    metrics = quality_metrics(df)
    absent = [c for c in required if c not in df.columns]
    score = score_of(metrics)
    missing = F.lit(len(absent))
    errors = (missing > 0) | (F.col("total_rows") < 1) | (F.coalesce(F.col("missing_values_pct"), F.lit(0.0)) > 50)
    more = metrics.select(
        F.inline(
            F.array(
                _rule("required_columns", "error", missing, 0, missing > 0),
                _rule("empty_columns", "warning", F.col("empty_columns"), 0, F.col("empty_columns") > 0),
                _rule("quality_score", "error", score, MIN_SCORE, score < MIN_SCORE),
                _rule("is_valid", "verdict", score, MIN_SCORE, errors | (score < MIN_SCORE)),
            )
        )
    )
    return integrity_rules(metrics).unionByName(more)


def quick_check(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> bool:
    row = validate_dataset(df, required).where(F.col("rule") == "is_valid").first()
    return bool(row["passed"])


def validate_model_input(df: DataFrame, required: list[str]) -> DataFrame:
    """Model input rules: rows, required columns, mostly-null columns, duplicates."""
    filled = equal_rows(df).agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(COPIES))), F.lit(0)).alias(f"_null_{i}") for i, c in enumerate(df.columns)],
    )
    n = F.col("total_rows")
    worst = F.greatest(F.lit(0.0), *[F.coalesce(ratio(f"_null_{i}", n), F.lit(0.0)) for i in range(len(df.columns))])
    repeats = n - F.col("_distinct")
    absent = F.lit(len([c for c in required if c not in df.columns]))
    return filled.select(
        F.inline(
            F.array(
                _rule("dataset_not_empty", "error", n, 1, n < 1),
                _rule("required_columns", "error", absent, 0, absent > 0),
                _rule("null_share", "warning", worst, 0.8, worst > 0.8),
                _rule("duplicate_rows", "warning", repeats, 0, repeats > 0),
            )
        )
    )


def quality_alerts(rules: DataFrame) -> DataFrame:
    """Failed rules as alert records."""
    return rules.where(~F.col("passed") & (F.col("level") != "verdict")).select(
        F.lit("DATA_QUALITY").alias("alert_type"),
        F.lit("ERROR").alias("alert_level"),
        F.col("rule").alias("metric"),
        "threshold",
        F.col("value").alias("current_value"),
    )


def model_alerts(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Model metrics (model, metric, value) that fall below their threshold."""
    limits = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    return (
        metrics.withColumn("threshold", limits[F.col("metric")])
        .where(F.col("value") < F.col("threshold"))
        .select(
            F.lit("MODEL_PERFORMANCE").alias("alert_type"),
            F.lit("WARNING").alias("alert_level"),
            "model",
            "metric",
            "threshold",
            F.col("value").alias("current_value"),
        )
    )
