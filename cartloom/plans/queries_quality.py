"""Validation queries."""

from pyspark.sql import functions as F

from cartloom.operators import quality
from cartloom.operators.churn import MODEL_FEATURES
from cartloom.plans.catalog import query
from cartloom.sources.fixtures import INVOICE_COLUMNS

_NULLS = "+".join(f'("{c}" IS NULL)::INTEGER' for c in INVOICE_COLUMNS)
_METRICS = f"""SELECT *, missing_values_count::DOUBLE/(total_rows*8)*100 AS missing_values_pct, duplicate_rows::DOUBLE/total_rows*100 AS duplicate_rows_pct,
 empty_rows::DOUBLE/total_rows*100 AS empty_rows_pct, (total_rows-duplicate_rows)::DOUBLE/total_rows*100 AS unique_rows_pct FROM (
SELECT sum(copies)::BIGINT AS total_rows, 8 AS total_columns, sum(({_NULLS})*copies)::BIGINT AS missing_values_count, (sum(copies)-count(*))::BIGINT AS duplicate_rows,
 coalesce(sum(copies) FILTER (({_NULLS})=8),0)::BIGINT AS empty_rows, ({" + ".join(f'(count("{c}")=0)::INTEGER' for c in INVOICE_COLUMNS)}) AS empty_columns FROM raw_counted)"""
_SCORE = """greatest(0.0,least(100.0,100.0::DOUBLE-missing_values_pct*1.5-duplicate_rows_pct-empty_columns::DOUBLE/total_columns*20
 +CASE WHEN total_rows>=1000 THEN 10 ELSE 0 END+CASE WHEN total_columns>=5 THEN 5 ELSE 0 END))"""


def _rounded(df, digits=4):
    from cartloom.functions.numeric import round_even

    return df.withColumns({c: round_even(c, digits) for c in df.columns if c.endswith("_pct")})


@query(
    "validate_schema",
    """SELECT unnest(['customer_id','order_date','total_amount']) AS column_name, 'missing_required_column' AS rule, 'error' AS level, false AS passed UNION ALL """
    + " UNION ALL ".join(f"""SELECT '{c}', 'empty_column', 'warning', count("{c}")>0 FROM raw""" for c in INVOICE_COLUMNS),
)
def validate_schema(m):
    return quality.schema_rules(m.raw)


@query("validate_empty_rows", f"""SELECT 'empty_rows_pct' AS rule, 'warning' AS level, round_even(empty_rows_pct,4) AS value, 10.0::DOUBLE AS threshold, NOT empty_rows_pct>10 AS passed FROM ({_METRICS})""")
def validate_empty_rows(m):
    return quality.integrity_rules(quality.quality_metrics(m.raw), ("empty",))


_MISSING = f"""SELECT 'missing_pct_critical' AS rule, 'error' AS level, round_even(missing_values_pct,4) AS value, 50.0::DOUBLE AS threshold, NOT missing_values_pct>50 AS passed FROM ({_METRICS})
UNION ALL SELECT 'missing_pct_high', 'warning', round_even(missing_values_pct,4), 20.0::DOUBLE, NOT (missing_values_pct>20 AND missing_values_pct<=50) FROM ({_METRICS})"""


@query("validate_missing_rate", _MISSING)
def validate_missing_rate(m):
    return quality.integrity_rules(quality.quality_metrics(m.raw), ("missing",))


@query("validate_duplicates", f"""SELECT 'duplicate_pct' AS rule, 'warning' AS level, round_even(duplicate_rows_pct,4) AS value, 20.0::DOUBLE AS threshold, NOT duplicate_rows_pct>20 AS passed FROM ({_METRICS})""")
def validate_duplicates(m):
    return quality.integrity_rules(quality.quality_metrics(m.raw), ("duplicates",))


_ORDER = ",".join(f'"{c}" NULLS FIRST' for c in INVOICE_COLUMNS)
_NUMERIC = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, v FROM (SELECT "{c}" AS v FROM raw WHERE "{c}" IS NOT NULL ORDER BY {_ORDER} LIMIT 100)"""
    for c in ("Invoice", "StockCode", "Description", "InvoiceDate", "Country")
)


@query(
    "validate_numeric_text",
    f"""SELECT column_name, count(*) AS sampled, count(*) FILTER (d) AS numeric_values, round_even(count(*) FILTER (d)::DOUBLE/count(*),4) AS numeric_share,
 count(*) FILTER (d)::DOUBLE/count(*)>0.8 AS looks_numeric FROM (SELECT column_name, regexp_matches(translate(v,'.,-',''),'^[0-9]+$') AS d FROM ({_NUMERIC})) GROUP BY 1""",
)
def validate_numeric_text(m):
    return quality.numeric_text_columns(m.raw)


@query("validate_date_like_names", """SELECT 'InvoiceDate' AS column_name, count(*) AS rows, count("InvoiceDate") AS filled FROM raw""")
def validate_date_like_names(m):
    return quality.date_like_columns(m.raw)


@query(
    "quality_metrics",
    f"""SELECT total_rows,total_columns,missing_values_count,round_even(missing_values_pct,4) AS missing_values_pct,duplicate_rows,round_even(duplicate_rows_pct,4) AS duplicate_rows_pct,
 empty_rows,round_even(empty_rows_pct,4) AS empty_rows_pct,empty_columns,round_even(unique_rows_pct,4) AS unique_rows_pct FROM ({_METRICS})""",
)
def quality_metrics(m):
    return _rounded(quality.quality_metrics(m.raw))


@query("quality_score_validator", f"""SELECT total_rows, round_even({_SCORE},4) AS quality_score FROM ({_METRICS})""")
def quality_score_validator(m):
    return quality.quality_score(quality.quality_metrics(m.raw))


@query(
    "quality_recommendations",
    f"""SELECT t AS recommendation FROM ({_METRICS}), (VALUES (1,'Considérer imputation des valeurs manquantes'),(2,'Supprimer les doublons identifiés'),(3,'Supprimer les colonnes entièrement vides')) v(k,t)
 WHERE (k=1 AND missing_values_pct>10) OR (k=2 AND duplicate_rows_pct>5) OR (k=3 AND empty_columns>0)""",
)
def quality_recommendations(m):
    """Advice for the raw lines with all their columns; none where no limit is passed."""
    return quality.recommendations(quality.quality_metrics(m.raw))


def _orders_rules() -> str:
    return """WITH c AS (SELECT *, count(*) AS n FROM orders_view GROUP BY ALL),
 k AS (SELECT sum(n)::BIGINT AS total_rows, (sum(n)-count(*))::DOUBLE/sum(n)*100 AS dup,
  sum(n*((customer_id IS NULL)::INTEGER+(order_date IS NULL)::INTEGER+(total_amount IS NULL)::INTEGER))::DOUBLE/(sum(n)*3)*100 AS missing FROM c),
 s AS (SELECT *, greatest(0,least(100,100-missing*1.5-dup+CASE WHEN total_rows>=1000 THEN 10 ELSE 0 END)) AS score FROM k)
SELECT 'dataset_not_empty' AS rule,'error' AS level,total_rows::DOUBLE AS value,1.0::DOUBLE AS threshold,total_rows>=1 AS passed FROM s
UNION ALL SELECT 'empty_rows_pct','warning',0,10,true FROM s
UNION ALL SELECT 'missing_pct_critical','error',round_even(missing,4),50,missing<=50 FROM s
UNION ALL SELECT 'missing_pct_high','warning',round_even(missing,4),20,NOT (missing>20 AND missing<=50) FROM s
UNION ALL SELECT 'duplicate_pct','warning',round_even(dup,4),20,dup<=20 FROM s
UNION ALL SELECT 'required_columns','error',0,0,true FROM s
UNION ALL SELECT 'empty_columns','warning',0,0,true FROM s
UNION ALL SELECT 'quality_score','error',round_even(score,4),60,score>=60 FROM s
UNION ALL SELECT 'is_valid','verdict',round_even(score,4),60,score>=60 AND total_rows>=1 AND missing<=50 FROM s"""


@query("validate_dataset", _orders_rules())
def validate_dataset(m):
    return quality.validate_dataset(m.orders)


def _input_rules(source: str, columns: list[str]) -> str:
    """The rules over all columns of a view that lacks none of the required ones."""
    worst = "greatest(" + ",".join(f'1-count("{c}")::DOUBLE/count(*)' for c in columns) + ")"
    return f"""SELECT r.* FROM (SELECT count(*)::DOUBLE AS n, round_even({worst},4) AS worst, (count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))::DOUBLE AS repeats FROM {source}) s,
 LATERAL (VALUES ('dataset_not_empty','error',n,1.0::DOUBLE,n>=1),('required_columns','error',0,0,true),('null_share','warning',worst,0.8,worst<=0.8),('duplicate_rows','warning',repeats,0,repeats=0)) r(rule,level,value,threshold,passed)"""


_LABEL_COLUMNS = [
    "customer_id", "first_order_date", "last_order_date", "total_orders", "total_spent", "avg_order_value", "spending_std", "recent_spent", "recent_aov", "recent_orders",
    "recency_days", "customer_lifetime_days", "spending_trend", "order_frequency_trend", "spending_volatility", "engagement_score", "avg_days_between_orders", "is_one_time_customer", "is_churned",
]


@query("validate_model_input", _input_rules("churn_labels", _LABEL_COLUMNS))
def validate_model_input(m):
    """The whole table the churn models are fitted on, with every name they need."""
    return quality.validate_model_input(m.churn_labels, ["customer_id", *MODEL_FEATURES, "is_churned"])


@query(
    "alerts_quality",
    f"""SELECT 'DATA_QUALITY' AS alert_type,'ERROR' AS alert_level, rule AS metric, threshold, value AS current_value FROM ({_input_rules("raw", INVOICE_COLUMNS)}) WHERE NOT passed""",
)
def alerts_quality(m):
    """Alerts of the raw lines with all their columns."""
    return quality.quality_alerts(quality.validate_model_input(m.raw, INVOICE_COLUMNS))


@query(
    "alerts_model",
    """SELECT 'MODEL_PERFORMANCE' AS alert_type,'WARNING' AS alert_level,'recency_score' AS model, metric, 0.95::DOUBLE AS threshold, value AS current_value FROM (
 SELECT 'accuracy' AS metric, round_even(count(*) FILTER (label=prediction)::DOUBLE/count(*),4) AS value FROM score_view) WHERE value<0.95""",
)
def alerts_model(m):
    from cartloom.operators import churn, modelling

    scored = churn.recency_score(m.churn_labels).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    metrics = modelling.classification_report(scored).where(F.col("class") == "accuracy").select(
        F.lit("recency_score").alias("model"), F.lit("accuracy").alias("metric"), F.col("precision").alias("value")
    )
    return quality.model_alerts(metrics, {"accuracy": 0.95})
