"""Recency, frequency and monetary scoring in both variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import rules
from cartloom.functions.numeric import ratio, whole_days
from cartloom.functions.ordering import bucket_scores
from cartloom.functions.scalars import with_row


def rfm_metrics(orders: DataFrame, reference_date: str | None = None) -> DataFrame:
    """Recency in days, order rows, spend and mean order per customer with positive spend."""
    per = (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("order_date").alias("_last"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("total_amount").cast("double").alias("monetary"),
            ratio(F.sum("total_amount"), F.count("total_amount")).alias("avg_order_value"),
        )
        .where(F.col("monetary") > 0)
    )
    if reference_date is None:
        per = per.transform(with_row, orders.agg(F.max("order_date").alias("_reference")))
    else:
        per = per.withColumn("_reference", F.lit(reference_date).cast("timestamp"))
    return per.select(
        "customer_id",
        whole_days("_reference", "_last").alias("recency"),
        "frequency",
        "monetary",
        "avg_order_value",
    )


def rfm_scores(customers: DataFrame, key: str = "customer_id", columns: tuple[str, str, str] = ("recency", "frequency", "monetary"), buckets: int = 5) -> DataFrame:
    """Quintile scores; recent customers score high, so recency is reversed."""
    recency, frequency, monetary = columns
    scored = bucket_scores(customers, key, {"R_score": recency, "F_score": frequency, "M_score": monetary}, buckets)
    scored = scored.withColumn("R_score", F.lit(buckets + 1) - F.col("R_score"))
    return scored.withColumn("rfm_score", F.col("R_score") + F.col("F_score") + F.col("M_score"))


def rfm_code() -> Column:
    return F.concat(*[F.col(c).cast("string") for c in ("R_score", "F_score", "M_score")])


def band(score: Column, bands: list[tuple[int, str]], rest: str) -> Column:
    out = F.lit(rest)
    for limit, name in reversed(bands):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def segment_lib(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rfm_segment", band(F.col("rfm_score"), rules.RFM_BANDS_LIB, rules.RFM_REST_LIB))


def segment_nb(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rfm_segment", band(F.col("rfm_score"), rules.RFM_BANDS_NB, rules.RFM_REST_NB))


def rfm_segmentation_nb(features: DataFrame) -> DataFrame:
    """Scores, code and six-band segment of customers with positive spend."""
    base = features.dropna(subset=["recency", "frequency", "monetary"]).where(F.col("monetary") > 0)
    return segment_nb(rfm_scores(base)).withColumn("rfm_code", rfm_code())
