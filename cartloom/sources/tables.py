"""Parquet tables of cleaned lines, segments and model metadata."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clean(lines: DataFrame, path: str) -> None:
    """Cleaned lines by year and month, so later reads prune to the months they need.

    Rows are gathered per month before the write; the rebalance hint lets
    adaptive execution split a peak month over as many tasks as its size asks
    for and merge the quiet ones.
    """
    parts = lines.withColumns({"year": F.year("InvoiceDate"), "month": F.month("InvoiceDate")})
    parts.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_segments(tagged: DataFrame, path: str) -> None:
    """Target lists as one table with a partition per target."""
    tagged.hint("rebalance", "target").write.mode("overwrite").partitionBy("target").parquet(path)


def read_segments(spark: SparkSession, path: str, targets: list[str], like: DataFrame | None = None) -> DataFrame:
    """The named target lists; a list that was never written is simply empty.

    ``like`` gives the schema to return when the whole table is absent.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if like is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return like.limit(0)
    return table.where(F.col("target").isin(targets))


def save_model(model: PipelineModel, path: str, info: dict) -> None:
    """Model below ``path``/model, its metadata as a one-row table beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    row = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in info.items()}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/info")


class ModelRegistry:
    """Saved models by name, each in a folder of its own with its metadata."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def save(self, name: str, model: PipelineModel, info: dict) -> None:
        save_model(model, f"{self.root}/{name}", info)

    def names(self, spark: SparkSession) -> list[str]:
        try:
            return sorted(r["model_name"] for r in spark.read.parquet(f"{self.root}/*/info").select("model_name").collect())
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def load(self, spark: SparkSession, name: str) -> tuple[PipelineModel, dict]:
        """The model and its metadata; a name that was never saved is a ValueError."""
        known = self.names(spark)
        if name not in known:
            raise ValueError(f"unknown model {name!r}; known: {', '.join(known)}")
        model, info = load_model(spark, f"{self.root}/{name}")
        found = info.first().asDict()
        return model, {**found, "feature_names": json.loads(found["feature_names"])}
