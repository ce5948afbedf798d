"""Shared tables of one data folder, each built once per session.

The chain is raw lines -> cleaned lines -> invoice facts -> customer tables.
Tables that several reports read are staged in the shared folder the first
time they are asked for; everything else stays a lazy plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.scalars import with_row
from cartloom.functions.staging import new_path, stage
from cartloom.operators import anomalies, campaigns, churn, cleaning, customers, modelling, profile, rfm, sales
from cartloom.operators.isolation import isolation_forest
from cartloom.session import bound_scans, pin_time_zone
from cartloom.sources import files, fixtures, tables


class Mart:
    MODELS = ("logistic", "random_forest", "gradient_boosting")

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_time_zone(spark)
        bound_scans(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self._trained: dict[str, modelling.TrainedModel] = {}
        self._saved: set[str] = set()
        self._csv: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    # -- invoice lines -----------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        """Landed export: eight raw columns."""
        return stage(fixtures.invoice_lines_raw(self.spark, self.sf_dir), "raw")

    @cached_property
    def raw_values(self) -> DataFrame:
        """How often each column of the raw lines has each value."""
        return profile.value_pairs(self.raw)

    @cached_property
    def cleaned_lib(self) -> DataFrame:
        return cleaning.clean_dataset_lib(self.raw)

    @cached_property
    def cleaned(self) -> DataFrame:
        """Cleaned lines, guest variant, with outlier flags."""
        settled = stage(cleaning.clean_until_logic(self.raw), "settled")
        return cleaning.flag_outliers(settled)

    @cached_property
    def sales_lines(self) -> DataFrame:
        return self.cleaned.where(F.col("Transaction_Type") == "SALE")

    @cached_property
    def facts(self) -> DataFrame:
        """Lines rolled up to (invoice, customer, date, country, type)."""
        return stage(sales.invoice_facts(self.cleaned), "facts")

    @cached_property
    def sales_facts(self) -> DataFrame:
        return self.facts.where(F.col("Transaction_Type") == "SALE")

    @cached_property
    def customer_anomalies(self) -> DataFrame:
        """Isolation-forest label and score of every customer."""
        columns = anomalies.FOREST_FEATURES
        features = anomalies.customer_anomaly_features(self.cleaned).fillna(0, subset=columns)
        return isolation_forest(modelling.standardized(features, columns), "CustomerID", columns)

    @cached_property
    def anomaly_summary(self) -> DataFrame:
        return stage(anomalies.anomaly_summary(self.cleaned, self.facts, self.customer_anomalies), "anomaly-summary")

    # -- orders --------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        return fixtures.orders_view(self.spark, self.sf_dir)

    @cached_property
    def order_lines(self) -> DataFrame:
        return fixtures.orders_lines_view(self.spark, self.sf_dir)

    @cached_property
    def rfm_base(self) -> DataFrame:
        return stage(rfm.rfm_metrics(self.orders), "rfm")

    @cached_property
    def rfm_lib(self) -> DataFrame:
        return stage(rfm.segment_lib(rfm.rfm_scores(self.rfm_base)), "rfm-scored")

    @cached_property
    def features_lib(self) -> DataFrame:
        return stage(customers.customer_features(self.order_lines), "features")

    @cached_property
    def clv(self) -> DataFrame:
        return customers.lifetime_value(self.features_lib)

    @cached_property
    def segmented(self) -> DataFrame:
        """RFM bands joined to customer features and lifetime value."""
        return customers.segmented_customers(self.rfm_lib, self.clv)

    @cached_property
    def features_nb(self) -> DataFrame:
        return stage(customers.behaviour_features(self.cleaned), "behaviour")

    @cached_property
    def rfm_nb(self) -> DataFrame:
        return stage(rfm.rfm_segmentation_nb(self.features_nb), "rfm-nb")

    # -- churn ---------------------------------------------------------------
    @cached_property
    def churn_features(self) -> DataFrame:
        return stage(churn.churn_features(self.orders), "churn-features")

    @cached_property
    def churn_labels(self) -> DataFrame:
        return churn.churn_labels(self.churn_features)

    @cached_property
    def churn_temporal(self) -> DataFrame:
        return stage(churn.temporal_features(self.cleaned), "churn-temporal")

    @cached_property
    def predictions(self) -> DataFrame:
        """Risk by recency alone: no model, so that later steps can be checked."""
        latest = self.orders.agg(F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("_on"))
        scores = churn.recency_score(self.churn_labels).transform(with_row, latest)
        return churn.as_predictions(scores, "recency_score", F.col("_on"))

    # -- models ----------------------------------------------------------------
    @cached_property
    def customer_vectors(self) -> DataFrame:
        return modelling.vector_table(self.features_lib, "customer_id", modelling.CLUSTER_FEATURES)

    @cached_property
    def clusters(self) -> DataFrame:
        return stage(modelling.kmeans_of(self.customer_vectors, "customer_id"), "clusters")

    @cached_property
    def elbow(self) -> DataFrame:
        return modelling.kmeans_elbow(self.customer_vectors)

    @cached_property
    def clustered(self) -> DataFrame:
        return self.segmented.join(self.clusters, "customer_id")

    @cached_property
    def clustered_nb(self) -> DataFrame:
        """Scored customers with their cluster; null for those without a whole vector (no invoice has a number), who are in no cluster."""
        found = modelling.kmeans_clusters(self.rfm_nb, "customer_id", modelling.CLUSTER_FEATURES_NB)
        return self.rfm_nb.join(stage(found, "clusters-nb"), "customer_id", "left")

    @cached_property
    def model_input(self) -> DataFrame:
        """Labelled customers with the model features, optional ones included, made finite."""
        ready = churn.add_external(self.churn_labels, self.clv)
        return stage(modelling.prepared(ready, churn.model_features(ready)), "model-input")

    def trained(self, name: str) -> modelling.TrainedModel:
        """A churn model, fitted the first time it is asked for."""
        if name not in self._trained:
            self._trained[name] = modelling.train(self.model_input, name, churn.model_features(self.model_input))
        return self._trained[name]

    @cached_property
    def _registry(self) -> tables.ModelRegistry:
        return tables.ModelRegistry(new_path(self.spark, "models"))

    def registered(self, *names: str) -> tables.ModelRegistry:
        """The registry of saved models, with the named ones fitted and saved."""
        for name in names:
            if name not in self._saved:
                fitted = self.trained(name)
                self._registry.save(name, fitted.model, fitted.info)
                self._saved.add(name)
        return self._registry

    @cached_property
    def model_scores(self) -> DataFrame:
        out = None
        for name in self.MODELS:
            fitted = self.trained(name)
            part = modelling.auc(fitted.score(fitted.test)).select(F.lit(name).alias("model"), "auc")
            out = part if out is None else out.unionByName(part)
        best = out.agg(F.max_by("model", F.struct("auc", "model")).alias("_best"))
        marked = out.transform(with_row, best).withColumn("is_best", F.col("model") == F.col("_best"))
        return stage(marked.drop("_best"), "model-scores")

    @cached_property
    def model_predictions(self) -> DataFrame:
        """Risk of every customer by the saved forest."""
        return churn.predict_risk(self.registered(churn.DEFAULT_MODEL), self.model_input)

    @cached_property
    def fold_predictions(self) -> DataFrame:
        """Temporal features scored by the three models, each row by models that have not seen its fold."""
        features = churn.temporal_model_features(self.churn_temporal)
        return modelling.fold_predictions(self.churn_temporal, self.MODELS, features, variant="nb")

    @cached_property
    def temporal_scored(self) -> DataFrame:
        """Temporal features with the probability of the linear model."""
        features = churn.temporal_model_features(self.churn_temporal)
        fitted = modelling.train(self.churn_temporal, "logistic", features, variant="nb")
        scores = fitted.score(modelling.prepared(self.churn_temporal, features))
        scores = scores.select("customer_id", F.col("score").alias("churn_probability"))
        return stage(self.churn_temporal.join(scores, "customer_id"), "temporal-scored")

    # -- marketing -----------------------------------------------------------
    @cached_property
    def campaign_customers(self) -> DataFrame:
        return campaigns.create_campaign_segments(self.rfm_lib, self.predictions)

    @cached_property
    def touches(self) -> DataFrame:
        return fixtures.touches(self.spark, self.sf_dir)

    @cached_property
    def conversions(self) -> DataFrame:
        return fixtures.conversions(self.spark, self.sf_dir)

    # -- files -----------------------------------------------------------------
    def csv_folder(self, separator: str) -> str:
        """The raw lines written as csv with one of the separators."""
        if separator not in self._csv:
            path = f"{new_path(self.spark, 'csv')}/lines.csv"
            files.write_csv(self.raw, path, separator)
            self._csv[separator] = path
        return self._csv[separator]

    @cached_property
    def latin_folder(self) -> str:
        """The raw lines in ISO-8859-1, with an accent that utf-8 would write differently."""
        path = new_path(self.spark, "latin")
        accented = self.raw.withColumn("Country", F.concat("Country", F.lit(" é")))
        files.write_csv(accented, path, ",", "iso-8859-1")
        return path

    @cached_property
    def named_sources(self) -> files.NamedSources:
        registry = files.NamedSources(new_path(self.spark, "data"))
        for name, frame in {
            "main": self.raw,
            "customers": self.table("customer"),
            "products": self.table("part"),
            "orders": self.table("orders"),
        }.items():
            frame.write.option("header", True).csv(registry.path(name))
        return registry

    @cached_property
    def clean_table(self) -> str:
        path = new_path(self.spark, "clean-table")
        tables.write_clean(self.cleaned, path)
        return path


#: The given tables that shared tables are built from.
GIVEN = ("nation", "customer", "part", "orders", "lineitem", "events")
_marts: dict[tuple[str, str], tuple[tuple, Mart]] = {}


def mart_for(spark: SparkSession, sf_dir: str) -> Mart:
    """The shared tables of a data folder; built anew once a file of its tables has changed."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    now = files.listing(spark, f"{key[1]}/{{{','.join(GIVEN)}}}.parquet")
    if key not in _marts or _marts[key][0] != now:
        _marts[key] = now, Mart(spark, key[1])
    return _marts[key][1]
