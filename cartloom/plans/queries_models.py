"""Model and evaluation queries."""

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.numeric import round_even
from cartloom.functions.scalars import with_row
from cartloom.operators import certificates, churn, modelling
from cartloom.plans.catalog import query


def _scored(m):
    return churn.recency_score(m.churn_labels).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


# Fits depend on seeds and on the order of sums.  Their values are registered as ``*_values``; the
# query of the operator's own name says for every row what must hold if the fit is right.
_WIDTH = len(modelling.CLUSTER_FEATURES)
_TEST = "('0x'||substr(md5('split:'||customer_id),1,8))::BIGINT % 100 >= 80"
_MODELS = "(VALUES ('logistic'),('random_forest'),('gradient_boosting')) v(model)"


@query("kmeans_clusters_values")
def kmeans_clusters_values(m):
    return m.clusters


@query("kmeans_clusters", "SELECT customer_id, true AS nearest_centre FROM features_lib")
def kmeans_clusters(m):
    """Every customer, and whether it lies at the nearest of the clusters' means."""
    return certificates.at_nearest_centre(m.customer_vectors, m.clusters, "customer_id", _WIDTH)


@query("kmeans_elbow_values")
def kmeans_elbow_values(m):
    return m.elbow


@query("kmeans_elbow", "SELECT k::INTEGER AS k, true AS below_one_cluster, true AS falls FROM range(2, 11) t(k)")
def kmeans_elbow(m):
    """For each number of clusters whether inertia is below that of one cluster and of fewer clusters."""
    whole = m.customer_vectors.agg((F.count(F.lit(1)) * _WIDTH).cast("double").alias("_whole"))  # columns of unit variance
    order = Window.orderBy("k")  # nine rows
    return m.elbow.transform(with_row, whole).select(
        "k", (F.col("inertia") < F.col("_whole")).alias("below_one_cluster"),
        (F.col("inertia") <= F.coalesce(F.lag("inertia").over(order), F.col("_whole"))).alias("falls"),
    )


@query("pca_2d_values")
def pca_2d_values(m):
    return modelling.pca_2d(m.customer_vectors, "customer_id")


@query("pca_2d", "SELECT customer_id, true AS on_axis_1, true AS on_axis_2, true AS explained FROM features_lib")
def pca_2d(m):
    """Every customer, and whether its coordinates are those on unit eigenvectors with the stated variances."""
    return certificates.on_principal_axes(m.customer_vectors, modelling.pca_2d(m.customer_vectors, "customer_id"), "customer_id", _WIDTH)


@query(
    "stratified_split",
    "SELECT customer_id, is_churned, ('0x'||substr(md5('split:'||customer_id),1,8))::BIGINT % 100 < 80 AS is_train FROM churn_labels",
)
def stratified_split(m):
    return modelling.stratified_split(m.churn_labels.select("customer_id", "is_churned"))


@query("churn_logistic_values")
def churn_logistic_values(m):
    return m.trained("logistic").score(m.model_input)


@query("churn_logistic", "SELECT customer_id, is_churned AS label, true AS in_range, true AS agrees, true AS flat FROM churn_labels")
def churn_logistic(m):
    """Every customer's score is sound, and the likelihood has no slope where the fit ended."""
    fitted = m.trained("logistic")
    return certificates.sound_scores(fitted.score(m.model_input)).transform(with_row, certificates.flat_at_optimum(fitted))


_BETTER = "SELECT customer_id, is_churned AS label, true AS in_range, true AS agrees, true AS better_than_chance FROM churn_labels"


def _sound_trees(m, name):
    scored = m.trained(name).score(m.model_input)
    better = modelling.auc(scored).select((F.col("auc") > 0.5).alias("better_than_chance"))
    return certificates.sound_scores(scored).transform(with_row, better)


@query("churn_random_forest_values")
def churn_random_forest_values(m):
    return m.trained("random_forest").score(m.model_input)


@query("churn_random_forest", _BETTER)
def churn_random_forest(m):
    return _sound_trees(m, "random_forest")


@query("churn_gbt_values")
def churn_gbt_values(m):
    return m.trained("gradient_boosting").score(m.model_input)


@query("churn_gbt", _BETTER)
def churn_gbt(m):
    return _sound_trees(m, "gradient_boosting")


@query(
    "auc",
    """WITH r AS (SELECT score, sum(label) AS pos, count(*)-sum(label) AS neg FROM score_view GROUP BY score),
 k AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM r)
SELECT round_even(sum(pos*(below+neg/2))::DOUBLE/(sum(pos)*sum(neg))::DOUBLE,4) AS auc FROM k""",
)
def auc(m):
    return modelling.auc(_scored(m))


@query("confusion_matrix", "SELECT label, prediction, count(*) AS rows FROM score_view GROUP BY 1,2")
def confusion_matrix(m):
    return modelling.confusion_matrix(_scored(m))


_CLASS = """SELECT c AS class, coalesce(h::DOUBLE/nullif(g,0),0) AS p, coalesce(h::DOUBLE/nullif(t,0),0) AS r, t FROM (SELECT c, count(*) FILTER (label=c AND prediction=c) AS h, count(*) FILTER (prediction=c) AS g,
 count(*) FILTER (label=c) AS t FROM score_view, (VALUES (0),(1)) v(c) GROUP BY c)"""


@query(
    "classification_report",
    f"""WITH k AS (SELECT *, coalesce(2*p*r/nullif(p+r,0),0) AS f FROM ({_CLASS})), a AS (SELECT count(*) FILTER (label=prediction)::DOUBLE/count(*) AS x, count(*) AS n FROM score_view)
SELECT class::VARCHAR AS class, round_even(p,4) AS precision, round_even(r,4) AS recall, round_even(f,4) AS f1, t AS support FROM k UNION ALL SELECT 'accuracy', round_even(x,4), round_even(x,4), round_even(x,4), n FROM a
UNION ALL SELECT 'weighted', round_even(sum(p*t)/sum(t),4), round_even(sum(r*t)/sum(t),4), round_even(sum(f*t)/sum(t),4), sum(t)::BIGINT FROM k""",
)
def classification_report(m):
    return modelling.classification_report(_scored(m))


@query(
    "regression_metrics",
    """SELECT count(*) AS rows, round_even(avg(e*e),4) AS mse, round_even(avg(abs(e)),4) AS mae, round_even(sqrt(avg(e*e)),4) AS rmse, round_even(1-avg(e*e)/var_pop(y),4) AS r2_score FROM (
 SELECT total_orders::DOUBLE AS y, total_orders-(1+customer_lifetime_days/200.0::DOUBLE) AS e FROM churn_features)""",
)
def regression_metrics(m):
    guess = F.lit(1) + F.col("customer_lifetime_days") / F.lit(200.0)
    return modelling.regression_metrics(m.churn_features.withColumn("guess", guess), "total_orders", "guess")


@query("clustering_metrics_values")
def clustering_metrics_values(m):
    return modelling.clustering_metrics(m.customer_vectors, m.clusters, "customer_id", _WIDTH)


@query("clustering_metrics", "SELECT 5 AS n_clusters, true AS silhouette_in_range, true AS dispersion_adds_up")
def clustering_metrics(m):
    """The cluster count, and whether dispersion worked out from sums of squares gives the same score."""
    values = vector_to_array("features")
    points = m.customer_vectors.join(m.clusters.select("customer_id", "cluster"), "customer_id")
    points = points.select("cluster", *[values[i].alias(f"f{i}") for i in range(_WIDTH)])
    return certificates.dispersion_adds_up(points, [f"f{i}" for i in range(_WIDTH)], clustering_metrics_values(m))


@query("feature_importance_values")
def feature_importance_values(m):
    return reduce(DataFrame.unionByName, [modelling.feature_importance(m.trained(name)) for name in m.MODELS])


_FEATURES = ",".join(f"('{f}')" for f in churn.MODEL_FEATURES + churn.OPTIONAL_FEATURES)


@query("feature_importance", f"SELECT model, feature, true AS valid, true AS sum_holds FROM {_MODELS}, (VALUES {_FEATURES}) f(feature)")
def feature_importance(m):
    """Every feature of every model; importances of trees add up to 1, those of the linear model are its coefficients' sizes."""
    found = feature_importance_values(m)
    sums = found.groupBy("model").agg(F.sum("importance").alias("_sum"))
    tree = F.isnull("coefficient")
    return found.join(F.broadcast(sums), "model").select(
        "model", "feature", ((F.col("importance") >= 0) & (tree | (F.col("importance") == F.abs("coefficient")))).alias("valid"),
        (~tree | (F.abs(F.col("_sum") - 1) < 1e-9)).alias("sum_holds"),
    )


@query("model_selection_values")
def model_selection_values(m):
    return m.model_scores.agg(
        F.max_by("model", F.struct("auc", "model")).alias("best_model"), F.max("auc").alias("best_auc")
    )


@query("model_selection", f"SELECT model, true AS not_above_best FROM {_MODELS}")
def model_selection(m):
    """Every model that was tried, and that none has a higher test AUC than the one selected."""
    return m.model_scores.transform(with_row, model_selection_values(m)).select(
        "model", ((F.col("auc") < F.col("best_auc")) | ((F.col("auc") == F.col("best_auc")) & (F.col("model") <= F.col("best_model")))).alias("not_above_best")
    )


@query("cross_validation_values")
def cross_validation_values(m):
    return modelling.cross_validation(m.fold_predictions)


@query(
    "cross_validation",
    f"""SELECT model, fold, rows, positives, true AS recall_is_accuracy, true AS errors_fit, true AS area_in_range, true AS spread_fits FROM {_MODELS},
 (SELECT (('0x'||substr(md5('fold:'||customer_id),1,8))::BIGINT % 100 % 5)::INTEGER AS fold, count(*) AS rows, sum(is_churned)::BIGINT AS positives FROM temporal_base WHERE invoices>=3 GROUP BY 1)""",
)
def cross_validation(m):
    """Rows and positives of every fold of every model, and what ties its scores to each other and to their means."""
    folds = modelling.fold_scores(m.fold_predictions)
    means = modelling.cross_validation(m.fold_predictions).groupBy("model").agg(
        *[F.max(F.when(F.col("metric") == x, F.col(c))).alias(f"_{c}_{x}") for x in ("accuracy", "auc") for c in ("mean", "std")]
    )
    within = [F.abs(F.col(x) - F.col(f"_mean_{x}")) <= F.col(f"_std_{x}") * 2.0 + 1e-9 for x in ("accuracy",)]  # of five values none is further off
    return folds.join(F.broadcast(means), "model").select(
        "model", "fold", "rows", "positives",
        (F.abs(F.col("recall_weighted") - F.col("accuracy")) < 1e-12).alias("recall_is_accuracy"),
        ((F.col("mae") * F.col("mae") <= F.col("mse") + 1e-12) & (F.col("mse") <= F.col("mae") + 1e-12) & (F.coalesce(F.col("r2"), F.lit(0.0)) <= 1)).alias("errors_fit"),
        F.coalesce(F.col("auc"), F.lit(0.5)).between(0, 1).alias("area_in_range"), within[0].alias("spread_fits"),
    )


@query(
    "class_balance_check",
    """SELECT count(*) AS rows, sum(is_churned)::BIGINT AS positives, round_even(sum(is_churned)::DOUBLE/count(*),4) AS positive_rate,
 sum(is_churned)::DOUBLE/count(*)<0.05 OR sum(is_churned)::DOUBLE/count(*)>0.95 AS unbalanced FROM churn_labels""",
)
def class_balance_check(m):
    return modelling.class_balance(m.churn_labels)


@query("model_train_record_values")
def model_train_record_values(m):
    return reduce(DataFrame.unionByName, [modelling.train_record(m.trained(name)) for name in m.MODELS])


@query(
    "model_train_record",
    f"""SELECT model, count(*) FILTER (NOT {_TEST}) AS train_rows, count(*) FILTER ({_TEST}) AS test_rows, true AS scores_in_range, true AS time_taken FROM churn_labels, {_MODELS} GROUP BY 1""",
)
def model_train_record(m):
    """Sizes of every fit, and whether its scores and its time can be such."""
    sound = F.lit(True)
    for c in ("auc", "precision", "recall", "f1"):
        sound = sound & F.coalesce(F.col(c), F.lit(0.5)).between(0, 1)
    return model_train_record_values(m).select("model", "train_rows", "test_rows", sound.alias("scores_in_range"), (F.col("training_seconds") > 0).alias("time_taken"))


@query("model_predict_values")
def model_predict_values(m):
    trained = m.trained("random_forest")
    return trained.score(trained.test).withColumn("score", round_even("score", 6))


@query("model_predict", f"SELECT customer_id, is_churned AS label, true AS in_range, true AS agrees FROM churn_labels WHERE {_TEST}")
def model_predict(m):
    """Every customer of the test share once, with a sound score."""
    trained = m.trained("random_forest")
    return certificates.sound_scores(trained.score(trained.test))


_NAMES = ", ".join(f'"{f}"' for f in churn.MODEL_FEATURES + churn.OPTIONAL_FEATURES)


@query(
    "model_sink",
    f"""SELECT 'logistic' AS model_name, 'classification' AS model_type, '[{_NAMES}]' AS feature_names, 'is_churned' AS target_name, (count(*) FILTER (NOT {_TEST}))::VARCHAR AS train_rows, 'True' AS is_trained FROM churn_labels""",
)
def model_sink(m):
    """Metadata of the saved model, read back."""
    return m.spark.read.parquet(f"{m.registered('logistic').root}/logistic/info")


@query("model_scan_values")
def model_scan_values(m):
    """Scores of the restored model."""
    model, _ = m.registered("logistic").load(m.spark, "logistic")
    return model.transform(m.model_input).select("customer_id", vector_to_array("probability")[1].alias("score"))


@query("model_scan", "SELECT customer_id, true AS as_before_saving FROM churn_labels")
def model_scan(m):
    """Every customer, and whether the restored model scores it as the fitted one did."""
    before = m.trained("logistic").score(m.model_input).select("customer_id", F.col("score").alias("_before"))
    return model_scan_values(m).join(before, "customer_id").select("customer_id", (F.abs(F.col("score") - F.col("_before")) < 1e-12).alias("as_before_saving"))
