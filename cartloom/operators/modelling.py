"""Clustering, classification and their evaluation on MLlib."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.numeric import dbl, ratio, round_even
from cartloom.functions.ordering import running_total
from cartloom.functions.scalars import with_row
from cartloom.functions.staging import stage
from cartloom.operators import kmeans

SEED = 42
TEST_SHARE = 0.2
CLUSTER_FEATURES = [
    "recency", "frequency", "monetary", "avg_order_value", "customer_lifetime",
    "avg_days_between_orders", "product_diversity",
]
CLUSTER_FEATURES_NB = [
    "recency", "frequency", "monetary", "avg_basket", "product_diversity", "customer_lifetime",
    "avg_days_between_orders",
]


# -- preparation --------------------------------------------------------------------
def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[e.alias(f"_{n}_{c}") for c in columns for n, e in (("m", F.avg(dbl(c))), ("s", F.stddev_pop(dbl(c))))]
    )
    scaled = {c: F.coalesce(ratio(dbl(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(0.0)) for c in columns}
    return df.transform(with_row, stats).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def _for_iteration(df: DataFrame, label: str) -> DataFrame:
    """Staged in files of a task's size: fits start thousands of small jobs, each with as many tasks as there are parts."""
    return stage(df.hint("rebalance"), label)


def vector_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, standardised feature vector) without incomplete rows, staged for iteration."""
    complete = df.select(key, *columns).dropna(subset=columns)
    scaled = standardized(complete, columns)
    return _for_iteration(scaled.select(key, F.array(*[dbl(c) for c in columns]).alias("_a")), "vectors").select(
        key, array_to_vector("_a").alias("features")
    )


# -- clustering -----------------------------------------------------------------------
#: Lloyd steps at most.
STEPS = 300


def best_kmeans(vectors: DataFrame, k: int = 5, restarts: int = 10, seed: int = SEED) -> kmeans.Run:
    """The cheapest of several seeded runs over the same vectors."""
    return min(kmeans.fit_all(vectors, [(k, seed + i) for i in range(restarts)], STEPS), key=lambda run: run.cost)


def kmeans_of(vectors: DataFrame, key: str, k: int = 5, restarts: int = 10, seed: int = SEED) -> DataFrame:
    """(key, cluster, pca_1, pca_2) of standardised vectors."""
    best = best_kmeans(vectors, k, restarts, seed)
    projected = PCA(k=2, inputCol="features", outputCol="pca").fit(vectors).transform(vectors)
    point, cluster = vector_to_array("pca"), kmeans.nearest(F.col("_x"), best.centres)
    own = projected.withColumn("_x", vector_to_array("features"))
    return own.select(key, cluster.alias("cluster"), point[0].alias("pca_1"), point[1].alias("pca_2"))


def kmeans_clusters(features: DataFrame, key: str, columns: list[str], k: int = 5, restarts: int = 10, seed: int = SEED) -> DataFrame:
    """(key, cluster, pca_1, pca_2)."""
    return kmeans_of(vector_table(features, key, columns), key, k, restarts, seed)


def kmeans_elbow(vectors: DataFrame, ks: range = range(2, 11), restarts: int = 10, seed: int = SEED) -> DataFrame:
    """Inertia of the cheapest of several runs for each number of clusters."""
    runs = kmeans.fit_all(vectors, [(k, seed + i) for k in ks for i in range(restarts)], STEPS)
    costs = [(k, min(run.cost for run in runs if run.k == k)) for k in ks]
    return vectors.sparkSession.createDataFrame(costs, "k int, inertia double")


def pca_2d(vectors: DataFrame, key: str) -> DataFrame:
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(vectors)
    first, second = (float(v) for v in model.explainedVariance)
    point = vector_to_array("pca")
    return model.transform(vectors).select(
        key, point[0].alias("pca_1"), point[1].alias("pca_2"),
        F.lit(first).alias("explained_1"), F.lit(second).alias("explained_2"),
    )


def calinski_harabasz(points: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Between- over within-cluster dispersion from two aggregates."""
    n = F.count(F.lit(1))
    per = points.groupBy(cluster).agg(n.alias("_n"), *[F.avg(dbl(c)).alias(f"_c_{c}") for c in columns])
    whole = points.agg(n.alias("_all"), *[F.avg(dbl(c)).alias(f"_g_{c}") for c in columns])
    between = sum(((F.col(f"_c_{c}") - F.col(f"_g_{c}")) ** 2 for c in columns), F.lit(0.0))
    within = sum(((dbl(c) - F.col(f"_c_{c}")) ** 2 for c in columns), F.lit(0.0))
    b = per.transform(with_row, whole).agg(
        F.sum(F.col("_n") * between).alias("_between"), F.count(F.lit(1)).alias("n_clusters"), F.max("_all").alias("_all")
    )
    # One row per cluster on the small side.
    w = points.join(F.broadcast(per), cluster).agg(F.sum(within).alias("_within"))
    k = F.col("n_clusters")
    score = ratio("_between", k - 1) / ratio("_within", F.col("_all") - k)
    return b.transform(with_row, w).select("n_clusters", round_even(score, 4).alias("calinski_harabasz_score"))


def clustering_metrics(vectors: DataFrame, clustered: DataFrame, key: str, width: int) -> DataFrame:
    """Silhouette by squared distance (linear in rows), Calinski-Harabasz, cluster count."""
    joined = vectors.join(clustered.select(key, "cluster"), key)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(joined)
    values = vector_to_array("features")
    names = [f"f{i}" for i in range(width)]
    points = joined.select("cluster", *[values[i].alias(n) for i, n in enumerate(names)])
    return calinski_harabasz(points, names).withColumn("silhouette_score", round_even(F.lit(silhouette), 4))


# -- classification ---------------------------------------------------------------------
def split_bucket(key: Column | str, salt: str = "split") -> Column:
    """0..99 from the id alone, the same in every run and engine."""
    name = F.concat(F.lit(f"{salt}:"), F.col(key).cast("string") if isinstance(key, str) else key)
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def stratified_split(labelled: DataFrame, key: str = "customer_id", test_share: float = TEST_SHARE) -> DataFrame:
    """Add is_train; ids are hashed independently of the label, so each label keeps its share."""
    return labelled.withColumn("is_train", split_bucket(key) < int(round((1 - test_share) * 100)))


def class_balance(labelled: DataFrame, label: str = "is_churned", low: float = 0.05, high: float = 0.95) -> DataFrame:
    rate = ratio(F.sum(label), F.count(F.lit(1)))
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), round_even(rate, 4).alias("positive_rate"),
        ((rate < low) | (rate > high)).alias("unbalanced"),
    )


def with_class_weights(labelled: DataFrame, label: str) -> DataFrame:
    """weight = n / (2 * rows of the class)."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    whole = sizes.agg(F.sum("_rows").alias("_all"))
    weights = sizes.transform(with_row, whole).select(label, (F.col("_all") / (F.col("_rows") * 2.0)).alias("weight"))
    return labelled.join(F.broadcast(weights), label)


#: The deepest tree the engine grows; the library variant has no limit of its own.
DEEPEST = 30


def classifier(
    name: str, rows: int, variant: str = "lib", rounds: int = 100, trees: int = 100, depth: int | None = None
) -> Estimator:
    """The three churn models with their settings in either variant."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if name == "logistic":
        # Unit penalty on summed loss equals 1/n on mean loss.
        return LogisticRegression(
            weightCol="weight", regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, maxIter=100, **common
        )
    if name == "random_forest":
        depth = depth or (10 if variant == "nb" else DEEPEST)
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, weightCol="weight", **common)
    if name == "gradient_boosting":
        # Trees this shallow are walked faster than a table of every row's node is kept up; the trees are the same.
        return GBTClassifier(
            maxIter=rounds, maxDepth=6 if variant == "nb" else 3, stepSize=0.1, seed=SEED, cacheNodeIds=False, checkpointInterval=10, **common
        )
    raise ValueError(f"unknown model {name!r}")


def prepared(labelled: DataFrame, features: list[str], label: str = "is_churned") -> DataFrame:
    """Finite features and a double label, where there is one."""
    clean = {
        c: F.when(dbl(c).isNull() | F.isnan(dbl(c)) | (F.abs(dbl(c)) == float("inf")), 0.0).otherwise(dbl(c)) for c in features
    }
    out = labelled.withColumns(clean)
    return out.withColumn("label", dbl(label)) if label in labelled.columns else out


def pipeline_for(name: str, features: list[str], rows: int, variant: str = "lib", **options) -> Pipeline:
    """Assembler, scaler for the linear model, estimator."""
    if name == "logistic":
        stages = [
            VectorAssembler(inputCols=features, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        ]
    else:
        stages = [VectorAssembler(inputCols=features, outputCol="features")]
    return Pipeline(stages=[*stages, classifier(name, rows, variant, **options)])


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    features: list[str]
    train_rows: int
    seconds: float
    test: DataFrame
    fit_rows: DataFrame

    @property
    def info(self) -> dict:
        """What is kept beside the saved model."""
        return {
            "model_name": self.name, "model_type": "classification", "feature_names": self.features,
            "target_name": "is_churned", "train_rows": self.train_rows, "is_trained": True,
        }

    @property
    def estimator(self):
        return self.model.stages[-1]

    def score(self, df: DataFrame, key: str = "customer_id") -> DataFrame:
        """(key, label?, score, prediction) with the training feature list."""
        keep = [key, *[c for c in ("label",) if c in df.columns]]
        out = self.model.transform(df)
        return out.select(*keep, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))


def train(labelled: DataFrame, name: str, features: list[str], key: str = "customer_id", label: str = "is_churned", variant: str = "lib", **options) -> TrainedModel:
    split = _for_iteration(stratified_split(prepared(labelled, features, label), key), "split")
    # the test rows have no say in the weights
    fit_rows, test = with_class_weights(split.where("is_train"), "label"), split.where("NOT is_train")
    rows = fit_rows.count()
    began = time.perf_counter()
    model = pipeline_for(name, features, rows, variant, **options).fit(fit_rows)
    return TrainedModel(name, model, features, rows, time.perf_counter() - began, test, fit_rows)


def feature_importance(trained: TrainedModel) -> DataFrame:
    """Tree importances, or coefficients and their absolute value."""
    last = trained.estimator
    spark = trained.test.sparkSession
    if hasattr(last, "featureImportances"):
        values = [(f, float(v), None) for f, v in zip(trained.features, last.featureImportances.toArray())]
    else:
        values = [(f, abs(float(v)), float(v)) for f, v in zip(trained.features, last.coefficients.toArray())]
    out = spark.createDataFrame(values, "feature string, importance double, coefficient double")
    return out.withColumn("model", F.lit(trained.name)).orderBy(F.desc("importance"), "feature")


def train_record(trained: TrainedModel) -> DataFrame:
    """One row: sizes, time and test metrics of a fit."""
    scored = trained.score(trained.test)
    report = classification_report(scored).where(F.col("class") == "weighted")
    return (
        auc(scored)
        .transform(with_row, report.select("precision", "recall", "f1", F.col("support").alias("test_rows")))
        .select(
            F.lit(trained.name).alias("model"), F.lit(trained.train_rows).alias("train_rows"), "test_rows",
            F.lit(trained.seconds).alias("training_seconds"), "auc", "precision", "recall", "f1",
        )
    )


def fold_predictions(
    labelled: DataFrame, names: Sequence[str], features: list[str], folds: int = 5, key: str = "customer_id",
    label: str = "is_churned", variant: str = "lib", parallelism: int = 8, **options,
) -> DataFrame:
    """(model, fold, key, label, score, prediction), staged: every row scored by models that have not seen its fold.

    Folds come from the id hash, so they are the same in every run.
    """
    spark = labelled.sparkSession
    data = prepared(labelled, features, label).withColumn("fold", split_bucket(key, "fold") % folds)
    data = _for_iteration(data.select(key, "fold", "label", *features), "folds")

    def scored(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        rows = with_class_weights(data.where(F.col("fold") != fold), "label")
        model = pipeline_for(name, features, rows.count(), variant, **options).fit(rows)
        return model.transform(data.where(F.col("fold") == fold)).select(
            F.lit(name).alias("model"), "fold", key, F.col("label").cast("int").alias("label"),
            vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"),
        )

    # The driver only starts the fits; a few at a time keep the cluster busy between iterations.
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(scored), [(n, f) for n in names for f in range(folds)]))
    return stage(reduce(DataFrame.unionByName, parts), "fold-predictions")


#: Scores of a fold; the errors are those of the probability.
FOLD_METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "mse", "mae", "r2", "auc"]


def fold_scores(predictions: DataFrame) -> DataFrame:
    """(model, fold, rows, positives, one column for each of FOLD_METRICS) from one table of fold predictions."""
    label, guess, error = F.col("label"), F.col("prediction"), F.col("label") - F.col("score")
    by = ["model", "fold"]
    sums = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"),
        *[F.count(F.when((label == c) & (guess == c), 1)).alias(f"_hit{c}") for c in (0, 1)],
        *[F.count(F.when(guess == c, 1)).alias(f"_guess{c}") for c in (0, 1)],
        *[F.count(F.when(label == c, 1)).alias(f"_true{c}") for c in (0, 1)],
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("label").alias("_var"),
    )
    # rank sums; the running count of negatives goes over all groups and starts anew by taking off where a group begins
    per = predictions.groupBy(*by, F.col("score").alias("_s")).agg(F.sum("label").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_neg", F.col("_n") - F.col("_pos"))
    placed = running_total(per, [F.col("model"), F.col("fold"), F.col("_s")], "_neg", "_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)) - F.min("_below") * F.sum("_pos")
    areas = placed.groupBy(*by).agg(F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    precision = [zero(ratio(f"_hit{c}", f"_guess{c}")) for c in (0, 1)]
    recall = [zero(ratio(f"_hit{c}", f"_true{c}")) for c in (0, 1)]
    f1 = [zero(F.try_divide(2 * p * r, p + r)) for p, r in zip(precision, recall)]

    def weighted(parts: list[Column]) -> Column:
        return ratio(parts[0] * F.col("_true0") + parts[1] * F.col("_true1"), "rows")

    # one row for each model and fold
    return sums.join(F.broadcast(areas), by).select(
        *by, "rows", "positives", ratio(F.col("_hit0") + F.col("_hit1"), "rows").alias("accuracy"),
        weighted(precision).alias("precision_weighted"), weighted(recall).alias("recall_weighted"), weighted(f1).alias("f1_weighted"),
        "mse", "mae", (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"), "auc",
    )


def cross_validation(predictions: DataFrame) -> DataFrame:
    """(model, metric, folds, mean, std) over the folds of :func:`fold_predictions`."""
    long = fold_scores(predictions).unpivot(["model", "fold"], FOLD_METRICS, "metric", "score")
    return long.groupBy("model", "metric").agg(F.count("score").alias("folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


# -- evaluation -----------------------------------------------------------------------
def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores share their mean rank.

    Rows are first counted per distinct score, so ties cost one row.
    """
    per = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_neg", F.col("_n") - F.col("_pos"))
    placed = running_total(per, [F.col("_s")], "_neg", "_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    area = F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double"))
    return placed.agg(round_even(area, 4).alias("auc"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("label").cast("int").alias("label"), "prediction").agg(F.count(F.lit(1)).alias("rows"))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and the weighted mean."""
    cells = confusion_matrix(scored)

    def part(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    label, guess = F.col("label"), F.col("prediction")
    sums = [part((label == c) & (guess == c)).alias(f"_hit{c}") for c in (0, 1)]
    sums += [part(guess == c).alias(f"_guess{c}") for c in (0, 1)] + [part(label == c).alias(f"_true{c}") for c in (0, 1)]
    row = cells.agg(*sums, F.sum("rows").alias("_all"))

    def scores(c: int) -> tuple[Column, Column, Column]:
        p = F.coalesce(ratio(f"_hit{c}", f"_guess{c}"), F.lit(0.0))
        r = F.coalesce(ratio(f"_hit{c}", f"_true{c}"), F.lit(0.0))
        return p, r, F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), round_even(p, 4).alias("precision"), round_even(r, 4).alias("recall"),
            round_even(f, 4).alias("f1"), n.alias("support"),
        )

    zero, one = scores(0), scores(1)
    mean = [F.coalesce(ratio(a * F.col("_true0") + b * F.col("_true1"), "_all"), F.lit(0.0)) for a, b in zip(zero, one)]
    hits = F.coalesce(ratio(F.col("_hit0") + F.col("_hit1"), "_all"), F.lit(0.0))
    lines = [
        line("0", *zero, F.col("_true0")), line("1", *one, F.col("_true1")),
        line("accuracy", hits, hits, hits, F.col("_all")), line("weighted", *mean, F.col("_all")),
    ]
    return row.select(F.inline(F.array(*lines)))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    y, e = dbl(actual), dbl(actual) - dbl(predicted)
    n = F.count(F.lit(1))
    sums = df.agg(F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("_mae"), F.var_pop(y).alias("_var"), n.alias("rows"))
    return sums.select(
        "rows", round_even("_mse", 4).alias("mse"), round_even("_mae", 4).alias("mae"),
        round_even(F.sqrt("_mse"), 4).alias("rmse"), round_even(F.lit(1.0) - F.try_divide(F.col("_mse"), F.col("_var")), 4).alias("r2_score"),
    )
