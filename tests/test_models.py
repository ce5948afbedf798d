"""Invariants of fitted models."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartloom.operators import certificates, churn, isolation, kmeans, modelling
from cartloom.sources import tables


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(f"far{i}", 9.0 + i, -9.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    out = isolation.isolation_forest(df, "k", ["a", "b"], trees=40)
    found = {r["k"] for r in out.where("anomaly = -1").collect()}
    assert {f"far{i}" for i in range(5)} <= found
    assert 1 <= len(found) <= 0.06 * len(rows)
    assert out.count() == len(rows)


def test_bags_are_bounded_and_repeatable(spark):
    df = spark.range(20000).withColumn("x", F.rand(1))
    once = isolation.bags(df, "id", trees=20, bag_rows=64)
    sizes = [r["count"] for r in once.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and max(sizes) == 64 and min(sizes) > 40
    again = isolation.bags(df.repartition(3), "id", trees=20, bag_rows=64)
    assert once.select("tree", "id").exceptAll(again.select("tree", "id")).count() == 0


def test_kmeans_recovers_groups(spark):
    rng = random.Random(1)
    rows = [(i, (i % 3) * 10 + rng.random(), (i % 3) * -7 + rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = modelling.kmeans_clusters(df, "id", ["a", "b"], k=3, restarts=3)
    groups = {(r["id"] % 3, r["cluster"]) for r in out.collect()}
    assert len(groups) == 3
    metrics = modelling.clustering_metrics(modelling.vector_table(df, "id", ["a", "b"]), out, "id", 2).first()
    assert metrics["n_clusters"] == 3 and metrics["silhouette_score"] > 0.9 and metrics["calinski_harabasz_score"] > 100


def test_elbow_runs_share_their_scans(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(60, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 5), (5, 0))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    vectors = modelling.vector_table(df, "id", ["a", "b"])
    spark.sparkContext.setJobGroup("elbow", "elbow")
    try:
        costs = {r["k"]: r["inertia"] for r in modelling.kmeans_elbow(vectors, range(2, 7), restarts=10).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("elbow")) < 150  # run by run: several for each of 50 runs
    scaled = (points - points.mean(axis=0)) / points.std(axis=0)
    own = np.repeat(np.arange(4), 60)
    best = sum(((scaled[own == j] - scaled[own == j].mean(axis=0)) ** 2).sum() for j in range(4))
    assert costs[4] == pytest.approx(best) and list(costs.values()) == sorted(costs.values(), reverse=True)


def test_kmeans_ends_at_means_of_its_own_vectors(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(3000, 3)), np.zeros((500, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    vectors = modelling.vector_table(df, "id", ["a", "b", "c"])
    scaled = np.array([r["features"].toArray() for r in vectors.collect()])
    for run in kmeans.fit_all(vectors, [(3, 1), (6, 2)], 300):
        apart = ((scaled[:, None, :] - run.centres[None]) ** 2).sum(axis=2)
        assert run.cost == pytest.approx(apart.min(axis=1).sum())
        for j in range(run.k):
            assert np.allclose(run.centres[j], scaled[apart.argmin(axis=1) == j].mean(axis=0), atol=1e-3)
    two = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "id int, a double")
    few = kmeans.fit_all(modelling.vector_table(two, "id", ["a"]), [(5, 1)], 300)[0]
    assert len(few.centres) == 2 and few.cost == pytest.approx(0.0)  # two different vectors make two clusters


def test_boosted_trees_keep_no_table_of_nodes(spark):
    assert not modelling.classifier("gradient_boosting", 10, "nb").getCacheNodeIds()
    rng = np.random.default_rng(7)
    rows = [(Vectors.dense(p), float(p[0] * p[1] > 0)) for p in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, ["features", "label"])
    ours = modelling.classifier("gradient_boosting", 400, "nb", rounds=3)
    a, b = ours.fit(df), ours.copy({ours.cacheNodeIds: True}).fit(df)
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 5) / 5) for _ in range(300)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert modelling.auc(df).first()["auc"] == pytest.approx(want, abs=1e-4)


def test_churn_model_scores_every_customer(mart):
    fitted = mart.trained("logistic")
    scored = fitted.score(mart.model_input)
    row = scored.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["n"] == mart.churn_labels.count() and 0 <= row["lo"] <= row["hi"] <= 1
    importance = modelling.feature_importance(fitted)
    assert importance.count() == len(fitted.features) and set(churn.MODEL_FEATURES) < set(fitted.features)


def test_split_keeps_shares(mart):
    split = modelling.stratified_split(mart.churn_labels).groupBy("is_train").count().collect()
    assert {r["is_train"] for r in split} == {True, False}


def test_saved_models_score_by_name(spark, mart, tmp_path):
    registry = tables.ModelRegistry(str(tmp_path / "models"))
    with pytest.raises(ValueError):
        churn.predict_risk(registry, mart.model_input)
    fitted = mart.trained("logistic")
    registry.save("logistic", fitted.model, fitted.info)
    assert registry.names(spark) == ["logistic"]
    with pytest.raises(ValueError, match="unknown model 'random_forest'; known: logistic"):
        churn.predict_risk(registry, mart.model_input)
    found = churn.predict_risk(registry, mart.model_input, "logistic")
    assert found.count() == found.select("customer_id").distinct().count() == mart.churn_labels.count()
    latest = mart.orders.agg(F.date_format(F.max("order_date"), "yyyy-MM-dd")).first()[0]
    assert [tuple(r) for r in found.select("model_used", "prediction_date").distinct().collect()] == [("logistic", latest)]
    assert churn.predict_risk(registry, mart.model_input, "logistic", on="2020-02-02").first()["prediction_date"] == "2020-02-02"
    assert churn.predict_risk(mart.registered("random_forest"), mart.model_input).first()["model_used"] == "random_forest"


def test_optional_features_are_used_where_present(mart):
    assert churn.model_features(mart.churn_labels) == churn.MODEL_FEATURES
    assert churn.model_features(mart.model_input) == churn.MODEL_FEATURES + churn.OPTIONAL_FEATURES
    assert mart.trained("logistic").features[-2:] == churn.OPTIONAL_FEATURES
    plain = modelling.train(mart.churn_labels, "logistic", churn.model_features(mart.churn_labels))
    assert plain.score(mart.model_input).count() == mart.churn_labels.count()


def test_fold_scores_against_plain_sums(spark):
    rng = random.Random(8)
    rows = [(m, f, i, rng.randint(0, 1), rng.randint(0, 8) / 8) for m in ("a", "b") for f in range(3) for i in range(40)]
    rows = [(m, f, i, y, s, int(s > 0.5)) for m, f, i, y, s in rows] + [("c", 0, 1, 1, 0.9, 1), ("c", 0, 2, 1, 0.2, 0)]
    found = modelling.fold_scores(spark.createDataFrame(rows, "model string, fold int, customer_id int, label int, score double, prediction int"))
    for row in found.collect():
        part = [(y, s, p) for m, f, _, y, s, p in rows if (m, f) == (row["model"], row["fold"])]
        n, ys = len(part), [y for y, _, _ in part]
        assert (row["rows"], row["positives"]) == (n, sum(ys))
        assert row["accuracy"] == pytest.approx(sum(y == p for y, _, p in part) / n)
        assert row["mse"] == pytest.approx(sum((y - s) ** 2 for y, s, _ in part) / n) and row["mae"] == pytest.approx(sum(abs(y - s) for y, s, _ in part) / n)
        weighted = {"precision_weighted": 0.0, "recall_weighted": 0.0, "f1_weighted": 0.0}
        for c in (0, 1):
            hit, guess, true = sum(y == p == c for y, _, p in part), sum(p == c for _, _, p in part), ys.count(c)
            p, r = hit / guess if guess else 0.0, hit / true if true else 0.0
            for name, value in zip(weighted, (p, r, 2 * p * r / (p + r) if p + r else 0.0)):
                weighted[name] += value * true / n
        assert all(row[k] == pytest.approx(v) for k, v in weighted.items())
        pos, neg = [s for y, s, _ in part if y], [s for y, s, _ in part if not y]
        if not neg:
            assert row["auc"] is None and row["r2"] is None
            continue
        assert row["auc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
        assert row["r2"] == pytest.approx(1 - row["mse"] / np.var(ys))


def test_folds_score_every_row_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "customer_id int, x double, y double, is_churned int")
    found = modelling.fold_predictions(df, ["logistic", "random_forest"], ["x", "y"], folds=3, trees=5, depth=3)
    assert found.count() == 400 and found.select("model", "customer_id").distinct().count() == 400
    means = {(r["model"], r["metric"]): r["mean"] for r in modelling.cross_validation(found).collect()}
    assert set(m for _, m in means) == set(modelling.FOLD_METRICS) and means["logistic", "auc"] > 0.7


def test_certificates_fail_for_wrong_results(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(3 * (i % 3) + a), float(b - 4 * (i % 3))) for i, (a, b) in enumerate(rng.normal(size=(120, 2)) / 5)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    vectors = modelling.vector_table(df, "id", ["a", "b"])
    clustered = modelling.kmeans_of(vectors, "id", k=3, restarts=3)
    assert certificates.at_nearest_centre(vectors, clustered, "id", 2).where("not nearest_centre").count() == 0
    moved = clustered.withColumn("cluster", F.when(F.col("id") == 0, (F.col("cluster") + 1) % 3).otherwise(F.col("cluster")))
    assert [r["id"] for r in certificates.at_nearest_centre(vectors, moved, "id", 2).where("not nearest_centre").collect()] == [0]
    pca = modelling.pca_2d(vectors, "id")
    assert certificates.on_principal_axes(vectors, pca, "id", 2).where("on_axis_1 and on_axis_2 and explained").count() == 120
    turned = pca.withColumn("pca_1", F.col("pca_1") + F.col("pca_2") * 0.1)
    assert certificates.on_principal_axes(vectors, turned, "id", 2).where("on_axis_1 and explained").count() == 0
    labelled = df.withColumn("is_churned", (F.col("a") + F.col("b") > F.lit(-1.2)).cast("int")).withColumnRenamed("id", "customer_id")
    fitted = modelling.train(labelled, "logistic", ["a", "b"])
    assert certificates.flat_at_optimum(fitted).first()["flat"]
    flipped = modelling.TrainedModel(fitted.name, fitted.model, fitted.features, 1, 0.0, fitted.test, fitted.fit_rows.withColumn("label", F.lit(1.0) - F.col("label")))
    assert not certificates.flat_at_optimum(flipped).first()["flat"]


@pytest.mark.parametrize("width", [1, 2, 7])
def test_cells_give_the_sums_of_their_vectors(width):
    rng = np.random.default_rng(width)
    rows = np.column_stack([rng.lognormal(sigma=2, size=5000) for _ in range(min(width, 2))] + [np.zeros(5000)] * (width - 2))
    rows[:900] = rows[0]  # copies
    rows[900:1000, 0] = np.linspace(-3, 3, 100)  # some on the borders of the first centres
    near = kmeans._by_cell(rows)
    assert sorted(map(tuple, near)) == sorted(map(tuple, rows))
    cells = kmeans._cells(near)
    assert cells[:, 0].sum() == len(rows)
    for centres in (rows[:1], np.array([[-1.0] * width, [1.0] * width, [1.0] * width]), rows[rng.integers(900, 5000, 6)]):
        own, apart = kmeans._nearest(rows, np.square(rows).sum(axis=1), centres)
        n, cost, total, compared = kmeans._block_sums(near, cells, centres)
        assert n.tolist() == [(own == j).sum() for j in range(len(centres))]
        assert np.allclose(cost, [apart[own == j].sum() for j in range(len(centres))])
        assert np.allclose(total, [rows[own == j].sum(axis=0) for j in range(len(centres))])
        assert compared < 0.7 * len(rows)  # one by one it would be all
