"""Facts that hold for the result of a fit if and only if the fit did its work.

A fitted model depends on seeds and on the order of sums, so its numbers cannot be
restated in another engine.  What makes them right can: every point lies at its
nearest mean, a component is an eigenvector, a penalised likelihood has no slope
at its maximum.  Each function turns one such condition into a column of every row.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.numeric import dbl
from cartloom.functions.scalars import with_row
from cartloom.operators.modelling import TrainedModel


def _cells(width: int, name: str = "_x") -> list[Column]:
    return [F.col(name)[i] for i in range(width)]


def at_nearest_centre(vectors: DataFrame, clustered: DataFrame, key: str, width: int, slack: float = 1e-3) -> DataFrame:
    """(key, nearest_centre): whether no other cluster's mean is nearer than the own one's (by more than the search's own tolerance)."""
    points = vectors.join(clustered.select(key, "cluster"), key).select(key, "cluster", vector_to_array("features").alias("_x"))
    means = points.groupBy("cluster").agg(F.array(*[F.avg(c) for c in _cells(width)]).alias("_mean"))
    centres = means.agg(F.collect_list(F.struct("cluster", "_mean")).alias("_centres"))  # a row for each cluster
    apart = F.transform("_centres", lambda c: F.struct(c["cluster"].alias("cluster"), F.aggregate(
        F.zip_with("_x", c["_mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d")))
    found = points.transform(with_row, centres).withColumn("_apart", apart)
    own = F.filter("_apart", lambda c: c["cluster"] == F.col("cluster"))[0]["d"]
    least = F.array_min(F.transform("_apart", lambda c: c["d"]))
    return found.select(key, (F.sqrt(own) <= F.sqrt(least) + slack).alias("nearest_centre"))


def on_principal_axes(vectors: DataFrame, projected: DataFrame, key: str, width: int, slack: float = 1e-6) -> DataFrame:
    """(key, on_axis_1, on_axis_2, explained): whether a row's coordinates are those on a unit eigenvector, and the shares those of its variance.

    With t = Xv the vector X't / t't is v again just for eigenvectors of X'X.
    """
    points = vectors.join(projected, key).select(key, vector_to_array("features").alias("_x"), "pca_1", "pca_2", "explained_1", "explained_2")
    square = {j: F.sum(F.col(f"pca_{j}") * F.col(f"pca_{j}")) for j in (1, 2)}
    stats = points.agg(
        *[F.array(*[F.sum(c * F.col(f"pca_{j}")) / square[j] for c in _cells(width)]).alias(f"_v{j}") for j in (1, 2)],
        *[(square[j] / F.sum(sum((c * c for c in _cells(width)), F.lit(0.0)))).alias(f"_share{j}") for j in (1, 2)],
        (F.abs(F.sum(F.col("pca_1") * F.col("pca_2"))) <= F.lit(slack) * (square[1] + square[2])).alias("_apart"),
    )

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d)

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.lit(slack) * (F.lit(1.0) + F.abs(b))

    found = points.transform(with_row, stats)
    return found.select(
        key,
        *[(near(dot("_x", f"_v{j}"), F.col(f"pca_{j}")) & near(dot(f"_v{j}", f"_v{j}"), F.lit(1.0))).alias(f"on_axis_{j}") for j in (1, 2)],
        (near(F.col("_share1"), F.col("explained_1")) & near(F.col("_share2"), F.col("explained_2")) & F.col("_apart") & (F.col("explained_1") >= F.col("explained_2"))).alias("explained"),
    )


def flat_at_optimum(trained: TrainedModel, slack: float = 1e-3) -> DataFrame:
    """One row, flat: whether the penalised likelihood of a logistic model has no slope where the fit ended."""
    last = trained.estimator
    weights = [float(b) for b in last.coefficients.toArray()]
    rows = trained.model.transform(trained.fit_rows).select("weight", "label", vector_to_array("probability")[1].alias("_p"), vector_to_array("features").alias("_x"))
    miss, whole = F.col("weight") * (F.col("_p") - F.col("label")), F.sum("weight")
    slopes = [F.sum(miss) / whole] + [F.sum(miss * c) / whole + F.lit(last.getRegParam() * b) for c, b in zip(_cells(len(weights)), weights)]
    return rows.agg((F.greatest(*[F.abs(s) for s in slopes]) <= slack).alias("flat"))


def sound_scores(scored: DataFrame, key: str = "customer_id") -> DataFrame:
    """(key, label, in_range, agrees): a probability, and the class it speaks for."""
    return scored.select(
        key, F.col("label").cast("int").alias("label"), F.col("score").between(0, 1).alias("in_range"),
        (F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("agrees"),
    )


def dispersion_adds_up(points: DataFrame, columns: list[str], score: DataFrame, cluster: str = "cluster", slack: float = 1e-3) -> DataFrame:
    """``score`` (n_clusters, calinski_harabasz_score, silhouette_score) with whether total, between and within dispersion make that score."""
    n = F.count(F.lit(1))
    squares = sum((dbl(c) * dbl(c) for c in columns), F.lit(0.0))
    per = points.groupBy(cluster).agg(n.alias("_n"), F.sum(squares).alias("_q"), *[F.sum(dbl(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    own = sum((F.col(f"_s{i}") * F.col(f"_s{i}") / F.col("_n") for i in range(len(columns))), F.lit(0.0))
    whole = sum((F.sum(f"_s{i}") * F.sum(f"_s{i}") for i in range(len(columns))), F.lit(0.0)) / F.sum("_n")
    sums = per.agg(F.sum(own).alias("_own"), F.sum("_q").alias("_q"), whole.alias("_whole"), F.sum("_n").alias("_rows"))
    k = F.col("n_clusters")
    again = ((F.col("_own") - F.col("_whole")) / (k - 1)) / ((F.col("_q") - F.col("_own")) / (F.col("_rows") - k))
    return score.transform(with_row, sums).select(
        "n_clusters", F.col("silhouette_score").between(-1, 1).alias("silhouette_in_range"),
        (F.abs(again - F.col("calinski_harabasz_score")) <= F.lit(slack) * again).alias("dispersion_adds_up"),
    )
