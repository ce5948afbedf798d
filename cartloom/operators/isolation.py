"""Isolation forest: trees over small hashed bags, scoring spread over the rows.

A tree needs only a bag of 256 rows.  Bags are drawn by hashing the row id,
in one pass; each bag becomes one small group whose tree is grown on an
executor.  The grown forest is bounded by trees x nodes, so it is shipped to
the scoring tasks, which score rows in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.functions.numeric import dbl
from cartloom.functions.ordering import exact_quantiles
from cartloom.functions.scalars import with_row
from cartloom.functions.staging import stage

TREES = 100
BAG_ROWS = 256
CONTAMINATION = 0.05
SPARE = 1.3
SEED = 42
NODE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, rows int, depth int"
EULER = 0.5772156649015329


def mean_path(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def bags(rows: DataFrame, key: str, trees: int = TREES, bag_rows: int = BAG_ROWS, seed: int = SEED) -> DataFrame:
    """(tree, row) pairs, at most ``bag_rows`` per tree, chosen by hash of the id.

    A row joins on average ``trees*bag_rows/n`` bags (a little more, so that
    few bags come short); the extra rows are cut off by hash order.
    """
    n = rows.count()
    wanted = min(float(trees), trees * bag_rows * SPARE / max(n, 1))
    whole, part = int(wanted), wanted - int(wanted)
    grain = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(grain)) < F.lit(int(part * grain))
    joins = F.lit(whole) + F.when(draw, 1).otherwise(0)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(trees))
    member = (
        rows.withColumn("_joins", joins)
        .where(F.col("_joins") > 0)
        .withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_joins") - 1)))
        .withColumn("tree", F.pmod(start + F.col("_nth"), F.lit(trees)).cast("int"))
        .drop("_joins", "_nth")
    )
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), F.col("tree"), F.col(key)), F.col(key))
    return member.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= bag_rows)


def _grower(columns: list[str], bag_rows: int, seed: int):
    limit = math.ceil(math.log2(bag_rows))

    def grow(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values("_place")
        tree = int(bag["tree"].iloc[0])
        data = bag[columns].to_numpy(dtype=float)
        rng = np.random.default_rng(seed * 1000 + tree)
        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        free = 1
        while todo:
            node, index, depth = todo.pop()
            part = data[index]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(index) > 1 and depth < limit else []
            if len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(index), depth))
                continue
            feature = int(rng.choice(spread))
            values = part[:, feature]
            cut = float(rng.uniform(values.min(), values.max()))
            nodes.append((tree, node, feature, cut, free, free + 1, len(index), depth))
            todo.append((free, index[values <= cut], depth + 1))
            todo.append((free + 1, index[values > cut], depth + 1))
            free += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "rows", "depth"])

    return grow


def grow_forest(rows: DataFrame, key: str, columns: list[str], trees: int = TREES, bag_rows: int = BAG_ROWS, seed: int = SEED) -> DataFrame:
    """One row per tree node."""
    chosen = bags(rows.select(key, *columns), key, trees, bag_rows, seed)
    return chosen.select("tree", "_place", *columns).groupBy("tree").applyInPandas(_grower(columns, bag_rows, seed), NODE_SCHEMA)


def _scorer(forest: pd.DataFrame, bag_rows: int):
    trees = []
    for _, part in forest.groupby("tree"):
        part = part.sort_values("node")
        leaf = part["depth"].to_numpy() + mean_path(part["rows"].to_numpy())
        trees.append(tuple(part[c].to_numpy() for c in ("feature", "cut", "low", "high")) + (leaf,))
    # bags of a small input hold fewer rows than they may
    scale = float(mean_path(min(bag_rows, int(forest.loc[forest["depth"] == 0, "rows"].max()))))

    def score(*columns: pd.Series) -> pd.Series:
        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        row = np.arange(len(data))
        total = np.zeros(len(data))
        for feature, cut, low, high, leaf in trees:
            at = np.zeros(len(data), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                value = data[row, np.maximum(feature[at], 0)]
                at = np.where(inner, np.where(value <= cut[at], low[at], high[at]), at)
            total += leaf[at]
        return pd.Series(np.power(2.0, -total / max(len(trees), 1) / scale))

    return score


def isolation_forest(rows: DataFrame, key: str, columns: list[str], contamination: float = CONTAMINATION, trees: int = TREES, bag_rows: int = BAG_ROWS, seed: int = SEED) -> DataFrame:
    """Add anomaly_score (negative is unusual) and anomaly (-1 unusual, 1 normal)."""
    # Read three times (size, bags, scores), so written once.
    numbers = stage(rows.withColumns({c: F.coalesce(dbl(c), F.lit(0.0)) for c in columns}), "isolation-input")
    forest = grow_forest(numbers, key, columns, trees, bag_rows, seed).toPandas()
    rate = F.pandas_udf(_scorer(forest, bag_rows), "double")
    scored = stage(numbers.withColumn("_raw", -rate(*[F.col(c) for c in columns])), "isolation")
    cut = exact_quantiles(scored, {"cut": F.col("_raw")}, [contamination])
    return (
        scored.transform(with_row, cut)
        .withColumn("anomaly_score", F.col("_raw") - F.col("cut_q0"))
        .withColumn("anomaly", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
        .drop("_raw", "cut_q0")
    )
