"""Arithmetic and ordering helpers against plain Python, numpy and pandas."""

import datetime as dt
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartloom.functions import numeric, ordering
from cartloom.functions.scalars import with_distinct_counts
from cartloom.functions.staging import stage
from cartloom.operators.churn import risk_band
from cartloom.operators.rfm import rfm_scores


def test_round_even_follows_numpy(spark):
    values = [0.125, 0.135, 2.675, -0.125, 1e9 + 0.005, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numeric.round_even("v", 2)).collect()]
    assert got == [None if v is None else float(np.round(v, 2)) for v in values]


def test_whole_days_floors_elapsed_time(spark):
    rows = [(dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 23)), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    assert [r[0] for r in df.select(numeric.whole_days("a", "b")).collect()] == [0, -1]


def test_bands_are_closed_on_the_right(spark):
    values = [0.0, 0.1, 0.3, 0.31, 0.7, 1.0, 1.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(risk_band("v")).collect()]
    want = pd.cut(values, [0, 0.3, 0.7, 1.0], labels=["low", "medium", "high"])
    assert got == [None if pd.isna(w) else w for w in want]


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.normal_cdf("x")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=2e-7)


def test_global_rank_and_running_total(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(7)
    ranked = {r["id"]: r["rank"] for r in ordering.global_rank(df, [F.col("v"), F.col("id")]).collect()}
    assert ranked == {i: n + 1 for n, (_, i) in enumerate(sorted(rows))}
    total, want = 0, {}
    for v, i in sorted(rows):
        want[i] = total
        total += v
    got = {r["id"]: r["before"] for r in ordering.running_total(df, [F.col("v"), F.col("id")], "v").collect()}
    assert got == want


def test_quantiles_with_a_hot_value_and_groups(spark):
    rng = random.Random(5)
    rows = [("a", 7.0) for _ in range(900)] + [("a", rng.random()) for _ in range(101)]
    rows += [("b", float(rng.randint(0, 9))) for _ in range(50)] + [("b", None), ("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["v_q0"], r["v_q1"]) for r in ordering.exact_quantiles(df, {"v": F.col("v")}, [0.05, 0.5], by=["g"]).collect()}
    for g in "abc":
        data = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(data, [0.05, 0.5])))
    whole = ordering.exact_quantiles(df, {"v": F.col("v")}, [0.25]).collect()
    assert whole[0][0] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ordering.exact_quantiles(df, {"v": F.col("v")}, [0.5]).collect()[0][0] is None


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 23, 101])
def test_scores_match_quintiles_of_first_ranks(spark, n):
    rng = random.Random(n)
    rows = [(f"c{i:03d}", rng.randint(0, 30), rng.randint(1, 3), float(rng.randint(1, 9))) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id string, recency int, frequency int, monetary double")
    got = {r["customer_id"]: (r["R_score"], r["F_score"], r["M_score"]) for r in rfm_scores(df).collect()}
    if n == 1:
        assert got == {"c000": (5, 1, 1)}
        return
    pdf = pd.DataFrame(rows, columns=["id", "r", "f", "m"]).sort_values("id")
    cut = lambda c, labels: pd.qcut(pdf[c].rank(method="first"), 5, labels=labels).astype(int)
    want = dict(zip(pdf["id"], zip(cut("r", [5, 4, 3, 2, 1]), cut("f", [1, 2, 3, 4, 5]), cut("m", [1, 2, 3, 4, 5]))))
    assert got == want


def test_expand_copies_spreads_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_COPIES_PER_BLOCK", 10)
    df = spark.createDataFrame([("hot", 95), ("cold", 1), ("two", 2)], "k string, n long")
    out = ordering.expand_copies(df, "n", "i")
    rows = sorted((r["k"], r["i"]) for r in out.collect())
    assert rows == sorted([("hot", i) for i in range(95)] + [("cold", 0), ("two", 0), ("two", 1)])
    parts = out.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in found.split("\n") if "shuffle_" in name}


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("customer_id"), F.col("id").alias("x"))
    before = shuffle_files(spark)
    total = stage(rows.groupBy("customer_id").agg(F.sum("x").alias("total")), "sums")
    counted = with_distinct_counts(total, rows, {"different": F.col("x")})
    for _ in range(100):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert counted.agg(F.count("*"), F.sum("different"), F.sum("total")).first() == (700, 5000, sum(range(5000)))
