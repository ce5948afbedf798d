"""Exact ranks, running totals and quantiles over data of any size.

A window without ``PARTITION BY`` would pull every row into one task.  Here
the rows are range-sorted over all tasks, staged with their position, and
only one row per task (its row count or its weight) is summed centrally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cartloom.functions.scalars import with_row
from cartloom.functions.staging import stage

_SEQ, PART, LOCAL = "_seq", "_part", "_local"
_LOCAL_BITS = 33
_COPIES_PER_BLOCK = 100_000


def sorted_stage(df: DataFrame, keys: Sequence[Column], label: str) -> DataFrame:
    """Range-sort on ``keys`` and stage with (part, position in part)."""
    ordered = df.orderBy(*keys).withColumn(_SEQ, F.monotonically_increasing_id())
    return (
        stage(ordered, label)
        .withColumn(PART, F.shiftright(_SEQ, _LOCAL_BITS))
        .withColumn(LOCAL, F.col(_SEQ).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop(_SEQ)
    )


def _before(per_part: DataFrame, amount: str) -> DataFrame:
    """Total of all earlier parts; one row per sort task, so a plain window is bounded."""
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(PART, F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias("_offset"))


def global_rank(df: DataFrame, keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the order of ``keys``."""
    staged = sorted_stage(df, keys, "rank")
    sizes = staged.groupBy(PART).agg(F.count(F.lit(1)).alias("_size"))
    return (
        staged.join(F.broadcast(_before(sizes, "_size")), PART)
        .withColumn(name, F.col("_offset") + F.col(LOCAL) + F.lit(1))
        .drop(PART, LOCAL, "_offset")
    )


def _accumulated(staged: DataFrame, weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` over all rows of a sorted stage that come before each row."""
    sizes = staged.groupBy(PART).agg(F.sum(weight).alias("_size"))
    inside = Window.partitionBy(PART).orderBy(LOCAL).rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(F.broadcast(_before(sizes, "_size")), PART)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop(PART, LOCAL, "_offset", "_inside")
    )


def running_total(df: DataFrame, keys: Sequence[Column], weight: str, name: str = "before") -> DataFrame:
    """Add the sum of ``weight`` over all rows that sort before this one.

    Feed it grouped rows: each sort task then walks its own short run.
    """
    return _accumulated(sorted_stage(df, keys, "running"), weight, name)


def value_frequencies(
    df: DataFrame, columns: dict[str, Column], by: Sequence[str] = (), value_type: str = "double"
) -> DataFrame:
    """Rows (by.., metric, value, copies) of every non-null value, counted once.

    Counting is combined before the shuffle, so a value that fills a third of
    the table still reaches the shuffle as one row per task.
    """
    pairs = [
        F.struct(F.lit(name).alias("metric"), c.cast(value_type).alias("value")) for name, c in columns.items()
    ]
    return (
        df.select(*by, F.explode(F.array(*pairs)).alias("_pair"))
        .select(*by, "_pair.metric", "_pair.value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "metric", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles, one row per ``by`` group (one row in all without).

    Columns are named ``<metric>_q<i>`` for the i-th probability.  ``by`` must
    be a label with a fixed, small set of values (segments, bands, clusters).
    """
    group = [*by, "metric"]
    staged = sorted_stage(
        value_frequencies(df, columns, by), [F.col(c) for c in (*group, "value")], "quantiles"
    )
    counted = _accumulated(staged, "copies", "before")
    # One row per group and metric, so a plain window over them is bounded.
    earlier = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    extents = (
        staged.groupBy(*group)
        .agg(F.sum("copies").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    placed = counted.join(F.broadcast(extents), group).withColumn(
        "_first", F.col("before") - F.col("_start")
    )
    picks, outs = [], [F.col(c) for c in by]
    for name in columns:
        mine = F.col("metric") == F.lit(name)
        picks.append(F.max(F.when(mine, F.col("_n"))).alias(f"{name}_n"))
        for i, p in enumerate(probs):
            target = F.lit(float(p)) * (F.col("_n") - F.lit(1)).cast("double")
            for side, position in (("lo", F.floor(target)), ("hi", F.ceil(target))):
                covers = (F.col("_first") <= position) & (position < F.col("_first") + F.col("copies"))
                picks.append(F.max(F.when(mine & covers, F.col("value"))).alias(f"{name}_{side}{i}"))
            target = F.lit(float(p)) * (F.col(f"{name}_n") - F.lit(1)).cast("double")
            low, high = F.col(f"{name}_lo{i}"), F.col(f"{name}_hi{i}")
            outs.append((low + (high - low) * (target - F.floor(target))).alias(f"{name}_q{i}"))
    grouped = placed.groupBy(*by).agg(*picks) if by else placed.agg(*picks)
    return grouped.select(*outs)


def bucket_scores(
    df: DataFrame, key: str, metrics: dict[str, str], buckets: int = 5
) -> DataFrame:
    """Equal-count bucket (1..buckets) of each metric's first-come rank.

    Ties rank in the order of ``key``.  Row r of n falls in bucket
    ``max(1, ceil(buckets*(r-1)/(n-1)))``; only the rows sitting on the bucket
    limits are looked up, and every customer is then compared with those few
    limits in place, without moving the customer table.
    """
    rows = df.count()
    # exact numbers are compared as such, any others as doubles
    kinds = [df.select(c).schema[0].dataType for c in metrics.values()]
    kind = "double" if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds) else "decimal(38,4)"
    limits = sorted({(b, b * (rows - 1) // buckets) for b in range(1, buckets)})
    pairs = [
        F.struct(F.lit(i).alias("metric"), F.col(c).cast(kind).alias("value"))
        for i, c in enumerate(metrics.values())
    ]
    narrow = df.select(F.explode(F.array(*pairs)).alias("_p"), F.col(key).alias("_key")).select(
        "_p.metric", "_p.value", "_key"
    )
    ranked = global_rank(narrow, [F.col("metric"), F.col("value"), F.col("_key")], "_rank")
    place = F.col("_rank") - F.lit(1) - F.col("metric") * F.lit(rows).cast("bigint")
    picks = []
    for i in range(len(metrics)):
        for b, position in limits:
            hit = (F.col("metric") == i) & (place == position)
            picks.append(F.max(F.when(hit, F.struct("value", "_key"))).alias(f"_limit_{i}_{b}"))
    wanted = ranked.where(place.isin([p for _, p in limits] or [0]))
    out = df.transform(with_row, wanted.agg(*picks))
    for i, (name, column) in enumerate(metrics.items()):
        mine = F.struct(F.col(column).cast(kind).alias("value"), F.col(key).alias("_key"))
        score = F.lit(1)
        for b, _ in limits:
            score = score + F.when(mine > F.col(f"_limit_{i}_{b}"), 1).otherwise(0)
        out = out.withColumn(name, score)
    return out.drop(*[f"_limit_{i}_{b}" for i in range(len(metrics)) for b, _ in limits])


def task_count(df: DataFrame) -> int:
    """Tasks of a shuffle that must stay spread although its rows are few."""
    spark = df.sparkSession
    wanted = spark.conf.get("spark.sql.shuffle.partitions") or ""
    return max(int(wanted) if wanted.isdigit() else 0, spark.sparkContext.defaultParallelism)


def expand_copies(df: DataFrame, copies: str, ordinal: str) -> DataFrame:
    """Repeat each row ``copies`` times with ordinal 0..copies-1.

    A row with very many copies is first cut into blocks that are spread over
    the cluster, so no task writes out a whole hot group.  The number of tasks
    is given, because the small blocks would otherwise be merged into one.
    """
    rest = [c for c in df.columns if c != copies]
    last_block = F.floor((F.col(copies) - 1) / F.lit(_COPIES_PER_BLOCK)).cast("bigint")
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    start = F.col("_block") * F.lit(_COPIES_PER_BLOCK)
    end = F.least(start + F.lit(_COPIES_PER_BLOCK), F.col(copies)) - F.lit(1)
    return (
        blocks.repartition(task_count(df), *rest, "_block")
        .withColumn(ordinal, F.explode(F.sequence(start, end)))
        .drop("_block", copies)
    )
