"""Channel credit of conversions over observed touches.

A conversion shares its revenue among the customer's touches up to that
moment.  Pairing every conversion with every touch would square a busy
customer's rows, so each model is a scan along one timeline.

Touches and conversions are range-sorted by (customer, time, kind, id) and staged;
a customer with most of the rows is spread over many parts, however close
together the rows are.  Running values are built inside each part.  Only
the customers that reach over the edge of a part need anything from before
it: there are no more of them than parts, and what they bring along is one row
for each (customer, part, channel), which enters the next parts like a touch
before all others.  No row is moved by its customer alone.

Decay.  The weight of a touch halves with every half-life of age, so the weights
of one conversion's touches stand to each other as 2^(ts/h).  Time is
cut into epochs of ``EPOCH`` half-lives; a touch weighs 2^(time since its
epoch began / h), which a double holds, and the sum of one epoch is scaled by
2^(-EPOCH) to stand beside the next.  What lies two epochs before a channel's last touch is
below the precision of a double.  Nothing is clamped: shares depend on the
touches up to the conversion only, however old they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.functions.numeric import MICROS_PER_DAY, ratio, round_even
from cartloom.functions.ordering import LOCAL, PART, sorted_stage
from cartloom.functions.scalars import with_row

HALF_LIFE_DAYS = 7.0
#: Half-lives in one epoch; 2^512 times the number of touches is far inside a double.
EPOCH = 512
MODELS = ("last_touch", "first_touch", "linear", "time_decay")
_BEFORE = [Window.unboundedPreceding, Window.currentRow]


def _timeline(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """Touches and paid conversions in order, staged; a touch precedes a conversion of the same instant."""
    left = touches.where(F.col("customer_id").isNotNull() & F.col("ts").isNotNull()).select(
        "customer_id", "ts", F.lit(0).alias("_kind"), F.col("touch_id").alias("_id"), "channel",
        F.lit(None).cast(conversions.schema["revenue"].dataType).alias("revenue"),
    )
    right = conversions.where(
        F.col("customer_id").isNotNull() & F.col("ts").isNotNull() & (F.col("revenue") > 0)
    ).select(
        "customer_id", "ts", F.lit(1).alias("_kind"), F.col("conversion_id").alias("_id"),
        F.lit(None).cast("string").alias("channel"), "revenue",
    )
    return sorted_stage(left.unionByName(right), [F.col(c) for c in ("customer_id", "ts", "_kind", "_id")], "timeline")


def _in_order(frame: DataFrame) -> Window:
    return Window.orderBy(PART)


# -- shares ---------------------------------------------------------------------------
def _reach(timeline: DataFrame) -> DataFrame:
    """(customer_id, _last): customers with rows in several parts and the last of them; fewer than parts."""
    edges = timeline.groupBy(PART).agg(F.min("customer_id").alias("low"), F.max("customer_id").alias("high"))
    ends = edges.select(PART, F.explode(F.array("low", "high")).alias("customer_id"))
    return ends.groupBy("customer_id").agg(F.min(PART).alias("_first"), F.max(PART).alias("_last")).where("_first < _last").drop("_first")


def _brought_along(touches: DataFrame, reach: DataFrame) -> DataFrame:
    """What earlier parts hand to each part: (part, customer, channel, epoch, weight), in rows of the shape of touches.

    A sum stands until the same epoch or one that makes it vanish comes up in a
    later part; the last sums of a channel stand to the customer's last part.
    """
    sums = (
        touches.join(F.broadcast(reach), "customer_id")
        .groupBy("customer_id", "channel", "_epoch", PART)
        .agg(F.sum("_weight").alias("_own"), F.first("_last").alias("_last"))
    )
    here = Window.partitionBy("customer_id", "channel", "_epoch").orderBy(PART)
    far = Window.partitionBy("customer_id", "channel").orderBy("_epoch").rangeBetween(2, Window.unboundedFollowing)
    until = F.least(F.coalesce(F.lead(PART).over(here), F.col("_last")), F.coalesce(F.min(PART).over(far), F.col("_last")), F.col("_last"))
    standing = sums.withColumn("_weight", F.sum("_own").over(here.rowsBetween(*_BEFORE))).withColumn("_until", until)
    return standing.where(F.col("_until") > F.col(PART)).select(
        F.explode(F.sequence(F.col(PART) + 1, F.col("_until"))).alias(PART), F.lit(-1).cast("bigint").alias(LOCAL),
        "customer_id", "channel", "_epoch", "_weight",
    )


def _shares(timeline: DataFrame, epoch: Column, weight: Column, fade: float) -> DataFrame:
    """Credit in proportion to the weight each channel has gathered before the conversion.

    ``weight`` is relative to the touch's ``epoch``; an epoch before counts ``fade`` times.
    """
    key = [PART, "customer_id"]
    touches = timeline.where((F.col("_kind") == 0) & F.col("channel").isNotNull()).select(
        PART, LOCAL, "customer_id", "channel", epoch.alias("_epoch"), weight.alias("_weight")
    )
    touches = touches.unionByName(_brought_along(touches, _reach(timeline)))
    known = touches.select(*key, "channel").distinct()
    paid = timeline.where("_kind = 1").select(*key, LOCAL, F.col("_id").alias("conversion_id"), "revenue")
    asked = paid.join(known, key)
    # One exchange serves every window below: a part of a customer is never larger than a part.
    rows = touches.unionByName(asked, allowMissingColumns=True).repartition(*key)
    channel = Window.partitionBy(*key, "channel")
    # the epoch of a conversion is that of the channel's last touch
    rows = rows.withColumn("_epoch", F.max("_epoch").over(channel.orderBy(LOCAL).rowsBetween(*_BEFORE)))
    same = Window.partitionBy(*key, "channel", "_epoch").orderBy(LOCAL).rowsBetween(*_BEFORE)
    previous = channel.orderBy("_epoch").rangeBetween(-1, -1)
    rows = rows.withColumn("_sum", F.sum("_weight").over(same) + F.coalesce(F.sum("_weight").over(previous), F.lit(0.0)) * F.lit(fade))
    rows = rows.where("revenue is not null and _epoch is not null")
    conversion = Window.partitionBy(*key, "conversion_id", LOCAL)
    apart = F.max("_epoch").over(conversion) - F.col("_epoch")
    rows = rows.withColumn("_sum", F.col("_sum") * F.pow(F.lit(fade), apart.cast("double")))
    return rows.select(
        "conversion_id", "customer_id", "channel",
        (F.col("revenue").cast("double") * F.col("_sum") / F.sum("_sum").over(conversion)).alias("credit"),
    )


def linear(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    return _shares(_timeline(touches, conversions), F.lit(0).cast("bigint"), F.lit(1.0), 1.0)


def time_decay(touches: DataFrame, conversions: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Weight halves with every half-life of age.

    Every channel touched up to the conversion has a row; after very many half-lives without a
    touch its credit is 0.
    """
    micros = MICROS_PER_DAY * half_life_days
    length = max(1, min(1 << 62, round(EPOCH * micros)))
    at, span = F.unix_micros("ts"), F.lit(length).cast("bigint")
    # whole numbers up to the last division, so the weight is as exact as a double can be
    weight = F.pow(F.lit(2.0), F.pmod(at, span).cast("double") / F.lit(float(micros)))
    epoch = F.expr(f"(unix_micros(ts) - pmod(unix_micros(ts), {length})) div {length}")
    return _shares(_timeline(touches, conversions), epoch, weight, 2.0 ** (-length / micros))


# -- single touches -----------------------------------------------------------------------
def _carried_touch(timeline: DataFrame, first: bool) -> DataFrame:
    """(part, customer, _old): the first or last touch, in earlier parts, of the customer a part begins with; one row a part at most."""
    touch = F.when(F.col("_kind") == 0, F.struct("ts", "_id", "channel"))
    best = F.min(touch) if first else F.max(touch)
    sums = timeline.groupBy(PART, "customer_id").agg(best.alias("_touch"))
    edges = sums.groupBy(PART).agg(F.min("customer_id").alias("low"), F.max(F.struct("customer_id", "_touch")).alias("high"))
    edges = edges.select(PART, "low", F.col("high.customer_id").alias("high"), F.col("high._touch").alias("_touch"))
    # one row a part from here on, so plain windows are bounded
    along = Window.partitionBy("high").orderBy(PART).rowsBetween(*_BEFORE)
    edges = edges.withColumn("_best", (F.min if first else F.max)("_touch").over(along))
    order = Window.orderBy(PART)
    edges = edges.withColumns({"_from": F.lag("high").over(order), "_old": F.lag("_best").over(order)})
    return edges.where("_from = low").select(PART, F.col("low").alias("customer_id"), "_old")


def _whole_credit(timeline: DataFrame, first: bool) -> DataFrame:
    """The whole revenue to one touch before the conversion."""
    key = [PART, "customer_id"]
    touch = F.when(F.col("_kind") == 0, F.struct("ts", "_id", "channel"))
    window = Window.partitionBy(*key).orderBy(LOCAL).rowsBetween(*_BEFORE)
    rows = timeline.withColumn("_touch", (F.min if first else F.max)(touch).over(window)).where("_kind = 1")
    rows = rows.join(F.broadcast(_carried_touch(timeline, first)), key, "left")
    # earlier parts come first in time
    chosen = F.coalesce("_old", "_touch") if first else F.coalesce("_touch", "_old")
    return rows.withColumn("_touch", chosen).where("_touch is not null").select(
        F.col("_id").alias("conversion_id"), "customer_id", F.col("_touch.channel").alias("channel"),
        F.col("revenue").cast("double").alias("credit"),
    )


def last_touch(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    return _whole_credit(_timeline(touches, conversions), first=False)


def first_touch(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """The customer's first touch of all, where it lies before the conversion."""
    return _whole_credit(_timeline(touches, conversions), first=True)


def attribute(touches: DataFrame, conversions: DataFrame, model: str = "last_touch", **options) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"unknown attribution model {model!r}; known: {', '.join(MODELS)}")
    chosen = {"last_touch": last_touch, "first_touch": first_touch, "linear": linear, "time_decay": time_decay}
    return chosen[model](touches, conversions, **options)


def attribution_summary(credits: DataFrame) -> DataFrame:
    """Credit, conversions and share per channel."""
    per = credits.groupBy("channel").agg(
        F.sum("credit").alias("_credit"), F.count_distinct("conversion_id").alias("conversions")
    )
    everything = credits.agg(F.sum("credit").alias("_all"))
    return per.transform(with_row, everything).select(
        "channel",
        round_even("_credit", 2).alias("credit"),
        "conversions",
        round_even(ratio("_credit", "_all") * 100, 3).alias("share_pct"),
    )
