"""Attribution against brute force, with one customer holding most rows."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from cartloom.operators import attribution


@pytest.fixture(scope="module")
def journeys(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    pick = lambda: 1 if rng.random() < 0.6 else rng.randint(2, 6)
    touches = [(i, pick(), start + dt.timedelta(minutes=rng.randint(0, 6000)), rng.choice(["email", "sms", "ads"])) for i in range(300)]
    paid = [(i, pick(), start + dt.timedelta(minutes=rng.randint(0, 6000)), Decimal(rng.randint(-1, 50))) for i in range(80)]
    return (
        touches, paid,
        spark.createDataFrame(touches, "touch_id long, customer_id long, ts timestamp, channel string"),
        spark.createDataFrame(paid, "conversion_id long, customer_id long, ts timestamp, revenue decimal(18,2)"),
    )


def brute(touches, paid, model):
    out = defaultdict(float)
    for cid, who, when, revenue in paid:
        seen = sorted((t, i, ch) for i, c, t, ch in touches if c == who and t <= when)
        if revenue <= 0 or not seen:
            continue
        if model == "last_touch":
            weights = [0.0] * (len(seen) - 1) + [1.0]
        elif model == "first_touch":
            weights = [1.0] + [0.0] * (len(seen) - 1)
        elif model == "linear":
            weights = [1.0] * len(seen)
        else:
            weights = [2 ** (-(when - t).total_seconds() / 86400 / 7) for t, _, _ in seen]
        for w, (_, _, ch) in zip(weights, seen):
            if w:
                out[cid, ch] += float(revenue) * w / sum(weights)
    return dict(out)


@pytest.mark.parametrize("model", attribution.MODELS)
def test_credit_equals_brute_force(journeys, model):
    touches, paid, t, c = journeys
    got = {(r["conversion_id"], r["channel"]): r["credit"] for r in attribution.attribute(t, c, model).collect()}
    want = brute(touches, paid, model)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.fixture
def parts(spark):
    """Sorted stages keep all their parts, however small, so customers reach over edges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set(name, before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def frames(spark, touches, paid):
    return (
        spark.createDataFrame(touches, "touch_id long, customer_id long, ts timestamp, channel string"),
        spark.createDataFrame(paid, "conversion_id long, customer_id long, ts timestamp, revenue decimal(18,2)"),
    )


def exact(touches, paid, half_life_days):
    """Credit with weights relative to the newest touch, so that none of them matters is lost."""
    out = {}
    for cid, who, when, revenue in paid:
        seen = [(t, ch) for _, c, t, ch in touches if c == who and t <= when]
        if revenue > 0 and seen:
            newest = max(t for t, _ in seen)
            weights = [2.0 ** max(-2000.0, (t - newest) / dt.timedelta(days=half_life_days)) for t, _ in seen]
            for w, (_, ch) in zip(weights, seen):
                out[cid, ch] = out.get((cid, ch), 0.0) + float(revenue) * w / sum(weights)
    return out


def close(credits, want):
    got = {(r["conversion_id"], r["channel"]): r["credit"] for r in credits.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


@pytest.mark.parametrize("model", attribution.MODELS)
def test_customers_over_many_parts(spark, parts, journeys, model):
    touches, paid, t, c = journeys
    got = {(r["conversion_id"], r["channel"]): r["credit"] for r in attribution.attribute(t, c, model).collect()}
    want = brute(touches, paid, model)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("model", attribution.MODELS)
def test_a_third_of_all_events_in_one_hour(spark, parts, model):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 1, 12)
    moment = lambda hot: start + (dt.timedelta(seconds=rng.randint(0, 600) * 6) if hot else dt.timedelta(hours=rng.randint(-5000, 5000)))
    touches = [(i, 7 if i % 3 == 0 else rng.randint(1, 40), moment(i % 3 == 0), rng.choice(["email", "sms", "ads", "tv"])) for i in range(900)]
    paid = [(i, 7 if i % 3 == 0 else rng.randint(1, 40), moment(i % 3 == 0), Decimal(rng.randint(1, 50))) for i in range(240)]
    close(attribution.attribute(*frames(spark, touches, paid), model), brute(touches, paid, model))


def test_a_later_touch_changes_nothing(spark, parts):
    """A touch more than a thousand half-lives after a conversion is not the conversion's business."""
    start = dt.datetime(2000, 1, 1)
    touches = [(1, 1, start, "email"), (2, 1, start + dt.timedelta(days=70), "sms")]
    paid = [(1, 1, start + dt.timedelta(days=71), Decimal(100)), (2, 1, start + dt.timedelta(days=7 * 1500), Decimal(100))]
    want = exact(touches, paid, 7)
    assert want[1, "email"] == pytest.approx(100 / 1025)
    close(attribution.time_decay(*frames(spark, touches, paid)), want)
    late = (3, 1, start + dt.timedelta(days=7 * 1400), "ads")
    credits = {(r["conversion_id"], r["channel"]): r["credit"] for r in attribution.time_decay(*frames(spark, [*touches, late], paid)).collect()}
    assert credits[1, "email"] == pytest.approx(100 / 1025) and credits[1, "sms"] == pytest.approx(100 * 1024 / 1025)
    # every channel touched has a row, 1400 half-lives later with nothing in it
    assert (credits[2, "ads"], credits[2, "email"], credits[2, "sms"]) == (100.0, 0.0, 0.0)


@pytest.mark.parametrize("half_life_days", [1 / 86400, 0.01, 0.7, 365000.0])
def test_half_lives_of_any_length(spark, parts, half_life_days):
    rng = random.Random(9)
    start = dt.datetime(1999, 12, 31)
    pick = lambda: 1 if rng.random() < 0.7 else rng.randint(2, 4)
    moment = lambda: start + dt.timedelta(seconds=rng.randint(0, 60000))
    touches = [(i, pick(), moment(), rng.choice("abc")) for i in range(400)]
    paid = [(i, pick(), moment(), Decimal(rng.randint(1, 90))) for i in range(120)]
    close(attribution.time_decay(*frames(spark, touches, paid), half_life_days=half_life_days), exact(touches, paid, half_life_days))


def test_events_are_not_joined_by_customer_alone(spark, journeys):
    for model in attribution.MODELS:
        plan = attribution.attribute(journeys[2], journeys[3], model)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Join" in line and "customer_id" in line:
                assert "_part" in line or "broadcast" in line, (model, line)


def test_nothing_to_attribute(spark, journeys):
    for model in attribution.MODELS:
        assert attribution.attribute(journeys[2].limit(0), journeys[3], model).count() == 0
        assert attribution.attribute(journeys[2], journeys[3].limit(0), model).count() == 0


def test_unknown_model(journeys):
    with pytest.raises(ValueError):
        attribution.attribute(journeys[2], journeys[3], "other")
