"""Ordered work by ranges: the same as a plain loop, with 1 and with 64 partitions, and with one key that most rows have."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, ordered, routing


def rows(seed=1, n=400):
    r = random.Random(seed)
    steps = r.sample(range(10 * n), n)
    return [(i, r.choice(["hot"] * 8 + ["a", "b", None]), s, r.randint(0, 64) / 8, r.randint(0, 5)) for i, s in enumerate(steps)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture
def df(spark, data):
    return spark.createDataFrame(data, "id long, k string, at long, x double, y int").repartition(5)


def by_key(data):
    out = {}
    for row in sorted(data, key=lambda r: r[2]):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("partitions", [1, 64])
def test_numbers_windows_and_frames(df, data, partitions):
    got = {r["id"]: r["rn"] for r in ordered.numbered(df, ["at"], ["k"], partitions=partitions).collect()}
    assert got == {r[0]: i + 1 for own in by_key(data).values() for i, r in enumerate(own)}
    got = {r["id"]: r["rn"] for r in ordered.numbered(df, ["at"], partitions=partitions).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: r[2]))}
    got = {r["id"]: r["window"] for r in routing.count_windows(df, "at", 4, "k", partitions=partitions).collect()}
    assert got == {r[0]: i // 24 for own in by_key(data).values() for i, r in enumerate(own)}
    got = {r["id"]: r["trailing_mean"] for r in routing.trailing_mean(df, "x", "at", "k", 7, partitions=partitions).collect()}
    want = {r[0]: float(sum(Fraction(o[3]) for o in own[max(0, i - 6) : i + 1]) / min(i + 1, 7)) for own in by_key(data).values() for i, r in enumerate(own)}
    assert got == pytest.approx(want)
    got = {r["id"]: r["previous"] for r in routing.not_increasing(df, "y", "at", "k", partitions=partitions).collect()}
    assert got == {b[0]: a[4] for own in by_key(data).values() for a, b in zip(own, own[1:], strict=False) if b[4] <= a[4]}


def test_small_blocks_carry_what_they_need(df, data):
    columns = {"s": (F.sum("y"), -9, 0), "first": (F.first("id"), -9, -9)}
    got = {r["id"]: (r["s"], r["first"]) for r in ordered.over_rows_before(df, ["at"], ["k"], 9, columns, partitions=3, block=10).collect()}
    assert got == {r[0]: (sum(o[4] for o in own[max(0, i - 9) : i + 1]), own[i - 9][0] if i >= 9 else None) for own in by_key(data).values() for i, r in enumerate(own)}


def test_no_task_holds_a_key(df):
    hot = df.where("k = 'hot'")
    sizes = [r["n"] for r in ordered.in_ranges(hot, "k", "at", partitions=16).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < hot.count() / 4


@pytest.mark.parametrize("partitions", [1, 64])
def test_latest(spark, df, data, partitions):
    r = random.Random(3)
    times = [row[2] for row in data]
    epochs = [(e, r.choice(times) + r.choice([-1, 0, 1])) for e in range(1, 300)] + [(999, None)]
    facts = spark.createDataFrame(epochs, "epoch long, at long")
    out = routing.snapshot_at(df, facts, "id", "at", partitions)
    known = sorted((t, e) for e, t in epochs if t is not None)
    want = {row[0]: max(((t, e) for t, e in known if t <= row[2]), default=(None, None))[1] for row in data}
    assert {x["id"]: x["epoch"] for x in out.collect()} == want and None in want.values()
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {x["epoch"] for x in routing.snapshot_at(df, facts.where("epoch < 0"), "id", "at", partitions).collect()} == {None}
    assert routing.snapshot_at(df.where("id < 0"), facts, "id", "at", partitions).count() == 0


def test_latest_at_one_moment(spark):
    """All rows at the same time, and epochs then."""
    df = spark.range(100).withColumn("at", F.lit(5))
    facts = spark.createDataFrame([(1, 4), (2, 5), (3, 5), (4, 6)], "epoch long, at int")
    assert {r["epoch"] for r in ordered.latest(df, facts, "at", "epoch", "id", 8).collect()} == {3}


@pytest.mark.parametrize("partitions", [1, 64])
def test_round_robin(spark, partitions):
    replicas = spark.createDataFrame([("f", "e", p, f"{p}{k}", c, s) for p, k, c, s in [("a", 1, 9, "READY"), ("a", 2, 20, "READY"), ("b", 1, 20, "READY"), ("b", 2, 20, "DOWN"), ("c", 1, 30, "READY")]],
                                     "model_family string, expert_id string, pool_id string, replica_id string, max_context_tokens long, state string")
    asked = [(i, "f", "e" if i % 7 else "other", (i * 7) % 33) for i in range(200)]
    requests = spark.createDataFrame(asked, "id long, model_family string, expert_id string, needed long").repartition(3)
    ready = [r.asDict() for r in replicas.where("state = 'READY'").collect()]
    turns, own, want = 0, {}, {}
    for i, _, e, needed in asked:
        pools = {}
        for r in ready:
            if r["expert_id"] == e and r["max_context_tokens"] >= needed:
                pools.setdefault(r["pool_id"], []).append(r["replica_id"])
        if pools:
            pool = sorted(pools)[turns % len(pools)]
            turns += 1
            want[i] = sorted(pools[pool])[own.get(pool, 0) % len(pools[pool])]
            own[pool] = own.get(pool, 0) + 1
    assert {r["id"]: r["replica_id"] for r in routing.round_robin(requests, replicas, "id", "id", partitions).collect()} == want


def test_pilot_takes_first_longest_rest(df, data):
    got = {}
    for r in corpus.pilot_order(df.where("k IS NOT NULL"), "k", "y", "at", 6).collect():
        got.setdefault(r["k"], {})[r["rn"]] = r["id"]
    for k, own in by_key(data).items():
        if k is not None:
            longest = max(own, key=lambda r: (r[4], -r[2]))
            queue = [own[0]] + [r for r in [longest] if r is not own[0]] + [r for r in own[1:] if r is not longest]
            assert got[k] == {i + 1: r[0] for i, r in enumerate(queue[:6])}
