"""Exact sums, lookups, padding and pooling against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import routing as R
from millrace.operators import encoder, exact, joins, routing
from millrace.sources import readers

TINY, HUGE = 5e-324, 1.7e308


def lists():
    r = random.Random(2)
    wild = [r.uniform(-1, 1) * 2.0 ** r.randint(-1060, 1000) for _ in range(300)]
    return {
        "cancels": [1e16, 1.0, -1e16, 1e-16, 3.0], "tenths": [0.1] * 10, "tiny": [TINY, TINY, -2 * TINY, 3 * TINY], "huge": [HUGE, -HUGE, 1.0], "zero": [0.0, -0.0], "wild": wild,
        "wild_both": wild + [-x for x in wild] + [math.pi], "powers": [2.0**k for k in range(-1074, 1000, 7)] + [-(2.0**k) * (1 - 2**-53) for k in range(-900, 1000, 7)], "one": [0.3],
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_sums_equal_fsum(spark, seed):
    rows = [(k, x) for k, xs in lists().items() for x in xs] + [("none", None), ("tenths", None), (None, 2.5)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(7 * seed - 6)
    got = {r["k"]: (r["s"], r["t"]) for r in exact.exact_sums(df, ["k"], {"s": F.col("x"), "t": -F.col("x")}).collect()}
    want = {k: math.fsum(xs) for k, xs in lists().items()} | {None: 2.5}
    assert got == {k: (s, -s) for k, s in want.items()} | {"none": (None, None)}


def test_exact_sums_refuse_what_is_not_finite(spark):
    for bad in (math.nan, math.inf, -math.inf):
        with pytest.raises(Exception, match="not finite"):
            exact.exact_sums(spark.createDataFrame([("a", 1.0), ("a", bad)], "k string, x double"), ["k"], {"s": F.col("x")}).collect()
    assert exact.exact_sums(spark.createDataFrame([], "k string, x double"), ["k"], {"s": F.col("x")}).count() == 0


def test_mean_nll_is_fsum(spark):
    xs = [-0.1] * 10 + [-1e-17, -3e15]
    df = spark.createDataFrame([([1], list(range(12)), [0.0, *xs]), ([1], [2], [0.0, math.inf]), ([1], [2], [0.0])], "p array<bigint>, t array<bigint>, lp array<double>")
    got = [r["m"] for r in df.select(R.mean_target_nll(F.col("p"), F.col("t"), F.col("lp")).alias("m")).collect()]
    assert got == [math.fsum(-x for x in xs) / 12, None, None]


def test_epoch_and_validation_means(spark):
    train = [(e, x, n) for e, xs in {1: [1e16, 1.0, -1e16], 2: [0.1] * 10}.items() for x, n in zip(xs, [2, 1, 2, 1, 1, 1, 1, 1, 1, 1], strict=False)] + [(3, 1.0, 0)]
    df = spark.createDataFrame(train, "e int, x double, n long").repartition(5)
    got = {r["e"]: (r["mean"], r["updates"], r["samples"], r["validation_recorded"]) for r in routing.epoch_means(df, spark.createDataFrame([(2,)], "e int"), "e", "x", "n").collect()}
    assert got == {1: (0.2, 3, 5, False), 2: (math.fsum(x * n for e, x, n in train if e == 2) / 12, 10, 12, True), 3: (None, 1, 0, False)}
    batches = spark.createDataFrame([(1, 0.5, 3, 0.5, 4), (1, 1.5, 1, 0.25, 4), (2, 0.0, 0, 0.0, 0)], "epoch int, loss double, top1_correct long, routing_regret_sum double, batch_samples long")
    got = {r["epoch"]: tuple(r)[1:] for r in routing.validation_means(batches).collect()}
    assert got == {1: (1.0, 0.5, 0.09375, 8), 2: (None, None, None, 0)}


def test_repeated_scores_make_no_pair(spark):
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (2, "a", 1.0), (2, "b", 3.0), (3, "a", 1.0), (4, "a", None), (4, "b", 1.0), (5, "a", 1.0), (5, "b", 2.0), (5, "c", 9.0)], "id int, expert_id string, loss double")
    got = {r["id"]: r["expert_losses"] for r in routing.paired_losses(spark.range(9).selectExpr("int(id) AS id"), scores, ["b", "a"]).collect()}
    assert got == {1: [2.0, 1.0], 5: [2.0, 1.0]}


def test_soft_targets_are_of_finite_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, math.inf],), ([math.nan, 1.0],), ([1.0, None],)], "l array<double>")
    got = [r["t"] for r in df.select(R.soft_targets(F.col("l"), 1.0).alias("t")).collect()]
    assert got[0] == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e)]) and got[1:] == [None] * 3
    for t in (0, -1, math.inf, math.nan):
        with pytest.raises(ValueError, match="temperature"):
            R.soft_targets(F.col("l"), t)


def test_lookup_with_a_hot_id(spark):
    r = random.Random(1)
    table = {i: [float(i), -float(i)] for i in range(50)}
    ids = {k: [7 if r.random() < 0.4 else r.randint(0, 49) for _ in range(r.randint(1, 40))] for k in range(60)} | {100: [], 101: None, 102: [3, 77], 103: [None, 1], 104: [7]}
    rows = spark.createDataFrame(list(ids.items()), "k int, ids array<int>")
    vectors = spark.createDataFrame([(*x, "clash") for x in table.items()], "token int, vector array<double>, k string")
    got = {x["k"]: (x["vectors"], x["problem"]) for x in encoder.looked_up(rows, vectors, "k", "ids", "token", "vector").collect()}
    assert got == {k: (None, "token_out_of_range") if v and not set(v) <= set(table) else ([table[i] for i in v or []], None) for k, v in ids.items()}


def test_join_by_counts(spark):
    rows = [(i, 5 if i % 3 else None if i % 2 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k int")
    facts = spark.createDataFrame([(k, k * 2) for k in range(0, 400, 5)], "k int, twice int")
    got = sorted((r["i"], r["twice"]) for r in joins.join_by_counts(df, facts, "k").collect())
    assert got == [(i, 2 * k if k is not None and k % 5 == 0 else None) for i, k in rows]
    assert joins.join_by_counts(df.where("k < 0"), facts, "k").count() == 0


def test_large_tables_are_not_broadcast(spark):
    many = spark.range(50)
    assert "ResolvedHint" not in joins.sent(many, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in joins.sent(many, 50)._jdf.queryExecution().analyzed().toString()


def test_batches_are_padded_to_their_own_width(spark):
    ids = {3: [1, 2, 3], 1: [4], 5: [6] * 9, 4: [], 9: [7]}
    got = {r["k"]: (r["batch"], r["padded"], r["mask"]) for r in encoder.padded_batches(spark.createDataFrame(list(ids.items()), "k long, ids array<bigint>"), "k", "ids", 2).collect()}
    assert got == {
        1: (0, [4, 0, 0], [True, False, False]), 3: (0, [1, 2, 3], [True] * 3), 4: (1, [0] * 9, [False] * 9), 5: (1, [6] * 9, [True] * 9), 9: (2, [7], [True]),
    }


@pytest.mark.parametrize(("cut", "fan_in", "levels"), [(1, 2, 2), (3, 2, 3), (128, 128, 2), (1000, 2, 0)])
def test_pooling_is_the_same_for_any_cut(spark, cut, fan_in, levels):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.normal() * 40 + 500 * (k == 1)), rng.normal(size=5).tolist()) for k, n in ((0, 97), (1, 200), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, at int, z double, v array<double>").repartition(6)
    got = {r["k"]: r["pooled"] for r in encoder.softmax_pool(df, ["k"], "at", "z", "v", cut, fan_in, levels).collect()}
    for k in range(3):
        z, v = np.array([r[2] for r in rows if r[0] == k]), np.array([r[3] for r in rows if r[0] == k])
        w = np.exp(z - z.max())
        assert got[k] == pytest.approx((w @ v / w.sum()).tolist(), abs=1e-12)


def test_configs(tmp_path):
    good = tmp_path / "c.json"
    good.write_text('{"hidden_dim": 4, "rate": 0.5, "names": ["a"]}')
    kinds = {"hidden_dim": int, "rate": float, "names": list}
    assert readers.config(str(good), kinds) == {"hidden_dim": 4, "rate": 0.5, "names": ["a"]}
    for text in ('{"hidden_dim": 4.0, "rate": 0.5, "names": []}', '{"hidden_dim": true, "rate": 0.5, "names": []}', '{"rate": 0.5, "names": []}', '{"hidden_dim": 1, "rate": 0.5, "names": [], "more": 1}'):
        good.write_text(text)
        with pytest.raises(ValueError, match="wrong or unknown"):
            readers.config(str(good), kinds)
