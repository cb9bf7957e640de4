"""Vector codes against a plain Lloyd loop in whole numbers."""

import hashlib
import math
import random

import pytest

from millrace.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, pos int, part string, code string"


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, _, lab), c in zip(kept, cut, strict=True):
        each = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in each], sum(d for d, _ in each)))
    return out, books


def vectors(n, dim=16, seed=4):
    r = random.Random(seed)
    hot = [r.choice([-0.5, 0.25, 0.125]) for _ in range(dim)]
    rows = [(r.randint(0, 3 * n), [r.choice([-1, 1]) * r.randint(0, 40) / 64 for _ in range(dim)] if k % 3 else hot, r.choice([None, 0, 1, 2])) for k in range(n)]
    bad = [(1, None, 1), (2, [], 1), (3, [None] + hot[1:], 1), (4, [math.nan] + hot[1:], 1), (5, hot[:-1] + [math.inf], None), (6, hot[:-1] + [-math.inf], None)]
    return rows + rows[:5] + rows[:2] + bad + [(None, hot, None), (0, hot, None)]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(300, 8, 16, 6), (9, 8, 16, 6), (60, 2, 5, 2), (60, 1, 1, 0)])
def test_against_plain_lloyd(spark, n, parts, entries, rounds):
    rows = vectors(n)
    df = spark.createDataFrame([(*r, "i", 1, "p", "c") for r in rows], SCHEMA).repartition(6)
    got = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, books = lloyd(rows, parts, entries, rounds)
    assert got.codebooks == books
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])
    assert sorted(map(tuple, got.rows.collect()), key=key) == sorted(want, key=key)
    assert got.fingerprint() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    out = vector_codes.with_label_error(got.rows).collect()
    assert len(out) == len(want) and all(r["label_error"] == sums[r["label"]] for r in out)


def test_nothing(spark):
    got = vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 1, "", "")], SCHEMA))
    assert got.codebooks == [] and vector_codes.with_label_error(got.rows).collect() == []


@pytest.mark.parametrize("bad", [[0.5] * 9, [0.5] * 8, [1e9] * 16])
def test_vectors_that_do_not_fit_are_errors(spark, bad):
    df = spark.createDataFrame([(1, [0.5] * 16, 1), (2, bad, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="different lengths|no multiple"):
        vector_codes.compress(df).rows.collect()


def test_hex_codes(spark):
    got = spark.createDataFrame([([0, 15, 16, 255],), ([],)], "codes array<int>").select(vector_codes.hex_code("codes").alias("h")).collect()
    assert [r["h"] for r in got] == ["000f10ff", ""]


def test_join_counted_keeps_every_row(spark):
    rows = [(None, i) for i in range(500)] + [(1, i) for i in range(300)] + [(k, k) for k in range(2, 200)]
    df = spark.createDataFrame(rows, "k int, v int")
    facts = df.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice")
    got = vector_codes.join_counted(df, facts, ["k"], "n", len(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((k, v, None if k is None else 2 * k) for k, v in rows), key=key)
