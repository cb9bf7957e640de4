"""The filter audit against a walk through all orders, document by document."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, mask string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def walk(docs, labels):
    firsts = {}
    for i, t, *_ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and i > firsts[t],
        }
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        shapley, of_part = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, x in enumerate(order):
                gone = [r for r in left if r[1][x]]
                redundant = sum(r[1][x] for r in rows if r[0] == part) - len(gone)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                left = [r for r in left if not r[1][x]]
                shapley[x] += len(gone)
                of_part.append([part, "".join(order), k + 1, len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in of_part]
    return sorted(out)


def table():
    r = random.Random(11)
    long = [" ".join(f"w{r.randint(0, m)}" for _ in range(r.randint(150, 260))) for m in (40, 400, 400, 400)]
    texts = [None, "", " \n", "SHOUT", "a # b", "é" * 50 + "AB", *long, *long, long[1] + " $", long[2].upper(), "word " * 90_000]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate([*texts, *texts, *texts[6:10] * 5])]
    rows += [(3, texts[7], "en"), (3, texts[7], "en"), (3, texts[7], "fr"), (None, texts[7], "en"), (None, None, None), (0, None, "de")]
    return [(*x, "clash", 5) for x in rows]


def test_filter_audit(spark):
    rows = table()
    labels = [(i, (i % 3) - 1 if i % 5 else None, i % 2) for i in range(0, 30)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == walk(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
    unlabelled = filter_audit.audit(spark.createDataFrame([(1, "a", None, None, None)], DOCS), labels).collect()
    assert len(unlabelled) == 600 and {r["part"] for r in unlabelled} == {""} and sum(r["good_lost"] for r in unlabelled) == 0


@pytest.mark.parametrize("n", [1, 3])
def test_parity_sums_give_back_the_cells(spark, n):
    counts = {m: 7 * m * m + 3 for m in range(1 << n)}
    rows = spark.createDataFrame([("p", m % 2 == 0, False, m, c) for m, c in counts.items()], "part string, good boolean, toxic boolean, mask int, n bigint")
    cells = filter_audit.cells(filter_audit.parity_sums(rows, n), n)
    got = cells.first()
    assert got["all"] == list(counts.values()) and got["good"] == [c if m % 2 == 0 else 0 for m, c in counts.items()] and got["toxic"] == [0] * (1 << n)
    steps = filter_audit.orders(cells, "XYZ"[:n]).groupBy("filter_order").agg(F.sum("removed").alias("removed"), F.min("kept").alias("kept")).collect()
    assert all(r["removed"] + r["kept"] == sum(counts.values()) and r["kept"] == counts[0] for r in steps)
