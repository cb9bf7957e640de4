"""Queries whose work must follow the rows, not the numbers in them nor the length of what rows are matched with."""

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import cleaning, corpus, groups
from millrace.plans import catalog, flows
from millrace.sources import readers
from millrace.streaming import keyed, windows


def test_scoring_order_carries_numbers(spark, tmp_path):
    """A user's number of 2e9 would be an array of as many tokens."""
    spark.createDataFrame([(1, 2_000_000_000), (2, 5), (3, 4)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["scoring_order"](spark, str(tmp_path)).collect()] == [(2, 7), (3, 7), (1, 2_000_000_001)]


def test_scoring_order_of_arrays_and_numbers(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5, i % 3) for i in range(20)], "id long, p int, t int")
    arrays = rows.select("id", F.array_repeat(F.lit(0), F.col("p")).alias("input_ids"), F.array_repeat(F.lit(0), F.col("t")).alias("target_ids"))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(corpus.scoring_order(arrays, "id")) == ids(corpus.scoring_order(rows, "id", prompt="p", target="t"))


def test_round_robin_sends_no_lists_along(spark, tmp_path):
    """Rows that are dealt carry a number of choices, so a pool of 300 replicas makes no row wider; and a large registry needs no bound."""
    replicas = spark.range(300).select(F.lit("f").alias("model_family"), F.lit("e").alias("expert_id"), F.lit("p").alias("pool_id"), F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("replica_id"), F.lit(9).alias("max_context_tokens"), F.lit("READY").alias("state"))
    asked = spark.range(700).select("id", F.lit("f").alias("model_family"), F.lit("e").alias("expert_id"), F.lit(5).cast("long").alias("needed"))
    asked.write.parquet(f"{tmp_path}/in")
    placed = keyed.round_robin(spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in"), replicas)
    exchanges = [x for x in placed._jdf.queryExecution().analyzed().toString().splitlines() if "TransformWithState" in x]
    assert exchanges and not any("replica_id" in x and "pools" in x for x in exchanges) and not [c for c in ("own", "pools") if f"{c}#" in "".join(exchanges)]
    got = {r["id"]: r["replica_id"] for r in keyed.run_keyed(placed, f"{tmp_path}/run").collect()}
    assert got == {i: f"r{i % 300:03d}" for i in range(700)}


def test_python_gets_few_bytes_at_once(spark):
    """3,000 texts of 20 KB aren't one batch any more, as they were while only rows were counted."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("é"), 10_000).alias("t"))
        assert texts.select(T.canonical(F.col("t")).alias("c")).where("length(c) = 10000").count() == 3000
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert sizes.agg(F.max("n")).first()[0] < 3 * T.BATCH_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1000)
        T.canonical(F.col("t"))
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("name", ["split_isolation_violations", "repeated_reference_audit", "record_reasons"])
def test_queries_of_canonical_texts_are_bounded(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == T.BATCH_BYTES
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_cleaning_writes_whole_records_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(cleaning, "cut", lambda df, name: tables.append(df.columns) or groups.cut(df, name))
    row = ([("user", "x y"), ("assistant", "ok")], "l1", 7, 0)
    raw = spark.createDataFrame([row, ([("user", "x y"), ("assistant", "other")], "l2", 7, 1)], readers.SCHEMAS["long"] + ", place bigint")
    marks = corpus.fingerprints(spark.createDataFrame([("m" * 50,)], "c string"), "c")
    tokens = lambda rows: rows.withColumns({"input_ids": F.array(F.lit(1).cast("long")), "target_ids": F.array(F.lit(2).cast("long"))})
    out = cleaning.clean({"long": raw}, marks, tokens, quotas={"long": 18})
    assert sum("messages" in t for t in tables) == 1
    assert [(r["source_id"], r["target_ids"]) for r in out.records.collect()] == [("l1", [2, 0])] == [(r["source_id"], r["target_ids"]) for r in out.starter.collect()]


def test_log_writers_hold_a_batch():
    """Pieces follow the batches, end inside a line or a character, and all are read."""
    batches = [pa.RecordBatch.from_pydict({"line": x}) for x in (["ab", "é"], ["c"], ["d", "e"])]
    got = list(flows._pieces(iter(batches), 6))
    assert got == ["ab\né\n".encode(), b"", b""]
    assert list(flows._pieces(iter(batches), 4)) == ["ab\né".encode()[:4], b"", b""] and b"".join(flows._pieces(iter(batches), 100)) == "ab\né\nc\nd\ne\n".encode()


def test_several_windows_a_batch(spark, tmp_path):
    """Five windows, two at a time: three batches, each window whole and in its place."""
    rows = spark.createDataFrame([(i, (i * 7) % 31) for i in range(31)], "id long, at int")
    n = windows.write_windows(rows, ["at"], f"{tmp_path}/in", batch=1)
    got = []
    stream = windows.admitted(spark, f"{tmp_path}/in", n, spark.createDataFrame([], "at int, window long").schema, at_once=2)
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, k: got.append((k, [tuple(r) for r in df.collect()]))).start()
    q.processAllAvailable()
    q.stop()
    assert n == 6 and [k for k, _ in got] == [0, 1, 2] and sorted(x for _, b in got for x in b) == [(i, i // 6) for i in range(31)]
    assert {w for _, w in got[1][1]} == {2, 3}
    with pytest.raises(ValueError, match="one window"):
        windows.admitted(spark, "x", 1, rows.schema, at_once=0)


def test_a_known_score_asks_the_store_once():
    calls = []

    class Value:
        def get(self):
            calls.append("get")
            return ("s", 3, 0.5)

    cache = keyed.ScoreCache()
    cache._score, cache._waiting = Value(), None
    rows = iter([Row(kind="request", tokens_sha256=s, target_tokens=3, loss=None) for s in "st"])
    assert [(r["state"], r["loss"]) for r in cache.handleInputRows(("e", "1"), rows, None)] == [("known", 0.5), ("tokens_differ", None)]
    assert calls == ["get"]
