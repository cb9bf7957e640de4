"""Keyed state: caches that grow with their stream and counters that outlive restarts."""

import pytest

from millrace.streaming import keyed, operators

EVENTS = "expert_id string, id string, kind string, tokens_sha256 string, target_tokens long, loss double"


def stream(spark, folder, schema, files=100):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(folder))


def add(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_score_cache(spark, tmp_path):
    """Each step is a run of its own, so the query restarts between them."""
    seen = 0

    def step(*rows):
        nonlocal seen
        add(spark, tmp_path / "in", EVENTS, rows)
        out = [tuple(r) for r in keyed.run_keyed(keyed.score_cache(stream(spark, tmp_path / "in", EVENTS)), str(tmp_path / "run")).collect()]
        old, seen = seen, len(out)
        return out, len(out) - old

    ask = lambda e, i, sha="s", n=3: (e, i, "request", sha, n, None)
    score = lambda e, i, loss, sha="s", n=3: (e, i, "score", sha, n, loss)
    out, _ = step(ask("a", "1"), ask("a", "1"), ask("b", "1"), ask("a", "2"))
    assert sorted(out) == [("a", "1", "missing", None), ("a", "2", "missing", None), ("b", "1", "missing", None)]
    out, n = step(ask("a", "1"))
    assert n == 0  # still waiting, and not asked for again
    out, n = step(score("a", "1", 0.5), score("a", "1", 0.5), score("a", "2", 0.25, sha="other"), score("b", "1", -1.0))
    assert n == 3 and {("a", "1", "scored", 0.5), ("a", "2", "tokens_differ", None), ("b", "1", "loss", None)} <= set(out)
    out, n = step(ask("a", "1"), ask("a", "1", n=4), ask("a", "1", sha="t"), score("a", "1", 0.75), ask("b", "1"), score("b", "1", 2.0), score("a", "3", 1.0))
    assert n == 6  # b's request waited already
    assert {("a", "1", "known", 0.5), ("a", "1", "token_count", None), ("a", "1", "tokens_differ", None), ("a", "1", "conflict", None), ("b", "1", "scored", 2.0)} <= set(out)
    assert keyed.STORE not in {k for k, v in spark.conf.getAll.items() if v == keyed.ROCKS}


REPLICA = "model_family string, expert_id string, pool_id string, replica_id string, max_context_tokens long, state string"
ASKED = "id long, model_family string, expert_id string, needed long"


def test_round_robin_over_restarts_and_epochs(spark, tmp_path):
    """a1, h1, a2, h1 and so on, whatever the batches; a pool that moves to another expert keeps its counter."""
    first = [("f", "e", "a", "a1", 9, "READY"), ("f", "e", "a", "a2", 9, "READY"), ("f", "e", "h", "h1", 9, "READY"), ("f", "e", "h", "h2", 9, "DRAINING"), ("f", "g", "z", "z1", 9, "READY")]
    run = lambda replicas: {r["id"]: r["replica_id"] for r in keyed.run_keyed(keyed.round_robin(stream(spark, tmp_path / "in", ASKED), spark.createDataFrame(replicas, REPLICA)), str(tmp_path / "run")).collect()}
    add(spark, tmp_path / "in", ASKED, [(1, "f", "e", 5), (2, "f", "e", 5), (3, "f", "e", 99), (4, "f", "e", 5)])
    assert run(first) == {1: "a1", 2: "h1", 4: "a2"}
    add(spark, tmp_path / "in", ASKED, [(5, "f", "e", 5), (6, "f", "none", 5), (7, "f", "g", 5)])
    assert run(first) == {1: "a1", 2: "h1", 4: "a2", 5: "h1", 7: "z1"}
    moved = [("f", "g", "a", "a1", 9, "READY"), ("f", "g", "a", "a2", 9, "READY"), ("f", "g", "a", "a3", 9, "READY")]
    add(spark, tmp_path / "in", ASKED, [(8, "f", "g", 5), (9, "f", "e", 5)])
    assert run(moved)[8] == "a3" and 9 not in run(moved)


def test_registries_are_bounded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="more than 1"):
        keyed.round_robin(stream(spark, tmp_path / "in", ASKED), spark.createDataFrame([("f", "e", "a", x, 9, "READY") for x in "ab"], REPLICA), most=1)


def test_publish_again_and_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "registry")
    of = lambda *epochs: spark.createDataFrame([(e, f"r{e}") for e in epochs], "epoch long, replica_id string")
    there = lambda: {(r["epoch"], r["replica_id"]) for r in spark.read.parquet(path).collect()}
    operators.publish(spark, of(1), path, batch=0)
    operators.publish(spark, of(2, 3), path, batch=1)
    before = there()
    operators.publish(spark, of(2, 3), path, batch=1)  # tried again
    assert there() == before == {(1, "r1"), (2, "r2"), (3, "r3")}
    (tmp_path / "registry/epoch=3").rename(tmp_path / "gone")  # as if it had died between its epochs
    operators.publish(spark, of(2, 3), path, batch=1)
    assert there() == before
    for batch in (2, None):
        with pytest.raises(ValueError, match="must increase"):
            operators.publish(spark, of(3, 4), path, batch=batch)
    assert there() == before and not [p for p in (tmp_path / "registry").iterdir() if p.name.startswith("_")]


def test_publish_from_a_stream(spark, tmp_path):
    """foreachBatch whose function fails after it has published is run again with the same batch."""
    schema, path, fails = "epoch long, replica_id string", str(tmp_path / "registry"), [True]
    add(spark, tmp_path / "in", schema, [(1, "a"), (1, "b"), (2, "c")])

    def each(rows, batch):
        operators.publish(spark, rows, path, batch)
        if fails.pop() if fails else False:
            raise RuntimeError("lost")

    start = lambda: stream(spark, tmp_path / "in", schema).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(each).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert sorted((r["epoch"], r["replica_id"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "b"), (2, "c")]
