"""State by key in streams: a cache of scores that grows with its stream, and counters of placement in two key spaces.

Both keep their state in RocksDB by `transformWithState`; queries are started by `run_keyed`, which sets the store for that query alone.
State is a few numbers a key and outlives restarts with the query's checkpoint.
"""

from __future__ import annotations

import contextlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from millrace.operators.groups import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST, SCORE = "request", "score"
ANSWERS = "expert_id string, id string, state string, loss double"
#: Rows that leave a task at once.
SLICE = 10_000


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's own store comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_keyed(stream: DataFrame, path: str) -> DataFrame:
    """As `operators.run_resumed`, with state in RocksDB."""
    spark = stream.sparkSession
    with rocks(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


class ScoreCache(StatefulProcessor):
    """One expert's score of one id, and whether it has been asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._score = handle.getValueState("score", "tokens_sha256 string, target_tokens long, loss double")
        self._waiting = handle.getMapState("waiting", "tokens_sha256 string, target_tokens long", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # Most keys have a few rows, so what counts is how often the store is called: once if the score is known.
        answer = lambda state, loss=None: Row(expert_id=key[0], id=key[1], state=state, loss=loss)
        scores, asked = [], []
        for r in rows:
            if r["kind"] == SCORE:
                scores.append((r["tokens_sha256"], r["target_tokens"], math.nan if r["loss"] is None else r["loss"]))
            elif r["kind"] == REQUEST:
                asked.append((r["tokens_sha256"], r["target_tokens"]))
        known = before = self._score.get()
        for score in sorted(scores, key=lambda x: [(v is None or v != v, v) if v is not None and v == v else (True, 0) for v in x]):
            if not (math.isfinite(score[2]) and score[2] >= 0):
                yield answer("loss")
            elif known is None:
                known = score
                self._score.update(score)
            elif tuple(known) != score:
                yield answer("conflict")
        # Nothing waits once a score is known.
        waiting = [tuple(k) for k in self._waiting.keys()] if before is None and (asked or known is not None) else []
        if known is None:
            for k in dict.fromkeys(asked):
                if k not in waiting:
                    self._waiting.updateValue(k, (1,))
                    yield answer("missing")
            return
        if waiting:
            self._waiting.clear()
        for (sha, n), waited in [(k, True) for k in waiting] + [(k, False) for k in asked]:
            if known[0] != sha:
                yield answer("tokens_differ")
            elif known[1] != n:
                yield answer("token_count")
            else:
                yield answer("scored" if waited else "known", known[2])

    def close(self) -> None:
        pass


def score_cache(events: DataFrame) -> DataFrame:
    """What becomes of requests for scores: a stream of (expert_id, id, state, loss).

    events: expert_id, id, kind (`request` or `score`), tokens_sha256, target_tokens and loss (of scores).  A request whose id has no score yet is
    `missing`, once for the same tokens, and answered as `scored` when the score comes; one whose score came before is `known` and not scored again.
    A score whose tokens aren't the request's gives `tokens_differ` or `token_count` in place of a loss.  The first score of an id stays: the same
    again is nothing, another is a `conflict`, and one that isn't finite or is negative is `loss`.  Within a batch scores come before requests.
    """
    rows = events.select("expert_id", F.col("id").cast("string").alias("id"), "kind", "tokens_sha256", F.col("target_tokens").cast("long").alias("target_tokens"), F.col("loss").cast("double").alias("loss"))
    return rows.groupBy("expert_id", "id").transformWithState(ScoreCache(), ANSWERS, "append", "None")


class Turns(StatefulProcessor):
    """A counter for each key, which deals out the turns of its rows, in the order of ids: `k`, from 0 to the row's number of choices, `n`, less one.

    Of a batch's rows only numbers are held; a column of `names` becomes codes."""

    def __init__(self, names: list[str], out: list[str]):
        self._names, self._out = names, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turn = handle.getValueState("turn", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn = self._turn.get()[0] if self._turn.exists() else 0
        seen, parts = {}, []
        for part in rows:
            own = part.drop(columns=[c for c in part.columns if c not in ("id", "needed", "step", "n")])
            parts.append(own.assign(code=np.array([seen.setdefault(x, len(seen)) for x in zip(*(part[c] for c in self._names), strict=True)], np.int32)))
        held = pd.concat(parts, ignore_index=True)
        del parts
        held = held.sort_values("id", ignore_index=True)
        names = {c: np.array(x, object) for c, x in zip(self._names, zip(*seen, strict=True), strict=True)}
        self._turn.update((int(turn) + len(held),))
        for at in range(0, len(held), SLICE):
            part = held.iloc[at : at + SLICE]
            k = (int(turn) + at + np.arange(len(part))) % part["n"].to_numpy()
            yield part.assign(k=k, **{c: x[part["code"].to_numpy()] for c, x in names.items()})[self._out]

    def close(self) -> None:
        pass


def _choices(rows: DataFrame, keys: list[str], choice: str, size: str) -> tuple[DataFrame, DataFrame]:
    """What rows of the keys can choose: (keys, _sizes: how many choices are large enough, by steps of size), and (keys, _step, _k, choice)."""
    steps = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(size)).alias("_steps"))
    enough = rows.join(steps, keys).select(*keys, choice, F.explode(F.filter("_steps", lambda s: s <= F.col(size))).alias("step"))
    places = enough.withColumn("k", (F.row_number().over(Window.partitionBy(*keys, "step").orderBy(choice)) - 1).cast("long"))
    sizes = enough.groupBy(*keys, "step").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("_sizes"))
    return cut(sizes, "sizes"), cut(places, "places")


def _turns(rows: DataFrame, keys: list[str], names: list[str], choices: tuple[DataFrame, DataFrame], choice: str) -> DataFrame:
    """Adds the choice of each row whose turn it is; rows: id, needed and names, of which keys are some or none."""
    sizes, places = choices
    at = F.get(F.filter("_sizes", lambda s: s["step"] >= F.col("needed")), F.lit(0))
    able = rows.join(sizes, keys).withColumn("_at", at).where("_at IS NOT NULL").select("id", "needed", *names, F.col("_at.step").alias("step"), F.col("_at.n").alias("n"))
    out = {"id": "long", "needed": "long", **{c: "string" for c in names}, "step": "long", "k": "long"}
    dealt = able.groupBy(*keys).transformWithStateInPandas(Turns(names, list(out)), ", ".join(f"{c} {t}" for c, t in out.items()), "append", "None")
    return dealt.join(places, [*keys, "step", "k"]).select("id", "needed", *names, choice)


def round_robin(requests: DataFrame, replicas: DataFrame, most: int | None = None) -> DataFrame:
    """Places requests (id, model_family, expert_id, needed) as they come, in the order of ids within a batch: (id, model_family, expert_id, pool_id, replica_id).

    The pools of (family, expert) come in turn, then the replicas of the pool; the counters are two states in a row, so that a pool keeps its own
    when a later snapshot gives it to another expert.  A request that can't be placed moves no counter.  replicas: one snapshot, of at most `most` rows if that is given.
    Rows carry how many choices they have, and their turn; the choice itself is looked up, so no row carries a list of replicas.
    """
    ready = replicas.where("state = 'READY'").select("model_family", "expert_id", "pool_id", "replica_id", F.col("max_context_tokens").cast("long").alias("size"))
    if most is not None and ready.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} replicas in a registry")
    groups = ["model_family", "expert_id"]
    asked = requests.select("id", *groups, F.col("needed").cast("long").alias("needed"))
    pools = _choices(ready.groupBy(*groups, "pool_id").agg(F.max("size").alias("size")), groups, "pool_id", "size")
    first = _turns(asked, groups, groups, pools, "pool_id")
    placed = _turns(first, ["pool_id"], [*groups, "pool_id"], _choices(ready.select("pool_id", "replica_id", "size"), ["pool_id"], "replica_id", "size"), "replica_id")
    return placed.select("id", *groups, "pool_id", "replica_id")
