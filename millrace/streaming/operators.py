"""Structured Streaming twins of the batch operators.

State is bounded: a score whose partner doesn't come within `ttl` of event time is dropped
(and can be had from the stored scores with `unpaired`), and repeated ids are remembered for as long.  `keyed` has
what keeps state by key without a bound in time.
"""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.groups import cut, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def valid_scores(scores: DataFrame) -> DataFrame:
    """Scores that keep the contract: an id, and a finite loss of 0 or more."""
    return scores.where("id IS NOT NULL AND loss IS NOT NULL AND NOT isnan(loss) AND loss >= 0 AND loss < double('inf')")


def pair_losses(streams: dict[str, DataFrame], ttl: str = "1 hour", time: str = "ts") -> DataFrame:
    """Ids that every expert's stream has scored, with expert_losses in the order of `streams`; ids that come again are dropped.

    streams: by expert, (id, loss, ts).  Rows pair whatever the order of arrival, within `ttl` of event time.
    """
    own = []
    for k, (_, s) in enumerate(streams.items()):
        once = valid_scores(s).withWatermark(time, ttl).dropDuplicatesWithinWatermark(["id"])
        own.append(once.select(F.col("id").alias(f"id{k}"), F.col("loss").alias(f"loss{k}"), F.col(time).alias(f"ts{k}")))

    def join(a: tuple[int, DataFrame], b: tuple[int, DataFrame]) -> tuple[int, DataFrame]:
        k = b[0]
        near = f"id0 = id{k} AND ts{k} BETWEEN ts0 - INTERVAL {ttl} AND ts0 + INTERVAL {ttl}"
        return 0, a[1].join(b[1], F.expr(near))

    out = reduce(join, enumerate(own))[1]
    return out.select(F.col("id0").alias("id"), F.array(*[f"loss{k}" for k in range(len(own))]).alias("expert_losses"))


def unpaired(scores: dict[str, DataFrame], paired: DataFrame, time: str = "ts") -> DataFrame:
    """(expert_id, id, loss, ts) of the valid scores whose ids `pair_losses` has not paired: a partner is missing or came too late.

    scores: tables, by expert, of what the streams have brought; paired: the stored result of `pair_losses`."""
    rows = [valid_scores(s).select(F.lit(name).alias("expert_id"), "id", "loss", time) for name, s in scores.items()]
    return reduce(DataFrame.unionByName, rows).join(paired.select("id"), "id", "left_anti").select("expert_id", "id", "loss", time)


def checked_against_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (id, tokens_sha256, target_tokens; a stream or a table) with state and loss from an expert's cache (a table).

    state: `missing` (to be scored), `known` (with its loss), or why what is cached can't be the request's: `tokens_differ`,
    `token_count` or `loss`.  So a known id is never scored again, and never used unchecked."""
    c = cache.select("id", F.col("tokens_sha256").alias("_sha"), F.col("target_tokens").alias("_n"), F.col("mean_target_nll").alias("_loss"), F.lit(True).alias("_there"))
    bad = F.col("_loss").isNull() | F.isnan("_loss") | (F.col("_loss") < 0) | (F.col("_loss") == float("inf"))
    state = (
        F.when(F.col("_there").isNull(), "missing").when(~F.col("_sha").eqNullSafe(F.col("tokens_sha256")), "tokens_differ")
        .when(~F.col("_n").eqNullSafe(F.col("target_tokens")), "token_count").when(bad, "loss").otherwise("known")
    )
    joined = requests.join(c, "id", "left").withColumn("state", state)
    return joined.withColumn("loss", F.when(F.col("state") == "known", F.col("_loss"))).drop("_sha", "_n", "_loss", "_there")


def response_violations(asked: DataFrame, answered: DataFrame, expert: str, gpu: str) -> DataFrame:
    """(place, problem) of an expert's answer to a window.

    asked: place, id, target_tokens; answered: place, id, target_tokens, mean_target_nll, expert_id, gpu.  The same ids come in the
    same places, from the expert asked, with its number of tokens and a finite loss of 0 or more."""
    a = answered.select("place", F.col("id").alias("_id"), F.col("target_tokens").alias("_n"), F.col("mean_target_nll").alias("_loss"), "expert_id", "gpu", F.lit(True).alias("_there"))
    both = asked.select("place", "id", "target_tokens", F.lit(True).alias("_asked")).join(a, "place", "full_outer")
    bad = F.col("_loss").isNull() | F.isnan("_loss") | (F.col("_loss") < 0) | (F.col("_loss") == float("inf"))
    problem = (
        F.when(F.col("_there").isNull() | F.col("_asked").isNull() | ~F.col("id").eqNullSafe(F.col("_id")), "ids")
        .when(~F.col("expert_id").eqNullSafe(F.lit(expert)) | ~F.col("gpu").cast("string").eqNullSafe(F.lit(gpu)), "identity")
        .when(bad | ~F.col("_n").eqNullSafe(F.col("target_tokens")), "loss")
    )
    return both.select("place", problem.alias("problem")).where("problem IS NOT NULL")


def window_violations(rows: DataFrame, window: str = "window", most: int = 64) -> DataFrame:
    """(window, problem) of windows with more than `most` rows or with an id twice.  An empty window has no row, so it can't be here."""
    n, ids = F.count("*"), F.count_distinct("id")
    counted = rows.groupBy(window).agg(n.alias("_n"), ids.alias("_ids"))
    problem = F.when(F.col("_n") > most, "size").when(F.col("_ids") < F.col("_n"), "id_repeated")
    return counted.select(window, problem.alias("problem")).where("problem IS NOT NULL")


def log_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON log files as they appear; files must appear whole (renamed into place)."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def publish(spark: SparkSession, snapshots: DataFrame, path: str, batch: int | None = None) -> None:
    """Publishes whole registry snapshots (epoch, replicas), each a folder `epoch=N` that appears by a rename.

    Readers see an epoch whole or not at all.  Epochs must increase: a batch that holds one not above the newest raises, and so does
    the later of two writers of one epoch, whose rename finds it there.  For foreachBatch, which passes `batch`: an epoch's folder names its batch, so
    a batch that is tried again passes over the epochs that it published before, and goes on with the others."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    root = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs, files = root.getFileSystem(conf), None
    there = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    place = lambda p: fs.makeQualified(jvm.org.apache.hadoop.fs.Path(p))
    mark = f"_batch-{batch}"  # readers pass over names that begin so
    known = {int(n.removeprefix("epoch=")) for n in there if n.startswith("epoch=")}
    kept = cut(snapshots, "snapshots")  # computed once, and the same rows for each epoch
    epochs = sorted(r["epoch"] for r in kept.select("epoch").distinct().collect())  # epochs of one batch
    done = {e for e in epochs if batch is not None and e in known and fs.exists(place(f"{path}/epoch={e}/{mark}"))}
    newest, left = max(known - done, default=0), [e for e in epochs if e not in done]
    if left and left[0] <= newest:
        raise ValueError("registry epoch must increase")
    for epoch in left:
        hidden = f"{path}/_{uuid.uuid4().hex}"
        try:
            kept.where(F.col("epoch") == epoch).drop("epoch").write.parquet(hidden)
            if batch is not None:
                fs.create(place(f"{hidden}/{mark}")).close()
            files = files or jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
            files.rename(place(hidden), place(f"{path}/epoch={epoch}"), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        finally:
            fs.delete(place(hidden), True)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_resumed(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is new since the last run with this path, which keeps its progress and results, and reads all results.

    A run that is lost goes on from its last whole batch; the sink takes a batch once."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def as_stream(rows: DataFrame, name: str, files: int = 3) -> DataFrame:
    """A stream over a table's rows, dealt to files and taken one file a batch."""
    written = cut(rows.repartition(files), name)
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
