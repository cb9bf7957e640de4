"""Pairing of losses, routing metrics, placement on replicas, and analytics of training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.routing import arg_max, arg_min
from millrace.operators.exact import exact_sums
from millrace.operators.joins import sent
from millrace.operators.ordered import latest, numbered, over_rows_before


def paired_losses(requests: DataFrame, scores: DataFrame, experts: list[str], key: str = "id") -> DataFrame:
    """Requests that all experts have scored, with expert_losses in the experts' order.  scores: key, expert_id, loss.

    An id that an expert has scored twice has no pair; `score_violations` names it.  Scores are reduced to an id's before they are shuffled."""
    of = lambda e: F.when(F.col("expert_id") == e, F.col("loss"))
    one = [F.when(F.count_if(F.col("expert_id") == e) == 1, F.max(of(e))).alias(f"_loss{i}") for i, e in enumerate(experts)]
    losses = scores.groupBy(key).agg(*one).select(key, F.array(*(f"_loss{i}" for i in range(len(experts)))).alias("expert_losses"))
    return requests.join(losses.where(~F.exists("expert_losses", lambda x: x.isNull())), key)


def score_violations(scores: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """(key, expert_id, problem) of scores that break the contract."""
    joined = scores.join(requests.select(key, F.col("tokens_sha256").alias("_sha"), F.col("target_tokens").alias("_n")), key, "left")
    repeated = F.count("*").over(Window.partitionBy(key, "expert_id")) > 1
    problem = (
        F.when(F.col("_sha").isNull(), "unknown_id").when(repeated, "repeated").when(F.col("_sha") != F.col("tokens_sha256"), "tokens_differ")
        .when(F.col("_n") != F.col("target_tokens"), "token_count").when(F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == float("inf")) | (F.col("loss") < 0), "loss")
    )
    return joined.select(key, "expert_id", problem.alias("problem")).where("problem IS NOT NULL")


def routing_metrics(rows: DataFrame, logits: str = "logits", losses: str = "losses") -> DataFrame:
    """One row: n, top1_accuracy and mean_routing_regret."""
    pick = arg_max(F.col(logits))
    return rows.agg(
        F.count("*").alias("n"), F.avg((pick == arg_min(F.col(losses))).cast("int")).alias("top1_accuracy"),
        F.avg(F.element_at(losses, pick + 1) - F.array_min(losses)).alias("mean_routing_regret"),
    )


def policy_report(rows: DataFrame, experts: int, logits: str = "logits", losses: str = "losses") -> DataFrame:
    """Means of the selected and the best losses, regret, each constant policy's mean and count, and the gain over the best constant policy."""
    pick = arg_max(F.col(logits))
    sums = [F.avg(F.element_at(losses, i + 1)).alias(f"constant_{i}") for i in range(experts)]
    routed = [F.count_if(pick == i).alias(f"routed_{i}") for i in range(experts)]
    out = rows.agg(F.avg(F.element_at(losses, pick + 1)).alias("selected"), F.avg(F.array_min(losses)).alias("oracle"), *sums, *routed)
    constants = [F.col(f"constant_{i}") for i in range(experts)]
    best = F.least(*constants) if experts > 1 else constants[0]
    return out.withColumns({"regret": F.col("selected") - F.col("oracle"), "gain": best - F.col("selected")})


def count_windows(rows: DataFrame, order: str, batch: int, key: str, most_rows: int = 64, batches: int = 6, partitions: int | None = None) -> DataFrame:
    """Adds window: runs of batch * min(batches, most_rows // batch) rows in order, per key."""
    size = batch * min(batches, most_rows // batch)
    return numbered(rows, [order], [key], "_number", partitions).withColumn("window", F.floor((F.col("_number") - 1) / size).cast("int")).drop("_number")


# Placement


def snapshot_at(requests: DataFrame, epochs: DataFrame, key: str, at: str = "ts", partitions: int | None = None) -> DataFrame:
    """Adds the newest epoch at each request's time (null before the first), however many of either there are.  key: tells requests apart."""
    return latest(requests, epochs, at, "epoch", key, partitions)


def eligible_experts(requests: DataFrame, replicas: DataFrame, key: str) -> DataFrame:
    """(key, experts): the sorted experts that have an eligible replica.  Replicas are first reduced to each expert's largest context."""
    most = replicas.where("state = 'READY'").groupBy("model_family", "expert_id").agg(F.max("max_context_tokens").alias("most"))
    return requests.join(sent(most), "model_family").where("most >= needed").groupBy(key).agg(F.array_sort(F.collect_set("expert_id")).alias("experts"))


def first_eligible(ranked: Column, experts: Column) -> Column:
    """The first expert of the ranking that is eligible, or null."""
    return F.get(F.filter(ranked, lambda e: F.array_contains(experts, e)), F.lit(0))


def round_robin(requests: DataFrame, replicas: DataFrame, order: str, key: str, partitions: int | None = None) -> DataFrame:
    """Places each request (model_family, expert_id, needed): pools of the expert in turn, then replicas of the pool in turn.

    Both counters advance in the order of requests, and only by those that can be placed.  A request's pools are those
    with an eligible replica, sorted by id; likewise its replicas.  Requests are numbered by ranges, so no task holds those of an expert or pool.
    """
    groups = ["model_family", "expert_id"]
    ready = replicas.where("state = 'READY'").select(*groups, "pool_id", "replica_id", "max_context_tokens")
    # What a request can take depends on its expert and on the smallest context that is enough, so replicas are arranged once for
    # each context that an expert offers, and a request looks its own up; no request meets all replicas.
    steps = ready.groupBy(*groups).agg(F.array_sort(F.collect_set("max_context_tokens")).alias("_steps"))
    enough = ready.join(steps, groups).withColumn("_step", F.explode(F.filter("_steps", lambda s: s <= F.col("max_context_tokens")))).select(*groups, "_step", "pool_id", "replica_id")
    pool = [*groups, "_step", "pool_id"]
    places = enough.withColumn("_k", F.row_number().over(Window.partitionBy(*pool).orderBy("replica_id")) - 1)
    sizes = enough.groupBy(*pool).agg(F.count("*").alias("_n"))
    pools = sizes.groupBy(*groups, "_step").agg(F.array_sort(F.collect_list("pool_id")).alias("_pools"))
    own = list(dict.fromkeys([key, order, *groups]))
    asked = requests.select(*own, "needed").join(steps, groups).withColumn("_step", F.get(F.filter("_steps", lambda s: s >= F.col("needed")), F.lit(0)))
    turn = F.col("_turn") - 1
    able = numbered(asked.where("_step IS NOT NULL").select(*own, "_step"), [order], groups, "_turn", partitions)
    chosen = able.join(pools, [*groups, "_step"]).withColumn("pool_id", F.element_at("_pools", (turn % F.size("_pools") + 1).cast("int"))).drop("_pools", "_turn")
    placed = numbered(chosen, [order], ["pool_id"], "_turn", partitions).join(sizes, pool).withColumn("_k", (turn % F.col("_n")).cast("int"))
    return placed.join(places, [*pool, "_k"]).select(key, *groups, "pool_id", "replica_id")


def registry_violations(replicas: DataFrame) -> DataFrame:
    """(epoch, problem, name) of snapshots that must not be published."""
    every = lambda by, problem, bad: replicas.groupBy("epoch", by).agg(bad.alias("bad")).where("bad").select("epoch", F.lit(problem).alias("problem"), F.col(by).cast("string").alias("name"))
    identity = F.count_distinct(F.struct("model_family", "expert_id", "checkpoint_version")) > 1
    expert = replicas.groupBy("epoch", "model_family", "expert_id").agg((F.count_distinct("checkpoint_version") > 1).alias("bad")).where("bad")
    return (
        every("replica_id", "replica_repeated", F.count("*") > 1).unionByName(every("endpoint", "endpoint_repeated", F.count("*") > 1)).unionByName(every("pool_id", "pool_mixed", identity))
        .unionByName(expert.select("epoch", F.lit("checkpoints_differ").alias("problem"), F.col("expert_id").alias("name")))
        .unionByName(replicas.where("epoch < 1").select("epoch", F.lit("epoch").alias("problem"), F.col("replica_id").alias("name")))
    )


# Logs


def trailing_mean(rows: DataFrame, value: str, order: str, by: str, window: int = 50, partitions: int | None = None) -> DataFrame:
    """Adds trailing_mean: of the row and the window - 1 rows before it; the first rows have fewer."""
    return over_rows_before(rows, [order], [by], window - 1, {"trailing_mean": (F.avg(value), 1 - window, 0)}, partitions)


def not_increasing(rows: DataFrame, step: str, order: str, by: str, partitions: int | None = None) -> DataFrame:
    """Rows whose step isn't larger than the one before."""
    return over_rows_before(rows, [order], [by], 1, {"previous": (F.first(step), -1, -1)}, partitions).where(F.col(step) <= F.col("previous"))


def repeated_steps(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def epoch_means(train: DataFrame, valid: DataFrame, epoch: str, value: str, weight: str) -> DataFrame:
    """Weighted mean, updates and samples of each epoch, and whether its validation is there.  The weighted values are summed without error."""
    sums = exact_sums(train, [epoch], {"_sum": F.col(value) * F.col(weight)})
    out = train.groupBy(epoch).agg(F.count("*").alias("updates"), F.sum(weight).alias("samples")).join(sums, epoch)
    out = out.select(epoch, F.try_divide("_sum", F.col("samples").cast("double")).alias("mean"), "updates", "samples")
    done = valid.select(epoch).distinct().withColumn("_v", F.lit(True))
    return out.join(done, epoch, "left").withColumn("validation_recorded", F.coalesce("_v", F.lit(False))).drop("_v")


def validation_means(batches: DataFrame, by: str = "epoch") -> DataFrame:
    """loss, top1_accuracy and mean_routing_regret of each validation from its batches: loss (a batch's mean), top1_correct,
    routing_regret_sum and batch_samples.  Batches count by their samples, and sums are without error; a validation without samples has null
    means; a value that isn't finite fails the query."""
    values = {"loss": F.col("loss") * F.col("batch_samples"), "top1_accuracy": F.col("top1_correct"), "mean_routing_regret": F.col("routing_regret_sum")}
    counted = batches.groupBy(by).agg(F.sum("batch_samples").alias("samples"))
    mean = lambda c: F.try_divide(c, F.col("samples").cast("double")).alias(c)
    return exact_sums(batches, [by], values).join(counted, by).select(by, *map(mean, values), "samples")


# Two runs over the same questions


def paired_runs(a: DataFrame, b: DataFrame, *keys: str, same: tuple[str, ...] = ("prompt_sha256", "input_ids"), values: tuple[str, ...] = ("answer",)) -> DataFrame:
    """keys, problem, and each run's values (`a_answer`, `b_answer`): null, or what makes the runs no pair.

    A problem is `missing` (in a run), or the first of the columns `same` that differs.  Keys are unique in a run."""
    side = lambda df, name: df.select(*keys, F.lit(True).alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in (*same, *values)])
    both = side(a, "a").join(side(b, "b"), list(keys), "full_outer")
    problem = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing")
    for c in same:
        problem = problem.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return both.select(*keys, problem.alias("problem"), *[f"{name}_{c}" for c in values for name in ("a", "b")])
