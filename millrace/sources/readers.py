"""Typed readers.  Row order, where it matters, is (path, place in the file); it is never taken from partitions."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import is_blank
from millrace.operators.joins import sent

MESSAGES = "array<struct<role: string, content: string>>"
#: Schemas of raw sources and of records.
SCHEMAS = {
    "chat": "conversation_hash string, conversation array<struct<role: string, content: string, redacted: boolean, toxic: boolean>>, language string, model string, turn bigint, redacted boolean, toxic boolean",
    "math": "question string, answer string",
    "code": "problem string, solution string, seed string, index bigint, lang string",
    "long": f"messages {MESSAGES}, id string, length bigint",
    "verdict": "id string, analysis string, verdict string, reviewer string, thinking boolean, full_context boolean, temperature double, prompt_sha256 string, answer_sha256 string",
    "score": "id string, mean_target_nll double, target_tokens bigint, expert_id string, gpu string, tokens_sha256 string",
    "replica": "epoch bigint, model_family string, expert_id string, pool_id string, replica_id string, endpoint string, max_context_tokens bigint, state string, checkpoint_version string",
    "metrics": "epoch bigint, step bigint, split string, loss double, expert_loss_mean array<double>, batch_samples bigint, lr double, grad_norm double, top1_accuracy double, mean_routing_regret double, sample_ids array<string>",
}


SPLIT_ROW = "id string, source string, source_id string, group_id string, prompt_hash string, split string, input_ids array<bigint>, target_ids array<bigint>, max_new_tokens bigint"


def parquet(spark: SparkSession, path: str, kind: str, glob: str = "*.parquet", limit: int = 0) -> DataFrame:
    """A Parquet source with _path and _row, its order; limit 0 is no limit."""
    rows = spark.read.schema(SCHEMAS[kind]).option("pathGlobFilter", glob).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return rows.orderBy("_path", "_row").limit(limit) if limit else rows


def ordinal(rows: DataFrame, path: str = "_path", row: str = "_row") -> DataFrame:
    """Adds ordinal: the running place over all files.  Files' counts (one row a file) precede places within them."""
    sizes = rows.groupBy(path).agg((F.max(row) + 1).alias("_n"))
    before = sizes.select(path, F.coalesce(F.sum("_n").over(Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(sent(before), path).withColumn("ordinal", F.col(row) + F.col("_before")).drop("_before")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), value, end (the place in bytes behind the line and its end) and size (of the file when it was listed).

    Files are read in blocks; lines are numbered within theirs, and the counts of the blocks before (one row a block) come on top, so that a
    large file is never one value.  Of a line that the file ends in without a line end, `end` is beyond the size.  Files have no byte order mark."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("_at"), "value",
        (F.octet_length("value") + 1).alias("_bytes"),
    )
    sizes = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_sum"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")))
    within = Window.partitionBy("path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_rn": F.count("*").over(within), "_to": F.sum("_bytes").over(within)}).join(starts, ["path", "_block"])
    return rows.select("path", (F.col("_rn") - 1 + F.col("_n_before")).alias("line"), "value", (F.col("_to") + F.col("_sum_before")).alias("end"), "size")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0) and value of each line."""
    return placed_lines(spark, path).select("path", "line", "value")


def json_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSONL source with path and line (from 0, blank lines counted but left out); a line that isn't JSON fails the read."""
    lines = numbered_lines(spark, path).where(F.length(F.trim("value")) > 0)
    return lines.select("path", "line", F.from_json("value", SCHEMAS[kind], {"mode": "FAILFAST"}).alias("r")).select("path", "line", "r.*")


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSONL source; blank lines are skipped, and one that isn't JSON fails the read."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def benchmark(spark: SparkSession, root: str, more: str | None = None) -> DataFrame:
    """question of all test files and, if given, of a JSONL file; empty ones are left out."""
    rows = spark.read.option("pathGlobFilter", "test-*.parquet").parquet(root).select("question")
    if more:
        rows = rows.unionByName(spark.read.schema("question string").json(more))
    return rows.where(F.length("question") > 0).distinct()


def labelled_requests(spark: SparkSession, path: str, experts: list[str], most_tokens: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a labelled JSONL file.  Types are strict: true and 1.0 are no integers.  A violation has path, line and message."""
    lines = numbered_lines(spark, path)
    v = lines.where(F.length(F.trim("value")) > 0).select("path", (F.col("line") + 1).alias("line"), F.try_parse_json("value").alias("v"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    ids = F.try_variant_get("v", "$.input_ids", "array<bigint>")
    losses = F.try_variant_get("v", "$.expert_losses", "array<double>")
    names = F.try_variant_get("v", "$.expert_ids", "array<string>")
    budget = F.try_variant_get("v", "$.max_new_tokens", "bigint")
    own_id = F.try_variant_get("v", "$.id", "string")
    numbers = lambda c: c.isin("ARRAY<BIGINT>", "ARRAY<DOUBLE>") | c.rlike(r"^ARRAY<DECIMAL\(\d+,\d+\)>$")
    message = (
        F.when(F.col("v").isNull(), "not JSON").when(F.coalesce(kind("$.id"), F.lit("")) != "STRING", "id must be a string").when(is_blank(own_id), "id is empty")
        .when(F.coalesce(kind("$.input_ids"), F.lit("")) != "ARRAY<BIGINT>", "input_ids must be integers").when(F.size(ids) > most_tokens, "prompt too long").when(F.exists(ids, lambda t: t < 0), "negative token")
        .when(F.coalesce(kind("$.max_new_tokens"), F.lit("")) != "BIGINT", "max_new_tokens must be an integer").when(budget < 0, "max_new_tokens must not be negative")
        .when(~numbers(F.coalesce(kind("$.expert_losses"), F.lit(""))), "expert_losses must be numbers").when(F.size(losses) != len(experts), "one loss for each expert")
        .when(F.exists(losses, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))), "expert_losses must be finite")
        .when((F.coalesce(kind("$.expert_ids"), F.lit("VOID")) != "VOID") & ~F.coalesce(names == F.array(*map(F.lit, experts)), F.lit(False)), "expert_ids differ")
    )
    checked = v.select("path", "line", own_id.alias("id"), ids.alias("input_ids"), budget.alias("max_new_tokens"), losses.alias("expert_losses"), message.alias("message"))
    twice = checked.where("message IS NULL").groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    checked = checked.join(twice, (F.col("id") == F.col("_id")) & F.col("message").isNull(), "left").withColumn("message", F.coalesce("message", F.when(F.col("_n") > 1, "id repeated"))).drop("_id", "_n")
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    empty = files.join(v, "path", "left_anti").select("path", F.lit(0).alias("line"), F.lit("no examples").alias("message"))
    return checked.where("message IS NULL").drop("message", "path", "line"), checked.where("message IS NOT NULL").select("path", "line", "message").unionByName(empty)


def split_rows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of the files train, valid and test.jsonl, with the nine keys that training needs.

    Ids are unique over all files, no group is in two of them, and a row's split is its file's; a violation has problem and name."""
    rows = reduce(DataFrame.unionByName, [spark.read.schema(SPLIT_ROW).option("mode", "FAILFAST").json(f"{root}/{s}.jsonl").withColumn("_file", F.lit(s)) for s in ("train", "valid", "test")])
    named = lambda df, problem, name: df.select(F.lit(problem).alias("problem"), F.col(name).alias("name"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    crossing = rows.groupBy("group_id").agg(F.count_distinct("_file").alias("n")).where("n > 1")
    other = rows.where(~F.col("split").eqNullSafe(F.col("_file")))
    return rows.drop("_file"), named(twice, "id_repeated", "id").unionByName(named(crossing, "group_crosses", "group_id")).unionByName(named(other, "split", "id"))


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that are still being written: what follows the last line end is left out, whatever bytes it holds; a broken line before it
    stays, for the parser to refuse.  Files are as long as when this was called; `sources.growing` follows them."""
    lines = placed_lines(spark, path).where("end <= size").select("path", "line", "value")
    return lines.where(F.length(F.trim("value")) > 0)


def metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a metrics log, its unterminated tail left out; a broken record fails the read."""
    parsed = complete_lines(spark, path).select("path", "line", F.from_json("value", SCHEMAS["metrics"], {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("path", "line", "r.*")


def cached_scores(spark: SparkSession, path: str, expert: str) -> tuple[DataFrame, DataFrame]:
    """(scores, violations) of a resumable cache: ids are unique and all are the expert's."""
    rows = json_lines(spark, path, "score")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem"))
    other = rows.where(F.col("expert_id") != expert).select("id", F.lit("expert").alias("problem"))
    return rows, twice.unionByName(other)


def wanted(rows: DataFrame, keys: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted keys in the order of their ordinal, wanted keys that were not found)."""
    found = rows.join(sent(keys), list(by)).orderBy("ordinal")
    return found, keys.join(rows.select(*by).distinct(), list(by), "left_anti")


def config(path: str, required: dict[str, type]) -> dict:
    """A JSON configuration with exactly the required keys and types."""
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    wrong = [k for k, t in required.items() if type(values.get(k)) is not t] + [k for k in values if k not in required]
    if wrong:
        raise ValueError(f"{path}: wrong or unknown: {wrong}")
    return values


def deployment_violation(experts: Column, router_gpu: Column) -> Column:
    """experts: array of (expert_id, port, gpu).  Exactly two, with different ids and ports, disjoint GPUs, and one more GPU for the router."""
    gpus = lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int"))
    bad = lambda g: ~g.rlike(r"^\s*\d+\s*(,\s*\d+\s*)*$")
    a, b = F.element_at(experts, 1), F.element_at(experts, 2)
    return (
        F.when(F.size(experts) != 2, "two_experts").when((a["expert_id"] == b["expert_id"]) | (a["port"] == b["port"]), "not_distinct")
        .when(bad(a["gpu"]) | bad(b["gpu"]) | bad(router_gpu), "gpu_number").when(F.arrays_overlap(gpus(a["gpu"]), gpus(b["gpu"])), "gpus_shared")
        .when(F.size(F.array_distinct(gpus(router_gpu))) != 1, "router_gpu").when(F.arrays_overlap(gpus(router_gpu), F.concat(gpus(a["gpu"]), gpus(b["gpu"]))), "router_gpu_shared")
    )
