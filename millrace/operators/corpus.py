"""Deduplication, benchmark overlap, strata, bounds, splits and shards of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.matching import contains_any
from millrace.operators.groups import cut

#: Fixed values.
PROMPT_LIMIT, CONTEXT_LIMIT, LEAST_ITEM, FINGERPRINT = 8192, 40_960, 40, 96
#: Bytes of fingerprints in an automaton.
AUTOMATON_BYTES = 2 << 20


def keep_first(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order, nulls first; never depends on how rows are partitioned.  Rows are reduced before they
    are shuffled, so a key that most rows have makes no large task."""
    least = F.min_by(F.struct(*rows.columns), F.struct(*(F.col(o) if isinstance(o, str) else o for o in order)))
    return rows.groupBy(F.col(key).alias("_key")).agg(least.alias("_row")).select("_row.*")


def keep_first_reference(rows: DataFrame, id_: str, answer_hash: str, length: str, *order: str | Column, least: int = 120) -> DataFrame:
    """Adds same_reference_as: the id of the first row with an equal normalized answer, if that is long enough and another row."""
    long_ = rows.where((F.col(length) >= least) & F.col(answer_hash).isNotNull())
    first = long_.groupBy(F.col(answer_hash).alias("_answer")).agg(F.min_by(id_, F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))).alias("_first"))
    own = F.when(F.col(length) >= least, F.col(answer_hash))
    marked = rows.join(first, own == F.col("_answer"), "left").withColumn("same_reference_as", F.when(F.col("_first") != F.col(id_), F.col("_first")))
    return marked.drop("_answer", "_first")


def fingerprints(benchmark: DataFrame, text: str) -> DataFrame:
    """First characters of all canonical items that are long enough, once each.  text: a canonical column."""
    return benchmark.where(F.length(text) >= LEAST_ITEM).select(F.substring(text, 1, FINGERPRINT).alias("fingerprint")).distinct()


def with_overlap(rows: DataFrame, text: Column, marks: DataFrame, name: str = "overlaps", part_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """`rows` with a boolean: whether `text` contains a fingerprint, wherever it begins.

    Fingerprints become an automaton that is sent to the tasks and passes over each text once.  Beyond `part_bytes` of them they are parted by
    hash into automata of about that size, one pass each, with the rows written in between, so that no task holds two.
    """
    size = marks.agg(F.sum(F.octet_length("fingerprint")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part_bytes))
    marks = cut(marks.select("fingerprint"), "fingerprints") if parts > 1 else marks
    rows = rows.withColumn(name, F.lit(False))
    for k in range(parts):
        own = marks.where(F.pmod(F.xxhash64("fingerprint"), F.lit(parts)) == k) if parts > 1 else marks
        patterns = [r["fingerprint"] for r in own.select("fingerprint").collect()]  # part_bytes, about
        rows = rows.withColumn(name, F.col(name) | contains_any(text, patterns))
        rows = cut(rows, "overlaps") if k + 1 < parts else rows
    return rows


def overlap(docs: DataFrame, key: str, text: str, marks: DataFrame, part_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Keys of the documents that contain a fingerprint, wherever it begins."""
    return with_overlap(docs.select(key, text), F.col(text), marks, "_overlaps", part_bytes).where("_overlaps").select(key).distinct()


def length_bucket(n: Column) -> Column:
    return F.when(n <= 512, "0-512").when(n <= 2048, "513-2048").when(n <= 4096, "2049-4096").otherwise("4097-8192")


def stratum(code_language: Column, language: Column, n: Column) -> Column:
    return F.concat_ws("|", F.coalesce(code_language, language, F.lit("unknown")), length_bucket(n))


def token_reason(prompt: Column, target: Column, budget: Column) -> Column:
    """Bounds on token counts in order; target without its end."""
    return (
        F.when(prompt > PROMPT_LIMIT, "prompt_over_8192")
        .when(target + 1 > budget, "reference_over_generation_budget")
        .when(target == 0, "empty_reference_tokens")
        .when(prompt + budget > CONTEXT_LIMIT, "expert_context_limit")
    )


def allocate(strata: DataFrame, by: list[str], key: str, count: str, budget: Column) -> DataFrame:
    """Largest-remainder shares of each group's budget (at most its total) over its strata, as `allocated`."""
    g = Window.partitionBy(*by)
    total = F.sum(count).over(g)
    bounded = F.least(total, budget).cast("double")
    rows = strata.withColumn("_exact", F.col(count) * bounded / total).withColumn("_floor", F.floor("_exact"))
    left = bounded.cast("long") - F.sum("_floor").over(g)
    rank = F.row_number().over(g.orderBy(F.desc(F.col("_exact") - F.col("_floor")), key))
    return rows.withColumn("allocated", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop("_exact", "_floor")


def stratified_sample(rows: DataFrame, by: list[str], key: str, order: str | Column, budget: Column, most: int) -> DataFrame:
    """The first rows of each stratum, as many as `allocate` gives it.  The literal bound `most` (no budget is larger)
    lets Spark keep only that many rows of a stratum before it shuffles them."""
    counts = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    shares = allocate(counts, by, key, "n", budget).select(*by, key, "allocated")
    rn = F.row_number().over(Window.partitionBy(*by, key).orderBy(order))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= most).join(shares, [*by, key]).where("_rn <= allocated").drop("_rn", "allocated")


def global_rank(rows: DataFrame, groups: list[str], priority: str, prefix: int = 2) -> DataFrame:
    """Adds rank, from 0, in the order of the groups and then of `priority`, a hexadecimal digest.

    Rows are ranked within group and first digits; the counts of all cells before (a small table) come on top.
    So no task orders all rows, nor those of a large group.
    """
    cells = rows.withColumn("_cell", F.substring(priority, 1, prefix))
    sizes = cells.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
    order = Window.orderBy(*groups, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*groups, "_cell", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(priority))
    return cells.withColumn("_rn", rn).join(before, [*groups, "_cell"]).withColumn("rank", F.col("_rn") - 1 + F.col("_before")).drop("_cell", "_rn", "_before")


def striped(rows: DataFrame, groups: list[str], priority: str, shards: int = 8) -> DataFrame:
    """Adds shard: the global rank modulo `shards`."""
    return global_rank(rows, groups, priority).withColumn("shard", (F.col("rank") % shards).cast("int")).drop("rank")


def first_k(rows: DataFrame, by: str, k: int, *order: str | Column) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rn", rn).where(F.col("rn") <= k)


def pilot_order(rows: DataFrame, by: str, length: str, order: str, most: int) -> DataFrame:
    """Adds rn: within each source the first row, then the longest (the first of equals), then the rest in order; up to `most`.

    Only the first `most` rows of a source and its longest one can be among them, so a source is reduced to those before it is ranked."""
    of_source, columns = Window.partitionBy(by), rows.columns
    first = rows.withColumn("_rn", F.row_number().over(of_source.orderBy(order))).where(F.col("_rn") <= most).drop("_rn")
    longest = F.min_by(F.struct(*columns), F.struct(-F.col(length), F.col(order)))
    longest = rows.groupBy(F.col(by).alias("_by")).agg(longest.alias("_row")).select("_row.*", F.lit(True).alias("_longest"))
    marked = first.withColumn("_longest", F.lit(False)).unionByName(longest)
    ranked = marked.withColumns({"_first": F.min(order).over(of_source), "_copies": F.max("_longest").over(Window.partitionBy(by, order))}).where(F.col("_longest") == F.col("_copies"))
    kind = F.when(F.col(order) == F.col("_first"), 0).when(F.col("_longest"), 1).otherwise(2)
    return ranked.withColumn("rn", F.row_number().over(of_source.orderBy(kind, order))).where(F.col("rn") <= most).select(*columns, "rn")


def balanced_pilot(rows: DataFrame, by: str, length: str, order: str, n: int) -> DataFrame:
    """n rows, taken in turns from the sources' queues."""
    return pilot_order(rows, by, length, order, n).orderBy("rn", by).limit(n)


def reject_counts(rows: DataFrame, source: str, reason: str) -> DataFrame:
    """scanned, accepted and rejected by source."""
    return rows.groupBy(source).agg(F.count("*").alias("scanned"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.count_if(F.col(reason).isNotNull()).alias("rejected"))


def reject_reasons(rows: DataFrame, source: str, reason: str) -> DataFrame:
    """How many rows of each source each reason rejected."""
    return rows.where(F.col(reason).isNotNull()).groupBy(source, F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are not once on either side: problem is missing, extra or duplicate."""
    l = left.groupBy(key).agg(F.count("*").alias("nl"))  # noqa: E741
    r = right.groupBy(key).agg(F.count("*").alias("nr"))
    both = l.join(r, key, "full_outer")
    problem = F.when(F.col("nr").isNull(), "missing").when(F.col("nl").isNull(), "extra").when((F.col("nl") > 1) | (F.col("nr") > 1), "duplicate")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def seeded_order(rows: DataFrame, id_: str, seed: int) -> DataFrame:
    """A reproducible shuffle: by SHA-256 of seed and id."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256), id_)


def scoring_order(rows: DataFrame, *ties: str | Column, prompt: str = "input_ids", target: str = "target_ids") -> DataFrame:
    """Rows by their number of tokens, so that those scored together are about as long; equals keep the order of `ties`.
    prompt and target: arrays of ids, or numbers of tokens, so that no ids need to travel with the rows that are sorted."""
    count = lambda c: F.col(c) if isinstance(rows.schema[c].dataType, T.NumericType) else F.size(c)
    return rows.orderBy(count(prompt) + count(target), *ties)
