"""From candidates to a reviewed data set: starter quotas, the pool for review, what a review decides, and the audit of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import sha
from millrace.operators import audit, corpus
from millrace.operators.records import SOURCES

# Train quotas by kind of source, how many times larger train is than each hold-out part, the pool's caps, the review's seed.
QUOTAS = {"chat": 20_000, "math": 5_000, "code": 10_000, "long": 5_000}
HOLD_OUT_SHARE = 18
POOL_CAPS = {"train": 10_000, "valid": 556, "test": 556}
CAPPED = (SOURCES["chat"], SOURCES["code"])
REVIEW_SEED = "hq-v2-20261001"


def starter_quota(source: Column, split: Column) -> Column:
    """Rows of a source's split in the starter set; null for an unknown source."""
    train = F.element_at(F.create_map(*[F.lit(x) for k, n in QUOTAS.items() for x in (SOURCES[k], n)]), source)
    return F.when(split == "train", train).otherwise(F.ceil(train / HOLD_OUT_SHARE).cast("int"))


def sample_key(prompt_hash: Column, seed: int = 42) -> Column:
    return sha(F.concat(F.lit(f"{seed}:"), prompt_hash))


def review_priority(id_: Column) -> Column:
    return sha(F.concat(F.lit(f"{REVIEW_SEED}:"), id_))


def review_pool(candidates: DataFrame, capped: Column | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """The candidates (source, split, stratum, priority) that are reviewed.

    Sources that are capped give each split as many rows as its cap says, shared out over the strata by largest remainders; within a
    stratum the smallest priorities are taken.  All rows of other sources are taken, without a shuffle."""
    caps = POOL_CAPS if caps is None else caps
    capped = F.coalesce(F.col("source").isin(*CAPPED) if capped is None else capped, F.lit(False))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("split"))
    drawn = corpus.stratified_sample(candidates.where(capped), ["source", "split"], "stratum", "priority", budget, max(caps.values()))
    return drawn.select(*candidates.columns).unionByName(candidates.where(~capped))


def with_records(pool: DataFrame, records: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """The pool's rows with their records; the pool is small beside the records, whose keys are unique."""
    return pool.join(records, key)


def parent_violations(rows: DataFrame, parent: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """(key, problem) of rows whose group or split is not their parent's."""
    p = parent.select(key, F.col("group_id").alias("_g"), F.col("split").alias("_s"), F.lit(True).alias("_there"))
    problem = F.when(F.col("_there").isNull(), "missing").when(~F.col("split").eqNullSafe(F.col("_s")), "split").when(~F.col("group_id").eqNullSafe(F.col("_g")), "group")
    return rows.select(key, "group_id", "split").join(p, key, "left").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def reviewed(pool: DataFrame, decisions: DataFrame, *order: str, id_: str = "id", answer: str = "answer_sha256", length: str = "answer_length", least: int = 120) -> DataFrame:
    """Adds verdict, outcome and same_reference_as.  outcome is `kept`, `duplicate_normalized_reference`, `rejected` or, for a row without a
    decision, `undecided`.

    Of passed rows with an equal normalized answer of `least` characters or more the first in `order` is kept.  decisions: id and verdict,
    once each (`corpus.reconcile` tells); answer, length: hash and length of the normalized answer."""
    met = pool.join(decisions.select(id_, "verdict"), id_, "left")
    passed = F.coalesce(F.col("verdict") == "PASS", F.lit(False))
    rows = corpus.keep_first_reference(met.withColumn("_own", F.when(passed, F.col(answer))), id_, "_own", length, *order, least=least).drop("_own")
    outcome = F.when(F.col("verdict").isNull(), "undecided").when(~passed, "rejected").when(F.col("same_reference_as").isNotNull(), "duplicate_normalized_reference").otherwise("kept")
    return rows.withColumn("outcome", outcome)


def review_counts(rows: DataFrame, by: str = "source") -> DataFrame:
    """passed, kept and duplicates of each source; `audit.unconserved(counts, "passed", "kept", "duplicates")` must be empty."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return rows.groupBy(by).agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), n("kept").alias("kept"), n("duplicate_normalized_reference").alias("duplicates"))


def lost_in_review(rows: DataFrame, by: str = "source") -> DataFrame:
    return audit.unconserved(review_counts(rows, by), "passed", "kept", "duplicates")


def example_page(title: Column, id_: Column, split: Column, prompt_tokens: Column, target_tokens: Column, messages: Column, answer: Column) -> Column:
    """An example as Markdown: its heading, facts, messages and answer."""
    said = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("**"), m["role"], F.lit("**\n\n"), m["content"], F.lit("\n\n"))), "")
    facts = F.concat(F.lit("ID: `"), id_, F.lit("`; split: "), split, F.lit("; prompt/target: "), prompt_tokens.cast("string"), F.lit("/"), target_tokens.cast("string"), F.lit(" tokens."))
    return F.concat(F.lit("### "), title, F.lit("\n\n"), facts, F.lit("\n\n"), said, F.lit("**reference answer**\n\n"), answer, F.lit("\n\n---\n"))


def examples(rows: DataFrame, *order: str, k: int = 5, by: str = "source") -> DataFrame:
    """The first k rows of each source, with their place `rn` and `markdown` page."""
    page = example_page(F.concat_ws(" ", F.col(by), F.col("rn").cast("string")), F.col("id").cast("string"), F.col("split"), F.col("prompt_tokens"), F.col("target_tokens"), F.col("messages"), F.col("reference_answer"))
    return corpus.first_k(rows, by, k, *order).withColumn("markdown", page)
