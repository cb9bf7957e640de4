"""Assertions as DataFrames: what is returned breaks the rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    """A contract is broken."""


def require_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise AuditError(f"{what}: {[r.asDict() for r in rows]}")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def crossing_splits(rows: DataFrame, group: str, split: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def not_contained(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), list(keys), "left_anti")


def token_violation(ids: Column, targets: Column, prompt_tokens: Column, target_tokens: Column, vocabulary: int, end: int, most_prompt: int = 8192) -> Column:
    both = F.concat(ids, targets)
    return (
        F.when((F.size(ids) != prompt_tokens) | (F.size(targets) != target_tokens), "count").when((F.size(ids) < 1) | (F.size(ids) > most_prompt), "bounds")
        .when(F.element_at(targets, -1) != end, "end").when(F.exists(both, lambda t: (t < 0) | (t >= vocabulary)), "vocabulary")
    )


def message_violation(prompt: Column, reference: Column) -> Column:
    blank = lambda c: ~c.rlike(r"(?U)\S")
    return F.when(F.element_at(prompt, -1)["role"] != "user", "last_role").when(F.exists(prompt, lambda m: blank(m["content"])) | blank(reference), "blank")


def has_columns(rows: DataFrame, *names: str) -> list[str]:
    """Columns that must not be there but are."""
    return [n for n in names if n in rows.columns]


def unconserved(counts: DataFrame, scanned: str, *parts: str) -> DataFrame:
    """Rows of counters whose parts don't add up to what was scanned."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return counts.where(F.col(scanned) != total)


def verdict_violations(rows: DataFrame, verdicts: DataFrame, id_: str = "id") -> DataFrame:
    """Kept rows without a PASS that is bound to exactly their prompt and answer."""
    v = verdicts.select(id_, "verdict", "analysis", F.col("prompt_sha256").alias("_p"), F.col("answer_sha256").alias("_a"))
    joined = rows.join(v, id_, "left")
    problem = (
        F.when(F.col("verdict").isNull(), "missing").when(F.col("verdict") != "PASS", "verdict").when(~F.coalesce(F.col("analysis"), F.lit("")).rlike(r"\S"), "analysis")
        .when((F.col("_p") != F.col("prompt_sha256")) | (F.col("_a") != F.col("answer_sha256")), "text")
    )
    return joined.select(id_, problem.alias("problem")).where("problem IS NOT NULL")


def repeated_references(rows: DataFrame, answer: str, least: int = 120) -> DataFrame:
    """Normalized answers (long enough) that occur twice or more."""
    return repeated(rows.where(F.length(answer) >= least).select(F.sha2(answer, 256).alias("answer_sha256")), "answer_sha256")
