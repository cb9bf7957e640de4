"""From raw rows of the four kinds of sources to records of one shape, each with the reason that rejects it or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import canonical, final_answer, mostly_cjk, sha
from millrace.operators import conversation
from millrace.operators.corpus import with_overlap

# Names of sources, prefixes of groups, and lengths that results depend on.
BUDGETS = {"chat": 2048, "math": 1024, "code": 2048, "long": 2048}
SOURCES = {"chat": "WildChat-1M", "math": "gsm8k", "code": "Magicoder-OSS-Instruct-75K", "long": "LongAlign-10k"}
DOCUMENT_PREFIX, LEAST_INITIAL, KEY_DIGITS = 4096, 80, 16
METADATA = {"language": "string", "model": "string", "turn": "bigint", "config": "string", "split": "string", "final_answer": "string", "code_language": "string", "original_length": "bigint"}


def _metadata(**known: Column) -> Column:
    return F.struct(*(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in METADATA.items()))


def _pair(question: str, answer: str) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return F.array(one("user", question), one("assistant", answer))


def _group(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), sha(text))


def _chat(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    plain = F.transform("conversation", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    own = F.coalesce("conversation_hash", F.lit("None"))
    return raw.select(
        *keep,
        own.alias("source_id"), F.concat(F.lit("wild:"), own).alias("group_id"), plain.alias("raw_messages"), _metadata(language=F.col("language"), model=F.col("model"), turn=F.col("turn")).alias("metadata"),
        conversation.flag_reason(F.col("redacted"), F.col("toxic"), F.col("conversation")).alias("flag"), F.coalesce(F.exists("conversation", lambda m: m.isNull()), F.col("conversation").isNull()).alias("broken"),
    )


def _math(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    facts = _metadata(language=F.lit("English"), config=F.lit("main"), split=F.lit("train"), final_answer=final_answer(F.col("answer")))
    return raw.select(
        *keep,
        F.col("source_id").cast("string"), _group("gsm", canonical(F.col("question"))).alias("group_id"), _pair("question", "answer").alias("raw_messages"), facts.alias("metadata"),
        F.lit(None).cast("string").alias("flag"), (F.col("question").isNull() | F.col("answer").isNull()).alias("broken"),
    )


def _code(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    about = F.when(F.length("seed") > 0, F.col("seed")).otherwise(F.col("problem"))
    return raw.select(
        *keep,
        F.coalesce(F.col("index").cast("string"), F.lit("None")).alias("source_id"), _group("code", canonical(about)).alias("group_id"), _pair("problem", "solution").alias("raw_messages"),
        _metadata(language=F.lit("English"), code_language=F.col("lang")).alias("metadata"), F.lit(None).cast("string").alias("flag"), about.isNull().alias("broken"),
    )


def _long(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))
    document = F.when(first.isNull(), "").otherwise(first["content"])
    return raw.select(
        *keep,
        F.coalesce("id", F.lit("None")).alias("source_id"), _group("long", F.substring(canonical(document), 1, DOCUMENT_PREFIX)).alias("group_id"), F.col("messages").alias("raw_messages"),
        _metadata(original_length=F.col("length")).alias("metadata"), F.lit(None).cast("string").alias("flag"), (F.col("messages").isNull() | document.isNull()).alias("broken"),
    )


_KINDS = {"chat": _chat, "math": _math, "code": _code, "long": _long}


def records(raw: DataFrame, kind: str, marks: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, source, source_id, group_id, extra_group, prompt_hash, messages (the prompt), reference_answer, max_new_tokens, metadata and reason of each raw row.

    raw: a source of `sources.readers`; math has no id, so that source_id is a column of its own.  marks: fingerprints of benchmarks (of
    `corpus.fingerprints`).  keep: columns of raw to keep.  A source's flags come first, then rows whose fields don't allow a record (`invalid_record`), then the
    checks of the messages, then `benchmark_question_overlap`, where a message of the prompt holds a fingerprint.  Rejected rows have null for all
    that needs a valid prompt.  Fields of records are columns of the row, so nothing is shuffled.
    """
    rows = _KINDS[kind](raw, keep).withColumn("source", F.lit(SOURCES[kind]))
    hole = F.coalesce(F.exists("raw_messages", lambda m: m.isNull()), F.lit(False))
    reason = F.coalesce("flag", F.when(F.col("broken") | hole, "invalid_record"), conversation.reject_reason(F.col("raw_messages")))
    rows = rows.withColumn("reason", reason).withColumn("valid", F.when(F.col("reason").isNull(), conversation.cleaned(F.col("raw_messages"))))
    if marks is not None:
        prompt = conversation.canonical_contents(conversation.prompt_and_reference(F.col("valid"))[0])
        rows = with_overlap(rows, prompt, marks, "_overlaps")
        rows = rows.withColumns({"reason": F.coalesce("reason", F.when(F.col("_overlaps"), "benchmark_question_overlap")), "valid": F.when(~F.col("_overlaps"), F.col("valid"))})
    prompt, reference = conversation.prompt_and_reference(F.col("valid"))
    rows = rows.withColumns({"messages": prompt, "reference_answer": reference})
    initial = canonical(F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"])
    rows = rows.withColumns({"prompt_hash": conversation.prompt_key(F.col("messages")), "initial": initial if kind == "chat" else F.lit(None).cast("string")})
    facts = F.col("metadata")
    if kind == "long":
        last = F.element_at("messages", -1)["content"]
        facts = facts.withField("language", F.when(F.col("reason").isNull(), F.when(mostly_cjk(last), "Chinese").otherwise("English-or-other")))
    accepted = F.col("reason").isNull()
    return rows.select(
        F.when(accepted, F.concat_ws(":", "source", "source_id", F.substring("prompt_hash", 1, KEY_DIGITS))).alias("id"), "source", "source_id", "group_id",
        F.when(F.length("initial") >= LEAST_INITIAL, _group("initial", F.col("initial"))).alias("extra_group"), "prompt_hash", "messages", "reference_answer",
        F.when(accepted, F.lit(BUDGETS[kind]).cast("long")).alias("max_new_tokens"), facts.alias("metadata"), "reason", *keep,
    )
