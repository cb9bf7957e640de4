"""Conversations: building, validating and splitting arrays of (role, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import canonical, is_blank, opens_think_block, plain_lines, sha, without_think_block

ROLES = ("system", "user", "assistant")
CONTROL_TOKENS = ("<|im_start|>", "<|im_end|>")  # fixed values


def from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation: messages in the order of the turns."""
    entries = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(entries, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def cleaned(messages: Column) -> Column:
    """Line ends and byte order marks unified; opening think blocks removed from the assistant's messages."""

    def one(m: Column) -> Column:
        c = plain_lines(m["content"])
        return F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", without_think_block(c)).otherwise(c).alias("content"))

    return F.transform(messages, one)


def message_reason(m: Column) -> Column:
    """The first check that a message (as it came) fails, or null."""
    c = plain_lines(m["content"])
    thinks = (m["role"] == "assistant") & opens_think_block(c)
    after = without_think_block(c)
    tokens = reduce(lambda a, b: a | b, [F.contains(F.when(thinks, after).otherwise(c), F.lit(t)) for t in CONTROL_TOKENS])
    return (
        F.when(m["role"].isNull() | ~m["role"].isin(*ROLES) | m["content"].isNull(), "invalid_role_or_nontext")
        .when(is_blank(c), "empty_message")
        .when(c.rlike(r"[\x00-\x08\x0B-\x1F]"), "control_character")
        .when(thinks & ~F.contains(c, F.lit("</think>")), "unclosed_thinking_block")
        .when(thinks & is_blank(after), "empty_after_thinking_block")
        .when(tokens, "embedded_chat_control_token")
    )


def invalid_sequence(messages: Column) -> Column:
    """Unless user and assistant alternate, two or more and an even number, after at most one system message."""
    dialogue = F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, 2, F.size(messages))).otherwise(messages)
    wrong = F.exists(F.transform(dialogue, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return (F.size(dialogue) < 2) | (F.size(dialogue) % 2 == 1) | wrong


def reject_reason(messages: Column) -> Column:
    """The whole cascade, message by message; the order of roles comes last.  Null: accepted."""
    first = F.element_at(F.filter(F.transform(messages, message_reason), lambda r: r.isNotNull()), 1)
    any_bad = F.exists(messages, lambda m: message_reason(m).isNotNull())
    return F.when(messages.isNull() | (F.size(messages) < 1), "invalid_messages").when(any_bad, first).when(invalid_sequence(messages), "invalid_role_sequence")


def flag_reason(redacted: Column, toxic: Column, conversation: Column | None = None) -> Column:
    """`redacted` before `source_toxic_flag`, of the row or of any message."""
    r, t = F.coalesce(redacted, F.lit(False)), F.coalesce(toxic, F.lit(False))
    if conversation is not None:
        r = r | F.coalesce(F.exists(conversation, lambda m: F.coalesce(m["redacted"], F.lit(False))), F.lit(False))
        t = t | F.coalesce(F.exists(conversation, lambda m: F.coalesce(m["toxic"], F.lit(False))), F.lit(False))
    return F.when(r, "redacted").when(t, "source_toxic_flag")


def prompt_and_reference(messages: Column) -> tuple[Column, Column]:
    """All messages but the last, and the last one's content."""
    return F.slice(messages, 1, F.size(messages) - 1), F.element_at(messages, -1)["content"]


def canonical_contents(messages: Column) -> Column:
    """The canonical contents of all messages in one text, with NUL between them, which no accepted message has and which canonical text
    keeps; so whatever has no NUL is found within one message only."""
    joined = canonical(F.array_join(F.transform(messages, lambda m: m["content"]), "\0"))
    return F.trim(F.regexp_replace(joined, r" ?\x00 ?", "\0"))


def prompt_key(messages: Column) -> Column:
    """SHA-256 of the JSON array of [role, canonical content], with a space after each comma."""
    contents = F.split(canonical_contents(messages), r"\x00", -1)
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)
    each = F.zip_with(messages, contents, lambda m, t: F.concat(F.lit("["), quoted(m["role"]), F.lit(", "), quoted(t), F.lit("]")))
    return F.when(messages.isNotNull(), sha(F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))))


def prompt_keys(rows: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """(key, prompt_hash) of each row."""
    return rows.select(key, prompt_key(F.col(prompt)).alias("prompt_hash"))


def request_violation(messages: Column, budget: Column, tokens: Column, most_tokens: int = 8192, most_budget: int = 2048) -> Column:
    """What makes a routing request unusable, or null."""
    return (
        F.when(messages.isNull() | (F.size(messages) < 1), "no_messages")
        .when(F.exists(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*ROLES)), "role")
        .when(F.exists(messages, lambda m: m["content"].isNull() | is_blank(m["content"])), "blank")
        .when(F.element_at(messages, -1)["role"] != "user", "last_not_user")
        .when(budget.isNull() | (budget < 1) | (budget > most_budget), "budget")
        .when(tokens > most_tokens, "too_long")
    )
