"""Quality rules as a ledger: every rule is evaluated once, policies come later.

`ledger` adds the measurements and one long, `failures`, with a bit for each rule
that the document fails.  A policy is a named, versioned set of rules, that is, a bit
mask: `apply_policy` decides with one bitwise AND, and `ablations` counts what any
rule does to a policy by aggregating the stored bits, so neither reads a text again.

All of it stays within the row: there is no shuffle, so no source or group of copies
can be too large for a task.

Defined results: a null text counts as the empty one, which has no words and fails
`few_words`; rows with equal texts or ids get equal results each; an empty table gives
an empty result; further columns are kept, and those with names of the ledger's own
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.native import SPACES, covered, let, unused, words

#: Rules in the order of their bits; a rule fails where its condition on the measurements is true.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "many_exclamations": "10 * n_exclamations > n_words",
    "mostly_capitals": "2 * n_capitals > word_chars",
    "odd_word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "some_repetition": "100 * n_repeat_words > 30 * n_words",
    "ellipsis_lines": "10 * n_ellipsis_lines > 3 * n_lines",
    "bullet_lines": "10 * n_bullet_lines > 9 * n_lines",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals", "n_ellipsis_lines", "n_bullet_lines")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that a kept document must pass."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "strict": Policy("strict", tuple(RULES)),
    "standard": Policy("standard", tuple(r for r in RULES if r not in ("repeated_lines", "some_repetition", "bullet_lines"))),
}


def _neighbours(sorted_: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements of a sorted array that are the same as the one before or after."""
    at = F.when(F.size(sorted_) > 1, F.sequence(F.lit(0), F.size(sorted_) - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.filter(at, lambda k: same(F.get(sorted_, k), F.get(sorted_, k + 1)))
    return let(pairs, lambda ks: F.transform(F.array_union(ks, F.transform(ks, lambda k: k + 1)), lambda k: F.get(sorted_, k)))


def _repeat_words(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Each window is a long: its hash, with its place in the low bits (as many as the number
    of words needs).  Sorting these brings equal windows together at the price of sorting
    plain longs.  Those that share the rest of their hash with another one are then sorted and
    compared by their words, so the bits that go to the place cost nothing but comparisons.
    """
    n = F.size(ws)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1

    def starts(b: Column) -> Column:
        windows = F.transform(
            F.slice(ws, F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(b["high"]).bitwiseOR(i.cast("long")),
        )
        alike = let(F.sort_array(windows), lambda s: _neighbours(s, lambda x, y: x.bitwiseXOR(y).bitwiseAND(b["high"]) == 0))
        place = lambda x: x.bitwiseAND(b["low"]).cast("int")
        spelled = F.transform(alike, lambda x: F.struct(F.array_join(F.slice(ws, place(x) + 1, 3), " ").alias("words"), place(x).alias("place")))
        return F.sort_array(F.transform(let(F.sort_array(spelled), lambda s: _neighbours(s, lambda x, y: x["words"] == y["words"])), lambda x: x["place"]))

    return let(F.struct(low.alias("low"), F.bitwise_not(low).alias("high")), lambda b: covered(starts(b), 3))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements and the failure bits."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    per_line = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09-\x0D]*[-*•][\x20\x09]")))).cast("long").alias("n_bullet_lines"),
        ),
    )
    per_word = let(
        words(F.col(text), SPACES),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeat_words(ws).alias("n_repeat_words")
        ),
    )
    docs = docs.drop(*MEASURES, "failures")
    of_words, of_lines = unused([*docs.columns, *MEASURES, "failures"], "words", "lines")
    measured = docs.withColumns({of_words: per_word, of_lines: per_line})
    measured = measured.withColumns(
        {
            "n_words": F.col(of_words)["n_words"],
            "word_chars": F.col(of_words)["word_chars"],
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": F.col(of_lines)["n_dup_lines"],
            "n_repeat_words": F.col(of_words)["n_repeat_words"],
            "n_lines": F.col(of_lines)["n_lines"],
            "n_exclamations": count("!"),
            "n_capitals": count(r"\p{Lu}"),
            "n_ellipsis_lines": F.col(of_lines)["n_ellipsis_lines"],
            "n_bullet_lines": F.col(of_lines)["n_bullet_lines"],
        }
    ).drop(of_words, of_lines)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures)


def passes(policy: Policy, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with `kept`, the policy's verdict, and its version."""
    return rows.withColumns({"kept": passes(policy), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many rows fail it, how many fail it alone, so that
    the policy without it would keep them, and how many the policy rejects.  One pass of
    bitwise aggregates over the stored bits, and as many rows as the policy has rules."""
    names, mask = list(RULES), F.lit(policy.mask).cast("long")
    bad = F.col("failures").bitwiseAND(mask)
    sums = [F.count_if(bad != 0).alias("rejected"), F.bit_or(bad).alias("ever")]
    for r in policy.rules:
        bit = F.lit(1 << names.index(r)).cast("long")
        sums += [F.count_if(bad.bitwiseAND(bit) != 0).alias(f"fails_{r}"), F.count_if(bad == bit).alias(f"only_{r}")]
    each = [
        F.struct(
            F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"only_{r}").alias("fails_alone"),
            F.col("rejected"), F.coalesce(F.col("ever").bitwiseAND(F.lit(1 << names.index(r)).cast("long")) != 0, F.lit(False)).alias("ever_fails"),
        )
        for r in policy.rules
    ]
    return rows.agg(*sums).select(F.inline(F.array(*each)))
