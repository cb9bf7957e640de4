"""Text normalization and hashing as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Bytes of texts that a Python worker is handed at once.
BATCH_BYTES = 1 << 20
#: ASCII characters that separate words, as Unicode-aware splitting sees them.
ASCII_BLANKS = r"[\x09-\x0D\x1C-\x20]+"
#: Unicode's white space, with the separators among the ASCII control characters.
BLANK = r"[\s\x1C-\x1F]"


def _unicode_canonical(texts: pd.Series) -> pd.Series:
    each = {t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts.dropna().unique()}
    return texts.map(each.get)


_unicode_udf = F.pandas_udf(_unicode_canonical, StringType())


def bounded_batches() -> None:
    """Bounds what Arrow hands to Python at once by bytes too: 10,000 texts can have any size, and a worker holds them several times.
    For the session; a smaller bound of the caller's stays."""
    spark = SparkSession.getActiveSession()
    if spark and (spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def canonical(text: Column) -> Column:
    """NFKC, case folding and single spaces.  ASCII texts stay in the JVM; only the others go to Python, in Arrow batches of BATCH_BYTES."""
    bounded_batches()
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    native = F.when(ascii_only, F.trim(F.regexp_replace(F.lower(text), ASCII_BLANKS, " ")))
    return F.coalesce(native, _unicode_udf(F.when(~ascii_only, text)))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often body refers to it: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1C-\x1F]")


def opens_think_block(text: Column) -> Column:
    return text.rlike(rf"(?U)\A{BLANK}*<think>")


def plain_lines(text: Column) -> Column:
    """CRLF and CR become LF, and one leading byte order mark goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "^\ufeff", "")


def without_think_block(text: Column) -> Column:
    """What follows the first closing tag, without leading line ends, if the text opens with a think block."""
    after = F.substring(text, F.locate("</think>", text) + F.lit(8), F.length(text))
    return F.when(opens_think_block(text) & F.contains(text, F.lit("</think>")), F.regexp_replace(after, r"^\n+", "")).otherwise(text)


def hash_bucket(key: Column, seed: str = "42", buckets: int = 100) -> Column:
    """The first 64 bits of the seeded SHA-256, as an unsigned number, modulo `buckets`."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), key), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(buckets)).cast("int")


def hash_split(group: Column, seed: str = "42") -> Column:
    """90 / 5 / 5 by group."""
    b = hash_bucket(group, seed)
    return F.when(b < 90, "train").when(b < 95, "valid").otherwise("test")


def final_answer(answer: Column) -> Column:
    """What follows the last `####`, stripped."""
    return strip(F.element_at(F.split(answer, "####", -1), -1))


def split_thinking(raw: Column) -> Column:
    """reasoning and answer, stripped, and whether the think block was closed; until it is, all is reasoning, as it stands."""
    opened = F.regexp_replace(raw, r"\A<think>\n", "")
    at, closed = F.locate("</think>", raw), F.contains(raw, F.lit("</think>"))
    before = strip(F.regexp_replace(F.substring(raw, F.lit(1), at - 1), r"\A<think>\n", ""))
    after = strip(F.substring(raw, at + F.lit(8), F.length(raw)))
    return F.struct(F.when(closed, before).otherwise(opened).alias("reasoning"), F.when(closed, after).otherwise("").alias("answer"), closed.alias("closed"))


def explicit_answer(answer: Column, has_choices: Column) -> Column:
    """Of a question with choices the last boxed A-D; of others the last number after `####`, else the last boxed number."""

    def last(pattern: str) -> Column:
        found = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))
        return F.get(found, F.size(found) - 1)

    number = r"([-+]?\d[\d,.]*)"
    return F.when(has_choices, last(r"\\boxed\{([ABCD])\}")).otherwise(F.coalesce(last(r"(?U)####\s*" + number), last(r"(?U)\\boxed\{" + number + r"\}")))


def mostly_cjk(text: Column) -> Column:
    """Whether over 15 % of the characters are CJK ideographs."""
    return F.regexp_count(text, F.lit("[\u4e00-\u9fff]")) > F.length(text) * 0.15
