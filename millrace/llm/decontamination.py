"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into item-sized windows (10 words; a shorter item is one
window), and a window occurs in a document where its words stand in a row.  As a set
join: a window is the set of its shingles (runs of five words, or of all words where the window
is shorter) and the document must contain all of them, so that one shingle is a
sufficient prefix, and the rarest is the best.

1. `benchmark_shingles` of the documents: one pass over the texts counts the words and keeps the
   places of shingles that the benchmark may have: the first two words pass a bit filter, then the
   whole shingle passes another.  Both grow with the benchmark up to FILTER_WORDS; beyond that they
   let more places through and lose none.  A place comes with the words themselves.
2. The places give each shingle's frequency, and each window's shingles are ordered by it;
   the rarest is the window's prefix token, and only places of prefix tokens are joined.
3. The match has a place in both, so the window could only begin at one place; the
   positional and length bounds drop matches whose window would begin before the first
   word or end after the last.
4. What is left is verified: all of the window's shingles must stand at their places, word for word.

The benchmark side is sent to all executors only while it has at most `broadcast_rows`
windows; beyond that the joins are left to shuffle by shingle.

Defined results: null or empty texts have no words, no hits and are not contaminated;
rows with equal ids are told apart by a hash of their texts; items without words have no window; items
without an id hit words but are not counted or named; an empty benchmark leaves all
documents clean; columns of `docs` named as those that are added are replaced, all others of either table play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.native import PLAIN_GAPS, covered, let, lower_ascii, unused, words
from millrace.llm.storage import written

WINDOW, SHINGLE, BROADCAST_ROWS = 10, 5, 100_000
#: 64-bit words of a filter, at most: 512 KB.  One word for each four shingles, as far as that goes.
FILTER_WORDS = 1 << 16


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, length, k (the words in a shingle) and tokens (its shingles in order, their words joined by spaces) of each window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(lower_ascii(F.col(text)), PLAIN_GAPS).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("ws") - length + 1)
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, length))).alias("window"))
    k = F.least(F.size("window"), F.lit(shingle))
    tokens = F.transform(F.sequence(F.lit(1), F.size("window") - k + 1), lambda i: F.array_join(F.slice("window", i, k), " "))
    return cut.select("item_id", F.size("window").alias("length"), k.alias("k"), tokens.alias("tokens"))


def _bit(h: Column, n: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(n - 1).cast("long")).cast("int"), h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _filter_bits(hashes: DataFrame, n: int) -> Column:
    """A constant array of n longs with a bit set for each `h`."""
    at, bit = _bit(F.col("h"), n)
    rows = hashes.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).collect()  # n rows at most
    bits = [0] * n
    for r in rows:
        bits[r["at"]] = r["b"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded into one constant


def benchmark_shingles(docs: DataFrame, windows: DataFrame, text: str, filter_words: int = FILTER_WORDS) -> DataFrame:
    """`docs` without the text, with n_words and `seen`: (k, place, token) of the shingles that may be of the benchmark, in order."""
    tokens = windows.select("k", F.explode("tokens").alias("token")).distinct()
    sizes = {r["k"]: r["n"] for r in tokens.groupBy("k").agg(F.count("*").alias("n")).collect()}  # k up to the shingle's
    n = min(filter_words, 1 << max(4, (sum(sizes.values()) // 4).bit_length()))
    first_two = F.split("token", " ")
    starts = _filter_bits(tokens.select(F.xxhash64(F.get(first_two, F.lit(0)), F.get(first_two, F.lit(1))).alias("h")), n)
    wholes = _filter_bits(tokens.select(F.xxhash64("token").alias("h")), n)

    def passes(h: Column, bits: Column) -> Column:
        at, bit = _bit(h, n)
        return F.call_function("shiftrightunsigned", F.get(bits, at), bit).bitwiseAND(F.lit(1).cast("long")) == 1

    def seen(ws: Column, k: int) -> Column:
        second = (lambda i: F.get(ws, i + 1)) if k > 1 else (lambda i: F.lit(None).cast("string"))
        # first the few places, by their index, then their words
        places = F.filter(F.transform(ws, lambda w, i: F.when(passes(F.xxhash64(w, second(i)), starts), i)), lambda i: i.isNotNull())
        found = F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("place"), F.array_join(F.slice(ws, i + 1, k), " ").alias("token")))
        return F.filter(found, lambda s: passes(F.xxhash64(s["token"]), wholes))

    empty = F.array().cast("array<struct<k:int,place:int,token:string>>")
    all_of = let(words(lower_ascii(F.col(text)), PLAIN_GAPS), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.concat(empty, *(seen(ws, k) for k in sorted(sizes))).alias("seen")))
    return docs.select(*(c for c in docs.columns if c != text), F.inline(F.array(all_of)))


def occurrences(seen: DataFrame, windows: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`keys`, start (from 0) and length of each place where a window occurs, and item_id.  seen: from `benchmark_shingles`."""
    distinct = windows.select("k", "length", "tokens").distinct()
    send = F.broadcast if distinct.count() <= broadcast_rows else (lambda df: df)
    places = seen.select(*keys, "seen", F.posexplode("seen").alias("at_seen", "s")).select(*keys, "seen", "at_seen", "s.*")
    frequencies = seen.select(F.explode("seen").alias("s")).groupBy("s.k", "s.token").agg(F.count("*").alias("frequency"))
    prefix = (
        distinct.select("*", F.posexplode("tokens").alias("at", "token")).join(frequencies, ["k", "token"])  # unseen ones can't be contained; `rarest` still must be
        .groupBy("k", "length", "tokens").agg(F.min(F.struct("frequency", "token", "at")).alias("rarest"))
        .select("k", "length", "tokens", "rarest.token", "rarest.at")
    )
    start, first = F.col("place") - F.col("at"), F.col("at_seen") - F.col("at") + 1
    expected = F.transform("tokens", lambda t, j: F.struct(F.col("k").alias("k"), (F.col("start") + j).alias("place"), t.alias("token")))
    found = (
        places.join(send(prefix), ["k", "token"]).select("*", start.alias("start"), first.alias("first"))
        .where((F.col("start") >= 0) & (F.col("first") >= 1) & (F.col("first") + F.size("tokens") - 1 <= F.size("seen")))
        .where(F.slice("seen", F.col("first"), F.size("tokens")) == expected)
        .select(*keys, "start", "length", "k", "tokens").distinct()
    )
    return found.join(send(windows.select("item_id", "k", "length", "tokens").distinct()), ["k", "length", "tokens"]).select(*keys, "start", "length", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All rows and columns of `docs`, with n_words, n_hit, n_items, items (sorted ids) and contaminated added."""
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    docs = docs.drop(*added)
    windows = item_windows(benchmark, text=text, window=window, shingle=shingle)
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_content"), F.col(text).alias("_text"))
    seen = written(benchmark_shingles(keyed, windows, "_text"), "benchmark_shingles")
    found = occurrences(seen.where(F.size("seen") > 0).drop("n_words"), windows, ["_id", "_content"], broadcast_rows)
    begin_end = lambda p: (p["start"], p["start"] + p["length"])
    hits = found.groupBy("_id", "_content").agg(
        covered(F.sort_array(F.collect_set(F.struct("start", "length"))), begin_end).alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    # One row a text: how many words it has, and what hits it.
    facts = seen.select("_id", "_content", "n_words", F.lit(None).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    facts = facts.unionByName(hits.withColumn("n_words", F.lit(None).cast("bigint"))).groupBy("_id", "_content").agg(*(F.max(c).alias(c) for c in ("n_words", "n_hit", "items")))
    here, own, content, words_, hit, names = unused([*docs.columns, *added], "here", "id", "content", "words", "hit", "names")
    # The hash is taken before the join, so that the text goes along only if it is asked for.
    marked = docs.withColumn(here, F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col(own)) & (F.col(here) == F.col(content))
    items = F.coalesce(F.col(names), F.array().cast("array<string>"))
    return marked.join(facts.toDF(own, content, words_, hit, names), same, "left").select(
        *docs.columns, F.col(words_).alias("n_words"), F.coalesce(F.col(hit), F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        items.alias("items"), F.col(hit).isNotNull().alias("contaminated"),
    )
