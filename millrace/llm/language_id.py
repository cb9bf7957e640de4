"""Language identification by partial matching (PPM) over bytes.

Each language has context trees of the orders 0 to ORDER with frozen counts.  A byte's
code length is that of the longest context in which it was seen, after the escapes from
longer ones; escapes have the probability D / (T + D) and symbols c / (T + D), with T
bytes and D different ones seen in the context, and below order 0 all 256 bytes are equal.
The language with the shortest code for the whole text wins; ties go to the first by name.

The trees of all languages are merged into one trie over a common alphabet.  A node (an
n-gram) knows the exact code length of its last byte by language, escapes included, so
scoring looks a text up once, whatever the number of languages: n-grams by array lookups
from their beginnings, then one row of code lengths.

Learning takes a bounded sample: SAMPLE different texts of a language, chosen by a hash,
however often each occurs; of a text longer than SAMPLE_BYTES its first SAMPLE_BYTES
characters.  All texts are scored whole.

Defined results: null texts and those without a letter (Unicode's categories L*) are `und` with score 0; otherwise
score is the winner's share of the probability among all languages, each at its code
length per byte times 64 (1 means certain); rows without language teach nothing; with nothing
to learn from every text is `und`; equal texts get equal answers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import spans

ORDER, SAMPLE, SAMPLE_BYTES = 3, 150, 1 << 15
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    languages: list[str]
    order: int
    code: np.ndarray  # of each byte: 0 before a text, 1 never seen
    child: list[np.ndarray] = field(default_factory=list)  # by depth: (nodes, codes) -> node of the next depth, 0 for none
    cost: list[np.ndarray] = field(default_factory=list)  # by depth: (nodes, languages), bits of the n-gram's last byte
    escape: list[np.ndarray] = field(default_factory=list)  # by depth: (nodes, languages), bits of an escape from the n-gram as context

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of the texts, (texts, languages)."""
        k, n = self.order, len(offsets) - 1
        sizes = np.diff(offsets)
        # Each text after `order` codes of 0.
        at = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * k, sizes)
        codes = np.zeros(len(data) + n * k, np.int64)
        codes[at] = self.code[data]
        node = [np.zeros(len(codes), np.int32)]  # node[d][i]: the n-gram of the d codes that end at i
        for d in range(k + 1):
            before = np.zeros(len(codes), np.int32)
            before[1:] = node[d][:-1]
            found = self.child[d][before, codes]
            if d:
                found[before == 0] = 0
            node.append(found)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for d in range(k, -1, -1):
            own = node[d + 1][at[left]]
            seen = own > 0
            total[left[seen]] += self.cost[d + 1][own[seen]]
            left = left[~seen]
            if not len(left):
                break
            context = node[d][at[left] - 1] if d else np.zeros(len(left), np.int32)
            known = (context > 0) if d else np.ones(len(left), bool)
            total[left[known]] += self.escape[d][context[known]]
        total[left] += np.float32(8)
        run = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, 0, dtype=np.float64)])
        return run[offsets[1:]] - run[offsets[:-1]]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = spans.buffers(texts)
        sizes = np.diff(offsets)
        has = spans.per_text(_ASCII_LETTER[data].astype(np.int64), sizes) > 0
        for i in np.flatnonzero(~has & (sizes > 0)):
            has[i] = any(unicodedata.category(c)[0] == "L" for c in bytes(data[offsets[i] : offsets[i + 1]]).decode())
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.bits(data, offsets)
        best = bits.argmin(1)
        gap = (bits - bits.min(1, keepdims=True)) / np.maximum(sizes, 1)[:, None] * 64
        score = np.where(has, 1 / np.exp2(-np.minimum(gap, 500)).sum(1), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Context trees of each language, merged."""
    languages = sorted(texts)
    raw = {name: [t.encode() for t in texts[name]] for name in languages}
    seen = np.zeros(256, bool)
    for ts in raw.values():
        for t in ts:
            seen[np.frombuffer(t, np.uint8)] = True
    code = np.ones(256, np.int64)
    code[seen] = 2 + np.arange(seen.sum())
    m = Model(languages, order, code)
    if not languages:
        return m
    letters = int(seen.sum()) + 2
    # Codes of all texts, `order` zeros before each, and the language of each place that holds a byte.
    parts, owner = [], []
    for k, name in enumerate(languages):
        for t in raw[name]:
            c = code[np.frombuffer(t, np.uint8)]
            parts.append(np.concatenate([np.zeros(order, np.int64), c]))
            owner.append(np.concatenate([np.full(order, -1), np.full(len(c), k)]))
    codes, owner = (np.concatenate(x) for x in (parts, owner)) if parts else (np.empty(0, np.int64),) * 2
    at = np.flatnonzero(owner >= 0)
    size, lang = len(languages), owner[at]
    # As contexts of the depths above 0 serve the n-grams that end before a byte, those of zeros included.
    node, suffix_cost = np.zeros(len(at), np.int64), np.full((1, size), 8.0)
    gram = np.zeros(len(codes), np.int64)  # of depth d, ending at each place
    for d in range(order + 1):
        before = np.concatenate([[0], gram[:-1]])
        if d == 0:
            before[:] = 0
        key = before * letters + codes
        unique, inverse = np.unique(key, return_inverse=True)
        child = np.zeros((int(before.max(initial=0)) + 1, letters), np.int32)
        child.reshape(-1)[unique] = 1 + np.arange(len(unique))
        gram_next = 1 + inverse
        count = np.zeros((len(unique) + 1, size))
        np.add.at(count, (gram_next[at], lang), 1)
        context = np.zeros(len(unique) + 1, np.int64)
        context[1:] = unique // letters
        total = np.zeros((child.shape[0], size))
        np.add.at(total, context[1:], count[1:])
        kinds = np.zeros((child.shape[0], size))
        np.add.at(kinds, context[1:], (count[1:] > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(count / (total + kinds)[context])
        # The n-gram without its first code, which is the context tried next.
        lower = np.zeros(len(unique) + 1, np.int64)
        lower[gram_next] = node_all if d else 0
        cost = np.where(count > 0, own, escape[context] + suffix_cost[lower])
        cost[0] = 0
        m.child.append(child)
        m.escape.append(escape.astype(np.float32))
        if d == 0:
            m.cost.append(np.zeros((1, size), np.float32))
        m.cost.append(cost.astype(np.float32))
        gram, suffix_cost, node_all = gram_next, cost, gram_next
    return m


def sample(docs: DataFrame, learn: Column, most: int = SAMPLE, lang: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """`most` different texts of each language, or all if there are fewer, chosen by a hash of the text."""
    named = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = named.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    different = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages are few
    if not different:
        return {}
    share = F.lit(0.0)
    for name, n in different.items():
        share = F.when(F.col("lang") == name, F.lit(1.5 * most / n)).otherwise(share)
    part = F.when(F.octet_length("text") > SAMPLE_BYTES, F.substring("text", 1, SAMPLE_BYTES)).otherwise(F.col("text")).alias("text")
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "h", part).distinct()
    out: dict[str, list[str]] = {name: [] for name in different}
    for r in chosen.orderBy("h", "lang", "text").limit(3 * most * len(different)).collect():
        if len(out[r["lang"]]) < most:
            out[r["lang"]].append(r["text"])
    return {name: ts for name, ts in out.items() if ts}


def fit(docs: DataFrame, learn: Column, **of) -> Model:
    return train(sample(docs, learn, **of))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with lang_pred and score added."""
    spark = docs.sparkSession
    spans.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    name, most = text, max(1 << 16, min(1 << 20, (4 << 20) // max(1, len(model.languages))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, name, most):
                names, scores = shared.value.predict(part.column(name))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
