"""Quality classifier: supervised subword embeddings.

A document is three bags of hashed features: its words, its pairs of neighbouring words and
its character trigrams.  Every bucket has a learned vector; the vectors are averaged over each
bag and the averages over the bags, and a softmax layer gives the probability of label 1.
Training is stochastic gradient descent in numpy on a bounded sample of the labelled rows.

Scoring needs one number a bucket: the average of the vectors times the difference of the
output weights is the average of these products.  So the model that goes to the executors
is one array of fixed size, and a document costs a lookup for each feature.

Defined results: null counts as empty, also in learning; an empty text has no features and scores by the
bias alone; rows with equal texts score alike; labels that are null, or disagree for one
id, teach nothing; with nothing to learn from every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import spans

#: Rows to learn from and the bytes of all their texts together, and the model's sizes.
SAMPLE, SAMPLE_BYTES, BITS, DIM, EPOCHS, RATE, SEED = 5000, 1 << 26, 16, 16, 10, 1.0, 7
BAGS = 3


@dataclass(frozen=True)
class Model:
    """logit = bias + mean over the bags of the mean of `weights` over the bag's features."""

    weights: np.ndarray  # (BAGS << BITS,) float32
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        total, present = np.zeros(n), np.zeros(n)
        for features, counts in bags(texts):
            sums = spans.per_text(self.weights[features].astype(np.float64), counts)
            some = counts > 0
            total[some] += sums[some] / counts[some]
            present += some
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(present, 1), -50, 50)))


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each bag the features of all texts and how many each has."""
    data, offsets = spans.buffers(texts)
    begin, end, counts = spans.words(data, offsets)
    words = spans.hashes(data, begin, end)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), counts
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = spans.mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])[text[1:] == text[:-1]]
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS), np.maximum(counts - 1, 0)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
    if len(chars) < 3:
        yield np.empty(0, np.int64), np.zeros(len(n), np.int64)
        return
    h = chars[:-2] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h = (h + chars[1:-1]) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    h = (h + chars[2:]) * np.uint32(0xC2B2AE3D)
    inside = np.ones(len(chars), bool)
    last = np.cumsum(n)[n > 0]
    inside[last - 1] = False
    inside[np.maximum(last - 2, 0)] = False  # a text of one character loses what ended before it anyway
    yield (h >> np.uint32(32 - BITS))[inside[:-2]].astype(np.int64) + (2 << BITS), np.maximum(n - 2, 0)


def held(values: np.ndarray) -> np.ndarray:
    """The values in Arrow's memory, which goes back to the system as a whole; many small arrays of numpy's would leave the driver as large as they made it."""
    out = np.frombuffer(pa.allocate_buffer(values.nbytes), values.dtype)
    out[:] = values
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Vectors and output layer by gradient descent, one document a step, with a falling rate."""
    weights = np.zeros(BAGS << BITS, np.float32)
    if not len(texts):
        return Model(weights, 0.0)
    rng = np.random.default_rng(seed)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 50):
        part = pa.array(texts[at : at + 50], pa.string())
        each = [(f, np.cumsum(c) - c, c) for f, c in bags(part)]
        for k in range(len(part)):
            some = [(f[s[k] : s[k] + c[k]], c[k]) for f, s, c in each if c[k]]
            found = [(np.unique(f, return_counts=True), c) for f, c in some]
            index = np.concatenate([u for (u, _), _ in found]) if found else np.empty(0, np.int64)
            share = np.concatenate([t / c / len(found) for (_, t), c in found]) if found else np.empty(0)
            docs.append((held(index.astype(np.int32)), held(share.astype(np.float32))))
    vectors = rng.normal(0, 0.1, (BAGS << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            index, share = docs[k]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = share @ vectors[index]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * p
            if len(index):
                # Divided by the squared shares, a step moves the average by the rate, however many features there are.
                vectors[index] -= (lr / np.float32(share @ share)) * share[:, None] * back[None, :] * np.float32(0.1)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts == part


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """The first `most` labelled rows in the order of a hash of the id, or as many of them, one at least, as have `most_bytes` of text in all;
    so a text's length doesn't keep it out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).where("_low = _high")
    total = known.count()
    if not total:
        return [], np.empty(0, np.int64)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.4 * most / total)))
    rows = docs.where(learn).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen.select("_id", "_low"), "_id")
    order = [F.xxhash64(F.lit(2), "_id").alias("_order"), F.xxhash64("_text").alias("_hash")]
    sizes = rows.select(*order, F.octet_length("_text").alias("_bytes")).orderBy("_order", "_hash").limit(most).collect()
    run = np.cumsum([r["_bytes"] for r in sizes])
    n = max(1, int(np.searchsorted(run, most_bytes, "right"))) if len(sizes) else 0
    if not n:
        return [], np.empty(0, np.int64)
    found = rows.select("_text", "_low", *order).where(F.col("_order") <= sizes[n - 1]["_order"]).orderBy("_order", "_hash", "_text").limit(n).collect()
    return [r["_text"] for r in found], np.array([int(r["_low"]) for r in found])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, **of) -> Model:
    model = train(*sample(docs, labels, learn, **of))
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of `docs`, with the probability of label 1 added."""
    spark = docs.sparkSession
    spans.prepare(spark, by_bytes=True)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    name = text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, name, spans.CHUNK_BYTES // 4):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(pc.fill_null(part.column(name), "")))], [*part.schema.names, into])

    return docs.mapInArrow(run, schema)
