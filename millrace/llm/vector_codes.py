"""Vector compression by integer codes: product quantization with weighted Lloyd rounds over distinct parts.

1. `integer_parts`: vectors without nulls and non-finite components that aren't empty, as floor(scale * x), cut into equal
   consecutive parts.
2. Equal parts at a position become one row with a weight; copies are counted before they are shuffled, so a vector that a
   third of all rows have is one row a position.  The table is written, as all rounds read it.
3. Each round every task assigns its distinct rows to the nearest entries and adds up components and weights for each
   entry: positions x entries rows a task, whatever its input.  The new codebooks are those sums, divided.  All is in whole
   numbers, so neither the order of rows nor the number of tasks shows in a result.
4. Codes and errors are joined back by position and part.  Parts with more than a 64th of all vectors, of which there are at
   most 64 a position, are sent to all executors; the rest meet by a shuffle in which no key is larger.

Sums of a label's errors come back to its rows in the same way.

Defined results: of a table with fewer vectors than entries the codebooks have as many entries as there are vectors; with none the
result is empty; rows with equal ids are all kept, and the first entries go by id, then by components; a null id sorts last;
ties in distance go to the lower index; entries without rows stay.  Vectors of another length than that of the smallest id, a
length that isn't a multiple of the number of parts, and components beyond +-2^24 after scaling are errors.  Other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans
from millrace.llm.storage import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A key with more than this share of the rows is joined by sending it to all executors.
HOT_SHARE = 64
#: Squared distances and their sums over a position stay whole numbers of 64 bits.
MOST = 1 << 24


@dataclass
class Codes:
    """rows: id, label, codes (array<int>), error; codebooks: for each position its entries."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def fingerprint(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def integer_parts(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """id, label, whole (a hash of the vector) and parts (array of arrays of int) of the vectors whose components are all finite."""
    v = F.col(vector)
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    n = F.size("x")
    fits = (F.pmod(n, F.lit(parts)) == 0) & F.forall("x", lambda x: F.abs(x) < MOST)
    whole = F.when(fits, F.transform("x", lambda x: F.floor(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a vector's length is no multiple of {parts}, or a component is too large")))
    kept = vectors.where(finite).select(F.col(vector_id).alias("id"), F.col(label).alias("label"), scaled.alias("x")).select("id", "label", whole.alias("v"))
    width = (F.size("v") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", k * width + 1, width))
    return kept.select("id", "label", F.xxhash64("v").alias("whole"), cut.alias("parts"))


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`rows` with the columns of `facts`, which has each combination of keys once and, as `weight`, how many rows have it.

    more: adds columns to facts, after they are parted.  Null keys are equal.  Where weights add up to `total`,
    fewer than HOT_SHARE facts weigh more than its HOT_SHARE-th part; they are broadcast.
    """
    hot = F.col(weight) > max(1, total // HOT_SHARE)
    own = {k: f"_fact_{i}" for i, k in enumerate(keys)}
    heavy, light = (more(facts.where(on)).withColumnsRenamed(own) for on in (hot, ~hot))
    added = [c for c in heavy.columns if c not in own.values() and c != weight]
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
    met = rows.join(F.broadcast(heavy.withColumn("_met", F.lit(True))), same, "left")
    others = met.where("_met IS NULL").select(*rows.columns).join(light, same)
    return met.where("_met").select(*rows.columns, *added).union(others.select(*rows.columns, *added))


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry, the first of equal ones, and the squared distance."""
    d = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book):
        diff = x - entry
        d[:, k] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _matrices(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each position its rows' numbers in the batch and their components."""
    at = batch.column("pos").to_numpy()
    width = books[0].shape[1]
    part = batch.column("part")
    if len(part.flatten()) != len(part) * width or (pc.list_value_length(part).to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors have different lengths")
    x = part.flatten().to_numpy().astype(np.int64).reshape(-1, width)
    for pos in np.unique(at).tolist():
        rows = np.flatnonzero(at == pos)
        yield pos, rows, x[rows]


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over pos, part and weight."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width), np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for pos, rows, x in _matrices(batch, books):
                best, _ = _nearest(x, books[pos])
                w = weight[rows]
                order = np.argsort(best, kind="stable")
                used, at = np.unique(best[order], return_index=True)
                total[pos][used] += np.add.reduceat(x[order] * w[order, None], at)
                count[pos][used] += np.add.reduceat(w[order], at)
        used = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used]), pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64()))],
                ["pos", "entry", "n", "total"],
            )

    each = distinct.mapInArrow(sums, "pos int, entry int, n long, total array<long>")
    # Decimals, as a sum over all rows may pass 64 bits; positions x entries rows come to the driver.
    columns = [F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)]
    out = [b.copy() for b in books]
    for r in each.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *columns).collect():
        out[r["pos"]][r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(width)]
    return out


def assign(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """pos, part and weight with code, the number of the nearest entry, and error, its squared distance."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for pos, rows, x in _matrices(batch, books):
                code[rows], error[rows] = _nearest(x, books[pos])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("pos", "part", "weight")] + [pa.array(code), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return distinct.mapInArrow(codes, "pos int, part array<int>, weight long, code int, error long")


def compress(
    vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codes:
    """Codes and errors of all vectors that are kept, and the codebooks after the last round."""
    spans.prepare(vectors.sparkSession)
    rows = integer_parts(vectors, vector_id, vector, label, scale, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()  # `entries` rows
    if len({len(r["parts"][0]) for r in first}) > 1:
        raise ValueError("vectors have different lengths")
    books = [np.array([r["parts"][p] for r in first], np.int64) for p in range(parts)] if first else []
    columns = "id", "label", "codes", "error"
    if not books:
        empty = rows.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.where(F.lit(False)), [])
    places = rows.select("id", "label", "whole", F.posexplode("parts").alias("pos", "part"))
    distinct = written(places.groupBy("pos", "part").agg(F.count("*").alias("weight")), "parts")
    total = distinct.where("pos = 0").agg(F.sum("weight").alias("n")).first()["n"]
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = join_counted(places, distinct, ["pos", "part"], "weight", total, lambda df: assign(df, books))
    # A vector's parts come together again; equal rows are one with a count.
    at = lambda c, p: F.max(F.when(F.col("pos") == p, F.col(c)))
    own = coded.groupBy("id", "label", "whole").agg(F.count_if(F.col("pos") == 0).alias("n"), F.array(*(at("code", p) for p in range(parts))).alias("codes"), F.array(*(at("error", p) for p in range(parts))).alias("errors"))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x)
    return Codes(own.select("id", "label", "codes", error.alias("error"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*columns), [b.tolist() for b in books])


def with_label_error(rows: DataFrame) -> DataFrame:
    """`rows` (label, error) with label_error, the sum of the errors of all rows with the label."""
    rows = written(rows, "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_counted(rows, sums, ["label"], "n", rows.count())


def hex_code(codes: Column | str) -> Column:
    """Two hex digits for each number up to 255."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
