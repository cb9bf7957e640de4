"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of positions.  Each shard owns `virtual_nodes` of them, and a
key (a document's id) hashes to a position and belongs to the shard of the next virtual
node clockwise.  Loads are bounded: a shard takes keys in ring order until it is full, and
what overflows continues clockwise to the next virtual node of a shard with room.

With the default bound (`slack` 0) the capacities add up to the number of documents, so
every shard gets floor(n / shards) or one more: the `rows` law.  With slack e a shard
takes up to (1 + e) times that, and less moves when shards or documents are added.

Only counts of the ring's positions (a fixed number of rows, whatever the input) come to
the driver, which walks the ring once and cuts it into segments: position, ranks from and
to, shard and first slot.  The documents are ranked within their position, and positions
within salts, so a key or position that holds a third of the rows is spread over many
tasks; then they meet the segments in a broadcast join of fixed size.

Defined results: a null text counts as empty (size 1, crc32 0); a null id is a key of its
own; rows with equal ids share a position and may be cut apart by a bound; an empty table
gives an empty result; columns that clash with the result's names are replaced.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.storage import written

POSITIONS, VIRTUAL_NODES, SALTS = 1 << 16, 128, 32


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, positions: int = POSITIONS) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order; two at a position keep the order of their shards."""
    return sorted((xxhash.xxh64_intdigest(f"{s}#{v}") % positions, s) for s in range(shards) for v in range(virtual_nodes))


def capacities(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """Bounds of the shards.  Without slack they add up to n and differ by one at most."""
    if slack:
        return [int(-(-n * (1 + slack) // shards))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def segments(counts: dict[int, int], shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, positions: int = POSITIONS) -> list[tuple[int, int, int, int, int]]:
    """(position, rank from, rank to, shard, slot of the first) from the documents at each position."""
    nodes = ring(shards, virtual_nodes, positions)
    places = [p for p, _ in nodes]
    room, used, out = capacities(sum(counts.values()), shards, slack), [0] * shards, []
    for p in sorted(counts):
        k, rank = bisect.bisect_left(places, p), 0
        while rank < counts[p]:
            shard = nodes[k % len(nodes)][1]
            take = min(counts[p] - rank, room[shard] - used[shard])
            if take:
                out.append((p, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
            k += 1
    return out


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, positions: int = POSITIONS, salts: int = SALTS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null: adding a shard moves more than it takes)."""
    spark, t = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(key).alias("_key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(positions)).cast("int").alias("position"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
    )
    keyed = written(keyed, "ring_keys")  # the salts must not change between counting and ranking
    by_salt = keyed.groupBy("position", "salt").agg(F.count("*").alias("n"))
    own = Window.partitionBy("position").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("position", "salt", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("offset"))  # positions x salts rows at most
    counts = {r["position"]: r["n"] for r in keyed.groupBy("position").agg(F.count("*").alias("n")).collect()}  # `positions` rows at most
    cut = spark.createDataFrame(segments(counts, shards, slack, virtual_nodes, positions), "position int, low long, high long, shard int, base long")
    in_salt = Window.partitionBy("position", "salt").orderBy("_key", "text_crc32", "size")
    ranked = keyed.withColumn("in_salt", F.row_number().over(in_salt) - 1).join(offsets, ["position", "salt"]).withColumn("rank", F.col("in_salt") + F.col("offset"))
    return (
        ranked.join(F.broadcast(cut), "position").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes" if slack else "rows").alias("law"), "shard",
            (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
