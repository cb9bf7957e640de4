"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its 5-word shingles.  Documents a and b link if
100 |a & b| >= 75 |a | b|.  Of a set of n at least o = ceil(0.75 n) must be in the other, so
two that link share l tokens among the first n - o + l of each, for any l, in any order of
tokens that is the same for all.

1. `signatures`: id, set size and fingerprint of each document; equal sets are one node from here on.
   The same pass counts all tokens in a sketch of fixed size.
2. Tokens are ordered by how far their count stands out of the sketch's noise, rare ones first, then
   by hash.  Each document takes the l that costs least: a longer prefix costs postings, and its
   expected candidates are those of its tokens by the sketch, divided by l, as each must match l times.
   A token whose list is longer than SHORT is taken for one of SHORT, which is what a member of it costs below.
3. Prefixes meet by token, in parts of a bounded number of postings.  Lists of up to SHORT nodes give
   their pairs with the number of matches.  Longer lists are set aside; one that is long within a
   chunk of a task's input is set aside there and then, so that none gathers in one task.
4. A pair needs as many matches as the smaller l.  It needs more, too: whose prefix ends first has
   o - l tokens left, so that the matches and those must make up the overlap.  Matches in long lists aren't counted;
   they are at most as many as either has there.
5. Pairs that share long lists only must share l of them, so nodes in fewer lists than any partner of a fitting size asks for leave
   them.  A list's leader (the node of the least hash) stands for the list, and lists with
   one leader are one cluster, so that nearly all lists of a group of copies fall together.  All nodes are compared with their
   leaders, then with a few more, but only where they aren't connected yet.  Clusters whose nodes are all connected are done.  Of the others, nodes that aren't in the cluster's largest component are compared with all nodes in blocks of BLOCK tokens, by
   inverted lists in memory; only links that connect something come out.
6. Pairs of short lists are verified best first: each node's pair with the most matches, then those
   whose ends are not connected yet.
7. Links make components (contraction, see `components`), and each gets its smallest document id.

`join` returns links enough to connect all that link; those between nodes that others connect already are not looked for.

Defined results: null or empty texts have an empty set, no links, and their own id as
component; a text of fewer than 5 words is one shingle; rows with equal ids are nodes of
their own; null ids are not considered for the smallest id; ids are whole numbers; an empty table gives an
empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans
from millrace.llm.components import components
from millrace.llm.native import unused
from millrace.llm.storage import drop_written, written

WORDS, PERCENT, SHORT, ROUNDS, HEADS, FILTER_WORDS = 5, 75, 16, 2, 4, 1 << 17
#: Buckets of the sketch (a power of two), and the blocks in which it travels.
BITS, SKETCH_BLOCKS = 22, 64
#: Buckets whose levels are found at once, so that the driver holds little besides the sketch; words of a bit filter that come to it as one value.
LEVEL_BLOCK, FILTER_BLOCK = 1 << 16, 1 << 10
#: Postings that a task holds before it passes them on, postings of a part, and tokens of a block.
CHUNK, PART, BLOCK = 1 << 21, 1 << 20, 1 << 20
#: Postings, and rows of lists, that leave Python in one Arrow batch, about; the JVM holds a batch as a whole outside its heap.
SENT_POSTINGS, SENT_ROWS = 1 << 16, 1 << 14
#: What a candidate costs, in postings; how many others are expected to have a token that doesn't stand out, at least and by the
#: deviation of the sketch's counts, among which they would hide; the choice of l.
CANDIDATE, ORDINARY, HIDDEN = 3.0, 0.25, 0.1
LADDER = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: A posting's key: the token's level in the upper bits, then the upper bits of its hash.
LEVEL_SHIFT = np.uint64(58)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and how many each has."""
    data, offsets = spans.buffers(texts)
    data = _LOWER[data]
    begin, end, counts = spans.words(data, offsets)
    return spans.sorted_sets(*spans.shingles(spans.hashes(data, begin, end), counts, k))


def fingerprints(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set a signed number, 0 for the empty one alone."""
    out, some = np.zeros(len(n), np.int64), n > 0
    if some.any():
        starts = (np.cumsum(n) - n)[some]
        one = np.bitwise_xor.reduceat(tokens * np.uint64(0x9E3779B97F4A7C15) ^ (tokens >> np.uint64(29)), starts)
        h = spans.mix(np.add.reduceat(tokens, starts) * np.uint64(3) + one + n[some].astype(np.uint64)).view(np.int64)
        out[some] = np.where(h == 0, 1, h)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with the tokens, set sizes and fingerprints of `_text`."""
    for batch in batches:
        for part in spans.chunks(batch, "_text", spans.CHUNK_BYTES // 4):
            tokens, n = token_sets(part.column("_text"))
            yield part, tokens, n, fingerprints(tokens, n)


def _first_of_each(nodes: np.ndarray) -> np.ndarray:
    """Whether a node is not 0 and occurs for the first time."""
    out = np.zeros(len(nodes), bool)
    out[np.unique(nodes, return_index=True)[1]] = True
    return out & (nodes != 0)


class Sketch:
    """How often tokens of each of 2^BITS buckets occur, whatever the number of tokens."""

    def __init__(self):
        self.counts, self.any = np.zeros(1 << BITS, np.uint64), False

    def add(self, tokens: np.ndarray) -> None:
        """Counts in place; an array of counts for each call, or tokens that wait, would be as large as the sketch or larger."""
        np.add.at(self.counts, (tokens >> np.uint64(64 - BITS)).astype(np.int64), np.uint64(1))
        self.any |= len(tokens) > 0

    def blocks(self) -> list[bytes]:
        return [_packed(x) for x in self.counts.reshape(SKETCH_BLOCKS, -1)]


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes(), 1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketches' blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(zlib.decompress(counts.as_buffer()), "<u4")
            if block in sums:
                sums[block] += own
            else:
                sums[block] = own.astype(np.uint64)
    packed = [_packed(x) for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def levels(counts: np.ndarray) -> np.ndarray:
    """Of each bucket 0 if its count is what chance gives, else one more than twice the logarithm of the rest."""
    mean, out = counts.mean(dtype=np.float64), np.zeros(len(counts), np.uint8)
    for at in range(0, len(counts), LEVEL_BLOCK):
        over = counts[at : at + LEVEL_BLOCK] - mean
        out[at : at + LEVEL_BLOCK] = np.where(over <= 4 * np.sqrt(mean) + 1, 0, np.minimum(1 + np.floor(2 * np.log2(np.maximum(over, 1))), 63))
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _content (a hash of the text), n and node (null without shingles) of each row; and rows with the sketches' blocks."""
    names = ["_id", "_content", "n", "node", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for part, tokens, n, nodes in _parts(batches):
            sketch.add(tokens[np.repeat(_first_of_each(nodes), n)])
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_content"), pa.array(n.astype(np.int64)), pa.array(nodes, mask=nodes == 0), *none], names)
        if sketch.any:
            empty = [pa.nulls(SKETCH_BLOCKS, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(sketch.blocks(), pa.binary())], names)

    columns = F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_content"), F.col(text).alias("_text")
    return docs.select(*columns).mapInArrow(spans.alone(run), "_id bigint, _content bigint, n bigint, node bigint, block int, counts binary")


def _levels(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """The level of each bucket, how many tokens there are, and how many others have an ordinary one.  Only the sketch, of fixed size, comes to the driver."""
    schema = "block int, counts binary"
    sketches = rows.where("block IS NOT NULL").select("block", "counts").mapInArrow(spans.alone(_added), schema)
    counts = np.zeros((SKETCH_BLOCKS, (1 << BITS) // SKETCH_BLOCKS), np.uint32)
    packed = sketches.repartition(SKETCH_BLOCKS, "block").mapInArrow(spans.alone(_added), schema).toArrow()
    for k in range(packed.num_rows):
        counts[packed.column("block")[k].as_py()] = np.frombuffer(zlib.decompress(packed.column("counts")[k].as_py()), "<u4")
    counts = counts.reshape(-1)
    return levels(counts), int(counts.sum(dtype=np.uint64)), max(ORDINARY, HIDDEN * float(np.sqrt(counts.mean(dtype=np.float64))))


def keys(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Numbers by which tokens are ordered."""
    own = level[(tokens >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64)
    return own << LEVEL_SHIFT | tokens >> np.uint64(64) - LEVEL_SHIFT


def prefixes(ordered: np.ndarray, n: np.ndarray, percent: int, short: int, ordinary: float = ORDINARY) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, whose keys are in order, the l that costs least and how long its prefix then is.
    ordinary: how many others are expected to have a token that doesn't stand out."""
    least = -(-percent * n // 100)
    level = (ordered >> LEVEL_SHIFT).astype(np.int64)
    expected = np.append(min(ordinary, short + 1), np.minimum(2.0 ** (np.arange(63) / 2), short + 1))[level]
    run, start = np.append(0, np.cumsum(expected)), np.cumsum(n) - n
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for x in LADDER:
        length = np.minimum(n, n - least + x)
        cost = length + CANDIDATE * (run[start + length] - run[start]) / x
        better = (x <= least) & (cost < best)
        best[better], matches[better] = cost[better], x
    return matches, np.minimum(n, n - least + matches)


def _pack(token: np.ndarray, node: np.ndarray, n: np.ndarray, matches: np.ndarray) -> bytes:
    return b"".join((token.astype("<u8").tobytes(), node.astype("<i8").tobytes(), n.astype("<i4").tobytes(), matches.astype("<u2").tobytes()))


def _unpack(data: list[bytes]) -> list[np.ndarray]:
    """Keys, nodes, sizes and matches asked of the postings."""
    each = []
    for raw in data:
        k = len(raw) // 22
        each.append([np.frombuffer(raw, "<u8", k), np.frombuffer(raw, "<i8", k, 8 * k), np.frombuffer(raw, "<i4", k, 16 * k), np.frombuffer(raw, "<u2", k, 20 * k)])
    return [np.concatenate(x) for x in zip(*each, strict=True)] if each else [np.empty(0, t) for t in ("<u8", "<i8", "<i4", "<u2")]


def _postings(docs: DataFrame, text: str, level: np.ndarray, ordinary: float, parts: int, percent: int, short: int) -> DataFrame:
    """Blocks of postings: (part, is_long, data).  A token of more than `short` nodes of a chunk is long; every part gets a
    posting of node 0 for each such token."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # of fixed size
    names = ["part", "is_long", "data"]

    def blocks(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Of what is held, which goes from there; it leaves a few parts at a time."""
        key, length, nodes, n, matches = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        first = _first_of_each(nodes)
        if not first.all():
            key, length, nodes, n, matches = key[np.repeat(first, length)], length[first], nodes[first], n[first], matches[first]
        doc = np.repeat(np.arange(len(nodes), dtype=np.int32), length)
        bucket = (key >> np.uint64(20)).astype(np.int32) & np.int32(0xFFFFF)
        some = np.flatnonzero((np.bincount(bucket, minlength=1 << 20) > short)[bucket])
        del bucket
        unique, inverse, counts = np.unique(key[some], return_inverse=True, return_counts=True)
        marks, at = unique[counts > short], some[(counts > short)[inverse]]
        del some, unique, inverse, counts
        if len(marks):
            to = pa.array([int(marks[0] % np.uint64(parts))], pa.int32())
            for k in range(0, len(at), SENT_POSTINGS):
                x = at[k : k + SENT_POSTINGS]
                own = doc[x]
                yield pa.RecordBatch.from_arrays([to, pa.array([True]), pa.array([_pack(key[x], nodes[own], n[own], matches[own])], pa.binary())], names)
            short_ = np.ones(len(key), bool)
            short_[at] = False
            key, doc = np.append(key[short_], marks), np.append(doc[short_], np.full(len(marks), -1, np.int32))
        del at
        part = (key % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(part)))
        del part
        nodes, n, matches = np.append(nodes, 0), np.append(n, 0), np.append(matches, 0)
        some = np.flatnonzero(np.diff(bounds))
        for own in np.split(some, np.flatnonzero(np.diff(bounds[some] // SENT_POSTINGS)) + 1) if len(some) else []:
            data = []
            for x, y in zip(bounds[own].tolist(), bounds[own + 1].tolist(), strict=True):
                at = order[x:y]
                d = doc[at]
                data.append(_pack(key[at], nodes[d], n[d], matches[d]))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(len(data), bool)), pa.array(data, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, tokens, n, nodes in _parts(batches):
            first = _first_of_each(nodes)
            tokens, n, nodes = tokens[np.repeat(first, n)], n[first], nodes[first]
            if not len(n):
                continue
            ordered, _ = spans.sorted_sets(keys(tokens, shared.value), n)
            if len(ordered) < len(tokens):  # two tokens of one document with the same upper bits; both stay
                ordered = keys(tokens, shared.value)
                for x, y in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True):
                    ordered[x:y].sort()
            matches, length = prefixes(ordered, n, percent, short, ordinary)
            held.append((ordered[spans.ranges(np.cumsum(n) - n, length)], length, nodes, n, matches))
            size += int(length.sum())
            if size >= CHUNK:
                yield from blocks(held)
                size = 0
        if held:
            yield from blocks(held)

    return docs.select(F.col(text).alias("_text")).mapInArrow(spans.alone(run), "part int, is_long boolean, data binary")


_LIST_SCHEMA = "is_long boolean, x bigint, y bigint, nx bigint, ny bigint, lx bigint, ly bigint, c bigint"


def _lists(postings: DataFrame, short: int) -> DataFrame:
    """From blocks in the order of their parts: of short lists the pairs x < y with sizes, matches asked and how many they have in this
    part; of long ones x is the token and y the node."""

    def out(is_long: bool, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(columns[0]), SENT_ROWS):
            own = [c[k : k + SENT_ROWS].astype(np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), is_long)), *map(pa.array, own)], [f.split()[0] for f in _LIST_SCHEMA.split(", ")])

    def members(token, node, n, matches) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(token), np.int64)
        return out(True, token.view(np.int64), node, n, zero, matches, zero, zero)

    def lists(token, node, n, matches) -> Iterator[pa.RecordBatch]:
        order = np.argsort(token)
        sorted_ = token[order]
        same = sorted_[1:] == sorted_[:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]
        order = order[np.lexsort((node[order], token[order]))]
        token, node, n, matches = token[order], node[order], n[order], matches[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # equal sets of several chunks
        token, node, n, matches = token[keep], node[keep], n[keep], matches[keep]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(token)))
        is_long = sizes > short
        marks = np.repeat(np.add.reduceat(node == 0, starts) > 0, sizes) if len(token) else np.empty(0, bool)
        is_long |= marks[starts]
        rows = np.repeat(is_long, sizes) & (node != 0)
        if rows.any():
            yield from members(token[rows], node[rows], n[rows], matches[rows])
        pairs = []
        for g in np.unique(sizes[~is_long & (sizes > 1)]).tolist():
            at = starts[~is_long & (sizes == g)][:, None]
            i, j = np.triu_indices(g, 1)
            pairs.append(((at + i).reshape(-1), (at + j).reshape(-1)))  # nodes ascend within a list
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((node[j], node[i]))
            i, j = i[order], j[order]
            new = np.flatnonzero(np.append(True, (node[i[1:]] != node[i[:-1]]) | (node[j[1:]] != node[j[:-1]])))
            times = np.diff(np.append(new, len(i)))
            i, j = i[new], j[new]
            yield from out(False, node[i], node[j], n[i], n[j], matches[i], matches[j], times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for own, is_long, data in zip(batch.column("part").to_pylist(), batch.column("is_long").to_pylist(), batch.column("data"), strict=True):
                if is_long:
                    yield from members(*_unpack([data.as_py()]))
                    continue
                if own != part and held:
                    yield from lists(*_unpack(held))
                    held = []
                part = own
                held.append(data.as_py())
        if held:
            yield from lists(*_unpack(held))

    return postings.mapInArrow(spans.alone(run), _LIST_SCHEMA)


def _bits(values: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over a column of longs, `key`."""
    at = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(FILTER_WORDS - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = values.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("b"))
    blocks = words.groupBy(F.floor(F.col("at") / FILTER_BLOCK)).agg(F.collect_list("at").alias("at"), F.collect_list("b").alias("b"))
    bits, table = np.zeros(FILTER_WORDS, np.int64), blocks.toArrow()  # FILTER_WORDS words at most, in few rows
    for k in range(table.num_rows):
        bits[table.column("at")[k].values.to_numpy()] = table.column("b")[k].values.to_numpy()
    return bits


def _key(doc_id: Column, content: Column) -> Column:
    return F.xxhash64(doc_id, content)


def _node_sets(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes asked for, from one document of each: those that pass a bit filter, then exactly."""
    wanted = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(_key(F.col("_id"), F.col("_content"))).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            hit = bits[(key >> np.uint64(6) & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)
            for _, tokens, n, own in _parts([batch.filter(pa.array(hit.astype(bool)))]):
                first, ends = _first_of_each(own), np.cumsum(n)
                each = [tokens[e - k : e].tobytes() for e, k in zip(ends[first].tolist(), n[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(each, pa.binary())], ["node", "tokens"])

    source = docs.select(_key(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("key"), F.col(text).alias("_text"))
    return source.mapInArrow(spans.alone(run), "node bigint, tokens binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, node_sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the pairs (a, b).  b's set is sent to where a's pairs are; of a node with many pairs, b had better be that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            linked = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(linked) for c in ("a", "b")], ["a", "b"])

    sa, sb = node_sets.toDF("a", "ta"), node_sets.toDF("b", "tb")
    return pairs.select("a", "b").distinct().join(sa, "a").join(sb, "b").select("a", "b", "ta", "tb").mapInArrow(spans.alone(run), "a bigint, b bigint")


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _candidates(lists: DataFrame, long_: DataFrame, percent: int) -> DataFrame:
    """(a, b, c): pairs of short lists with as many matches as they must have."""
    pairs = lists.where(~F.col("is_long")).groupBy(F.col("x").alias("a"), F.col("y").alias("b"), "nx", "ny", "lx", "ly").agg(F.sum("c").alias("c")).where(_sizes_fit("nx", "ny", percent))
    held = long_.groupBy("node").agg(F.count("*").alias("h"))
    ha, hb = held.toDF("a", "ha"), held.toDF("b", "hb")
    rest = lambda n, x: F.ceil(F.col(n) * percent / 100) - F.col(x)  # noqa: E731  what a prefix leaves out
    overlap = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    asked = F.greatest(F.least("lx", "ly"), overlap - F.greatest(rest("nx", "lx"), rest("ny", "ly")))
    most = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    return pairs.join(ha, "a", "left").join(hb, "b", "left").where(most >= asked).select("a", "b", "c")


def _needed(long_: DataFrame, percent: int) -> DataFrame:
    """The rows of nodes that are in as many long lists as they must share.  A pair needs the matches that one of both asks for, so a node needs
    its own l, or the least of the nodes in its lists whose sizes are near enough; sizes are taken in bands, of which neighbours are near."""
    band = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(100 / percent)) + 1e-9))
    banded = long_.withColumn("band", band)
    near = banded.groupBy("token", "band").agg(F.min("l").alias("low")).select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "low")
    near = near.groupBy("token", "band").agg(F.min("low").alias("low"))
    asked = banded.join(near, ["token", "band"]).groupBy("node").agg(F.count("*").alias("k"), F.min(F.least("l", "low")).alias("asked"))
    return long_.join(asked.where("k >= asked").select("node"), "node", "left_semi")


def _clusters(long_: DataFrame) -> DataFrame:
    """(leader, node, n): all nodes of the lists that have this leader."""
    leaders = long_.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("l")).select("token", F.col("l.node").alias("leader"))
    return long_.join(leaders, "token").select("leader", "node", "n").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, into: str) -> DataFrame:
    """`rows` with the component of a node, which is the node itself while nothing links to it."""
    if labels is None:
        return rows.withColumn(into, F.col(node))
    return rows.join(labels.select(F.col("node").alias("_of"), F.col("label").alias("_is")), F.col(node) == F.col("_of"), "left").withColumn(into, F.coalesce("_is", node)).drop("_of", "_is")


def _mixed(members: DataFrame, keys: list[str]) -> DataFrame:
    """The members of groups that hold more than one component."""
    several = members.groupBy(*keys).agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select(*keys)
    return members.join(several, keys, "left_semi")


def _heads(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): nodes of mixed clusters with HEADS ** k nodes of the cluster each, where they aren't connected."""
    salt = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(HEADS**k))
    heads = members.groupBy("leader", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64(F.lit(-k), "node").alias("h"), "node", "n", "label")).alias("l"))
    heads = heads.groupBy("leader").agg(F.collect_list("l").alias("ls"))  # HEADS ** k at most
    met = members.join(heads, "leader").select("node", "n", "label", F.explode("ls").alias("l")).select("node", "n", "label", F.col("l.node").alias("b"), F.col("l.n").alias("nb"), F.col("l.label").alias("lb"))
    return met.where((F.col("label") != F.col("lb")) & _sizes_fit("n", "nb", percent)).select(F.col("node").alias("a"), "b").distinct()


def block_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect different components of a block: nodes outside its largest one against all nodes."""
    names, own = np.unique(labels, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.fromiter(map(len, sets), np.int64, len(sets))
    unique, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner = np.repeat(np.arange(len(sets)), size)[shared]
    token, found = inverse[shared], []
    mine = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sets))))
    order = np.argsort(token, kind="stable")
    have, starts, lengths = owner[order], np.append(0, np.cumsum(np.bincount(token, minlength=len(unique)))), np.bincount(token, minlength=len(unique))
    for s in np.flatnonzero(own != np.bincount(own).argmax()).tolist():
        tokens = token[mine[s] : mine[s + 1]]
        both = np.bincount(have[spans.ranges(starts[tokens], lengths[tokens])], minlength=len(sets))
        links = np.flatnonzero((100 * both >= percent * (size + size[s] - both)) & (own != own[s]))
        for label, at in zip(*np.unique(own[links], return_index=True), strict=True):
            x, y = find(int(own[s])), find(int(label))
            if x != y:
                parent[x] = y
                found.append((int(nodes[s]), int(nodes[links[at]])))
    return found


def _in_blocks(members: DataFrame, node_sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) within mixed clusters that connect what is not connected yet.  A cluster of more than `block` tokens is dealt to
    blocks by a hash of the node, and any two of its blocks meet in one group."""
    sizes = members.groupBy("leader").agg(F.ceil(F.sum("n") / block).cast("int").alias("k"))
    dealt = members.join(sizes, "leader").withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("k")).cast("int"))
    other = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("leader", "node", "label", "own", F.explode(other).alias("other")).select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
    groups = _mixed(dealt, ["leader", "i", "j"]).join(node_sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, labels, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = block_links(np.array(nodes), np.array(labels), sets, percent) if nodes else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for leader, i, j, node, label, tokens in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "node", "label", "tokens")), strict=True):
                if (leader, i, j) != key:
                    yield links()
                    key, nodes, labels, sets = (leader, i, j), [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(np.frombuffer(tokens, np.uint64))
        yield links()

    order = ["leader", "i", "j"]
    return groups.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "label", "tokens").mapInArrow(spans.alone(run), "a bigint, b bigint")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, short: int = SHORT, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, links): _id, _content, n, node and label of each document, and verified links (a, b) between nodes, enough to connect all that link."""
    spark = docs.sparkSession
    spans.prepare(spark, by_bytes=True)
    docs = docs.select(doc_id, text)
    found_rows = written(signatures(docs, doc_id, text), "signatures")
    rows = found_rows.where("block IS NULL").drop("block", "counts")
    level, tokens, ordinary = _levels(found_rows)
    # About 0.3 of all tokens are in prefixes; a part holds PART of them on average.
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(0.3 * tokens / PART))
    dealt = _postings(docs, text, level, ordinary, parts, percent, short).repartition("part").sortWithinPartitions("part")
    lists = written(_lists(dealt, short), "prefix_lists")
    long_ = lists.where("is_long").select(F.col("x").alias("token"), F.col("y").alias("node"), F.col("nx").alias("n"), F.col("lx").alias("l")).distinct()
    pending = written(_candidates(lists, long_, percent), "short_pairs")
    clusters = written(_clusters(_needed(long_, percent)), "clusters")
    nodes = pending.select(F.explode(F.array("a", "b")).alias("node")).union(clusters.select("node")).distinct()
    node_sets = written(_node_sets(docs, doc_id, text, rows.where("node IS NOT NULL"), nodes), "node_sets")
    best = pending.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    if rounds:
        of_leader = clusters.select(F.col("node").alias("leader"), F.col("n").alias("nl")).distinct()
        with_leader = clusters.where("node <> leader").join(of_leader, "leader").where(_sizes_fit("n", "nl", percent))
        best = best.union(with_leader.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    found = [written(_verified(best, node_sets, percent), "links")]
    labels = components(found[0])
    for k in range(1, rounds):
        members = _mixed(_labelled(clusters, labels, "node", "label"), ["leader"])
        more = written(_verified(_heads(members, k, percent), node_sets, percent), "links")
        if not more.isEmpty():
            found.append(more)
            labels = components(reduce(DataFrame.union, found))
    apart = _labelled(_labelled(pending.join(best, ["a", "b"], "left_anti"), labels, "a", "la"), labels, "b", "lb").where("la <> lb")
    more = _verified(apart, node_sets, percent)
    members = _mixed(_labelled(clusters, labels, "node", "label"), ["leader"])
    more = written(more.union(_in_blocks(members, node_sets, percent, block)), "links")
    if not more.isEmpty():
        found.append(more)
        labels = components(reduce(DataFrame.union, found))
    drop_written(node_sets)
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), reduce(DataFrame.union, found)


def component_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **of) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    rows, _ = join(docs, doc_id, text, **of)
    by_node = rows.where("node IS NOT NULL").groupBy("node", "label").agg(F.min("_id").alias("least"))
    of_label = by_node.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = by_node.join(of_label, "label").select("node", "component_id")
    return rows.drop("label").join(of_node, "node", "left").select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **of) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns; of several texts under that id, that of the
    smallest hash.  Documents without shingles or without an id stay.  Rows with equal ids and equal texts are one document."""
    rows, _ = join(docs.where(F.col(doc_id).isNotNull()), doc_id, text, **of)
    own = rows.where("node IS NOT NULL").select("label", F.struct("_id", "_content").alias("own"))
    dropped = own.join(own.groupBy("label").agg(F.min("own").alias("kept")), "label").where("own <> kept")
    here, gone, what = unused(docs.columns, "here", "gone", "what")
    dropped = dropped.select(F.col("own._id").alias(gone), F.col("own._content").alias(what)).distinct()
    marked = docs.withColumn(here, F.xxhash64(text))
    return marked.join(dropped, (F.col(doc_id) == F.col(gone)) & (F.col(here) == F.col(what)), "left_anti").drop(here)
