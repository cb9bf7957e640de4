"""Substring dedup by automata of repeated phrases.

A word goes if a window of 50 words over it also starts in a document with a smaller id.

1. Phrases.  Each window chooses one of its phrases (runs of 8 words), that of the smallest hash, so
   windows of equal words choose equal phrases, and neighbours mostly the same one: about one phrase
   for 22 words.  Counting documents by phrase confirms which recur; those of one document only are
   sent back to it, which is one row each, however often the others occur.
2. Automata.  Documents are dealt into blocks by id.  The recurring phrases of a block are compiled into
   Aho-Corasick automata of at most SHARD_PHRASES each, and all of the block's documents are
   streamed through all of them, which finds every occurrence, byte for byte.
3. Passages.  Windows around an occurrence that they chose are counted by hash; the smallest id of each is
   again sent back to that document alone.  What a document doesn't hold first, it loses.

So nothing is joined on a phrase or a window: what a third of all rows share is counted before it is
shuffled and returns as one row.  A block holds about BLOCK_BYTES of text or one longer document.

Windows are compared by 64-bit hashes of their words' hashes, phrases also by their bytes.

Defined results: a null text has no words; rows with equal ids are judged each, and none takes from the other, as
no id is smaller; a row without an id loses nothing and takes nothing; ids are numbers or
strings, compared as Spark does; an empty table gives no rows; columns other than id and text play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans
from millrace.llm.storage import written

WINDOW, PHRASE = 50, 8
#: Bytes of text in a block; phrases in an automaton, which takes about 3 KB for each.
BLOCK_BYTES, SHARD_PHRASES = 4 << 20, 20_000
RESULT = "id {id}, n_words long, n_removed long, removed array<struct<begin:long,end:long>>, kept_text string"


@dataclass
class Texts:
    """Words of some texts in one row of places, and the windows over them."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # of windows
    chosen: np.ndarray  # of each window, the place of its phrase
    window: int
    phrase: int

    @classmethod
    def of(cls, texts: pa.Array, window: int, phrase: int) -> Texts:
        data, offsets = spans.buffers(texts)
        begin, end, counts = spans.words(data, offsets)
        hashes = spans.hashes(data, begin, end)
        windows = np.maximum(counts - window + 1, 0)
        starts = spans.ranges(np.cumsum(counts) - counts, windows)
        chosen = np.empty(len(starts), np.int64)
        if len(starts):
            of_place = sliding_window_view(spans.runs(hashes, np.arange(len(hashes) - phrase + 1), phrase), window - phrase + 1)
            for k in range(0, len(starts), 1 << 16):  # each in the cache
                at = starts[k : k + (1 << 16)]
                chosen[k : k + len(at)] = at + of_place[at].argmin(1)
        return cls(data, begin, end, counts, hashes, starts, chosen, window, phrase)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chosen phrases, each once, and their hashes."""
        at = np.unique(self.chosen)
        return at, spans.runs(self.hashes, at, self.phrase)

    def rows(self, places: np.ndarray) -> np.ndarray:
        """Of places of words, the number of the text."""
        return np.searchsorted(np.cumsum(self.counts), places, "right")

    def stream(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with a space between them, or a line end between texts, and where each begins and ends there."""
        length = self.end - self.begin + 1
        to = np.cumsum(length)
        out, gap = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8), np.zeros(int(to[-1]) if len(to) else 0, bool)
        gap[to - 1] = True
        out[~gap] = self.data[~spans.SPACE[self.data]]
        ends = np.cumsum(self.counts)
        out[to[ends[ends > 0] - 1] - 1] = 10
        return out.tobytes(), to - length, to - 1


def occurrences(texts: Texts, places: np.ndarray, shard_phrases: int = SHARD_PHRASES) -> np.ndarray:
    """For each word whether a phrase begins there that also stands at one of `places`."""
    import ahocorasick

    raw, begin, end = texts.stream()
    last = texts.phrase - 1
    found = np.zeros(len(begin), bool)
    phrases = sorted({raw[a:b] for a, b in zip(begin[places].tolist(), end[places + last].tolist(), strict=True)})
    line = raw.decode("latin-1")  # a letter a byte
    for k in range(0, len(phrases), shard_phrases):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases[k : k + shard_phrases]:
            automaton.add_word(p.decode("latin-1"))
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(line)), np.int64).reshape(-1, 2)
        stop = hits[:, 0] + 1
        at = np.minimum(np.searchsorted(begin, stop - hits[:, 1]), len(begin) - texts.phrase)
        whole = (begin[at] == stop - hits[:, 1]) & (end[at + last] == stop)  # neither begins nor ends inside a word
        found[at[whole]] = True
    return found


def _held(rows: np.ndarray, hashes: np.ndarray, own: pa.Table, ids: pa.Array) -> np.ndarray:
    """Which of the hashes, each of a row with an id, the table `own` (id, hash) holds for that id."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    distinct = pc.unique(ids)
    of_row = pc.index_in(ids, distinct).to_numpy(zero_copy_only=False)
    of_own = pc.index_in(own.column("id").combine_chunks(), distinct)
    here = of_own.is_valid().to_numpy(zero_copy_only=False)
    of_own = of_own.fill_null(0).to_numpy(zero_copy_only=False)[here]
    own_hashes = own.column("hash").to_numpy()[here].view(np.uint64)
    order = np.argsort(of_own, kind="stable")
    of_own, own_hashes = of_own[order], own_hashes[order]
    key = of_row[rows]
    mine = np.argsort(key, kind="stable")
    out = np.zeros(len(rows), bool)
    edges = np.flatnonzero(np.diff(key[mine], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x, y = np.searchsorted(of_own, [key[mine[a]], key[mine[a]] + 1])
        out[mine[a:b]] = np.isin(hashes[mine[a:b]], own_hashes[x:y])
    return out


def _candidates(docs: pa.Table, facts: pa.Table, window: int, phrase: int, shard_phrases: int) -> tuple[Texts, np.ndarray, np.ndarray]:
    """A block's texts, the starts of windows whose phrase recurs, and their hashes."""
    texts = Texts.of(docs.column("text"), window, phrase)
    places, hashes = texts.phrases()
    recur = ~_held(texts.rows(places), hashes, facts.filter(pc.equal(facts.column("kind"), 1)), docs.column("id"))
    if not recur.any():
        return texts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = texts.starts[occurrences(texts, places[recur], shard_phrases)[texts.chosen]]
    return texts, starts, spans.runs(texts.hashes, starts, window)


def _kept(texts: Texts, removed: np.ndarray, ids: pa.Array) -> pa.Table:
    """Rows of the result; removed: starts of the windows that go."""
    n = len(texts.begin)
    gone = np.cumsum(np.bincount(removed, minlength=n + 1) - np.bincount(removed + texts.window, minlength=n + 1))[:n] > 0
    last = np.cumsum(texts.counts)
    first = last - texts.counts
    # Runs of words that go, each within one text.
    fresh = np.zeros(n + 1, bool)
    fresh[first], fresh[n] = True, True
    begins = np.flatnonzero(gone & (fresh[:-1] | ~np.concatenate([[False], gone[:-1]])))
    ends = np.flatnonzero(gone & (fresh[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    row = texts.rows(begins)
    of_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts.counts)))])
    removed_spans = pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), pa.StructArray.from_arrays([pa.array(begins - first[row]), pa.array(ends - first[row])], ["begin", "end"]))
    # Words that stay, a space after each but the last of a text.
    stay = ~gone
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[texts.begin[stay]] += 1
    inside[texts.end[stay]] -= 1
    letters = texts.data[np.cumsum(inside[:-1]) > 0]
    length = (texts.end - texts.begin)[stay] + 1
    kept = spans.per_text(stay, texts.counts)
    to = np.cumsum(length)
    tail = np.cumsum(kept)[kept > 0] - 1
    out, gap, drop = (np.full(int(to[-1]) if len(to) else 0, x, kind) for x, kind in ((32, np.uint8), (False, bool), (False, bool)))
    gap[to - 1] = True
    drop[to[tail] - 1] = True
    out[~gap] = letters
    size = spans.per_text((texts.end - texts.begin) * stay, texts.counts) + np.maximum(kept - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(out[~drop])).cast(pa.string())
    return pa.table({"id": ids, "n_words": pa.array(texts.counts.astype(np.int64)), "n_removed": pa.array(spans.per_text(gone, texts.counts).astype(np.int64)), "removed": removed_spans, "kept_text": strings})


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, block_bytes: int = BLOCK_BYTES, shard_phrases: int = SHARD_PHRASES
) -> DataFrame:
    """doc_id, n_words, n_removed, removed (begin and end of the runs of words that go) and kept_text (the others, a space between two) of each row."""
    spark = docs.sparkSession
    spans.prepare(spark)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # two for a task at least, so that tasks are even
    blocks = max(math.ceil(size / block_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    known = docs.where("id IS NOT NULL")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                texts = Texts.of(part.column("text"), window, phrase)
                places, hashes = texts.phrases()
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(texts.rows(places))), pa.array(hashes.view(np.int64))], ["id", "hash"])

    def locate(mine: pa.Table, facts: pa.Table) -> pa.Table:
        texts, starts, hashes = _candidates(mine, facts, window, phrase, shard_phrases)
        return pa.table({"id": mine.column("id").take(pa.array(texts.rows(starts))), "hash": pa.array(hashes.view(np.int64))})

    def remove(mine: pa.Table, facts: pa.Table) -> pa.Table:
        texts, starts, hashes = _candidates(mine, facts, window, phrase, shard_phrases)
        own = _held(texts.rows(starts), hashes, facts.filter(pc.equal(facts.column("kind"), 2)), mine.column("id"))
        return _kept(texts, starts[~own], mine.column("id").combine_chunks())

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                yield from _kept(Texts.of(part.column("text"), window, phrase), np.zeros(0, np.int64), part.column("id")).to_batches()

    row = f"id {kind}, hash long"
    first, last = F.min("id").alias("id"), F.max("id").alias("last")
    only = known.mapInArrow(choose, row).groupBy("hash").agg(first, last).where("id = last")
    only = written(only.select(block, "id", F.lit(1).alias("kind"), "hash"), "phrases")
    dealt = known.select(block, "id", "text").groupBy("block")
    windows = dealt.cogroup(only.groupBy("block")).applyInArrow(locate, row)
    holders = windows.groupBy("hash").agg(first).select(block, "id", F.lit(2).alias("kind"), "hash")
    result = RESULT.format(id=kind)
    out = dealt.cogroup(only.union(holders).groupBy("block")).applyInArrow(remove, result)
    return out.union(docs.where("id IS NULL").mapInArrow(untouched, result)).withColumnRenamed("id", doc_id)
