"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Each shard holds the ids of some documents in order.  Re-Pair replaces pairs of ids that
occur often by a new symbol and repeats that on the result: every round counts all pairs
of the shard, takes the most frequent ones and replaces their occurrences from left to
right, until no pair occurs LEAST_COUNT times (a rule takes 12 bytes).  A pair never spans two documents, so each begins at a symbol of its own.

Format (one Parquet row a shard; numbers little-endian):
  part, block   place of the shard in the order of documents
  base          first id of a rule; smaller symbols are token ids
  rules         2 x uint32 a rule: the two symbols it stands for (token ids or earlier rules)
  rule_tokens   uint32 a rule: the tokens it expands to; with these a reader finds a token without expanding what precedes it
  body          the symbols of all documents, of `width` bytes each
  doc_ids, doc_tokens, doc_symbols   of each document: id, tokens, symbols in the body

Documents are in ascending order of ids (nulls first).  They are dealt out by ranges of
(id, place in the input), so that a repeated id does not end up in one task.

Defined results: a null or empty text is its end id alone; rows with equal ids follow each
other in the order of the input; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import spans
from millrace.llm.storage import written

END_ID, SHARD_TOKENS, RULES_A_ROUND, LEAST_COUNT = 1, 1 << 20, 1024, 16
SHARD_SCHEMA = "part int, block int, base long, width int, n_tokens long, rules binary, rule_tokens binary, body binary, doc_ids array<bigint>, doc_tokens array<bigint>, doc_symbols array<bigint>"
_BUCKETS = 1 << 18


@dataclass
class Grammar:
    """Rules and body of a sequence: symbols below `base` stand for themselves."""

    base: int
    rules: np.ndarray  # (n, 2)
    body: np.ndarray
    symbols: np.ndarray  # of each document, in the body

    def expansions(self, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, length): the tokens of each rule; with symbols, only of the rules that these lead to, nothing for others."""
        wanted: set[int] | range = range(len(self.rules))
        if symbols is not None:
            wanted, left = set(), (np.unique(symbols[symbols >= self.base]).astype(np.int64) - self.base).tolist()
            while left:
                k = left.pop()
                if k not in wanted:
                    wanted.add(k)
                    left += [int(s) - self.base for s in self.rules[k] if s >= self.base]
        none = np.empty(0, np.uint32)
        done: list[np.ndarray] = [none] * len(self.rules)
        of = lambda s: done[s - self.base] if s >= self.base else np.array([s], np.uint32)
        for k in sorted(wanted):  # a rule's symbols come before it
            a, b = self.rules[k].tolist()
            done[k] = np.concatenate([of(a), of(b)])
        length = np.fromiter(map(len, done), np.int64, len(done))
        return np.concatenate(done) if done else none, np.cumsum(length) - length, length

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Tokens of the body's symbols from `begin` to `end`."""
        body = self.body[begin:end]
        flat, start, length = self.expansions(body)
        # Expansions of the rules, followed by the plain symbols themselves.
        rule = body >= self.base
        counts = np.ones(len(body), np.int64)
        counts[rule] = length[body[rule] - self.base]
        from_ = np.empty(len(body), np.int64)
        from_[rule] = start[body[rule] - self.base]
        plain = np.flatnonzero(~rule)
        from_[plain] = len(flat) + np.arange(len(plain))
        return np.concatenate([flat, body[plain]]).astype(np.uint32)[spans.ranges(from_, counts)]


def re_pair(ids: np.ndarray, tokens: np.ndarray, base: int, rounds: int | None = None, rules_a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> Grammar:
    """The grammar of `ids`, which are those of documents of `tokens` ids each (one at least)."""
    seq = ids.astype(np.uint32)
    first = np.zeros(len(seq) + 1, bool)
    first[np.cumsum(tokens) - tokens] = True
    first[len(seq)] = True
    rules: list[np.ndarray] = []
    top = base
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        bucket = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA77))) >> np.uint32(14)
        allowed = ~first[1:-1]
        filled = np.bincount(bucket[allowed], minlength=_BUCKETS)
        # A pair occurs at most as often as its bucket, so rarer buckets hold no pair that is wanted.
        bar = max(least, int(np.partition(filled, -rules_a_round)[-rules_a_round]))
        for bar in (bar, least):  # the fullest buckets may hold only rare pairs
            at = np.flatnonzero(allowed & (filled >= bar)[bucket])
            pair = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
            keys, counts = np.unique(pair, return_counts=True)
            order = np.lexsort((keys, -counts))[:rules_a_round]
            chosen = np.sort(keys[order[counts[order] >= least]])
            if len(chosen):
                break
        else:
            break
        slot = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
        hit = chosen[slot] == pair
        at, slot = at[hit], slot[hit]
        # Of matches that overlap in a chain, every other one is taken.
        chain = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        begin = np.repeat(chain, np.diff(np.append(chain, len(at))))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, slot = at[take], slot[take]
        seq[at] = top + slot.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, first = seq[keep], np.append(first[:-1][keep], True)
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        top += len(chosen)
    return Grammar(base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), seq, np.diff(np.flatnonzero(first)) if len(seq) else np.empty(0, np.int64))


def _shard_row(block: int, ids: list[np.ndarray], doc_ids: list, tokens: list[np.ndarray], base: int) -> pa.RecordBatch:
    lengths = np.concatenate(tokens)
    g = re_pair(np.concatenate(ids), lengths, base)
    width = 2 if g.base + len(g.rules) <= 1 << 16 else 4
    row = {
        "part": TaskContext.get().partitionId(), "block": block, "base": base, "width": width, "n_tokens": int(lengths.sum()), "rules": g.rules.astype("<u4").tobytes(),
        "rule_tokens": g.expansions()[2].astype("<u4").tobytes(), "body": g.body.astype(f"<u{width}").tobytes(), "doc_ids": doc_ids, "doc_tokens": lengths.tolist(), "doc_symbols": g.symbols.tolist(),
    }
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def read_grammar(row: dict) -> Grammar:
    """The grammar in a shard's row."""
    body = np.frombuffer(row["body"], f"<u{row['width']}").astype(np.uint32)
    return Grammar(row["base"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), body, np.asarray(row["doc_symbols"], np.int64))


def read_document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard; only its own symbols are expanded."""
    g = read_grammar(row)
    begin = int(g.symbols[:k].sum())
    return g.decode(begin, begin + int(g.symbols[k]))


def token_at(row: dict, place: int) -> int:
    """The id at a place of the shard: the expansion lengths lead to its symbol, and then down the rules, of which none is expanded."""
    g, of_rule = read_grammar(row), np.frombuffer(row["rule_tokens"], "<u4")
    lengths = np.ones(len(g.body), np.int64)
    lengths[g.body >= g.base] = of_rule[g.body[g.body >= g.base] - g.base]
    ends = np.cumsum(lengths)
    at = int(np.searchsorted(ends, place, "right"))
    symbol, place = int(g.body[at]), place - int(ends[at] - lengths[at])
    while symbol >= g.base:
        first, second = g.rules[symbol - g.base].tolist()
        size = int(of_rule[first - g.base]) if first >= g.base else 1
        symbol, place = (first, place) if place < size else (second, place - size)
    return symbol


#: Bytes after which a letter has ended, and bytes of marks that are never part of a letter or, as the apostrophe is, of a contraction.
_LETTER, _MARK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LOWER[65:91] += 32


def token_units(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text, lower-cased, and begin and end of units that a lower-casing tokenizer, which splits
    letters from marks and drops white space, encodes alike on their own; and how many each text has.

    A unit is a word without white space, cut where a letter (A-Z or of the Latin-1 letters) meets an ASCII
    mark.  Where the name of a special token occurs, words stay as they are.
    """
    lower = _LOWER[data]
    begin, end, counts = spans.words(data, offsets)
    raw = lower.tobytes()
    if any(s.lower() in raw for s in special):
        return data, begin, end, counts
    letter = _LETTER[data]
    latin = np.zeros(len(data), bool)  # second bytes of C3 80 ... C3 BF but for the two signs
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    mark = _MARK[data]
    ends_letter = letter | latin
    begins_letter = letter.copy()
    begins_letter[:-1] |= latin[1:]
    cut = (ends_letter[:-1] & mark[1:]) | (mark[:-1] & begins_letter[1:])
    inner = np.flatnonzero(cut) + 1
    word = np.searchsorted(begin, inner, "right") - 1
    inner = inner[(word >= 0) & (begin[word] < inner) & (inner < end[word])] if len(begin) else inner[:0]
    begins = np.sort(np.concatenate([begin, inner]))
    ends = np.sort(np.concatenate([end, inner]))
    return lower, begins, ends, np.diff(np.searchsorted(begins, offsets))


def word_encoder(tokenizer_json: str) -> tuple[spans.Encoder, list[bytes]]:
    """The encoder of units, and the names of special tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
    return spans.Encoder(lambda ws: [e.ids for e in t.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)]), special


def write_shards(docs: DataFrame, tokenizer_json: str, base: int, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes all texts and writes them as shards; returns the written table."""
    spark = docs.sparkSession
    spans.prepare(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a file of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special = spans.kept(("token_output", len(shared.value), zlib.crc32(shared.value.encode())), lambda: word_encoder(shared.value))
        block, held, ids, doc_ids, tokens = 0, 0, [], [], []
        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                data, offsets = spans.buffers(part.column("_text"))
                data, begin, end, counts = token_units(data, offsets, special)
                flat, lengths = encoder.ids(data, begin, end)
                n = spans.per_text(lengths, counts)
                out = np.full(len(flat) + len(n), end_id, np.uint32)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                ids.append(out)
                tokens.append(n + 1)
                doc_ids += part.column("_id").to_pylist()
                held += len(out)
                if held >= shard_tokens:
                    yield _shard_row(block, ids, doc_ids, tokens, base)
                    block, held, ids, doc_ids, tokens = block + 1, 0, [], [], []
        if held:
            yield _shard_row(block, ids, doc_ids, tokens, base)

    ordered = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_place"))
    ordered = ordered.repartitionByRange("_id", "_place").sortWithinPartitions("_id", "_place").select("_id", "_text")
    return written(ordered.mapInArrow(encode, SHARD_SCHEMA), "token_shards")


def read_shards(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of each document."""
    spans.prepare(shards.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = read_grammar(row).decode().astype("<u4").tobytes()
                n = np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "start", "n_tokens", "ids_crc32"])

    order = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    before = shards.select("part", "block", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return shards.join(before, ["part", "block"]).mapInArrow(decode, f"{doc_id} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
