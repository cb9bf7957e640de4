"""Edit-aware token counts: a segment tree of pre-token counts per document.

A text is cut into units, white space with the word after it, which the byte-level
tokenizer encodes alike wherever they stand.  A document's tree has units as leaves and
in each node the bytes and tokens below it, in one array.  An edit (byte offset, bytes to
delete, text to insert) finds its leaves by the sums of bytes, joins them with one unit to
either side as boundary context, cuts that region into units again, encodes only those, and updates the
sums on the path to the root.  Units that find no free leaves in their place are spread evenly over the
smallest subtree with room for them, so leaves stay as small as units, however many edits fall side by side.

Edits that overlap or leave a text that isn't UTF-8 are the caller's fault and raise
ValueError for the latter.  Edits apply in the order given, each to the text that the
one before left.

Defined results: null counts as empty, which has no tokens and whose tree has one empty
leaf; an edit beyond the end appends; rows with equal ids have trees of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans

#: The last bytes of Unicode's further white space: after C2, and after E1-E3 with a byte between.
_AFTER_C2, _AFTER_E = np.zeros(256, bool), np.zeros(256, bool)
_AFTER_C2[[0x85, 0xA0]] = True
_AFTER_E[[*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each unit and how many each text has.  A unit begins where white space follows
    something else; what could be other than ASCII white space counts as white space here."""
    space = spans.SPACE[data]
    solid = ~space
    solid[1:] &= ~(_AFTER_C2[data[1:]] & (data[:-1] == 0xC2))
    solid[2:] &= ~(_AFTER_E[data[2:]] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    begin = np.zeros(len(data), bool)
    begin[1:] = space[1:] & solid[:-1]
    return spans.cut(data, offsets, begin)


class TokenTree:
    """Sums of bytes and tokens over the units of one text.  Leaves without bytes are free."""

    def __init__(self, text: bytes, sizes: np.ndarray, tokens: np.ndarray, count: Callable[[list[bytes]], list[int]]):
        """count: the tokens of each of several units."""
        self.text, self._count, self.encoded_bytes = bytearray(text), count, 0
        self._build(sizes, tokens, 1 << (len(sizes) + len(sizes) // 3).bit_length())

    def _build(self, sizes: np.ndarray, tokens: np.ndarray, leaves: int) -> None:
        """A tree of so many leaves (a power of two) over the units, which are spread evenly."""
        self.leaves = leaves
        sums = np.zeros((2, 2 * leaves), np.int64)
        at = leaves + np.arange(len(sizes)) * leaves // max(1, len(sizes))
        sums[0, at], sums[1, at] = sizes, tokens
        at = leaves
        while at > 1:
            sums[:, at // 2 : at] = sums[:, at : 2 * at : 2] + sums[:, at + 1 : 2 * at : 2]
            at //= 2
        self._bytes, self._tokens = sums.tolist()  # node k has the children 2k and 2k + 1

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    def _leaf(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the byte, the last one with bytes beyond the end; and where it begins."""
        at, begin = 1, 0
        offset = min(offset, self._bytes[1] - 1)
        while at < self.leaves:
            at *= 2
            left = self._bytes[at]
            if offset >= begin + left and self._bytes[at + 1]:
                begin, at = begin + left, at + 1
        return at - self.leaves, begin

    def _room(self, first: int, last: int, units: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
        """Begin and width of the leaves over which units are to be spread, and all units that are to be there; a width of 0 if even the whole tree is too full."""
        if len(units) <= last + 1 - first:
            return first, last + 1 - first, units
        node, width, level, height = first + self.leaves, 1, 0, self.leaves.bit_length() - 1
        while True:
            lo = node * width - self.leaves
            if lo <= first and last < lo + width:
                held = [(self._bytes[k], self._tokens[k]) for k in range(lo + self.leaves, lo + self.leaves + width)]
                kept = [x for x in held[: first - lo] if x[0]] + units + [x for x in held[last + 1 - lo :] if x[0]]
                if len(kept) <= width - width * level // (4 * max(1, height)):  # of the whole tree a quarter stays free, of smaller subtrees less
                    return lo, width, kept
                if node == 1:
                    return 0, 0, kept
            node, width, level = node // 2, 2 * width, level + 1

    def _replace(self, first: int, last: int, units: list[tuple[int, int]]) -> None:
        """Puts units, as bytes and tokens, in place of those of the leaves first to last."""
        lo, width, kept = self._room(first, last, units)
        if not width:
            self._build(np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64), 2 * self.leaves)
            return
        spread: list[tuple[int, int]] = [(0, 0)] * width
        for k, x in enumerate(kept):
            spread[k * width // len(kept)] = x
        at = lo + self.leaves
        self._bytes[at : at + width], self._tokens[at : at + width] = [x[0] for x in spread], [x[1] for x in spread]
        low, high = at, at + width - 1
        while low > 1:
            low, high = low // 2, high // 2
            for k in range(low, high + 1):
                self._bytes[k] = self._bytes[2 * k] + self._bytes[2 * k + 1]
                self._tokens[k] = self._tokens[2 * k] + self._tokens[2 * k + 1]

    def edit(self, offset: int, delete: int, insert: bytes) -> int:
        """Applies an edit and returns the new count of tokens."""
        n = self._bytes[1]
        offset = min(max(0, offset), n)
        delete = min(max(0, delete), n - offset)
        first, begin, last, end = 0, 0, self.leaves - 1, n
        if n:
            first, begin = self._leaf(offset)
            if begin:
                first, begin = self._leaf(begin - 1)
            # One more unit before the edit and one after it: a mark or letter at their borders may join what is inserted.
            last, last_begin = self._leaf(offset + delete)
            end = last_begin + self._bytes[last + self.leaves]
            if end < n:
                last, last_begin = self._leaf(end)
                end = last_begin + self._bytes[last + self.leaves]
        self.text[offset : offset + delete] = insert
        region = bytes(self.text[begin : end + len(insert) - delete])
        starts, ends, _ = units(np.frombuffer(region, np.uint8), np.array([0, len(region)]))
        self.encoded_bytes += len(region)
        pieces = [region[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        self._replace(first, last, list(zip(map(len, pieces), self._count(pieces), strict=True)))
        return self.tokens


class Counter:
    """Tokens of texts by a tokenizer, through kept counts of units."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(tokenizer_json)
        t.encode_special_tokens = True  # their names in a text are ordinary text
        self._tokenizer = t
        self._units = spans.Encoder(lambda ws: [e.ids for e in t.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)])

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)] if texts else []

    def count(self, text: bytes) -> int:
        return self.counts([text])[0]

    def trees(self, texts: pa.Array) -> Iterator[TokenTree]:
        data, offsets = spans.buffers(texts)
        begin, end, counts = units(data, offsets)
        tokens, sizes, raw, at = self._units.lengths(data, begin, end), end - begin, data.tobytes(), 0
        for n, x, y in zip(counts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield TokenTree(raw[x:y], sizes[at : at + n], tokens[at : at + n], self.counts)
            at += n


def standing_edits(text: bytes) -> list[tuple[int, int, bytes]]:
    """The edits that the query applies to every document: a word goes in at a quarter, up to 12 bytes go at the
    half and 3 characters are replaced at three quarters, each moved back to where a character begins."""

    def back(at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    n = len(text)
    a, b, c = back(n // 4), back(n // 2), back(3 * n // 4)
    b2, c2 = back(min(c, b + 12)), back(min(n, c + 3))
    return [(c, c2 - c, "né.".encode()), (b, b2 - b, b""), (a, 0, b" edited")]  # from behind, so that offsets stay those of the text


def count_with_edits(docs: DataFrame, tokenizer_json: str, edits: Callable[[bytes], list[tuple[int, int, bytes]]] = standing_edits, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens of the text, n_tokens_edited after its edits, and bytes that were encoded again for them."""
    spark = docs.sparkSession
    spans.prepare(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = spans.kept(("token_counts", len(shared.value), zlib.crc32(shared.value.encode())), lambda: Counter(shared.value))
        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                before, after, encoded = [], [], []
                for tree in counter.trees(part.column("_text")):
                    before.append(tree.tokens)
                    for e in edits(bytes(tree.text)):
                        tree.edit(*e)
                    after.append(tree.tokens)
                    encoded.append(tree.encoded_bytes)
                columns = [part.column("_id"), *(pa.array(x, pa.int64()) for x in (before, after, encoded))]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "n_tokens_edited", "encoded_bytes"])

    schema = f"{doc_id} bigint, n_tokens bigint, n_tokens_edited bigint, encoded_bytes bigint"
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
