"""Spans of text in numpy: cutting batches into words or units, hashing and encoding them.

Operators that run Python on the executors work on Arrow buffers here: the bytes of many
texts in one array, and spans as offsets into it.  No Python object is made for a word
unless an encoder sees it for the first time.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a batch that Arrow hands to Python at once, where `prepare` is asked for that; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def prepare(spark, by_bytes: bool = False) -> None:
    """Before Python runs on the executors: sends them this package, once a session, and bounds
    what Arrow hands to Python at once: by rows, and `by_bytes`, as rows may be long texts, sets or blocks of postings.
    The JVM gathers a batch outside its heap, in vectors that double as they grow."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_sent", None) is None:
        sc._millrace_sent = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace.zip"
        top = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(sc._millrace_sent, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(sc._millrace_sent))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if by_bytes and spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins and ends (n + 1 offsets); null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most `most` bytes of text, or one row."""
    n = len(batch)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without ASCII white space, and how many each text has."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    at = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    first[at] |= inside[1:-1][at]
    last[at - 1] |= inside[1:-1][at - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begin, offsets))


def cut(data: np.ndarray, offsets: np.ndarray, is_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, for units that cover each text: one begins where a text does and where `is_begin` says."""
    first = is_begin.copy()
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], len(data)) if len(begin) else begin, np.diff(np.searchsorted(begin, offsets))


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of eight bytes
_kept_powers: list[np.ndarray] = []
#: Powers that a worker keeps, at most; those for a longer text are made for it alone.
MOST_POWERS = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse, n or more."""
    if _kept_powers and len(_kept_powers[0]) >= n:
        return _kept_powers[0], _kept_powers[1]
    out = []
    for root in (_ROOT, _INVERSE):
        p = np.full(((n >> 16) + 1) << 16, root, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if len(out[0]) <= MOST_POWERS:
        _kept_powers[:] = out
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands: a polynomial over random
    values of the bytes, from differences of one running sum."""
    power, inverse = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=run[1:])
    return mix((run[end] - run[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 64, block: int = 1 << 15) -> np.ndarray:
    """As `hashes`, with other values and less work where spans are short: eight bytes a step, for a block of spans that the
    processor's cache holds; spans of more than `most` bytes go through `hashes`."""
    room, out = np.zeros((len(data) >> 3) + 2, np.uint64), np.empty(len(begin), np.uint64)
    room.view(np.uint8)[: len(data)] = data
    root = np.uint64(_ROOT)

    def eight(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next bytes of each span, eight at most, and how many are left."""
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = room[place] >> shift
        x |= room[place + 1] << np.uint64(1) << (np.uint64(63) - shift)
        x &= _FIRST[np.minimum(size, 8)]
        x *= root
        x += size.astype(np.uint64)
        return x

    for i in (slice(k, k + block) for k in range(0, len(begin), block)):
        at, size = begin[i], end[i] - begin[i]
        h = mix(eight(at, size))
        left = np.flatnonzero((size > 8) & (size <= most))
        for step in range(8, most, 8):
            left = left[size[left] > step]
            if not len(left):
                break
            h[left] = mix(h[left] * root + eight(at[left] + step, size[left] - step))
        out[i] = h
    long = np.flatnonzero(end - begin > most)
    if len(long):
        size = end[long] - begin[long]
        to = np.cumsum(size)
        out[long] = hashes(data[ranges(begin[long], size)], to - size, to)
    return out


def shingles(words_hash: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text and how many each has; a text of fewer words is one run, one of none has none."""
    n, docs = len(words_hash), len(counts)
    root, out = np.uint64(0x9FB21C651E98DF25), np.zeros(n, np.uint64)
    for j in reversed(range(k)):
        out *= root
        out[: max(0, n - j)] += words_hash[j:]
    # Runs that reach into the next text go; of a text of fewer words than k the first one is made anew.
    keep = np.ones(n, bool)
    ends = np.cumsum(counts)
    for j in range(1, k):
        keep[(ends - j)[counts >= j]] = False
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        h = 0
        for w in reversed(words_hash[ends[i] - counts[i] : ends[i]].tolist()):
            h = (h * int(root) + w) & 0xFFFFFFFFFFFFFFFF
        keep[ends[i] - counts[i]], out[ends[i] - counts[i]] = True, (h + int(counts[i])) & 0xFFFFFFFFFFFFFFFF
    return mix(out[keep]), np.where(counts < k, np.minimum(counts, 1), counts - (k - 1)) if docs else np.zeros(0, np.int64)


def runs(words_hash: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each of the places `begin` on, from differences of one running sum."""
    power, inverse = _powers(len(words_hash) + 1)
    run = np.zeros(len(words_hash) + 1, np.uint64)
    np.cumsum(words_hash * power[: len(words_hash)], out=run[1:])
    return mix((run[begin + k] - run[begin]) * inverse[begin])


def sorted_sets(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text sorted, each once, and how many each then has."""
    ends = np.cumsum(counts)
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        tokens[begin:end].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[(ends - counts)[counts > 0]] = True
    return tokens[keep], per_text(keep, counts)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those of start[1], and so on."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


class Table:
    """Places of 64-bit keys, 0, 1, 2 ... in the order in which they came, in one open-addressed array."""

    def __init__(self, bits: int = 16):
        self._keys, self._values, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _seek(self, keys: np.ndarray) -> np.ndarray:
        """Of each key its slot, or the empty one where it would be."""
        mask = np.uint64(len(self._keys) - 1)
        slot = (keys & mask).astype(np.int64)
        held = self._keys[slot]
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            held = self._keys[slot[left]]
            left = left[(held != keys[left]) & (held != 0)]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places, -1 where there is none.  (0 is taken for 1.)"""
        keys = np.maximum(keys, np.uint64(1))
        slot = self._seek(keys)
        return np.where(self._keys[slot] == 0, -1, self._values[slot])

    def add(self, keys: np.ndarray) -> None:
        """Gives new, distinct keys the next places."""
        while 2 * (self.n + len(keys)) > len(self._keys):
            old = self._keys != 0
            k, v = self._keys[old], self._values[old]
            self._keys, self._values = np.zeros(2 * len(self._keys), np.uint64), np.zeros(2 * len(self._values), np.int32)
            self._put(k, v)
        self._put(np.maximum(keys, np.uint64(1)), np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            slot = self._seek(keys)
            self._keys[slot] = keys  # of two that want one slot, one gets it
            got = self._keys[slot] == keys
            self._values[slot[got]] = values[got]
            keys, values = keys[~got], values[~got]


class Encoder:
    """Ids of spans by an encoder of words whose results do not depend on what stands around.

    encode: ids of each of a list of byte strings.  What it returned is kept by the span's
    hash, up to `limit` words, and then begun anew; so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 1_500_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._table, self._used = Table(), 0
        self._flat, self._start, self._length = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _add(self, spans: list[bytes]) -> None:
        found, n = self._encode(spans), self._table.n
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in found])
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while n + len(found) > len(self._start):
            self._start, self._length = (np.concatenate([x, np.empty_like(x)]) for x in (self._start, self._length))
        self._flat[self._used : self._used + len(flat)] = flat
        self._start[n : n + len(found)] = self._used + np.cumsum(lengths) - lengths
        self._length[n : n + len(found)] = lengths
        self._used += len(flat)

    def _entries(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        keys = hashes(data, begin, end)
        if self._table.n > self._limit:
            self._clear()
        places = self._table.find(keys)
        new = np.flatnonzero(places < 0)
        if len(new):
            _, at = np.unique(keys[new], return_index=True)
            raw = data.tobytes()
            for k in range(0, len(at), 5000):
                own = new[at[k : k + 5000]]
                self._add([raw[x:y] for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
                self._table.add(keys[own])
            places[new] = self._table.find(keys[new])
        return places

    def lengths(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many ids each span has."""
        entries = self._entries(data, begin, end)
        return self._length[entries].astype(np.int64)

    def ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans in one array, and how many each has."""
        entries = self._entries(data, begin, end)
        length = self._length[entries].astype(np.int64)
        return self._flat[ranges(self._start[entries], length)], length


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a Python worker and kept for its later tasks."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what `kept` holds, and gives memory that nothing holds back to the system; else an idle worker stays as large as its largest task made it."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for tasks that need nothing of what others left in their worker, and leave nothing there."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        forget()

    return own


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's spans; counts: how many each text has."""
    run = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return run[ends] - run[ends - counts]
