"""SentencePiece encoding and decoding with a unigram model.

The pieces and their log scores come from a model file.  Encoding is the Viterbi path of
the highest total score over a double-array trie of the pieces' bytes; a character that no
piece covers becomes byte pieces, and the white-space marker of the pieces stands for a
space, one of which is put before each text.  Decoding joins the pieces' bytes, turns
markers into spaces and drops the first.

Works on bytes throughout: in the trie the marker is the space itself, so that a marker
in a text is an ordinary character, kept by its bytes, and every text comes back exactly.
A text is cut before each run of spaces and around bytes of no piece (line ends, say); no
piece spans such a cut, so the parts are encoded on their own, and those that came before
are taken from a bounded table.  New parts go through the trie together, place by place.

Ties: of paths with equal scores, the one whose last piece begins first, then so for the
piece before it.  Characters without a piece score 10 less than the lowest piece.

Defined results: null counts as empty, which has no pieces; equal texts get equal pieces;
very long texts are worked on alone; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans

MARKER, UNKNOWN_PENALTY = "▁", 10.0
#: Longer parts are encoded one by one.
TOGETHER = 48


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes with the marker as a space, by id; scores; ids of the 256 byte pieces; whether an id may be on a path."""

    raw: list[bytes]
    score: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray


def load_pieces(model_file: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    byte_ids, raw, normal = np.full(256, -1, np.int32), [], np.zeros(n, bool)
    for i in range(n):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.replace(MARKER, " ").encode())
            normal[i] = True
    return Pieces(raw, np.array([m.get_score(i) for i in range(n)]), byte_ids, normal)


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c where check[t] == s; piece[t] is the id that ends there, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, i in keys:
            node = 0
            for c in key:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
            ends[node] = i
        size = 1 << 12
        self.base, self.check, self.piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        one_from = many_from = 1  # where to look for room for one child and for several
        todo = [(0, 0)]  # node of the dictionary trie, slot
        for node, slot in todo:
            if node in ends:
                self.piece[slot] = ends[node]
            codes = sorted(children[node])
            if not codes:
                self.base[slot] = -(1 << 30)
                continue
            while max(one_from, many_from) + 1024 > len(self.check):
                self._grow()
            if len(codes) == 1:
                one_from = max(one_from, codes[0] + 1)
                while self.check[one_from] >= 0:
                    one_from += 1
                begin = one_from - codes[0]
            else:
                at = np.array(codes)
                fits = (self.check[np.arange(many_from, many_from + 64)[:, None] + at[None, :]] < 0).all(1)
                while not fits.any():
                    many_from += 64
                    while many_from + 1024 > len(self.check):
                        self._grow()
                    fits = (self.check[np.arange(many_from, many_from + 64)[:, None] + at[None, :]] < 0).all(1)
                begin = many_from + int(np.argmax(fits))
            self.base[slot] = begin
            self.check[[begin + c for c in codes]] = slot
            todo += [(children[node][c], begin + c) for c in codes]

    def _grow(self) -> None:
        self.base, self.check, self.piece = (np.concatenate([x, np.full(len(x), v, np.int32)]) for x, v in ((self.base, 0), (self.check, -1), (self.piece, -1)))

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children and which there are."""
        t = self.base[nodes] + bytes_
        ok = t >= 0
        t = np.where(ok, t, 0)
        return t, ok & (self.check[np.minimum(t, len(self.check) - 1)] == nodes) & (t < len(self.check)) & (t > 0)


def build_trie(pieces: Pieces) -> DoubleArray:
    return DoubleArray([(p, i) for i, p in enumerate(pieces.raw) if pieces.normal[i]])


class UnigramEncoder:
    """Viterbi over the double array; see the module."""

    def __init__(self, pieces: Pieces, trie: DoubleArray | None = None):
        self.pieces = pieces
        self.trie = trie or build_trie(pieces)
        self.unknown = float(pieces.score[pieces.normal].min()) - UNKNOWN_PENALTY
        self.longest = max((len(p) for i, p in enumerate(pieces.raw) if pieces.normal[i]), default=1)
        within = {b for i, p in enumerate(pieces.raw) if pieces.normal[i] for b in p}
        self.alone = np.array([b not in within and b < 128 for b in range(256)])
        inside = any(b" " in p.lstrip(b" ") for i, p in enumerate(pieces.raw) if pieces.normal[i])
        self.at_spaces = not inside  # no piece has a space after another character
        self.words = spans.Encoder(self.encode)
        lengths = np.fromiter(map(len, pieces.raw), np.int64, len(pieces.raw))
        self._flat, self._length = np.frombuffer(b"".join(pieces.raw), np.uint8), lengths
        self._start = np.cumsum(lengths) - lengths

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part, without a space before it."""
        out: list = [None] * len(parts)
        order = sorted((i for i in range(len(parts)) if len(parts[i]) <= TOGETHER), key=lambda i: len(parts[i]))
        for at in range(0, len(order), 2000):
            own = order[at : at + 2000]
            for i, ids in zip(own, self._together([parts[i] for i in own]), strict=True):
                out[i] = ids
        for i, p in enumerate(parts):
            if out[i] is None:
                out[i] = self._one(p)
        return out

    def _together(self, parts: list[bytes]) -> list[np.ndarray]:
        n, width = len(parts), max(map(len, parts))
        if not width:
            return [np.empty(0, np.uint32)] * n
        length = np.fromiter(map(len, parts), np.int64, n)
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width).astype(np.int32)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        from_, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((s < length) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            lead = text[rows, s]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            covered = np.zeros(n, bool)
            live, node = rows, np.zeros(len(rows), np.int32)
            for k in range(s, min(width, s + self.longest)):
                node, ok = self.trie.step(node, text[live, k])
                ok &= k < length[live]
                live, node = live[ok], node[ok]
                if not len(live):
                    break
                id_ = self.trie.piece[node]
                ends = np.flatnonzero(id_ >= 0)
                r, i = live[ends], id_[ends]
                score = best[r, s] + self.pieces.score[i]
                better = score > best[r, k + 1]
                r2, i2 = r[better], i[better]
                best[r2, k + 1], from_[r2, k + 1], piece[r2, k + 1] = score[better], s, i2
                covered[r[k + 1 - s == _char_bytes(text[r, s])]] = True
            bare = ~covered[rows]
            r, to = rows[bare], np.minimum(s + char[bare], length[rows[bare]])
            score = best[r, s] + self.unknown
            better = score > best[r, to]
            r, to = r[better], to[better]
            best[r, to], from_[r, to], piece[r, to] = score[better], s, -1
        # Back from the ends, all parts together.
        row, at, got = np.arange(n), length.copy(), []
        while len(row := row[at[row] > 0]):
            e = at[row]
            b = from_[row, e].astype(np.int64)
            got.append((row, b, e, piece[row, e]))
            at[row] = b
        row, b, e, i = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 4
        order = np.lexsort((b, row))
        row, b, e, i = row[order], b[order], e[order], i[order]
        count = np.where(i < 0, e - b, 1)
        ids = np.repeat(i, count)
        unknown = np.repeat(i < 0, count)
        if unknown.any():
            where = spans.ranges(b, count)
            ids[unknown] = self.pieces.byte_ids[text[np.repeat(row, count)[unknown], where[unknown]]]
        ends = np.cumsum(np.bincount(row, weights=count, minlength=n).astype(np.int64))
        return np.split(ids.astype(np.uint32), ends[:-1])

    def _one(self, part: bytes) -> np.ndarray:
        n, base, check, piece, score = len(part), self.trie.base, self.trie.check, self.trie.piece, self.pieces.score
        best, from_, by = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            if best[s] == -np.inf:
                continue
            char, covered, node = int(_char_bytes(part[s])), False, 0
            for k in range(s, min(n, s + self.longest)):
                t = int(base[node]) + part[k]
                if t <= 0 or t >= len(check) or check[t] != node:
                    break
                node = t
                i = int(piece[t])
                if i >= 0:
                    covered |= k + 1 - s == char
                    if best[s] + score[i] > best[k + 1]:
                        best[k + 1], from_[k + 1], by[k + 1] = best[s] + score[i], s, i
            to = min(n, s + char)
            if not covered and best[s] + self.unknown > best[to]:
                best[to], from_[to], by[to] = best[s] + self.unknown, s, -1
        out, at = [], n
        while at:
            s = from_[at]
            out += [by[at]] if by[at] >= 0 else [int(self.pieces.byte_ids[b]) for b in reversed(part[s:at])]
            at = s
        return np.array(out[::-1], np.uint32)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and number of each text's parts."""
        space, alone = data == 32, self.alone[data]
        begin = alone.copy()
        begin[1:] |= alone[:-1]
        if self.at_spaces:
            begin[1:] |= space[1:] & ~space[:-1]
        return spans.cut(data, offsets, begin)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        led = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = spans.buffers(led)
        begin, end, counts = self.parts(data, offsets)
        ids, lengths = self.words.ids(data, begin, end)
        return ids, spans.per_text(lengths, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and how many each has."""
        length = self._length[ids]
        data = self._flat[spans.ranges(self._start[ids], length)]
        size = spans.per_text(length, counts)
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(size) - size)[size > 0]] = False  # the space before each text
        return data[keep], np.maximum(size - 1, 0)


def _char_bytes(lead):
    """How many bytes a character has, by its first."""
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def encode_decode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 and round_trip (decoding gives the text again); with keep also ids and decoded text."""
    spark = docs.sparkSession
    spans.prepare(spark, by_bytes=True)
    shared = spark.sparkContext.broadcast((pieces, build_trie(pieces)))  # a vocabulary of fixed size
    schema = f"{doc_id} bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, trie = shared.value
        encoder: UnigramEncoder = spans.kept(("unigram", len(p.raw), zlib.crc32(b"".join(p.raw)), hash(p.score.tobytes())), lambda: UnigramEncoder(p, trie))
        is_byte = np.zeros(len(p.raw), bool)
        is_byte[p.byte_ids[p.byte_ids >= 0]] = True
        for batch in batches:
            for part in spans.chunks(batch, "_text", spans.CHUNK_BYTES // 4):  # words and pieces take many times a text's bytes
                texts = part.column("_text")
                ids, counts = encoder.encode_texts(texts)
                back, sizes = encoder.decode(ids, counts)
                data, offsets = spans.buffers(texts)
                if len(back) == len(data) and np.array_equal(sizes, np.diff(offsets)) and np.array_equal(back, data):
                    same = np.ones(len(texts), bool)
                else:
                    ends = np.cumsum(sizes)
                    same = np.array([np.array_equal(back[e - s : e], data[x:y]) for e, s, x, y in zip(ends, sizes, offsets[:-1], offsets[1:], strict=True)], bool)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [part.column("_id"), pa.array(counts), pa.array(spans.per_text(is_byte[ids].astype(np.int64), counts)), pa.array(crc, pa.int64()), pa.array(same)]
                names = [doc_id, "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
                if keep:
                    columns += [pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids.astype(np.int32)))]
                    columns += [pa.array([bytes(back[e - s : e]).decode() for e, s in zip(np.cumsum(sizes), sizes, strict=True)], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
