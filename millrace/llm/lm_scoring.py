"""Language-model scoring with a gated recurrent network and a class-factored output.

Counts of all training tokens (words, and an end for each document) come from the whole
training part of the corpus.  The most frequent HEAD words are dealt to classes of about
equal square-root mass; all others, unseen ones included, form one more class in which a
word has the probability (c + 1) / Z.  The network gives the classes' probabilities and
those of the words within the head's classes, so the model is a proper distribution over
all known words and one unknown:

    P(w | before) = P(class(w) | state) P(w | class(w), state)

It is a GRU in numpy, trained by truncated backpropagation through time (windows of
STEPS tokens in lanes; the state goes on from window to window, gradients don't) on all
training documents.  It starts on the driver from a bounded sample; then the rows are dealt
by a hash to shards of about SHARD tokens, whose number grows with the corpus.  Each shard
trains a copy on its whole texts, and the copies' parameters are averaged by their tokens.
Texts longer than PIECE tokens are cut into pieces, which know the word before them and
begin without state.  Scoring runs whole documents in windows whose state is carried on, so
a text of any length has the log-likelihood of the whole.

The head has HEAD words, or twice the root of the number of different words if that is more
(the KNOWN most frequent at most, from 1e9 different words on).

The counts of words beyond the KNOWN most frequent, which go along with the model, meet
the documents in a join by word; only sums come back by document.

Defined results: null counts as empty, which is its end alone; equal texts score alike, and
rows with equal ids are told apart by their texts; nothing to learn from leaves one unknown
word of probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans
from millrace.llm.storage import written

HEAD, KNOWN, CLASSES, HIDDEN, DIM = 2048, 1 << 16, 48, 24, 16
SAMPLE, SAMPLE_BYTES, LANES, STEPS, RATE, SEED = 1200, 1 << 15, 48, 16, 0.01, 11
ROWS, BLOCK = 1 << 15, 2048  # tokens whose probabilities are taken at once, and those of their classes
GROUP, TOGETHER = 32 << 20, 1024  # bytes of text whose documents are sorted by length, and how many then go on together
POOL = 1 << 21  # words that are counted at once
SHARD, WIDE, PIECE, SLICE = 1 << 20, 256, 1024, 4096  # tokens a copy trains on, its lanes, tokens a piece, parameters a row
TASKS = 4096  # that train, at most; beyond that many shards a task trains several copies
END = -1  # the key of a document's end
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOG10 = np.log(10.0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words (signed 64-bit hashes) and how many each text has, ends not included."""
    data, offsets = spans.buffers(texts)
    data = _LOWER[data]
    begin, end, counts = spans.words(data, offsets)
    return spans.word_hashes(data, begin, end).view(np.int64), counts


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows; each row adds an END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def counted() -> pa.RecordBatch:
            unique, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(unique, END)), pa.array(np.append(c, ends))], ["word", "c"])

        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                held.append(tokens(part.column("_text"))[0])
                size, ends = size + len(held[-1]), ends + len(part)
                if size >= POOL:
                    yield counted()
                    held, size, ends = [], 0, 0
        if ends:
            yield counted()

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Head words are numbered by frequency from 0; `rest` stands for all others."""

    total: int  # N
    kinds: int  # V
    known: np.ndarray  # sorted keys of the KNOWN most frequent words
    known_c: np.ndarray
    known_head: np.ndarray  # their numbers in the head, or that of rest
    rest: int
    end: int
    class_of: np.ndarray  # of each head word, and of rest
    first: np.ndarray  # first head word of each class
    log_rest: float  # natural log of Z
    p: dict[str, np.ndarray]

    @cached_property
    def _begins(self) -> np.ndarray:
        """Of each value of a key's first 18 bits the place of the first known key that is no smaller."""
        return np.minimum(np.searchsorted(self.known, np.arange(-1 << 17, 1 << 17) << 46), len(self.known) - 1)

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its number in the head (rest for others) and its count (-1: not among the known)."""
        at = self._begins[(words >> 46) + (1 << 17)]
        left = np.flatnonzero(self.known[at] < words)
        while len(left):  # on to the next key, as long as it may be the one
            left = left[at[left] < len(self.known) - 1]
            at[left] += 1
            left = left[self.known[at[left]] < words[left]]
        hit = self.known[at] == words
        return np.where(hit, self.known_head[at], self.rest), np.where(hit, self.known_c[at], -1)

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs of the head words' probabilities, and of rest's class, after the states."""
        out = np.empty(len(target), np.float64)
        to_classes, c, to_heads, w = (self.p[k] for k in "CcWw")
        # Biases become weights of the sums, except where a sum might overflow.
        reach = max(1.0, float(states.max(initial=0)), -float(states.min(initial=0)))
        wide, wide_heads = _may_overflow(to_classes, c, reach).any(), _may_overflow(to_heads, w, reach)
        c_weight, w_weight = np.exp(np.minimum(c, 60)), np.exp(np.minimum(w, 60))
        kind = self.class_of.astype(np.int16 if len(self.first) < 1 << 15 else np.int64)  # short ones sort faster
        lows, width = np.append(self.first, self.rest), np.append(np.diff(np.append(self.first, self.rest)), 1)

        def measure(t: np.ndarray, place: np.ndarray, bias: np.ndarray, weight: np.ndarray, cut: bool, own: np.ndarray, sums: np.ndarray) -> None:
            """Of each row the sum of the exps, and what stands at its place without the bias."""
            if cut:
                t += bias
                np.minimum(t, 60, out=t)
                own[:] = t.reshape(-1).take(place) - bias.take(place % len(bias))
                weight = _ones(len(bias))
            else:
                t.reshape(-1).take(place, out=own, mode="clip")
            np.matmul(np.exp(t, out=t), weight, out=sums)

        for at in range(0, len(target), ROWS):
            order = np.argsort(kind[target[at : at + ROWS]], kind="stable")
            x, h = target[at : at + ROWS][order], states[at : at + ROWS].take(order, 0)
            k, rows = kind[x], np.arange(len(x))
            own, sums = np.empty(len(x), np.float32), np.empty(len(x), np.float32)
            place = rows % BLOCK * len(lows) + k
            for i in (slice(j, j + BLOCK) for j in range(0, len(x), BLOCK)):
                measure(h[i] @ to_classes, place[i], c, c_weight, wide, own[i], sums[i])
            lp = own + c[k] - np.log(sums)
            bounds = np.searchsorted(k, np.arange(len(lows) + 1))
            own[:], sums[:] = 0, 1  # a word alone in its class is certain
            place = (rows - bounds[k]) * width[k] + (x - lows[k])
            for cl in np.flatnonzero(np.diff(bounds) * (width > 1)).tolist():
                i, j = slice(bounds[cl], bounds[cl + 1]), slice(lows[cl], lows[cl] + width[cl])
                measure(h[i] @ to_heads[:, j], place[i], w[j], w_weight[j], wide_heads[j].any(), own[i], sums[i])
            lp = lp.astype(np.float64)
            lp += own + np.where(width[k] > 1, w.take(x, mode="clip"), 0) - np.log(sums)
            out[at + order] = lp
        return out

    def score(self, numbers: np.ndarray, counts: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """Of each document the sum of `log_probs` over its words and its end; of about `rows` tokens at once."""
        hidden, out = self.p["U"].shape[0], np.empty(len(counts))
        # What a word adds to each gate, and what the state does; those of the two sigmoids with the sign that exp needs.
        split = lambda a: np.ascontiguousarray((a * np.repeat([-1, -1, 1], hidden)).reshape(-1, 3, hidden).swapaxes(0, 1), np.float32)
        table, turn = split(self.p["E"] @ self.p["X"] + self.p["x"]), split(self.p["U"])
        # Documents of like lengths take their steps together, as many as the processor's cache holds.
        order, begin = np.argsort(-counts, kind="stable"), np.cumsum(counts) - counts
        for own in (order[at : at + TOGETHER] for at in range(0, len(order), TOGETHER)):
            out[own] = self._score_sorted(numbers[spans.ranges(begin[own], counts[own])], counts[own], table, turn, rows)
        return out

    def _score_sorted(self, numbers: np.ndarray, counts: np.ndarray, table: np.ndarray, turn: np.ndarray, rows: int) -> np.ndarray:
        """As `score`, for documents from the longest down."""
        n, hidden, length = len(counts), table.shape[2], counts + 1
        runs = np.searchsorted(-length, -np.arange(length[0]), "left")  # documents that have a token there: the first ones
        edges = np.append(0, np.cumsum(runs))
        # Each document with its end; then the first tokens of all, the second ones, and so on.
        begin = np.cumsum(length) - length
        place = edges[np.arange(edges[-1]) - np.repeat(begin, length)]
        place += np.repeat(np.arange(n), length)
        line = np.empty(edges[-1], np.int64)
        line[place] = np.insert(numbers, np.cumsum(counts), self.end)
        lp = np.empty(len(line))
        h, given = np.zeros((n, hidden), np.float32), np.full(n, self.end)  # begins like after an end
        room, drawn = np.empty(3 * n * hidden, np.float32), np.empty(3 * n * hidden, np.float32)
        runs, edges, t0 = runs.tolist(), edges.tolist(), 0
        while t0 < len(runs):
            lo = edges[t0]
            t1 = max(t0 + 1, bisect.bisect_right(edges, lo + rows) - 1)
            states = np.empty((edges[t1] - lo, hidden), np.float32)
            for t in range(t0, t1):
                run, at = runs[t], edges[t]
                own, made, x = h[:run], room[: 3 * run * hidden].reshape(3, run, hidden), drawn[: 3 * run * hidden].reshape(3, run, hidden)
                gates, c = made[:2], made[2]
                np.matmul(own, turn, out=made)
                table.take(given[:run], 1, out=x, mode="clip")
                gates += x[:2]
                np.exp(gates, out=gates)
                gates += 1
                c /= made[1]
                c += x[2]
                np.tanh(c, out=c)
                c -= own
                c /= made[0]
                h, given = states[at - lo : at - lo + run], line[at : at + run]
                np.add(own, c, out=h)
            lp[lo : edges[t1]] = self.log_probs(states, line[lo : edges[t1]])
            t0 = t1
        return np.add.reduceat(lp[place], begin)


def _may_overflow(weights: np.ndarray, bias: np.ndarray, reach: float = 1.0) -> np.ndarray:
    """Of each column whether states, which lie between -reach and reach, may lead to a sum whose exp is too large."""
    most = reach * np.abs(weights).sum(0)
    return most + np.maximum(bias, 0) > 60


def _sums(a: np.ndarray) -> np.ndarray:
    return a @ _ones(a.shape[1])


def _transposed_product(a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """a.T @ b for few columns and many rows, by blocks of rows."""
    most = len(a) // block * block
    x, y = (x[:most].reshape(-1, block, x.shape[1]) for x in (a, b))
    return np.matmul(x.swapaxes(1, 2), y).sum(0) + a[most:].T @ b[most:]


@lru_cache(256)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def build(counts: DataFrame, head: int | None = None, known: int = KNOWN, classes: int | None = None, hidden: int = HIDDEN, dim: int = DIM, seed: int = SEED) -> Model:
    """An untrained model: the network's output is the unigram distribution."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Buckets of counts, from the largest down, as long as they fit: at most `known` rows, and no global sort.
    bucket = F.floor(F.log2("c") * 16).cast("int")
    least, taken = 1 << 30, 0
    for r in sorted(counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):  # 1024 rows at most
        taken += r["n"]
        if taken > known:
            break
        least = r["b"]
    top = sorted(counts.where(bucket >= least).collect(), key=lambda r: (-r["c"], r["word"]))
    words, c = [r["word"] for r in top], [r["c"] for r in top]
    if END not in words:  # fewer documents than occurrences of any known word, or none
        words, c = [*words[: known - 1], END], [*c[: known - 1], (counts.where(F.col("word") == END).select("c").first() or [0])[0]]
    k = min(head or max(HEAD, 2 * math.isqrt(int(whole["v"]))), len(words))
    classes = classes or max(CLASSES, math.isqrt(k))
    if END not in words[:k]:
        i = words.index(END)
        words[k - 1], words[i], c[k - 1], c[i] = words[i], words[k - 1], c[i], c[k - 1]
    words, c = np.array(words, np.int64), np.array(c, np.int64)
    mass = np.cumsum(np.sqrt(c[:k] + 1.0))
    class_of = np.minimum((mass - mass[0]) / mass[-1] * classes, classes - 1).astype(np.int64)
    _, first, class_of = np.unique(class_of, return_index=True, return_inverse=True)
    z = (int(whole["n"]) - int(c[:k].sum())) + max(0, int(whole["v"]) - k) + 1
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)
    sizes = np.append(np.add.reduceat(c[:k] + 1.0, first), z)
    p = {
        "E": rng.normal(0, 0.3, (k + 1, dim)).astype(np.float32), "X": small(dim, 3 * hidden), "x": np.zeros(3 * hidden, np.float32), "U": small(hidden, 3 * hidden),
        "C": np.zeros((hidden, len(sizes)), np.float32), "c": np.log(sizes / sizes.sum()).astype(np.float32), "W": np.zeros((hidden, k), np.float32), "w": np.log(c[:k] + 1.0).astype(np.float32),
    }
    p["x"][:hidden] = -1.0  # states that last at first
    order = np.argsort(words)
    number = np.minimum(np.arange(len(words)), k)
    return Model(int(whole["n"]), int(whole["v"]), words[order], c[order], number[order], k, int(np.flatnonzero(words == END)[0]), np.append(class_of, len(first)), first, float(np.log(z)), p)


def _lanes(m: Model, docs: list[np.ndarray], lanes: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents, whole or in pieces, dealt to lanes of nearly equal length, in their order within a lane: by lane and step
    the word before, the word to tell, whether there is one, and whether the state goes on."""
    parts = []
    for d in docs:
        whole = np.append(d, m.end)
        for at in range(0, len(whole), piece or len(whole)):
            parts.append((whole[at : at + (piece or len(whole))], whole[at - 1] if at else m.end))
    # The longest first to the emptiest lane: few lanes are left to run alone at the end.
    load, lane = np.zeros(lanes, np.int64), np.empty(len(parts), np.int64)
    sizes = np.array([len(part) for part, _ in parts])
    for i in np.argsort(-sizes, kind="stable").tolist():
        lane[i] = k = load.argmin()
        load[k] += sizes[i]
    shape = (lanes, int(load.max()))
    before, target, valid, goes_on = np.full(shape, m.end), np.full(shape, m.end), np.zeros(shape, bool), np.ones(shape, np.float32)
    load[:] = 0
    for (part, prior), k in zip(parts, lane.tolist(), strict=True):
        at, to = load[k], load[k] + len(part)
        target[k, at:to], valid[k, at:to], goes_on[k, at] = part, True, 0
        before[k, at], before[k, at + 1 : to] = prior, part[:-1]
        load[k] = to
    return before, target, valid, goes_on


def train(m: Model, docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS, rate: float = RATE, piece: int = 0) -> list[float]:
    """Truncated backpropagation with Adam over the documents (numbers of words), dealt to lanes whole or in pieces; the mean loss of each window is returned."""
    if not docs:
        return []
    before, target, valid, goes_on = _lanes(m, docs, lanes, piece)
    length, n, dim = before.shape[1], m.p["U"].shape[0], m.p["E"].shape[1]
    # All parameters, their gradients and Adam's moments lie in one array each; those of a name are views, and biases follow their weights.
    names = sorted(m.p, key=lambda k: (k.lower(), k))
    values = np.concatenate([m.p[k].reshape(-1) for k in names]).astype(np.float32)
    slopes, first_moment, second = (np.zeros_like(values) for _ in range(3))
    bounds = dict(zip(names, np.append(0, np.cumsum([m.p[k].size for k in names])).tolist(), strict=False))
    views = lambda flat: {k: flat[bounds[k] : bounds[k] + m.p[k].size].reshape(m.p[k].shape) for k in names}
    joint = lambda flat, k: flat[bounds[k] : bounds[k] + m.p[k].size + m.p[k.lower()].size].reshape(-1, m.p[k].shape[1])
    p, g = views(values), views(slopes)
    (to_classes, to_heads, to_gates), (class_slope, head_slope, gate_slope) = ([joint(flat, k) for k in "CWX"] for flat in (values, slopes))
    m.p = p
    kind = m.class_of.astype(np.int16 if len(m.first) < 1 << 15 else np.int64)  # short ones sort faster
    lows, width = np.append(m.first, m.rest), np.append(np.diff(np.append(m.first, m.rest)), 1)
    # A step's arrays have a row for each unit and a column for each lane.  From the state come what it adds to the candidate and to the
    # gates, from the input and a one what those add to the gates and to the candidate; the gates with the sign that exp needs.
    most = min(steps, length)
    prior, turned = np.empty((most, n, lanes), np.float32), np.empty((most, 3 * n, lanes), np.float32)
    given, made = np.ones((most, dim + 1, lanes), np.float32), np.empty((most, 3 * n, lanes), np.float32)
    of_state, of_input = np.empty((3 * n, n), np.float32), np.empty((3 * n, dim + 1), np.float32)
    cs, out = np.empty((most, n, lanes), np.float32), np.empty((most, n, lanes), np.float32)
    factor, d = np.empty((most, 4, n, lanes), np.float32), np.empty((most, 4 * n, lanes), np.float32)
    by_lane, into = np.ones((most, lanes, n + 1), np.float32), np.empty((most, n, lanes), np.float32)
    moved, column, work = np.empty((n, lanes), np.float32), np.arange(dim)[:, None], np.empty(1 << 14, np.float32)
    h, losses, windows = np.zeros((n, lanes), np.float32), [], range(0, length, steps)
    for step, t0 in enumerate(windows):
        inputs, ok, on = (np.ascontiguousarray(x[:, t0 : t0 + steps].T) for x in (before, valid, goes_on))
        k = len(inputs)
        of_state[:n] = p["U"][:, 2 * n :].T
        np.negative(p["U"][:, : 2 * n].T, out=of_state[n:])
        np.negative(to_gates[:, : 2 * n].T, out=of_input[: 2 * n])
        of_input[2 * n :] = to_gates[:, 2 * n :].T
        given[:k, :dim] = p["E"].take(inputs, 0).swapaxes(1, 2)
        np.matmul(of_input, given[:k], out=made[:k])
        for t in range(k):
            own, gates, c = prior[t], made[t, : 2 * n], cs[t]
            np.multiply(h, on[t], out=own)
            np.matmul(of_state, own, out=turned[t])
            gates += turned[t, n:]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[n:], turned[t, :n], out=c)
            c += made[t, 2 * n :]
            np.tanh(c, out=c)
            h = out[t]
            np.subtract(c, own, out=h)
            h *= gates[:n]
            h += own
        w = target[:, t0 : t0 + steps].T[ok]
        if not len(w):
            h = h.copy()
            continue
        order = np.argsort(kind[w], kind="stable")
        place_of, w = np.flatnonzero(ok)[order], w[order]
        by_lane[:k, :, :n] = out[:k].swapaxes(1, 2)
        flat = by_lane.reshape(-1, n + 1).take(place_of, 0)  # a state and, for the biases, a one
        own, rows = kind[w], np.arange(len(w))
        # Neither softmax is divided by its sums: what meets it is, as it is narrower.
        s = flat @ to_classes
        if _may_overflow(p["C"], p["c"]).any():
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        sums, place = _sums(s), rows * s.shape[1] + own
        chance = s.reshape(-1)[place]
        s.reshape(-1)[place] = chance - sums
        chance /= sums
        scale = np.float32(16 / len(w))  # the slopes are those of 16 tokens
        share = (scale / sums)[:, None]
        class_slope[:] = _transposed_product(flat * share, s)
        back = s @ p["C"].T
        back *= share
        # The words of a class lie in a block of rows, and the blocks one behind the other; a word alone in its class is certain, and nothing to learn.
        edges = np.searchsorted(own, np.arange(len(lows) + 1))
        cells = np.append(0, np.cumsum(np.where(width > 1, np.diff(edges) * width, 0)))
        q, sums, within, blocks = np.empty(cells[-1], np.float32), np.ones(len(w), np.float32), np.ones(len(w), np.float32), []
        for cl in np.flatnonzero(np.diff(cells)).tolist():
            i, j = slice(edges[cl], edges[cl + 1]), slice(lows[cl], lows[cl] + width[cl])
            block = q[cells[cl] : cells[cl + 1]].reshape(-1, width[cl])
            np.matmul(flat[i], to_heads[:, j], out=block)
            blocks.append((i, j, block))
        np.minimum(q, 60, out=q)
        np.exp(q, out=q)
        learn = np.flatnonzero(width[own] > 1)
        if len(learn):
            cl = own[learn]
            place = cells[cl] + (learn - edges[cl]) * width[cl]  # where a row begins
            sums[learn] = total = np.add.reduceat(q, place)
            place += w[learn] - lows[cl]
            got = q[place]
            q[place] = got - total
            within[learn] = got / total
        np.divide(scale, sums[:, None], out=share)
        flat *= share
        head_slope[:] = 0
        from_heads = np.zeros_like(back)
        for i, j, block in blocks:
            np.matmul(flat[i].T, block, out=head_slope[:, j])
            np.matmul(block, p["W"][:, j].T, out=from_heads[i])
        from_heads *= share
        back += from_heads
        losses.append(-float(np.log(chance + 1e-12).sum() + np.log(within + 1e-12).sum()) / len(w))
        spread = np.zeros((k * lanes, n), np.float32) if len(w) < k * lanes else np.empty((k * lanes, n), np.float32)
        spread[place_of] = back
        into[:k] = spread.reshape(k, lanes, n).swapaxes(1, 2)
        # What a step's dh is multiplied with to give the slopes of what the matrix made, for all steps at once.
        z, r, c, from_state = made[:k, :n], made[:k, n : 2 * n], cs[:k], turned[:k, :n]
        stays, (to_state, to_z, to_r, to_c) = 1 - z, factor[:k].swapaxes(0, 1)
        np.subtract(prior[:k], c, out=to_z)
        to_z *= z
        to_z *= stays
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= z
        np.multiply(to_c, r, out=to_state)
        np.subtract(r, 1, out=to_r)
        to_r *= to_state
        to_r *= from_state
        backward, dh = np.ascontiguousarray(of_state.T), np.zeros((n, lanes), np.float32)
        for t in reversed(range(k)):
            dh += into[t]
            np.multiply(dh, factor[t], out=d[t].reshape(4, n, lanes))
            np.matmul(backward, d[t, : 3 * n], out=moved)
            dh *= stays[t]
            dh += moved
            dh *= on[t]
        slope = np.matmul(d[:k, : 3 * n], prior[:k].swapaxes(1, 2)).sum(0).T
        np.negative(slope[:, n:], out=g["U"][:, : 2 * n])
        g["U"][:, 2 * n :] = slope[:, :n]
        slope = np.matmul(d[:k, n:], given[:k].swapaxes(1, 2)).sum(0).T
        np.negative(slope[:, : 2 * n], out=gate_slope[:, : 2 * n])
        gate_slope[:, 2 * n :] = slope[:, 2 * n :]
        to_words = np.matmul(np.ascontiguousarray(of_input[:, :dim].T), d[:k, n:])
        g["E"][:] = 0
        np.add.at(g["E"].reshape(-1), (inputs[:, None] * dim + column).reshape(-1), to_words.reshape(-1))
        h = h.copy()  # the next window writes over its place
        # Adam, in place and a part after the other that the cache holds; the moments are kept without their factors of 0.1 and 0.01.
        even = math.sqrt(0.01 / (1 - 0.99 ** (step + 1)))
        by = rate * (1 - 0.9 * step / len(windows)) / (1 - 0.9 ** (step + 1)) * 0.1 / even
        for at in range(0, len(values), len(work)):
            slope, one, two, value = (x[at : at + len(work)] for x in (slopes, first_moment, second, values))
            move = work[: len(slope)]
            np.clip(slope, -1, 1, out=slope)
            one *= 0.9
            one += slope
            two *= 0.99
            slope *= slope
            two += slope
            np.sqrt(two, out=move)
            move += 1e-6 / even
            np.divide(one, move, out=move)
            move *= by
            value -= move
    return losses


def learned(docs: DataFrame, model: Model, text: str = "text", shard: int = SHARD) -> dict[str, np.ndarray]:
    """The model's parameters after training on all rows: the mean of the shards' copies.  Which rows are in a shard, and their
    order, depends on the rows alone.  What is shuffled of a task is one copy's parameters, and there are TASKS tasks at most."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = sorted(model.p)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                words, n = tokens(part.column("_text"))
                numbers = shared.value.numbers(words)[0].astype(np.int32)
                offsets = np.append(0, np.cumsum(n) * 4).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])
                yield pa.RecordBatch.from_arrays([part.column("key"), ids.cast(pa.binary())], ["key", "ids"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy for each 2 * shard tokens, or for all there are; a task adds its copies up, by their tokens, and passes on one."""
        total, seen, block, size = 0.0, 0, [], 0

        def copy() -> np.ndarray:
            m = replace(shared.value, p={k: v.copy() for k, v in shared.value.p.items()})
            train(m, block, min(WIDE, max(1, size // PIECE)), rate=RATE / 4, piece=PIECE)
            return np.concatenate([m.p[k].reshape(-1) for k in names]).astype(np.float64) * size

        for batch in batches:
            for x in batch.column("ids"):
                block.append(np.frombuffer(x.as_buffer(), np.int32))
                size += len(block[-1]) + 1
                if size >= 2 * shard:
                    total, seen = total + copy(), seen + size
                    block, size = [], 0
        if size:
            total, seen = total + copy(), seen + size
        if seen:
            flat = (total / seen).astype(np.float32)
            parts = [flat[at : at + SLICE].tobytes() for at in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())], ["part", "weight", "p"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for batch in batches:
            for part, weight, p in zip(*(batch.column(k).to_pylist() for k in ("part", "weight", "p")), strict=True):
                own = np.frombuffer(p, np.float32).astype(np.float64) * weight
                sums[part] = sums[part] + own if part in sums else own
                weights[part] = weights.get(part, 0.0) + weight
        out = [(sums[k] / weights[k]).astype(np.float32).tobytes() for k in sums]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["part", "p"])

    rows = docs.select(F.xxhash64(*docs.columns).alias("key"), F.col(text).alias("_text")).mapInArrow(number, "key bigint, ids binary")
    shards = min(TASKS, max(1, -(-model.total // shard)))
    trained = rows.repartition(shards, "key").sortWithinPartitions("key", "ids").mapInArrow(copies, "part int, weight double, p binary")
    got = trained.repartition("part").mapInArrow(mean, "part int, p binary").collect()  # one set of parameters
    if not got:
        return model.p
    flat, p, at = np.concatenate([np.frombuffer(r["p"], np.float32) for r in sorted(got, key=lambda r: r["part"])]), {}, 0
    for k in names:
        p[k] = flat[at : at + model.p[k].size].reshape(model.p[k].shape).copy()
        at += model.p[k].size
    return p


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model of these documents, and the counts of all their words.  docs: the training part."""
    spans.prepare(docs.sparkSession)
    counts = written(count_words(docs, text), "word_counts")
    model = build(counts)
    n = max(1, docs.count())
    some = docs.where(F.octet_length(text) <= SAMPLE_BYTES).where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * sample / n)))
    rows = some.select(F.col(text).alias("t")).distinct().orderBy(F.xxhash64("t")).limit(sample).collect()
    texts = []
    for r in rows:
        words, _ = tokens(pa.array([r["t"]], pa.string()))
        texts.append(model.numbers(words)[0])
    train(model, texts)
    return replace(model, p=learned(docs, model, text)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    spans.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # grows with the root of the number of different words

    def sequences(words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A key of each text's words, on which all that is returned of it depends."""
        return spans.runs(words.view(np.uint64), np.cumsum(n) - n, n).view(np.int64)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, key, times) of the words that the model doesn't know; once a text and chunk, with a row (null, key, 1)."""
        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                words, n = tokens(part.column("_text"))
                all_keys = sequences(words, n)
                keys, at = np.unique(all_keys, return_index=True)
                once = np.zeros(len(n), bool)
                once[at] = True
                _, c = shared.value.numbers(words)
                new_words = (c < 0) & np.repeat(once, n)
                doc, own = np.repeat(np.arange(len(n)), n)[new_words], words[new_words]
                order = np.lexsort((own, doc))
                own, doc = own[order], doc[order]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))) if len(own) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(own)))
                word = pa.concat_arrays([pa.array(own[new]), pa.nulls(len(keys), pa.int64())])
                key, times = np.concatenate([all_keys[doc[new]], keys]), np.concatenate([times, np.ones(len(keys), np.int64)])
                yield pa.RecordBatch.from_arrays([word, pa.array(key), pa.array(times.astype(np.int32))], ["word", "key", "times"])

    def network(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores documents of GROUP bytes of text at once."""
        m: Model = shared.value
        end_c = int(m.known_c[np.searchsorted(m.known, END)])
        names, held, size = ["_id", "_key", "n_tokens", "known", "base", "lp"], [], 0

        def scored() -> pa.RecordBatch:
            ids, *columns = zip(*held, strict=True)
            numbers, n, *columns, lp = map(np.concatenate, columns)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, columns), pa.array(lp + m.score(numbers, n))], names)

        for batch in batches:
            for part in spans.chunks(batch, "_text"):
                words, n = tokens(part.column("_text"))
                numbers, c = m.numbers(words)
                is_rest = numbers == m.rest
                rest = spans.per_text(is_rest.astype(np.int64), n)
                known = spans.per_text((c > 0).astype(np.int64), n) + (end_c > 0)
                logs = np.log(np.maximum(c, 0) + 1.0)
                base = spans.per_text(logs, n) + np.log(end_c + 1.0)
                lp = spans.per_text(np.where(is_rest, logs, 0.0), n) - rest * m.log_rest
                held.append((part.column("_id"), numbers.astype(np.int32), n, sequences(words, n), n + 1, known, base, lp))
                size += part.nbytes
                if size >= GROUP:
                    yield scored()
                    held, size = [], 0
        if held:
            yield scored()

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    scored = rows.mapInArrow(network, "_id bigint, _key bigint, n_tokens bigint, known bigint, base double, lp double")
    pairs = rows.select("_text").mapInArrow(rare, "word bigint, key bigint, times int")
    # A text's own row (null) has no count to meet, so it is spread by its key.
    own = pairs.withColumn("spread", F.when(F.col("word").isNull(), F.col("key")).otherwise(0))
    met = own.join(counts.withColumn("spread", F.lit(0).cast("long")), ["word", "spread"], "left")
    sums = met.groupBy("key").agg(
        F.sum(F.col("times") * F.log(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("seen"), F.count_if(F.col("word").isNull()).alias("copies")
    )
    more, seen = F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0)), F.coalesce((F.col("seen") / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    return scored.join(sums, scored["_key"] == sums["key"], "left").select(
        F.col("_id").alias(doc_id), "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        ((F.col("base") + more) / LOG10 - F.col("n_tokens") * float(np.log10(model.total + model.kinds + 1))).alias("base_score"), ((F.col("lp") + more) / LOG10).alias("score"),
    )


def in_training(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts != part
