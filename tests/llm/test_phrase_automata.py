"""Removal of repeated windows against brute force, on small blocks, windows and automata."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import phrase_automata, spans

SCHEMA = "doc_id bigint, text string, kept_text string, id int, removed int"


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in docs:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, ws in docs:
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone), sorted(gone)))
    return out


def passages(seed=5, n=40, window=50):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ab", "ba", "é", "日本", "x"]) + str(r.randint(0, 60))
    shared = [" ".join(word() for _ in range(m)) for m in (window, window + 1, window - 1, 3 * window, window // 2)]
    texts = [None, "", " \n", "one", shared[0], shared[0], shared[1], "w " * (4 * window), "w " * (window - 1), "\n".join(shared[3].split(" ")), shared[3].replace(" ", "\t \r")]
    for _ in range(n):
        own = [" ".join(word() for _ in range(r.randint(0, window)))] + [x for x in shared if r.random() < 0.3]
        r.shuffle(own)
        texts.append((" " if r.random() < 0.8 else "").join(own))
    ws = shared[3].split(" ")
    texts += [" ".join(ws[k:] + ws[:k]) for k in (1, 20, 70)] + [" ".join(ws[: 2 * window]) + "x", "x" + " ".join(ws[: 2 * window]), shared[3]]
    return texts


@pytest.mark.parametrize(("window", "phrase", "block_bytes", "shard_phrases"), [(50, 8, 1 << 22, 20_000), (50, 8, 1500, 3), (7, 3, 4000, 5), (3, 3, 4000, 50)])
def test_against_brute_force(spark, window, phrase, block_bytes, shard_phrases):
    texts = passages(window=window)
    rows = list(enumerate(texts)) + [(30, texts[20]), (30, texts[20]), (31, texts[6]), (None, texts[6]), (None, None)] + [(1000 + i, texts[4 + i % 8] if i % 3 else texts[25]) for i in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(7)
    got = phrase_automata.remove_repeats(df, window=window, phrase=phrase, block_bytes=block_bytes, shard_phrases=shard_phrases).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    flat = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], [k for s in r["removed"] for k in range(s["begin"], s["end"])]) for r in got]
    want = brute(rows, window)
    assert sorted(flat, key=key) == sorted(want, key=key)
    assert sum(x[2] for x in want) > 500


def test_ids_may_be_strings(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = phrase_automata.remove_repeats(spark.createDataFrame([("b", text), ("a", text), ("aa", "y " + text)], "name string, body string"), doc_id="name", text="body")
    assert {r["name"]: r["kept_text"] for r in got.collect()} == {"a": text, "b": "", "aa": "y"}


def test_nothing(spark):
    got = phrase_automata.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_words", "n_removed", "removed", "kept_text"] and got.count() == 0


def test_a_very_long_text(spark):
    r = random.Random(2)
    long = " ".join(str(r.randint(0, 50_000)) for _ in range(150_000))
    part = " ".join(long.split(" ")[70_000:70_100])
    rows = [(9, long), (1, f"head {part} tail"), (10, long)]
    got = {x["doc_id"]: x for x in phrase_automata.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()}
    assert (got[1]["n_removed"], got[9]["n_removed"], got[10]["n_removed"]) == (0, 100, 150_000)


def test_windows_choose_alike():
    """Equal windows choose equal phrases at equal places, wherever they stand; so every repeat has a phrase that recurs."""
    text = " ".join(f"w{i}" for i in range(200))
    texts = phrase_automata.Texts.of(pa.array([f"a b c {text}", text, "x"]), 50, 8)
    choice = {int(s): int(c) for s, c in zip(texts.starts, texts.chosen, strict=True)}
    assert all(choice[3 + k] - 3 == choice[203 + k] - 203 for k in range(151))
    assert all(s <= c <= s + 42 for s, c in choice.items())
    assert len(texts.phrases()[0]) < 2 * 400 / 12


def test_runs():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40, np.uint64)
    both = np.concatenate([h, h[:20]])
    assert (spans.runs(both, np.arange(16), 5) == spans.runs(both, np.arange(40, 56), 5)).all()
    assert len(set(spans.runs(both, np.arange(36), 5).tolist())) == 36
