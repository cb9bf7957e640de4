"""Operators of the llm subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import itertools
import math
import os
import random
import re
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import (
    components,
    decontamination,
    language_id,
    lm_scoring,
    ngram_join,
    quality_classifier,
    queries,
    rule_ledger,
    sharding,
    spans,
    storage,
    token_counts,
    token_output,
    unigram,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0d]+")
PLAIN = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = " ".join(f"w{i}" for i in range(60))


def varied(seed=3, n=60, vocabulary=400):
    r = random.Random(seed)
    return [" ".join(f"t{r.randint(0, vocabulary)}" for _ in range(r.randint(1, 90))) for _ in range(n)]


def edited(text, k, seed):
    r, ws = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(ws)), k):
        ws[i] = f"x{seed}"
    return " ".join(ws)


TEXTS = [None, "", " \n ", "one", "A b", "É à ßx", "word " * 3000, BASE, BASE, BASE.upper(), edited(BASE, 1, 1), edited(BASE, 1, 2), edited(BASE, 9, 3), "x" * 200_000, "😀 á ▁ ▁x\r\n\ttab  two", *varied()]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(5, TEXTS[7], "en", "s", 1), (5, TEXTS[5], None, None, None), (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def brute_hits(text, items):
    ws, hit, found = PLAIN.findall((text or "").translate(LOWER)), set(), set()
    for i, t in items:
        iw = PLAIN.findall((t or "").translate(LOWER))
        k = min(10, len(iw))
        for w in {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if k else ():
            for s in range(len(ws) - k + 1):
                if tuple(ws[s : s + k]) == w:
                    hit |= set(range(s, s + k))
                    found |= {str(i)} if i is not None else set()
    return len(ws), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("most", [10_000, 0])
def test_decontamination(spark, docs, nothing, most):
    items = [(1, " ".join(BASE.split()[5:20])), (2, "ONE"), (3, "t1 t2"), (10, BASE), (4, ""), (5, None), (None, "à ßx"), (6, "word " * 12), (2, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(7))
    got = decontamination.decontaminate(docs.withColumn("n_hit", F.lit("clash")), bench, broadcast_rows=most)
    rows = got.select("text", "n_words", "n_hit", F.array_join("items", ",").alias("i"), "contaminated")
    want = collections.Counter((t, *brute_hits(t, items)[:3], brute_hits(t, items)[1] > 0) for (t,) in docs.select("text").collect())
    assert by_row(rows, "text", "n_words", "n_hit", "i", "contaminated") == want
    assert decontamination.decontaminate(nothing, bench).isEmpty()
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").isEmpty()


def test_rule_ledger(docs, nothing):
    got = rule_ledger.ledger(docs.withColumn("failures", F.lit("clash")))
    for r in got.collect():
        t = r["text"] or ""
        ws, lines = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)]
        grams = list(zip(ws, ws[1:], ws[2:], strict=False))
        c = collections.Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
        want = (len(ws), sum(map(len, ws)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert bool(r["failures"] & 3) == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    policy = rule_ledger.POLICIES["standard"]
    failing = [r["failures"] & policy.mask for r in got.collect()]
    for r in rule_ledger.ablations(got, policy).collect():
        bit = 1 << list(rule_ledger.RULES).index(r["rule"])
        assert (r["fails"], r["fails_alone"], r["rejected"]) == (sum(bool(f & bit) for f in failing), failing.count(bit), sum(map(bool, failing)))
    assert rule_ledger.ledger(nothing).isEmpty()
    assert rule_ledger.apply_policy(got, policy).where("kept").count() == failing.count(0)


def test_rule_ledger_of_a_very_long_text(spark):
    """So many words that the places leave few bits to the hashes; and columns with names that the ledger might use itself."""
    ws = [f"w{i}" for i in range(300_000)]
    text = " ".join([*ws, "a", "b", "c", "d", "a", "b", "c"])
    row = rule_ledger.ledger(spark.createDataFrame([(text, 1, 2)], "text string, words int, _lines int")).first()
    assert (row["n_words"], row["n_repeat_words"], row["words"], row["_lines"]) == (300_007, 6, 1, 2)


def test_decontamination_with_clashing_names(spark):
    rows = [("a", " ".join(BASE.split()[:30]), 1, 2, 3, 4, 5, 6), ("b", None, 1, 2, 3, 4, 5, 6), (None, "w1 w2", 1, 2, 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _id int, _content int, _hit int, items int, here int, names int")
    got = decontamination.decontaminate(docs, spark.createDataFrame([(1, BASE)], "item_id int, text string"))
    assert by_row(got, "doc_id", "_id", "_content", "_hit", "here", "names", "n_words", "n_hit", "contaminated") == collections.Counter(
        [("a", 1, 2, 3, 5, 6, 30, 30, True), ("b", 1, 2, 3, 5, 6, 0, 0, False), (None, 1, 2, 3, 5, 6, 2, 0, False)]
    )


def test_sharding_fills_all_shards(spark, docs, nothing):
    many = docs.union(spark.range(3000).select((F.col("id") % 7 + 100).alias("doc_id"), F.lit("same"), F.lit("en"), F.lit("s"), F.col("id")))
    rows = sharding.shard(many, 16, salts=3).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == many.count() and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in many.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(nothing, 16).isEmpty()


def test_segments_against_a_walk_of_single_keys():
    r = random.Random(1)
    counts = collections.Counter(r.choice([5, r.randrange(1 << 16)]) for _ in range(500))
    for slack in (0.0, 0.2):
        room = sharding.capacities(500, 5, slack)
        used, nodes, want = [0] * 5, sharding.ring(5), []
        for p in sorted(counts):
            k = next((i for i, (q, _) in enumerate(nodes) if q >= p), 0)
            for _ in range(counts[p]):
                while used[nodes[k % len(nodes)][1]] >= room[nodes[k % len(nodes)][1]]:
                    k += 1
                s = nodes[k % len(nodes)][1]
                want.append((p, s, used[s]))
                used[s] += 1
        got = [(p, s, base + i) for p, lo, hi, s, base in sharding.segments(counts, 5, slack) for i in range(hi - lo)]
        assert got == want


def shingles(text):
    ws = SPACED.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("short", "rounds"), [(8, 6), (2, 6), (2, 0)])
def test_ngram_join(spark, docs, short, rounds):
    """Also with lists so short that nearly all go through leaders, or straight to the exact end."""
    group = [(1000 + i, edited(BASE + " " + " ".join(f"v{j}" for j in range(60)), 1 + i % 4, i)) for i in range(25)]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in group], SCHEMA)
    both = docs.union(extra).repartition(2)
    got = by_row(ngram_join.component_ids(both, short=short, rounds=rounds), "doc_id", "n_shingles", "component_id")
    assert got == brute_components([(r["doc_id"], r["text"]) for r in both.collect()])


def test_ngram_join_in_many_blocks(spark):
    """A chain of edits, whose ends don't link, and strays; with blocks of a few documents, and extra columns with the operator's own names."""
    long, rows, text = " ".join(f"v{j}" for j in range(300)), [], None
    for i in range(30):
        text = edited(text or long, 3, 100 + i)
        rows.append((i, text))
    rows += [(100 + i, edited(long, 25 + i, i)) for i in range(20)] + [(None, long), (200, None), (200, long)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id bigint, text string, _here int, node int, _gone string")
    for rounds in (0, 2):
        got = by_row(ngram_join.component_ids(docs, short=2, rounds=rounds, block=900), "doc_id", "n_shingles", "component_id")
        assert got == brute_components(rows)
    kept = ngram_join.representatives(docs)
    least = {c for i, n, c in brute_components(rows) if i is not None and n}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["text"]) == sorted(least)


def test_prefixes_keep_every_link():
    """Any two sets that link share the smaller of their numbers of matches in their prefixes, and enough for the bound."""
    r = np.random.default_rng(5)
    level = ngram_join.levels(r.poisson(3, 1 << ngram_join.BITS).astype(float) + (r.random(1 << ngram_join.BITS) < 0.2) * 40)
    for _ in range(60):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        gone = int(r.integers(0, len(a) // 6 + 1))
        b = np.unique(np.append(r.permutation(a)[gone:], r.integers(0, 1 << 63, int(r.integers(0, len(a) // 6 + 1))).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        heads, asked, rest = [], [], []
        for x in (a, b):
            ordered = np.sort(ngram_join.keys(x, level))
            (matches,), (length,) = ngram_join.prefixes(ordered, np.array([len(x)]), 75, 16)
            heads.append(ordered[:length])
            asked.append(matches)
            rest.append(len(x) - length)
        c = len(np.intersect1d(*heads))
        assert c >= min(asked) and c + max(rest) >= both


def test_ngram_join_of_nothing(nothing, docs):
    assert ngram_join.component_ids(nothing).isEmpty()
    kept = collections.Counter((r["doc_id"], r["text"]) for r in ngram_join.representatives(docs).collect())
    assert kept[5, TEXTS[7]] == 1 and kept[0, None] == 1 and kept[5, TEXTS[5]] == 2 and kept[None, "no id"] == 1
    assert not {7, 8, 9, 10} & {i for i, _ in kept}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b")).union(spark.createDataFrame([(5, 5)], "a long, b long"))
    assert components.components(edges).select("label").distinct().count() == 1


def test_spans():
    texts = ["a bc  d\n", None, "", "é x", "  "]
    data, offsets = spans.buffers(pa.array(texts))
    begin, end, counts = spans.words(data, offsets)
    assert [bytes(data[b:e]).decode() for b, e in zip(begin, end, strict=True)] == ["a", "bc", "d", "é", "x"] and counts.tolist() == [3, 0, 0, 2, 0]
    t = spans.Table(2)
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 62, 5000).astype(np.uint64))
    t.add(keys[:3000])
    t.add(keys[3000:])
    assert t.find(keys).tolist() == list(range(len(keys))) and (t.find(keys + np.uint64(1)) >= 0).sum() < 5


def test_quality_classifier_on_held_out():
    r = random.Random(0)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "the", "old", "bridge"]) + str(r.randint(0, 50)) for _ in range(60))
    bad = lambda: " ".join(w + "***" for w in good().split())
    texts, labels = [(good if i % 2 else bad)() for i in range(400)], np.array([i % 2 for i in range(400)])
    m = quality_classifier.train(texts[:300], labels[:300])
    s = m.scores(pa.array(texts[300:]))
    assert ((s >= 0.7) == (labels[300:] == 1)).mean() > 0.95
    edge = m.scores(pa.array(["", None, "a", "ab", "x" * 5000], pa.string()))
    assert len(edge) == 5 and ((edge >= 0) & (edge <= 1)).all() and edge[0] == edge[1]
    assert quality_classifier.train([], np.empty(0)).scores(pa.array(["x"]))[0] == 0.5
    assert m.scores(pa.array(texts[:7])) == pytest.approx([m.scores(pa.array([t]))[0] for t in texts[:7]])


def test_language_bits_by_brute_force():
    texts = {"a": ["abab abc", "bbb é", ""], "b": ["xyz xyz", "ab"]}
    m = language_id.train(texts, 3)
    for t in ["abab", "xyz é", "q", "日本", "a", " ab xyzabc"]:
        data, offsets = spans.buffers(pa.array([t]))
        want = []
        for name in sorted(texts):
            seen = collections.defaultdict(collections.Counter)
            for s in texts[name]:
                b = [-1] * 3 + list(s.encode())
                for i, k in itertools.product(range(3, len(b)), range(4)):
                    seen[tuple(b[i - k : i])][b[i]] += 1
            b, bits = [-1] * 3 + list(t.encode()), 0.0
            for i in range(3, len(b)):
                for k in (3, 2, 1, 0):
                    c = seen.get(tuple(b[i - k : i]))
                    if c and b[i] in c:
                        bits -= math.log2(c[b[i]] / (c.total() + len(c)))
                        break
                    if c:
                        bits -= math.log2(len(c) / (c.total() + len(c)))
                else:
                    bits += 8
            want.append(bits)
        assert m.bits(data, offsets)[0] == pytest.approx(want, abs=1e-4)
    assert m.predict(pa.array(["12 !", "", None, "ab"]))[0] == ["und", "und", "und", "a"]
    assert language_id.train({}).predict(pa.array(["ab"]))[0] == ["und"]


def test_re_pair_runs_until_no_pair_is_frequent():
    r = np.random.default_rng(2)
    ids = np.tile(r.integers(0, 1000, 512), 64).astype(np.uint32)
    g = token_output.re_pair(ids, np.array([len(ids)]), 1000)
    pairs = collections.Counter(zip(g.body[:-1].tolist(), g.body[1:].tolist(), strict=True))
    assert max(pairs.values()) < token_output.LEAST_COUNT and g.decode().tolist() == ids.tolist()


def test_language_sample_under_skew(spark):
    # Of each language a text that fills nearly all rows and five others; one language has only long texts, one has both.
    rows = [(f"l{k}", f"copied {k}") for k in range(10) for _ in range(995)] + [(f"l{k}", f"own {k} {i}") for k in range(10) for i in range(5)]
    rows += [("long", f"{i} " + "ab " * 12_000) for i in range(3)] + [("l0", "cd " * 12_000), (None, "none"), ("null", None)]
    got = language_id.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    cut = ("cd " * 12_000)[: language_id.SAMPLE_BYTES]
    assert {k: sorted(v) for k, v in got.items() if k != "long"} == {f"l{k}": sorted([f"copied {k}", *(f"own {k} {i}" for i in range(5)), *[cut] * (k == 0)]) for k in range(10)}
    assert sorted(t[:4] for t in got["long"]) == ["0 ab", "1 ab", "2 ab"] and {len(t) for t in got["long"]} == {language_id.SAMPLE_BYTES}
    # One short text among long ones is one of all.
    rows = [("a", "short")] + [("a", f"{i} " + "xyz " * 9000) for i in range(40)] + [("b", "other")]
    assert {k: len(v) for k, v in language_id.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True)).items()} == {"a": 41, "b": 1}
    # Two thirds copies: as many as without them.
    rows = [("a", f"text {i}") for i in range(1000)] + [("a", "text 0")] * 2000
    assert len(language_id.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))["a"]) == language_id.SAMPLE


def test_re_pair_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        ids = r.integers(0, 4, n).astype(np.uint32)
        tokens = np.diff(np.append(np.append(0, np.sort(r.choice(np.arange(1, n), min(n - 1, 5), replace=False))), n)) if n > 1 else np.array([1])
        g = token_output.re_pair(ids, tokens, 10, least=2)
        assert np.array_equal(g.decode(), ids) and (n < 5000 or len(g.body) < n / 2)
        at = np.cumsum(tokens) - tokens
        for k in range(len(tokens)):
            b = int(g.symbols[:k].sum())
            assert np.array_equal(g.decode(b, b + int(g.symbols[k])), ids[at[k] : at[k] + tokens[k]])
    assert np.array_equal(token_output.re_pair(np.full(9, 3, np.uint32), np.array([9]), 10, least=2).decode(), np.full(9, 3))


def test_token_output(docs, nothing):
    from tokenizers import Tokenizer

    js = queries._read(queries.vocabulary("word_bpe_49k.json"))
    t = Tokenizer.from_str(js)
    more = docs.union(docs.sparkSession.createDataFrame([(900 + i, x, "en", "s", 1) for i, x in enumerate(["a <|endoftext|> b<|startoftext|>c", "don't isn't we'll 'S", "Ünïcode,.mixed–dash… “q” 12a3", "ＦＵＬＬ É!x!é"])], SCHEMA))
    shards = token_output.write_shards(more, js, 49_408, shard_tokens=500)
    got = token_output.read_shards(shards).collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in more.collect()), key=lambda x: x[:2])
    want = []
    for known, i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i if known else None, len(ids), zlib.crc32(ids.tobytes())))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter(want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(len(ordered))]
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered] == [r[:2] for r in rows]
    row = shards.orderBy("part", "block").first().asDict()
    whole = token_output.read_grammar(row).decode()
    assert [token_output.token_at(row, p) for p in (0, len(whole) // 2, len(whole) - 1)] == [whole[0], whole[len(whole) // 2], whole[-1]]
    assert np.array_equal(token_output.read_document(row, 0), whole[: row["doc_tokens"][0]])
    assert token_output.read_shards(token_output.write_shards(nothing, js, 49_408)).isEmpty()


def test_unigram_against_brute_force(docs):
    pieces = unigram.load_pieces(queries.vocabulary("piece_bpe_32k.model"))
    e = unigram.UnigramEncoder(pieces)
    ids = {p: i for i, p in enumerate(pieces.raw) if pieces.normal[i]}
    texts = ["the theatre", "É 日本 x", "a  b", "▁ x", "", "tab\tnew\nline", "zzz" * 20, " lead", "x" * 70 + " " + "q" * 60]
    flat, counts = e.encode_texts(pa.array(texts))
    for text, got in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        b = (" " + text).encode() if text else b""
        best = [(0.0, [])] + [(-math.inf, [])] * len(b)
        for s in range(len(b)):
            if best[s][0] == -math.inf or b[s] & 0xC0 == 0x80:
                continue
            char = 1 + (b[s] >= 0xC0) + (b[s] >= 0xE0) + (b[s] >= 0xF0)
            for k in range(s + 1, min(len(b), s + e.longest) + 1):
                i = ids.get(b[s:k])
                if i is not None and best[s][0] + pieces.score[i] > best[k][0]:
                    best[k] = (best[s][0] + pieces.score[i], [*best[s][1], i])
            if b[s : s + char] not in ids and best[s][0] + e.unknown > best[s + char][0]:
                best[s + char] = (best[s][0] + e.unknown, [*best[s][1], *(int(pieces.byte_ids[x]) for x in b[s : s + char])])
        assert got.tolist() == best[len(b)][1]
    back, sizes = e.decode(flat, counts)
    assert back.tobytes().decode() == "".join(texts) and sizes.tolist() == [len(t.encode()) for t in texts]
    rows = unigram.encode_decode(docs, pieces, keep=True).collect()
    assert all(r["round_trip"] for r in rows) and collections.Counter(r["decoded"] for r in rows) == collections.Counter(r["text"] or "" for r in docs.collect())


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer

    js = queries._read(queries.vocabulary("byte_bpe_50k.json"))
    t, c = Tokenizer.from_str(js), token_counts.Counter(js)
    t.encode_special_tokens = True
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    r = random.Random(4)
    for text in ["", "a", "x \n y  ", "don't  stop", "é \n z", *varied(5, 15)]:
        tree = next(c.trees(pa.array([text])))
        for _ in range(8):
            i = r.randint(0, len(text))
            j, new = min(len(text), i + r.choice([0, 1, 5, 40])), r.choice(["", " ", "'s", "\n\n", "é,", " new words", " "])
            tree.edit(len(text[:i].encode()), len(text[i:j].encode()), new.encode())
            text = text[:i] + new + text[j:]
            assert bytes(tree.text).decode() == text and tree.tokens == count(text)
    for row in token_counts.count_with_edits(docs, js).join(docs.where("doc_id > 5").select("doc_id", "text"), "doc_id").collect():
        text = (row["text"] or "").encode()
        after = text
        for at, n, new in token_counts.standing_edits(text):
            after = after[:at] + new + after[at + n :]
        assert (row["n_tokens"], row["n_tokens_edited"]) == (count(text.decode()), count(after.decode()))
    assert token_counts.count_with_edits(nothing, js).isEmpty()


def test_token_tree_keeps_its_leaves_small():
    """Many edits side by side encode as few bytes at the end as at the start."""
    c = token_counts.Counter(queries._read(queries.vocabulary("byte_bpe_50k.json")))
    text = " ".join(f"word{i}" for i in range(5000))
    tree, at, costs = next(c.trees(pa.array([text]))), 20_000, []
    for i in range(400):
        before = tree.encoded_bytes
        tree.edit(at, 0, f" new{i}".encode())
        text, at = text[:at] + f" new{i}" + text[at:], at + len(f" new{i}")
        costs.append(tree.encoded_bytes - before)
    assert max(costs) < 60 and bytes(tree.text).decode() == text and tree.tokens == c.count(text.encode())
    for _ in range(300):
        tree.edit(10_000, 30, b"")
        text = text[:10_000] + text[10_030:]
    assert tree.tokens == c.count(text.encode())


def test_language_needs_a_letter():
    m = language_id.train({"a": ["abab"], "b": ["xyz"]})
    assert m.predict(pa.array(["² ½ ①", "Ⅷ", "٣ ५", "_", "ª", "日", "3a"]))[0][:4] == ["und"] * 4 and "und" not in m.predict(pa.array(["ª", "日", "3a"]))[0]


def test_op4_query(spark, tmp_path):
    """The registered query against the model, applied row by row, and its contract's columns."""
    rows = [(i, ["the old bridge " * 9, "le vieux pont " * 9][i % 2] + str(i), ["en", "fr"][i % 2]) for i in range(60)] + [(60, None, "en"), (61, "12 ½", "fr"), (62, "the bridge", None), (62, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    of = dict((r["doc_id"], r) for r in got)
    assert [of[i]["lang_pred"] for i in (0, 1, 60, 61)] == ["en", "fr", "und", "und"] and all(0 <= r["score"] <= 1 for r in got)
    learn = collections.defaultdict(set)
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 5:
            learn[lang].add(t)
    m = language_id.train({k: sorted(v) for k, v in learn.items()})
    for i, t, _ in rows[:60]:
        (name,), (score,) = m.predict(pa.array([t]))
        assert of[i]["lang_pred"] == name and of[i]["score"] == pytest.approx(score, abs=1e-5)


def test_op2_query(spark, tmp_path):
    """Null and conflicting labels, empty tables and a clashing column; scores as the model gives them to each text."""
    rows = [(i, ("calm river stone " if i % 2 else "buy ### now $$$ ") * 12 + str(i)) for i in range(120)] + [(120, None), (121, ""), (3, "again"), (None, "no id")]
    labels = [(i, i % 2, 0) for i in range(110)] + [(0, 1, 0), (111, None, 0), (None, 1, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 120]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = quality_classifier.sample(docs, marks, ~quality_classifier.held_out(F.col("doc_id"), 4, 2))
    want = {(t, i % 2) for i, t in rows if i is not None and 0 < i < 110 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(zip(texts, y.tolist(), strict=True)) == want and len(texts) == len(want)
    assert len(quality_classifier.sample(docs, marks, F.lit(True), most_bytes=900)[0]) < 8
    model = quality_classifier.train(texts, y)
    clash = docs.withColumn("score", F.lit("x"))
    for r in quality_classifier.score(clash, model).collect():
        assert r["score"] == pytest.approx(model.scores(pa.array([r["text"] or ""]))[0])
    assert quality_classifier.score(docs.limit(0), model).isEmpty()
    assert quality_classifier.sample(docs, marks.limit(0), F.lit(True))[0] == [] and quality_classifier.sample(docs.limit(0), marks, F.lit(True))[0] == []


def test_written_needs_a_shared_folder():
    of = lambda at: types.SimpleNamespace(conf={"spark.checkpoint.dir": at}, sparkContext=types.SimpleNamespace(master="spark://somewhere:7077"))
    assert storage.shared_dir(of("/shared")) == "/shared"
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(of(None))


def test_lm_base_and_distribution(spark, docs, nothing):
    training = docs.where(lm_scoring.in_training(F.col("doc_id")))
    model, counts = lm_scoring.fit(training)
    got = lm_scoring.score(docs, model, counts).collect()
    words = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    c = collections.Counter(w for r in training.collect() for w in words(r["text"]))
    n, v = c.total(), len(c)
    want = sorted((str(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r["text"])), 4)) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want and all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    # After any state the probabilities of all known words and one unknown add up to 1.
    h = np.random.default_rng(0).normal(0, 1, (1, lm_scoring.HIDDEN)).astype(np.float32)
    head = np.arange(model.rest + 1)
    p = np.exp(model.log_probs(np.repeat(h, len(head), 0), head))
    rest = sum(x + 1 for x in c.values()) - sum(int(k) + 1 for k, i in zip(model.known_c, model.known_head, strict=True) if i < model.rest) + 1
    assert p[:-1].sum() + p[-1] * rest / math.exp(model.log_rest) == pytest.approx(1, abs=1e-4)
    # State goes on from window to window.
    numbers, per = np.arange(40) % model.rest, np.array([30, 0, 10])
    assert model.score(numbers, per, 256) == pytest.approx(model.score(numbers, per, 7), rel=1e-5)
    empty, none = lm_scoring.fit(nothing)
    assert all(math.isfinite(r["score"]) for r in lm_scoring.score(docs, empty, none).collect())


def log_prob_by_hand(m, p, words):
    """One document through the network, a token at a time, in the order of its formulas."""
    n, h, before, total = len(p["U"]), np.zeros(len(p["U"])), m.end, 0.0
    share = lambda s, i: s[i] - np.log(np.exp(s).sum())
    for w in [*words, m.end]:
        x, a = p["E"][before] @ p["X"] + p["x"], h @ p["U"]
        z, r = (1 / (1 + np.exp(-(x[i : i + n] + a[i : i + n]))) for i in (0, n))
        h = h + z * (np.tanh(x[2 * n :] + r * a[2 * n :]) - h)
        k = m.class_of[w]
        total += share(h @ p["C"] + p["c"], k)
        if w < m.rest:
            lo, hi = m.first[k], [*m.first, m.rest][k + 1]
            total += share(h @ p["W"][:, lo:hi] + p["w"][lo:hi], w - lo)
        before = w
    return total


def test_lm_network_by_hand():
    r, h, d = np.random.default_rng(5), 5, 3
    f = lambda *s: r.normal(0, 0.7, s).astype(np.float32)
    p = {"E": f(7, d), "X": f(d, 3 * h), "x": f(3 * h), "U": f(h, 3 * h), "C": f(h, 4), "c": f(4), "W": f(h, 6), "w": f(6)}
    m = lm_scoring.Model(0, 0, np.arange(6), np.ones(6, np.int64), np.arange(6), 6, 4, np.array([0, 0, 0, 1, 1, 2, 3]), np.array([0, 3, 5]), 0.0, {k: v.copy() for k, v in p.items()})
    wide = {k: v.astype(np.float64) for k, v in p.items()}
    texts = [r.integers(0, 7, n) for n in (0, 9, 1, 0, 30, 9, 4)]
    want = [log_prob_by_hand(m, wide, t) for t in texts]
    for window in (1, 7, 256):
        assert m.score(np.concatenate(texts), np.array([len(t) for t in texts]), window) == pytest.approx(want, rel=1e-4)
    assert m.score(np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []
    # Adam's first step goes against the sign of each slope; two documents in one lane, within one window.
    rate = 0.001
    losses = lm_scoring.train(m, texts[1:3], lanes=1, steps=32, rate=rate)
    loss = lambda: -sum(log_prob_by_hand(m, wide, t) for t in texts[1:3])
    assert losses == [pytest.approx(loss() / 12, rel=1e-4)]
    for k, values in wide.items():
        for i in np.ndindex(*values.shape):
            at, ends = values[i], []
            for values[i] in (at + 1e-4, at - 1e-4):
                ends.append(loss())
            values[i] = at
            slope = (ends[0] - ends[1]) / 2e-4
            if abs(slope) > 1e-3:
                assert m.p[k][i] - p[k][i] == pytest.approx(-rate * np.sign(slope), rel=0.02), (k, i)


def test_lm_keys_are_found():
    r = np.random.default_rng(2)
    for n in (1, 2, 5000):
        known = np.unique(r.integers(-1 << 63, (1 << 63) - 1, n))
        known = np.unique(np.concatenate([known, known[:1] + np.arange(1, 4), [-1]]))
        m = lm_scoring.Model(0, 0, known, np.arange(len(known)), np.minimum(np.arange(len(known)), 3), 3, 0, np.zeros(4, np.int64), np.array([0]), 0.0, {})
        words = np.concatenate([known, known + 1, [np.iinfo(np.int64).min, np.iinfo(np.int64).max]])
        place = {k: i for i, k in enumerate(known.tolist())}
        numbers, c = m.numbers(words)
        assert c.tolist() == [place.get(w, -1) for w in words.tolist()] and numbers.tolist() == [min(place.get(w, 3), 3) for w in words.tolist()]


def test_lm_learns():
    m = lm_scoring.Model(0, 0, np.arange(3), np.ones(3, np.int64), np.arange(3), 3, 2, np.array([0, 0, 0, 1]), np.array([0]), 0.0, {})
    r, h, d = np.random.default_rng(0), 8, 4
    f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
    m.p = {"E": f(4, d), "X": f(d, 3 * h), "x": np.zeros(3 * h, np.float32), "U": f(h, 3 * h), "C": np.zeros((h, 2), np.float32), "c": np.zeros(2, np.float32), "W": np.zeros((h, 3), np.float32), "w": np.zeros(3, np.float32)}
    losses = lm_scoring.train(m, [np.arange(60) % 2] * 60, lanes=4, steps=8, rate=0.02)
    assert np.mean(losses[-5:]) < 0.4 * np.mean(losses[:5])


def test_lm_lanes_end_together():
    """Training takes about as many windows as its tokens fill: few lanes are left to run alone at the end."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, 3, n) for n in r.integers(1, 200, 300)]
    h, d = 4, 3
    f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
    p = {"E": f(4, d), "X": f(d, 3 * h), "x": f(3 * h), "U": f(h, 3 * h), "C": f(h, 2), "c": f(2), "W": f(h, 3), "w": f(3)}
    m = lm_scoring.Model(0, 0, np.arange(3), np.ones(3, np.int64), np.arange(3), 3, 2, np.array([0, 0, 0, 1]), np.array([0]), 0.0, p)
    assert len(lm_scoring.train(m, docs, lanes=16, steps=8, piece=150)) <= -(-sum(len(x) + 1 for x in docs) // (16 * 8)) + 1


def test_word_hashes_tell_words_apart():
    r = np.random.default_rng(4)
    words = [b"a" * n for n in range(1, 150)] + [b"a\0", b"a\0\0", b"\0"] + [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in r.integers(1, 140, 500)]
    for blank in (b" ", b"   "):  # wherever they stand
        data = np.frombuffer(blank.join([*words, *words]), np.uint8)
        begin, end, _ = spans.words(data, np.array([0, len(data)]))
        for block in (7, 1 << 15):
            got = spans.word_hashes(data, begin, end, block=block).tolist()
            assert got[: len(words)] == got[len(words) :] and len(set(got)) == len(set(words))


def test_lm_learns_from_every_row(spark):
    # No text fits into the sample that the network starts from, so all it knows of order comes from the other rows.
    long = [(i, "ab cd ef gh " * 3000 + f"n{i}") for i in range(24)]
    docs = spark.createDataFrame(long, "doc_id bigint, text string")
    model, counts = lm_scoring.fit(docs)
    for row in lm_scoring.score(docs, model, counts).collect():
        assert row["score"] > 0.5 * row["base_score"]
    # Nor does it depend on how the rows lie in partitions.
    again, _ = lm_scoring.fit(docs.repartition(5))
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-6) for k in model.p)


def test_lm_tasks_add_their_copies_up(spark, monkeypatch):
    """One task that trains all copies gives what as many tasks do, up to how rows fall into copies; and the rows of texts aren't one key."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(40))) for i in range(60)], "doc_id bigint, text string")
    model = lm_scoring.build(lm_scoring.count_words(docs, "text"))
    monkeypatch.setattr(lm_scoring, "TASKS", 1)
    one = lm_scoring.learned(docs, model, shard=300)
    monkeypatch.setattr(lm_scoring, "TASKS", 9)
    many = lm_scoring.learned(docs, model, shard=300)
    assert all(np.isfinite(v).all() for p in (one, many) for v in p.values())
    changed = {k for k, v in one.items() if not np.array_equal(v, model.p[k])}
    assert changed and changed == {k for k, v in many.items() if not np.array_equal(v, model.p[k])}
    assert all(np.abs(v - many[k]).mean() < 0.1 for k, v in one.items())


def test_lm_head_grows(spark):
    counts = spark.range(4_000_000).select(F.when(F.col("id") == 0, lm_scoring.END).otherwise(F.col("id")).alias("word"), F.when(F.col("id") < 9000, F.lit(3)).otherwise(F.lit(1)).cast("long").alias("c"))
    assert lm_scoring.build(counts).rest == 4000


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_pipeline(spark):
    """Against the stages' decisions, taken one after the other by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in rule_ledger.ledger(docs).where(rule_ledger.passes(rule_ledger.POLICIES["standard"])).collect()}
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~quality_classifier.held_out(F.col("doc_id"), 4, 2))
    ids = sorted(kept)
    ids = [i for i, s in zip(ids, model.scores(pa.array([kept[i] for i in ids])), strict=True) if s >= 0.7]
    ids = sorted({c for _, _, c in brute_components([(i, kept[i]) for i in ids])})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = [i for i in ids if brute_hits(kept[i], items)[1] == 0]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == ids and all(r["round_trip"] for r in got)


def test_pipeline_with_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {"n_words": F.lit(1), "score": F.lit("s"), "label": F.lit(None).cast("int"), "kept": F.lit(True), "_text": F.lit(0)}
    odd = spark.createDataFrame([(None, "no id " * 40, None, None, None), (5000, None, "en", "s", 0), (5001, "", None, None, None), (None, None, None, None, None)], SCHEMA)
    rows = docs.union(docs.where("doc_id < 40")).union(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 9000)).union(odd.select(*docs.columns)).withColumns(extra)
    rows.write.parquet(f"{tmp_path}/some/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        for d in ("some", "none"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{d}/{t}.parquet")
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect())
    before = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert not {i for i in got if i is not None and i >= 5000} and all(got[i] == 2 for i in before if i < 40 and i in got)
    assert len(before & set(got)) > 0.9 * len(before)  # the classifier has learned from more rows
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
