"""The cleaning flow on hand-made sources, and its files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning, corpus, records
from millrace.sources import readers

LONG = "please explain how rivers carve valleys over very long stretches of time, in detail and with examples"
MARK = "what is the capital of the country that lies north of spain and west of switzerland, and why"


def encode(rows):
    tokens = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))
    return rows.withColumns({"input_ids": tokens(F.array_join(F.transform("messages", lambda m: m["content"]), " ")), "target_ids": tokens(F.col("reference_answer"))})


def chat(spark, *rows):
    """rows: (hash, place, (role, text)...)"""
    data = [(h, [(r, t, False, False) for r, t in ms], "English", "m", 1, False, False, p) for h, p, *ms in rows]
    return spark.createDataFrame(data, readers.SCHEMAS["chat"] + ", place bigint")


@pytest.fixture
def marks(spark):
    return corpus.fingerprints(spark.createDataFrame([(MARK,)], "c string"), "c")


def test_benchmark_overlap_is_by_message_and_only_in_the_prompt(spark, marks):
    half = len(MARK) // 2
    ask = lambda *texts: [(("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    raw = chat(
        spark, ("in_last", 0, *ask("a", "b", f"So: {MARK.upper()}?", "d")), ("in_reference", 1, *ask("a", MARK)), ("across", 2, *ask("a", MARK[:half], MARK[half:], "d")),
        ("in_answer_before", 3, *ask("a", f"x{MARK}", "c", "d")), ("bad", 4, ("user", MARK)),
    )
    got = {r["source_id"]: r for r in records.records(raw, "chat", marks, keep=("place",)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "in_last": "benchmark_question_overlap", "in_reference": None, "across": None, "in_answer_before": "benchmark_question_overlap", "bad": "invalid_role_sequence",
    }
    assert all((r["id"] is None) == (r["reason"] is not None) == (r["prompt_hash"] is None) == (r["max_new_tokens"] is None) for r in got.values())
    assert got["in_reference"]["max_new_tokens"] == 2048 and got["in_reference"]["place"] == 1


@pytest.fixture
def cleaned(spark, marks):
    turns = lambda q, a="an answer": [("user", q), ("assistant", a)]
    sources = {
        "chat": chat(
            spark, ("h1", 5, *turns(LONG)), ("h2", 2, *turns(f"  {LONG.upper()} ", "another")), ("h3", 3, *turns(LONG), *turns("and more")), ("h4", 4, *turns("short")), ("h5", 6, *turns(MARK)),
            ("h6", 7, *turns("x " * 9000)), ("h7", 8, *turns("q", "y " * 3000)), ("h8", 9, ("user", "q"), ("assistant", None)),
        ),
        "math": spark.createDataFrame([("m1", "How much is 1 + 1?", "2 #### 2", 0), ("m2", "short", "#### 1", 1), ("m3", None, "x", 2)], "source_id string, question string, answer string, place bigint"),
        "code": spark.createDataFrame([("p1", "s1", "seed", 1, "python", 0), ("p2", "s2", "seed", 2, None, 1), ("p2", "s3", None, 3, "c", 2)], readers.SCHEMAS["code"] + ", place bigint"),
        "long": spark.createDataFrame([([("user", LONG * 3), ("assistant", "ok")], "l1", 7, 0), (None, "l2", 1, 1)], readers.SCHEMAS["long"] + ", place bigint"),
    }
    return cleaning.clean(sources, marks, encode, end=7, quotas={"chat": 1, "math": 5, "code": 1, "long": 0})


def test_clean(cleaned):
    rows = {r["id"].rsplit(":", 1)[0]: r for r in cleaned.records.collect()}
    chat_, code = "WildChat-1M", "Magicoder-OSS-Instruct-75K"
    # h2 comes before h1, which is its duplicate; the short prompt of math is that of a conversation.
    assert set(rows) == {f"{chat_}:h2", f"{chat_}:h3", f"{chat_}:h4", "gsm8k:m1", f"{code}:1", f"{code}:2", "LongAlign-10k:l1"}
    # Duplicates and long first turns tie groups together; seeds do as well.
    assert rows[f"{chat_}:h2"]["group_id"] == rows[f"{chat_}:h3"]["group_id"] != rows[f"{chat_}:h4"]["group_id"]
    assert rows[f"{code}:1"]["group_id"] == rows[f"{code}:2"]["group_id"]
    assert all(r["target_ids"][-1] == 7 and r["target_tokens"] == len(r["target_ids"]) for r in rows.values())
    assert rows[f"{code}:2"]["stratum"] == "English|0-512" and rows[f"{code}:1"]["stratum"] == "python|0-512"
    for r in rows.values():
        n = int(hashlib.sha256(f"42:{r['group_id']}".encode()).hexdigest()[:16], 16) % 100
        assert r["split"] == ("train" if n < 90 else "valid" if n < 95 else "test")
    counters = {r["source"]: (r["scanned"], r["accepted"], r["rejected"]) for r in cleaned.counters.collect()}
    assert counters == {chat_: (8, 3, 5), "gsm8k": (3, 1, 2), code: (3, 2, 1), "LongAlign-10k": (2, 1, 1)}
    reasons = {(r["source"], r["reason"]): r["n"] for r in cleaned.reasons.collect()}
    assert reasons == {
        (chat_, "duplicate_normalized_prompt"): 1, (chat_, "benchmark_question_overlap"): 1, (chat_, "prompt_over_8192"): 1, (chat_, "reference_over_generation_budget"): 1,
        (chat_, "invalid_role_or_nontext"): 1, ("gsm8k", "duplicate_normalized_prompt"): 1, ("gsm8k", "invalid_record"): 1, (code, "duplicate_normalized_prompt"): 1,
        ("LongAlign-10k", "invalid_record"): 1,
    }


def test_files_and_manifest(spark, cleaned, tmp_path):
    at = str(tmp_path / "v1")
    manifest = cleaning.write(cleaned, at, {"purpose": "test"})
    assert manifest == json.loads(spark.read.text(f"{at}/manifest").first()["value"])
    full = spark.read.parquet(f"{at}/full").groupBy("source", "split").count().collect()
    assert sorted((r["source"], r["split"], r["count"]) for r in full) == sorted((r["source"], r["split"], r["n"]) for r in manifest["full_split_counts"])
    starter = {}
    for r in manifest["starter_split_counts"]:
        starter[r["source"]] = max(starter.get(r["source"], 0), r["n"])
    assert starter["WildChat-1M"] == 1 and starter["gsm8k"] == 1 and "LongAlign-10k" not in starter
    assert {f["path"].split("v1/")[1].split("/")[0] for f in manifest["files"]} == {"full", "starter"}
    with pytest.raises(Exception, match="(?i)exist"):
        cleaning.write(cleaned, at, {})


def test_of_nothing(spark, marks):
    out = cleaning.clean({"math": spark.createDataFrame([], "source_id string, question string, answer string, place bigint")}, marks, encode)
    assert out.records.count() == out.starter.count() == out.counters.count() == out.reasons.count() == 0
