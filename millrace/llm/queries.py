"""The registered queries of this subpackage and their SQL.

Each query applies its operator, with production parameters, to its whole table; the SQL
is DuckDB's, where SQL can express the result at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, filter_audit, language_id, lm_scoring, ngram_join, phrase_automata, quality_classifier, rule_ledger, sharding, token_counts, token_output, unigram, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontamination.decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; they are not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_classifier.held_out(F.col("doc_id"), 4, 2)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality_classifier.held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = token_output.write_shards(docs, _read(vocabulary("word_bpe_49k.json")), base=49_408)
    return token_output.read_shards(shards)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = lm_scoring.in_training(F.col("doc_id"))
    model, counts = lm_scoring.fit(docs.where(training))
    return lm_scoring.score(docs, model, counts).select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), rule_ledger.POLICIES["standard"])
    base_failed = ~rule_ledger.passes(rule_ledger.POLICIES["base"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failures")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.encode_decode(docs, unigram.load_pieces(vocabulary("piece_bpe_32k.model")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"), _read(vocabulary("byte_bpe_50k.json")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_automata.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = vector_codes.with_label_error(out.rows)
    return rows.select(F.col("id").alias("vec_id"), vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(out.fingerprint()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM i),
p AS (SELECT doc_id, k, s, array_to_string(ws[s : s + k - 1], ' ') AS w
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, s, p.k, item_id FROM p JOIN i ON p.w = i.w AND p.k = i.k),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op3_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS label FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.label = e.a),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(label, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = node""",
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, s, hash(ws[s], ws[s + 1], ws[s + 2]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS s FROM d)),
r AS (SELECT doc_id, s FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS x FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_cap,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ell,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09]'))) AS n_bul
      FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
             + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT) + 16 * CAST(10 * n_excl > n_words AS BIGINT) + 32 * CAST(2 * n_cap > word_chars AS BIGINT)
             + 64 * CAST(word_chars > 20 * n_words OR word_chars < 2 * n_words AS BIGINT) + 128 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
             + 256 * CAST(10 * n_ell > 3 * n_lines AS BIGINT) + 512 * CAST(10 * n_bul > 9 * n_lines AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 375) = 0 AS kept, failures FROM f""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS m FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY part, m),
x AS (SELECT substr('ABCDE', i + 1, 1) AS x, 1 << i AS bit FROM (SELECT CAST(unnest(range(5)) AS INT) AS i)),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS ls, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(ls, '') AS filter_order, k AS step, ls[k] AS own, bs[k] AS bit, coalesce(list_sum(bs[1 : k - 1]), 0) AS before FROM (SELECT *, CAST(unnest(range(1, 6)) AS INT) AS k FROM o)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN t ELSE 0 END) AS toxic_lost
      FROM (SELECT part, m, n, g, t, filter_order, step, own, bit, CAST(before AS INT) AS before FROM c, s) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}


def _vector_codes_sql(rounds: int = 6) -> str:
    """Each round as two tables: `a`, the parts with 16 * squared distance + index of their nearest entry, and `c`, the entries."""

    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT i, p.pos, any_value(p.part) AS part,
 min(16 * CAST(list_sum([(p.part[j] - c.part[j]) * (p.part[j] - c.part[j]) for j in range(1, len(p.part) + 1)]) AS BIGINT) + e) AS best FROM p JOIN c{k} c ON p.pos = c.pos GROUP BY i, p.pos)"""

    steps = [nearest(0)]
    for k in range(1, rounds + 1):
        steps.append(f"""n{k} AS (SELECT pos, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS part
 FROM (SELECT pos, best % 16 AS e, j, CAST(sum(part[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM a{k - 1}) GROUP BY pos, best % 16, j) GROUP BY pos, e),
c{k} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(n.part, c.part) AS part FROM c{k - 1} c LEFT JOIN n{k} n ON c.pos = n.pos AND c.e = n.e)""")
        steps.append(nearest(k))
    return f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, vec_id, label, pos, x[pos * (len(x) // 8) + 1 : (pos + 1) * (len(x) // 8)] AS part FROM (SELECT *, unnest(range(8)) AS pos FROM v)),
c0 AS MATERIALIZED (SELECT pos, r - 1 AS e, part FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY vec_id, i) AS r FROM p) WHERE r <= 16),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c{rounds}),
s AS (SELECT i, string_agg(printf('%02x', best % 16), '' ORDER BY pos) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN s USING (i), h"""


ORACLE_SQL["op12_phrase_automata"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM w JOIN f USING (h) WHERE first < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [w for w, i in ws if NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""
ORACLE_SQL["op13_vector_codes"] = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
