"""Corpus pipeline: documents through STAGES in order, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, so what a stage decides shows in the rows that it keeps.

Defined results: a null text is the empty one, has too few words and goes with the first stage; rows with equal ids are judged each by its text;
of equal and near-equal texts that of the smallest id stays, under one id that of the smallest hash, and equal rows stay together; a document without
an id is no copy of any other.  A null in another column changes nothing.  An empty table gives an empty result at every stage.  Columns besides doc_id and text are passed on as they are, whatever
their names, and play no part; the last stage returns only doc_id and its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, ngram_join, quality_classifier, rule_ledger, unigram
from millrace.llm.queries import table, vocabulary
from millrace.llm.storage import written

#: The classifier, components and Viterbi paths can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy of the rule ledger."""
    kept = rule_ledger.passes(rule_ledger.POLICIES["standard"])
    return rule_ledger.ledger(docs).where(kept).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, which learns from the labelled ones that it may see, takes for good (0.7 or more)."""
    learn = ~quality_classifier.held_out(F.col("doc_id"), 4, 2)
    source = table(spark, sf_dir, "documents").select("doc_id", "text")  # rejected ones teach what to reject
    model = quality_classifier.fit(source, table(spark, sf_dir, "labels"), learn)
    return quality_classifier.score(docs, model, into="_score").where("_score >= 0.7").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of links."""
    return ngram_join.representatives(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts and checksum of the pieces, and whether they decode to the text again."""
    return unigram.encode_decode(docs.select("doc_id", "text"), unigram.load_pieces(vocabulary("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
