"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, then BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A
stage works on everything that the one before kept. Between the stages of `run` the rows are written to the shared
checkpoint folder, so a lost executor costs at most one stage. Null and empty texts pass every filter; they are
their own near-duplicate group and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import bpe, decontamination, ngram_join, pii, toxicity
from tesselon.llm.queries import tokenizer_path
from tesselon.llm.textcore import checkpointed, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(docs, report=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymize),
    ("bpe", encode),
]

#: SQL cannot express the classifier, the alignment, the pseudonyms and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
