"""The corpus pipeline: five stages of the llm operators over whole documents.

Each stage takes what its predecessor kept, and all but the last return the columns of
``documents``.  Nulls, empty tables and odd columns have the results that the operators define:
a document without a letter or in no learned language is rejected by the first stage, a document with a null id is never a
near duplicate, and texts are changed by the secret scan alone.  Repeated rows are copies: those of one id are one node and
stay together, of equal texts under several ids the least id stays.  Texts of any length go through every stage whole.

Near duplicates are those of five-word shingles here, which is the rule for a pipeline's stages; the query of the operator alone has
a contract of its own, with four words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, near_dup, pieces, secrets
from ledgerloom.llm.common import delete_folder, fresh_folder
from ledgerloom.session import ship

#: A document goes if it has no letter, if every language's classifier clearly disowns it, or if too many of its n-grams are
#: in no learned text (``language.keep_known``): clean texts of a few words score 0.45, foreign ones up to 0.8, so no score tells them apart.
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the kernel classifier knows."""
    model = language.learn(docs, docs)
    return language.keep_known(docs, model, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dup.drop_duplicates(docs, near_dup.NearDupConfig(words=5))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with begin and end, and what they decode to."""
    encoded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The classifier, the factorisation and the piece merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    ship(spark)
    folder = fresh_folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            delete_folder(spark, before)
        before = path
    return docs
