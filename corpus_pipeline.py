"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, secret scans, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages work row by row but for the near-duplicate one, so repeated rows are
treated alike there; extra columns, whatever their names, are kept up to the last stage; an empty table passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.common import exists, remove, scratch_root, scratch_scope
from stratalith.llm.decontaminate import decontaminate
from stratalith.llm.jaccard_join import keep_first
from stratalith.llm.langid import keep_identified, learn_dictionaries, training_rows
from stratalith.llm.secrets import redact_secrets
from stratalith.llm.sentencepieces import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those whose two best languages are too close, ties above all."""
    return keep_identified(docs, learn_dictionaries(training_rows(docs)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of copies and near copies (five-word shingles, Jaccard 0.8 or more); texts without words are in no group, rows of one id stay or go together."""
    return keep_first(docs, n=5, threshold="4/5")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window; a null text or item holds none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in its text are replaced and n_chars follows. Null stays null."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digest of what they decode to; null as the empty text. One row for each row."""
    return encode_documents(docs, decoded=True)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Compression sizes and subword ids can't be told in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared scratch folder and read again.

    A stage's result is deleted once the next one is written. With a `run_id`, a run that failed goes on behind its last whole stage
    (same stages and tables assumed).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark).rstrip('/')}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{root}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k in range(len(STAGES) - 1) if exists(spark, f"{paths[k]}/_SUCCESS")), default=-1)
    if done >= 0:
        docs = spark.read.parquet(paths[done])
    for k in range(done + 1, len(STAGES) - 1):
        with scratch_scope():
            STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            remove(spark, paths[k - 1])
    return STAGES[-1][1](spark, docs, sf_dir)
