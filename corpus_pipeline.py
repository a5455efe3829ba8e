"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, token files.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. ``run`` applies them to the documents table.

Stages decide row by row: rows that share a doc_id, or have none, are told apart by their texts and other columns.
Empty tables pass through as empty tables, and columns beyond those of documents are kept but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbeam.llm import decontam, langid, mixing, rans, simhash
from railbeam.llm.common import new_path, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: null texts, texts without a letter, and uncertain ones.

    The model learns from a bounded sample of the documents' own ``lang``.
    """
    model = langid.fit(docs, F.lit(True), "doc_id", "text", "lang")
    return langid.accepted(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text, source, row): rows that differ in anything have keys of their own, ordered by doc_id, null last."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.sha2("text", 256).alias("text"), F.xxhash64(*docs.columns).alias("rest"))
    return docs.select(key.alias("key"), "text", "source", F.struct(*docs.columns).alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, and of different rows with it the smallest text hash."""
    rows = _keyed(docs)
    groups = simhash.near_duplicates(rows, doc_id="key", shingle_words=3, max_bits=2)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark passage, exact or edited, go."""
    rows = _keyed(docs)
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: some not at all, none over three times."""
    rows = _keyed(docs)
    return mixing.repeated(rows, mixing.mix(rows, doc_id="key", weights=(5, 2, 1), max_copies=3), doc_id="key").select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens and ids_crc32 of each document and copy."""
    path = new_path(spark, "pipeline-token-files")
    rans.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rans.read_digests(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: A trained model, hashes of shingles, Newton steps and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
