"""From raw documents to token files: five stages, each on all that the one before it kept.

`documents` has doc_id, text, lang, source and n_chars, and may have more columns; all are kept
up to the last stage. A row's key is its doc_id and the hash of its text, so null or repeated
ids are no hindrance: rows that agree in both are copies of each other and share a fate.
"""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import language, leaks, mixing, similar, token_files
from vigil.llm.rows import without
from vigil.llm.store import staged, table
from vigil.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: Near copies: shingles of five words, at least 80 of 100 shared.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80

#: Model scores decide the first stage, so SQL cannot express run().
ORACLE_SQL = None


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("text")).alias("text"))


def _events(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("id"), F.col("text").alias("content"), F.col("lang").alias("lang"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the model rejects go.

    The model learns from the documents that have a `lang`. Texts that are null, empty or
    without any letter are rejected. No documents give no documents.
    """
    named = docs.select(F.xxhash64("doc_id", "text").alias("id"), F.col("text").alias("content"), "lang")
    model = language.fit_language(named)
    found = language.predict_language(_events(docs), model)
    return without(docs, _key(), found.where("rejected").select("id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar word shingles hold together: the smallest key.

    Of rows that repeat one stays; documents without words are in no group.
    """
    grouped = staged(similar.link_similar(_events(docs), SHINGLE_WORDS, SIMILAR_PERCENT), "pipeline-groups")
    gone = grouped.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id")
    repeated = grouped.where("n_shingles > 0").groupBy("id").count().where("count > 1").select("id")
    return without(docs, _key(), gone, repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no `benchmark` text, whole or in reordered passages."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("scenario"), F.col("text").alias("details"))
    return without(docs, _key(), leaks.leaked_cases(_events(docs), cases).select("id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; a null source is the last one."""
    events = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.col("text").alias("content"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    return mixing.taken_events(mixing.mix_domains(events)).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all texts in order of doc_id, and from them doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "pipeline-tokens")
    mails = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    token_files.write_tokens(mails, path, public_tokenizers.path(TOKENIZER))
    read = token_files.read_tokens(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), T.LongType())
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("found").alias("ids_crc32"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
