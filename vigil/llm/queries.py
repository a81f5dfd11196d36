"""The registered queries of this subpackage: thin steps from the given tables to the operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import chat, language, leaks, mixing, nearest, periodic, repeats, secrets, similar, spelling, token_files, topk, toxicity
from vigil.llm.oracles import ORACLES  # noqa: F401
from vigil.llm.store import staged, table
from vigil.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as event contents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query
def op1_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    windows = table(spark, sf, "embeddings").where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("user_key"), F.lit("1970-01-01").cast("date").alias("end_day"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("features"),
    )
    near = topk.nearest_windows(windows.where(F.col("user_key") % 50 == 0), windows, 5)
    return near.select(
        F.col("user_key").alias("query_id"), "rank", F.col("near_user_key").alias("vec_id"), "score"
    )


@query
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("scenario"), F.col("text").alias("details"))
    leaked = leaks.leaked_cases(contents(spark, sf), cases)
    return leaked.withColumnsRenamed({"id": "doc_id", "scenario": "item_id"})


@query
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.col("text").alias("content")
    )
    mixed = mixing.mix_domains(docs)
    return mixed.select(
        F.col("id").alias("doc_id"), F.col("n_words").alias("size"), F.col("domain_words").alias("source_size"),
        "target", F.col("words_taken").alias("taken"),
    )


@query
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("user_key"),
        F.concat_ws("/", "source", "lang").alias("pc"), F.col("text").alias("content"),
    )
    return secrets.scan_secrets(docs).withColumnRenamed("id", "doc_id")


@query
def op5_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similar.link_similar(contents(spark, sf)).withColumnRenamed("id", "doc_id")


def remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = contents(spark, sf)
    learned = table(spark, sf, "labels").where(remainder(5) != 0)
    model = toxicity.fit_toxicity(docs, learned.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    scored = toxicity.score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    named = lambda df: df.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    model = language.fit_language(named(docs.where(remainder(4) != 2)))
    found = language.predict_language(named(docs), model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(contents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"))
    read = token_files.read_tokens(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), T.LongType())
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("found").alias("ids_crc32"))


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = repeats.remove_repeats(contents(spark, sf))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("content", 256).alias("kept_sha256"))


@query
def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    kinds = "id long, timestamp long, activity string, content string"
    mails = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("timestamp"),
        F.col("role").alias("activity"), F.col("text").alias("content"),
    )
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], kinds)
    examples = staged(chat.format_threads(mails.unionByName(planted)), "chat-examples")
    threads = chat.read_threads(examples)
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["activity"], F.lit("\n"), t["content"], F.lit("\n"))), ""
    )
    loss = F.array_join("trained", "")
    return threads.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, h = F.size(words), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    period = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), period), F.lit(1), n), " ")
    mails = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("content")
    )
    found = periodic.collapse_runs(mails)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"] / r["period"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")
    )))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("content", 256).alias("collapsed_sha256"),
    )


@query
def op12_near_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    windows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("user_key"), F.lit("1970-01-01").cast("date").alias("end_day"), F.col("embedding").alias("features")
    )
    near = nearest.near_windows(windows.where(F.col("user_key") % 100 == 0), windows, 10)
    return near.select(
        F.col("user_key").alias("query_id"), "rank", F.col("near_user_key").alias("vec_id"), F.col("distance").alias("score")
    )


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.content_words(contents(spark, sf))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "word"))
    at = (h % F.char_length("word")).cast("int")
    slip = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return spelling.spelling_variants(words.select(F.when(h % 97 == 0, slip).otherwise(F.col("word")).alias("word")))
