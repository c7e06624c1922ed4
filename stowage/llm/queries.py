"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, knn, langid, linededup, lm, mixing, secrets, setsketch, syncmers, toxicity
from .common import cut, n_words, stored, table
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries", "tokenizer_path"]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("__size")))
    mixed = mixing.mix(sized, source="source", size="__size")
    return mixing.in_order(mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), path or tokenizer_path(), keep=["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.top_k(vectors, F.col("vec_id") % 100 == 0)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda p: p["k"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "weak"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(secrets.written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), secrets.written(every).alias("spans"), F.size("weak").cast("long").alias("n_weak"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    kept = linededup.drop_boilerplate(stored(pages))  # the HTML is parsed once
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, net, ["doc_id"])
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_bpe, op3_top_k, op4_secrets, op5_language_id, op6_line_dedup, op7_toxicity, op8_lm_score, op9_near_duplicates, op10_fingerprints)}
