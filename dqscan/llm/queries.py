"""The queries over the corpus operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_quotes, ppm_langid, rank_bpe, simhash, spaced_seeds, suffix_dedup, toxicity, url_filter, window_dedup, winnow
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = ppm_langid.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(*toxicity.labelled_sample(docs, labels.where(~out)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.conversations(table(spark, sf_dir, "conversations"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ppm_langid.held_out(F.col("doc_id"), 4, 2)
    model = ppm_langid.train(docs.where(~out))
    return ppm_langid.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "language.*")


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    made = {
        "op1_suffix_dedup": suffix_dedup, "op2_simhash": simhash, "op4_url_filter": url_filter, "op5_chat_quotes": chat_quotes, "op7_window_dedup": window_dedup, "op9_winnowing": winnow, "op10_decontaminate": spaced_seeds,
    }
    return {name: module.oracle() for name, module in made.items()}
