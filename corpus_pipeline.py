"""A training corpus from `documents`: language ID, near-dedup, substring dedup, decontamination, tokens.

Each stage takes what the one before it kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqscan.llm import ppm_langid, rank_bpe, simhash, spaced_seeds, suffix_dedup
from dqscan.llm.common import spool, table
from dqscan.llm.queries import tokenizer_path

#: Bits a byte from which a text is in none of the known languages; equal odds for all bytes cost 8.
FOREIGN_BITS = 7.0


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that even their likeliest language hardly predicts.

    Null and empty texts have no letter and go; rows of a null lang teach nothing and are judged like
    any other, as are repeated rows; texts of any length are judged whole; columns of any name come
    back as they were.
    """
    out = _fresh(docs, "language")
    found = ppm_langid.predict(docs, ppm_langid.train(docs), out=out)
    return found.where((F.col(out)["lang_pred"] != "und") & (F.col(out)["bits_per_byte"] < FOREIGN_BITS)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies, that of the smallest doc_id.

    Copies are those that SimHash fingerprints of their different words bring together and those of
    their shingles of five words confirm, at a similarity of 0.8 of the bits. Null, empty and blank
    texts are copies of each other; a null doc_id counts as larger than any other; of rows that share
    the id one stays, the first by a hash of its columns.
    """
    return simhash.one_of_each(docs, groups=simhash.near_copies)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 100 bytes that occur earlier; documents of which nothing is left go, and n_chars follows.

    Null, empty and short texts stay as they are; rows that share an id count as one document; a null
    id comes first; other columns, of whatever name, stay as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(F.col("text").isNull().alias("0"), *[F.col(f"`{c}`") for c in others]).alias("others")
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", carried), carry=("others",)).where("n_removed = 0 or length(kept_text) > 0")
    values = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("others")["0"], F.col("kept_text"))}
    length = F.when(F.col("n_removed") > 0, F.length("kept_text"))
    values |= {c: F.coalesce(length.cast(docs.schema[c].dataType), F.col("others")[c]) if c == "n_chars" else F.col("others")[c] for c in others}
    return cut.select(*[values[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item.

    Null and empty texts and items overlap nothing; rows that share an id go together; an empty
    benchmark drops nothing; columns of any name come back as they were.
    """
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of every text, the text decoded from them, and digests of both; null and empty texts have none."""
    return rank_bpe.encode_decode(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("decontamination", decontaminate), ("bpe_tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None
