"""The pipeline on a small folder of tables, held against brute force of its stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dqscan.llm import queries

from .test_dedup import brute_bytes, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, item = text(70), text(25)
    docs = [(i, text(120), "en", "s", 0) for i in range(30)]
    docs += [(40, docs[3][1], "en", "s", 0), (41, text(50) + " " + shared, "en", "s", 0), (42, text(60) + " " + shared, "en", "s", 0), (43, text(30) + " " + item + " " + text(30), "en", "s", 0)]
    docs += [(44, None, "en", "s", 0), (45, "123 !!", None, "s", 0), (46, "", None, None, None)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs


def test_stages(spark, folder):
    d, docs = folder
    left = [(r[0], r[1]) for r in docs if r[1] and any(c.isalpha() for c in r[1])]
    components = brute_components(left)
    left = [(k, t) for k, t in left if components[k][1] == k]
    cut = brute_bytes(left)
    want = {k: v[3] for k, v in cut.items() if v[0] > v[1] and k != 43}
    got = {r["doc_id"]: r["decoded"] for r in corpus_pipeline.run(spark, d).collect()}
    assert {k: hashlib.sha256(t.encode()).hexdigest() for k, t in got.items()} == want
    assert 40 not in got and got[42] != dict(left)[42]


def test_stages_keep_the_columns(spark, folder):
    """Also columns that are named as what an operator adds or works with."""
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name in ("score", "language", "lang_pred", "n_removed", "kept_text", "id", "extra", "fp", "fingerprint", "component_id", "hits", "doc", "item_id", "block", "data", "row", "others", "h", "k", "__bad"):
        docs = docs.withColumn(name, F.concat(F.lit(name), "doc_id"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.repeat("text", 2000)).otherwise(F.col("text")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.dtypes == docs.dtypes
        assert kept.where("score <> 'score' || doc_id or n_removed <> 'n_removed' || doc_id").count() == 0 and kept.count() > 20
    empty = docs.limit(0)
    assert all(stage(spark, empty, d).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_query_an_operator():
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
