"""The corpus pipeline: each stage on what the one before it kept."""

import corpus_pipeline
import numpy as np
from test_neardup import classes_by_brute_force
from tokenizers import Tokenizer

from terrascore.llm import bpe


def test_stages_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for number, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{number}")
        kept.append(spark.read.parquet(f"{tmp_path}/{number}"))
    assert all(sorted(k.columns) == sorted(columns) for k in kept[:-1])
    known, single, clean, mixed, encoded = kept[1:]
    assert known.count() >= 0.98 * docs.count()
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    classes, _ = classes_by_brute_force(texts)
    assert {r["doc_id"] for r in single.collect()} == set(classes.values())
    assert clean.count() == single.count() and not clean.where("text rlike 'token = \"[0-9a-f]{40}'").count()
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg({"doc_id": "count"}).toDF("source", "n").collect()}
    assert words and mixed.join(clean, "doc_id", "left_anti").count() == 0
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = {r["doc_id"]: r["text"] for r in mixed.collect()}
    got = encoded.collect()
    assert len(got) == mixed.count()
    for r in got:
        assert np.array_equal(r["ids"], library.encode(rows[r["doc_id"]], add_special_tokens=False).ids)
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in again) == sorted((r["doc_id"], r["ids_sha256"]) for r in got)


def test_stages_are_the_dealt_ones():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
