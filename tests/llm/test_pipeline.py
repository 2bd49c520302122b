"""The corpus pipeline: its last rows against the operators applied by hand, stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablemill.llm import jaccard, linededup, packing, quality, toxicity


def test_stages_against_the_operators(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fine = toxicity.toxicity_scores(docs, labels).where("predicted = 0").select(*docs.columns)
    good = quality.quality_scores(fine, labels).where("predicted = 1").select(*docs.columns)
    clean = linededup.dedup_lines(good)
    first = jaccard.near_duplicates(clean).where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    want = packing.packed_documents(clean.join(first, "doc_id"), packing_path()).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()


def test_odd_rows_pass_every_stage(spark, sf_dir, docs_of):
    rows = docs_of([(1, None), (2, ""), (None, "x"), (None, "x"), (3, "w " * 20_000), (4, "a\n" * 50, None)])
    for docs in (rows, rows.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            step(spark, docs, sf_dir).collect()


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_one_query(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in entry.queries()
