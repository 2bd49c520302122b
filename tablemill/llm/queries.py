"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import extraction, jaccard, linededup, mixing, negatives, neighbours, packing, pieces, quality, repetition, spelling, toxicity, urlrules
from tablemill.registry import Tables


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return quality.quality_scores(t.documents, t.labels).select("doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(Tables(spark, sf_dir).documents).select("doc_id", "text", "n_dropped")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(Tables(spark, sf_dir).documents)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(Tables(spark, sf_dir).pages).select("page_id", "url", "text", "n_chars")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(Tables(spark, sf_dir).pages).select("page_id", "host", "path", "rule", "verdict", "mined")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return toxicity.toxicity_scores(t.documents, t.labels).select("doc_id", "held_out", "score", "predicted")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(Tables(spark, sf_dir).embeddings)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_documents(Tables(spark, sf_dir).documents, path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of every document, and whether they decode to its text."""
    made = pieces.encode_documents(Tables(spark, sf_dir).documents, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("exact").alias("round_trip")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(Tables(spark, sf_dir).documents)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(Tables(spark, sf_dir).documents)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(Tables(spark, sf_dir).documents)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(Tables(spark, sf_dir).embeddings)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, which lies beside the package."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_line_dedup, op3_quality_rules, op4_html_extraction, op5_url_filters, op6_toxicity,
        op7_nearest_neighbours, op8_best_fit_packing, op9_sentencepiece, op10_ngram_jaccard_join,
        op11_source_mixing, op12_spelling_variants, op13_hard_negatives, pipeline,
    )
}
ORACLES = {"op2_line_dedup": linededup.dedup_sql(), "op11_source_mixing": mixing.mixing_sql(), "op13_hard_negatives": negatives.negatives_sql()}
