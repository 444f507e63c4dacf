"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from veilspan.llm import (
    bpe_monoid, decontaminate, filter_audit, merkle, norm_topk, pii, pu_quality, secret_scan, simhash_mih, source_mix, substring_dedup,
    toxic_cnn, vp_tree,
)
from veilspan.sources.tables import read_table, spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_documents(spark, sf_dir))


def op3_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), step=50, k=5)


def op4_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = toxic_cnn.fit(documents, read_table(spark, sf_dir, "labels"))
    return toxic_cnn.score(documents, model, threshold=0.5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), window=20)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_monoid.round_trip_digests(
        _documents(spark, sf_dir), "doc_id", "text", *bpe_monoid.public_tokenizer()
    )


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    network, _ = pu_quality.fit(documents, read_table(spark, sf_dir, "labels"))
    return pu_quality.score(documents, network, threshold=0.3)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.calibrated(_documents(spark, sf_dir))


def op9_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    found = simhash_mih.near_duplicates(documents, shingle=4, bits=64, segments=2, radius=4, seed=42)
    return found.select("doc_id", simhash_mih.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_products(read_table(spark, sf_dir, "embeddings"), step=100, k=10)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


QUERIES = (
    op1_secret_scan, op2_pii, op3_vp_tree, op4_toxic_cnn, op5_substring_dedup,
    op6_byte_bpe, op7_pu_quality, op8_source_mix, op9_simhash_mih, op10_norm_topk,
    op11_decontaminate, op12_merkle_manifest, op13_filter_audit,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same over whole tables; the other queries have brute-force tests."""
    found = {
        "op2_pii": pii.oracle(),
        "op5_substring_dedup": substring_dedup.oracle(20),
        "op8_source_mix": source_mix.oracle(),
        "op10_norm_topk": norm_topk.oracle(100, 10),
        "op11_decontaminate": decontaminate.oracle(),
        "op12_merkle_manifest": merkle.oracle(),
        "op13_filter_audit": filter_audit.oracle(),
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
