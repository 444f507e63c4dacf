"""A training-corpus pipeline: quality, near-duplicates, secrets, source mix, tokens.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last returns token ids. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe_monoid, pu_quality, secret_scan, simhash_mih, source_mix
from veilspan.session import dropped, shared_folder
from veilspan.sources.tables import read_table, spread

#: Token mix of the corpus: even sources, languages and topics near their natural shares; four fifths of all
#: tokens, or as many as the targets allow.
MIX = source_mix.Targets(
    lang={"en": 0.58, "de": 0.155, "fr": 0.155, "es": 0.11}, topic={"general": 0.955, "reference": 0.035, "legal": 0.0075, "commerce": 0.0025}, budget=0.8
)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the positive-unlabelled classifier rejects (score below 0.3).

    Null texts count as empty; null ids are scored like any other row."""
    network, _ = pu_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return pu_quality.keep_quality(docs, network, threshold=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies.

    Five-word shingles; near are estimated similarities of 0.8 or more. Rows with a null id stay;
    of rows that repeat an id one stays, the least by a hash of its columns and then by the columns."""
    columns = ("text", "lang", "source", "n_chars")
    found = simhash_mih.near_duplicates(docs)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    least = F.min(F.struct(F.xxhash64(*columns).alias("by"), *columns))  # the join has dealt the rows by id already
    kept = kept.groupBy("doc_id").agg(least.alias("row")).select("doc_id", *[f"row.{c}" for c in columns])
    return kept.unionByName(docs.where("doc_id is null").select("doc_id", *columns))


def secret_scan_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by a mark and brings n_chars up to date; null texts stay null."""
    return secret_scan.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the probabilities that rake their tokens to the target mix."""
    return source_mix.sample_mix(docs, MIX)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids of each text, and the digest of their decoding."""
    return bpe_monoid.encoded_documents(docs, "doc_id", "text", *bpe_monoid.public_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan_redaction),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the classifier, the fingerprints' bits or the tokenizer; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows go through the shared folder, where
    they are dropped once the next stage's rows are written."""
    docs = spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars")
    before = None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"corpus-pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            dropped(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
