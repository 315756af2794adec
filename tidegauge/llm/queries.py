"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    decontaminate,
    minhash,
    packing,
    piecewise,
    pii,
    secrets,
    sharding,
    simhash,
    suffix,
    toxicity,
    turntrie,
    variants,
    warc,
)
from tidegauge.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    best = F.max(F.struct("matched", "length", "start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start", "b.length", "b.matched")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan_documents(table(spark, sf_dir, "documents")))


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.round_trip(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_packing,
        op3_decontaminate,
        op4_suffix_dedup,
        op5_toxicity,
        op6_simhash,
        op7_warc,
        op8_sharding,
        op9_fingerprints,
        op10_pii,
        op11_piece_encoding,
        op12_spelling_variants,
        op13_prefix_trie,
    )
}

ORACLES = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), f AS (
            SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY payload
        )
        SELECT p.page_id,
               strlen(p.payload) AS payload_bytes,
               sha256(p.payload) AS payload_digest,
               CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (payload)
    """,
}
