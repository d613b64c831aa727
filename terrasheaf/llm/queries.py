"""The registered queries of this subpackage: thin, on whole tables; digests are derived from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, common, decontaminate, mixing, neighbors, pii, quality, secrets, simhash, substrings, suffixes, tokens, variants, warc
from .oracle_sql import ORACLE_SQL  # noqa: F401

#: Where a deployment sets its secret, and what stands in for it in the registered query.
PII_KEY_CONF, PII_KEY = "spark.terrasheaf.piiKey", "public demonstration key"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop")
    return judged.select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    index = warc.capture_index(warc.read_captures(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the demonstration key, which is public, anyone can undo this result; set PII_KEY_CONF for a secret one."""
    out = pii.pseudonymize(common.table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PII_KEY_CONF, PII_KEY))
    return out.select("doc_id", "text", "pii.*")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_token_ids(common.table(spark, sf_dir, "documents"), common.scratch(spark, "ids"))
    return tokens.with_crc32(tokens.read_token_ids(spark, path))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.table(spark, sf_dir, "documents")).drop("found")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(common.table(spark, sf_dir, "documents"))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(common.table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_substrings, op3_quality_rules, op4_suffix_arrays, op5_warc, op6_pii, op7_token_ids, op8_secrets, op9_simhash,
        op10_decontamination, op11_embeddings, op12_spelling, op13_codebooks,
    )
}
