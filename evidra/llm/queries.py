"""Queries of the problems on texts: 1, 2, 7, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import corpus_tokens, credentials, mixing, provenance, shared_spans, syntax
from evidra.session import saved
from evidra.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose content doesn't parse as the language of their extension."""
    return syntax.parse_verdicts(table(spark, folder, "files")).where("verdict != 'ok'").selectExpr("id as file_id").distinct()


def p1_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Where and how each of these files fails."""
    return syntax.parse_verdicts(table(spark, folder, "files")).where("verdict != 'ok'")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates per repo and language."""
    files = table(spark, folder, "files")
    return syntax.parse_rates(files, syntax.parse_verdicts(files))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return corpus_tokens.encode(table(spark, folder, "documents").select("doc_id", "text"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its number of tokens, and whether decoding gives its text again."""
    texts = table(spark, folder, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("wanted"))
    decoded = corpus_tokens.decode(p8_ids(spark, folder)).select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("text").alias("got"))
    return decoded.join(texts, "doc_id").select("doc_id", "n_tokens", (F.col("got") == F.col("wanted")).alias("same"))


def _drawn(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    counts = corpus_tokens.encode(documents.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n_tokens"))
    sizes = saved(documents.select("doc_id", "source").join(counts, "doc_id"))
    return mixing.mix(sizes, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn documents with their repeats."""
    return _drawn(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.shares(saved(_drawn(spark, folder)), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share a long verbatim span."""
    return shared_spans.sharing_pairs(table(spark, folder, "documents").select("doc_id", "text"))


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each document how much of it also stands elsewhere."""
    return shared_spans.shared_parts(table(spark, folder, "documents").select("doc_id", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on which a credential starts."""
    rows = credentials.located(table(spark, folder, "files"), table(spark, folder, "redaction_configs"))
    return rows.select("table_name", "record_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with content and every pattern of a config as redacted text, with the number of credentials in it.

    ``place`` is the number of the pattern from 1, and 0 for a file.
    """
    scans = {"files": credentials.scan_files(table(spark, folder, "files")), "redaction_configs": credentials.scan_configs(table(spark, folder, "redaction_configs"))}
    rows = [
        df.select(F.lit(name).alias("table_name"), "record_id", F.coalesce("place", F.lit(0)).alias("place"), F.size("hits").alias("n_credentials"), "redacted")
        for name, df in scans.items()
    ]
    return rows[0].unionByName(rows[1]).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody wrote by hand in their repo."""
    return provenance.classify(table(spark, folder, "files")).where("kind is not null").select(F.col("id").alias("file_id")).distinct()


def p7_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its kind and the evidence for it (``none`` if there is none)."""
    files = provenance.classify(table(spark, folder, "files"))
    return files.select("id", F.coalesce("kind", F.lit("hand-written")).alias("kind"), F.coalesce("reason", F.lit("none")).alias("reason"))


def p7_walked(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of directory walks with their kind."""
    return provenance.walked(table(spark, folder, "directory_walks"), table(spark, folder, "files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_failures, p1_rates, p2_found, p2_redacted, p7_found, p7_kinds, p7_walked, p8_ids, p8_roundtrip, p9_mix, p9_shares, p10_found, p10_shared)}
ORACLES: dict[str, str] = {}
