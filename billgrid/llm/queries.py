"""One query for each operator over its whole table, with the settings meant for production."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.llm import byte_bpe, checks, common, importance, katz, language_id, licenses, mixing, near_vectors, pii, set_join, simhash, token_counts, vector_codes, word_bpe


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    return token_counts.count_tokens(common.read(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"), common.folder(spark, "token-cache"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(common.read(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.read(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    return katz.score(common.read(spark, sf_dir, "documents"), kept)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its licenses and its best matches as text (template:license:containment:first word)."""
    found = licenses.scan(common.read(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["license"], F.format_string("%.4f", m["containment"]), m["first_word"]))
    return found.select("doc_id", "n_matches", "licenses", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("matches"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_groups(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(common.read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; the likelihoods are fitted on labelled documents."""
    docs = common.read(spark, sf_dir, "documents")
    languages, table = language_id.fit(docs)
    rows = language_id.evidence_of_documents(docs).unionByName(language_id.evidence_of_pages(common.read(spark, sf_dir, "pages")))
    found = language_id.identify(rows, languages, table)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select("kind", of("document").alias("doc_id"), of("page").alias("page_id"), "host", "lang", "confidence", "text_lang", "declared", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(common.read(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(common.read(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_near_vectors, op3_byte_bpe, op4_katz, op5_license_scan, op6_jaccard_join, op7_simhash, op8_language_id, op9_pii, op10_source_mix, op11_importance, op12_vector_codes, op13_word_bpe)}
#: DuckDB SQL of the queries that SQL can express.
CHECKS = checks.CHECKS
