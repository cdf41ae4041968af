"""Documents to training data: the stages in order, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.llm import byte_bpe, common, language_id, mixing, pii, set_join


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages that the table labels."""
    languages, table = language_id.fit(docs)
    found = language_id.identify(language_id.evidence_of_documents(docs), languages, table)
    out = found.filter("not kept").select("id", "key", "host").distinct()
    rows = docs.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.whole_text()).alias("text_key"), F.coalesce("source", F.lit("")).alias("source"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")) & (F.col("source") == F.col("host"))
    return rows.join(out, same, "left_anti").select("given.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.repeated(docs, mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the tokens, digest of what they decode to."""
    return byte_bpe.round_trip(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


STAGES = [
    ("language-id", known_languages),
    ("jaccard-join", one_of_each_group),
    ("pii", without_personal_data),
    ("source-mix", mixed_sources),
    ("byte-bpe", encoded),
]
#: SQL expresses neither the language models nor the random field nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
