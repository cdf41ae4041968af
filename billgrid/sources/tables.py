"""Readers (S1-S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid import schemas


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest document: origin, suite, pdf, position, ``d`` (the document)."""
    raw = (
        spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.manifest.json").json(path)
    )
    return raw.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("origin"), "schema_version",
        F.coalesce("suite", F.lit("unknown")).alias("suite"), "fixture_slug",
        F.coalesce("pdf.filename", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.manifest\.json$", ".pdf")).alias("pdf_filename"),
        F.col("pdf.page_count").alias("pdf_page_count"), F.col("challenge_tags").alias("file_tags"),
        F.size("documents").alias("document_count"), F.posexplode("documents").alias("position", "d"),
    )


def bad_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Origin and reason of the manifest files that :func:`read_manifests` has no document of."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.manifest.json").text(path)
    parsed = F.try_parse_json("value")
    documents = F.try_variant_get(parsed, "$.documents", "array<variant>")
    reason = F.when(parsed.isNull(), "unreadable").when(documents.isNull(), "no documents").when(F.size(documents) == 0, "empty")
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("origin"), reason.alias("reason")).filter("reason is not null")


def read_document_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """PDF files of a folder, whatever the case of their suffix. Name, size, bytes."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length", "modificationTime", "content")


def content_ledger(files: DataFrame, content: str = "content") -> DataFrame:
    """S3: one row per distinct content: sha256, size, storage path, first name."""
    return (
        files.select(F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(F.col(content)).cast("long").alias("byte_size"), "filename")
        .groupBy("sha256").agg(F.min("byte_size").alias("byte_size"), F.min("filename").alias("first_filename"), F.count("*").alias("copies"))
        .withColumn("storage_path", F.concat("sha256", F.lit(".pdf")))
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word grid in the fixed schema; extra columns are ignored, missing ones are NULL."""
    return spark.read.schema(schemas.WORD).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)
