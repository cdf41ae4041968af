import pytest
from llm_rows import DOCS, sentences


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, repeats, very long texts, ties."""
    rows = [(k, sentences(k, 30 + k), "en", f"src{k % 3}", 0) for k in range(24)]
    rows += [(100, None, "en", "src0", None), (101, "", None, None, 0), (102, " \n\t ", "fr", "src1", 4), (None, sentences(90, 40), "en", "src2", 1), (None, None, None, None, None)]
    rows += [(103, sentences(3, 33), "en", "src0", 0), (103, sentences(3, 33), "en", "src0", 0), (104, "One two", None, "ünïcode", 7), (105, "one TWO", "en", "src1", 7)]
    rows += [(106, "x" * 120_000, "en", "src1", 0), (107, sentences(7, 60_000), "en", "src2", 0), (108, "É" + sentences(8, 50) + " mail a.b@c.example.org +1 (389) 555-5010 and 42.144.35.254 with 4111 1111 1111 1111", "en", None, 0)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with columns whose names operators use themselves."""
    df = spark.createDataFrame(odd_rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("n_tokens", "size", "key", "digest", "bucket", "row", "kind", "rid", "chunk", "n", "h", "trained", "component_id", "taken", "mix_key", "word"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
