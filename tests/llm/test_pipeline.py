import hashlib

import corpus_pipeline
from billgrid.llm import mixing, pii
from llm_rows import DOCS, sentences


def test_stages_on_a_small_table(spark, odd_rows, tmp_path):
    words = {"en": "the and of with that house", "fr": "le la les des avec maison être"}
    rows = [(1000 + k, sentences(k, 60, words[lang]), lang, f"s{k % 4}", 0) for k, lang in enumerate(["en", "fr"] * 20)] + odd_rows
    rows += [(2000, sentences(3, 60, words["fr"]) + " more", "fr", "s1", 0), (2001, "zqx jxv kwq " * 80, None, "s1", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{sf}/{name}")
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        out = spark.read.parquet(f"{sf}/{name}")
        gone = ids(before) - ids(out)
        if name == "language-id":
            assert gone == {100, 101, 102, 106, 2001}
        if name == "jaccard-join":
            assert gone >= {2000, 103, 105} and ids(out) >= {3, 104, 1003}
        if name == "pii":
            assert not gone and out.count() == before.count()
            assert not any(pii.base_spans(r.text) for r in out.collect()) and all(r.n_chars == len(r.text) for r in out.collect())
        if name == "source-mix":
            taken = {(r.doc_id, r.source_key): r.copies for r in mixing.mix(before).collect()}
            assert out.count() == sum(taken.values())
        before = out
    want = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert sorted(r.decoded_sha256 for r in last.collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)


def test_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
