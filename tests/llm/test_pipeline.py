import hashlib

import corpus_pipeline
from noveltybench.llm import byte_bpe, decontam, language, near_dup


def test_stages_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    here = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, here, sf)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in here.collect()}, name
        here = spark.createDataFrame(rows, docs.schema)
    assert here.count() > 0.6 * docs.count()
    assert near_dup.groups(here, 5, 80).where("not kept").count() == 0
    assert decontam.digest(here, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, here, sf)
    texts = {r["doc_id"]: r["text"] for r in here.collect()}
    import public_tokenizers

    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    for r in last.collect():
        assert bpe.decode_bytes(bytes(r["token_ids"])) == texts[r["doc_id"]].encode()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    whole = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def test_language_stage_keeps_labelled_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert language.keep_identified(docs).count() >= 0.99 * docs.count()


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        got = stages[name](spark, odd_docs, sf)
        assert got.columns == odd_docs.columns and got.schema.simpleString() == odd_docs.schema.simpleString(), name
        kept[name] = sorted((r["doc_id"] for r in got.collect()), key=lambda d: (d is None, d))
        assert stages[name](spark, no_docs, sf).collect() == [], name
    assert not {2, 3, 4, 5} & set(kept["language_id"]) and {1, 6, 8} <= set(kept["language_id"])  # null, empty, no letters
    assert kept["line_dedup"] == kept["near_dedup"] == [1, 1, 2, 3, 4, 5, 6, 7, None]  # 8 repeats 1
    assert kept["decontamination"] == [1, 1, 2, 3, 4, 5, 6, 7, 8, None]
    assert stages["byte_bpe"](spark, odd_docs, sf).count() == odd_docs.count() and stages["byte_bpe"](spark, no_docs, sf).count() == 0
