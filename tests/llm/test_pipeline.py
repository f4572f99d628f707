import corpus_pipeline
from fleetscan.llm.common import stored


def test_stages_on_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "duplicates", "mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, data))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert 0 < out.count()
        docs = out
    tokens = docs.dropDuplicates(["doc_id", "doc_tokens"]).agg({"doc_tokens": "sum"}).first()[0]
    assert docs.agg({"length": "sum"}).first()[0] >= tokens


def test_stages_on_odd_and_no_documents(spark, data, odd_docs, no_docs):
    for docs in (odd_docs.withColumn("n_chars", odd_docs["doc_id"]), no_docs.withColumn("n_chars", no_docs["doc_id"])):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, data))
            assert k == 4 or docs.columns == columns
