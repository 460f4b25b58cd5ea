import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        assert kept.columns == columns and 0 < kept.count() <= docs.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0, name
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_registered_queries_run(spark):
    from sottovoce.llm import registry

    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]
    n = corpus_pipeline.table(spark, SF, "documents").count()
    for name, query in registry.queries().items():
        assert name == "op13_prefix_trie" or query(spark, SF).count() == (50 if name == "op4_warc" else n), name
