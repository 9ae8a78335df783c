import corpus_pipeline
from folio.llm import toxicity
from tests.llm.fixtures import DOCS
from tests.llm.test_documents import TOKENIZER, components, labelled, plain_sets  # noqa: F401


def test_stages_in_order_on_what_is_left(spark, tmp_path):
    """Each stage against what its rule says of the rows that reached it; columns stay those of documents."""
    docs, labels = labelled(spark)
    item = "lomi terka sanou inda kalo miter " * 4 + ".\nouin dater lomi kada terka."
    rows = [(2000, f"{item} ka lo", "en", "s", 10), (2001, "write to a@b.com now please my friend", "en", "s", 37), (2002, "write to a@b.com now please my friend", "en", "s", 37)]
    docs.unionByName(spark.createDataFrame(rows, DOCS)).filter("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(now, labels).collect()}
    kept = {i for i, s in scores.items() if s < 0.5}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in now.collect()} == set(before)
            break
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            assert set(after) == kept
        if name == "near_duplicates":
            groups = components(plain_sets({i: t or "" for i, t in before.items()}))
            assert set(after) == {i for i, c in groups.items() if i == c}
        if name == "decontamination":
            assert set(before) - set(after) == {2000}
        if name == "pii":
            assert after[2001] == "write to <EMAIL> now please my friend" and set(after) == set(before)
