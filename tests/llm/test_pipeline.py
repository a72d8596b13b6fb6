import corpus_pipeline

from marketlens.llm import jaccard, language, queries


def test_stages(odd):
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(odd.sparkSession, docs, "")
        assert docs.columns == odd.columns and 0 < docs.count() <= before, name
        assert all(a.dataType == b.dataType for a, b in zip(docs.schema, odd.schema))
        assert docs.filter("n_chars <> length(text)").count() == 0 or name == "language"
    pieces = corpus_pipeline.STAGES[-1][1](odd.sparkSession, docs, "")
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in pieces}
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert kept <= set(texts) and len(kept) > 0.7 * len(texts)
    classes = jaccard.document_links(source).collect()
    for r in classes:
        if r["n_links"] == 0 and any(c.isalpha() for c in texts[r["doc_id"]]):
            assert r["doc_id"] in kept


def test_registered():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_line_dedup_takes_long_and_only_lines(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{long}"), (2, f"b\n{long}\nc"), (3, "one"), (4, "one")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: f"a\n{long}", 2: "b\nc", 3: "one", 4: ""}


def test_language_stage_drops_what_no_language_is_near(spark):
    """Texts with letters of which no run occurs in a learned language go, also for the stages that follow."""
    known = [(k, f"the story of the {w} and the other things that were there", "en") for k, w in enumerate(["house", "river", "garden", "winter"])]
    odd = [(10, "жшщ фыц щзх ъэю цкф йыъ эхъ шъщ", None), (11, "the garden of the other story", None), (12, "12 34", None)]
    docs = spark.createDataFrame(known + odd, "doc_id long, text string, lang string")
    for least, left in ((0.0, {0, 1, 2, 3, 10, 11}), (language.CHANCE, {0, 1, 2, 3, 11})):
        assert {r["doc_id"] for r in language.filter_languages(docs, least).collect()} == left
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {0, 1, 2, 3, 11}
