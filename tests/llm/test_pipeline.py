import corpus_pipeline
from motifmill.llm import bm25, chosenpath, quality
from tests.llm.fixtures import documents, frame, prose


def tables(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, prose(30, 300)), (1, prose(40, 301))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rows = documents()
    rows.append((200, prose(70, 310) + " " + prose(30, 300) + " " + prose(200, 311), *rows[0][2:]))
    d = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    kept = stages["quality rules"](spark, docs, d)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    # document 19 has 81 of its 155 words in repeated windows, so the base rules reject it
    assert ids >= set(range(24)) - {19} | {200} and 19 not in ids and not ids & {27, 28, 29, 31, 33, 34}
    want = quality.score_documents(docs.drop("score", "kept", "bins_"), spark.read.parquet(f"{d}/labels.parquet")).where("kept").count()
    assert kept.count() == want
    kept = corpus_pipeline.save(kept, "kept")
    once = corpus_pipeline.save(stages["n-gram Jaccard join"](spark, kept, d), "once")
    assert once.columns == columns
    links = chosenpath.join(once).agg({"n_links": "max"}).first()[0]
    ids = {r.doc_id for r in once.select("doc_id").collect()}
    assert links == 0 and not ids & {24, 25} and {3, 5} <= ids
    clean = corpus_pipeline.save(stages["benchmark decontamination"](spark, once, d), "clean")
    assert clean.columns == columns and {r.doc_id for r in clean.select("doc_id").collect()} == ids - {200}
    mixed = corpus_pipeline.save(stages["mixing sources to target weights"](spark, clean, d), "mixed")
    assert mixed.columns == columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= ids - {200}
    out = stages["token-ID output"](spark, mixed, d).orderBy("start").collect()
    assert len(out) == mixed.count() and [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]


def test_run_on_nothing(spark, tmp_path):
    d = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_clean_documents_stay(spark, tmp_path):
    rows = [(i, prose(120, 1000 + i), "en", "s", 0, 1.0, 7, "r", 3, "p", True) for i in range(30)]
    items = spark.createDataFrame([(0, prose(30, 300))], "item_id long, text string")
    assert bm25.without_leaks(frame(spark, rows), items).count() == 30
