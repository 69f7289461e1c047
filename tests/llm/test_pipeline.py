import corpus_pipeline
from corpus import edited, prose
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    rows = []
    for i in range(80):
        rows.append((i, prose(i, 60), "xx"))
    rows += [(100 + i, " ".join(w + "$$$" for w in prose(300 + i, 60).split()), "xx") for i in range(40)]
    rows += [(200, prose(1, 60), "xx"), (201, prose(2, 60).replace(" ", "\n"), "xx"), (202, edited(prose(3, 60), 1, 1), "xx")]
    rows += [(300, None, None), (301, "", "xx"), (302, "123 456", None), (303, "日本語 テキスト", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == COLUMNS
        kept[name] = {r.doc_id for r in left.collect()}
    assert kept["language_id"] == {i for i, *_ in rows if i < 300}
    poor = set(range(100, 140))
    assert len(kept["quality_classifier"] & poor) <= 2 and len(kept["quality_classifier"]) >= 80
    clean = kept["quality_classifier"] - poor
    assert kept["exact_dedup"] - poor == clean - {200, 201}
    assert kept["jaccard_join"] - poor == clean - {200, 201, 202}
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == kept["jaccard_join"]


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_lose_and_double_no_row(spark, tmp_path):
    rows = [(i, prose(i, 60), "xx") for i in range(60)] + [(100 + i, " ".join(w + "$$$" for w in prose(300 + i, 60).split()), "xx") for i in range(40)]
    rows += [(None, prose(600, 60), "xx"), (None, prose(601, 60), None), (None, prose(602, 60), "xx"), (None, prose(602, 60), "xx")]
    rows += [(7, prose(7, 60), "xx"), (7, prose(7, 60), "xx"), (8, prose(608, 60), "xx"), (9, "123 456", "xx")]
    rows += [(None, edited(prose(600, 60), 1, 1), "xx"), (None, prose(10, 60), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == COLUMNS
        if name == "language_id":
            assert sorted(r.text for r in left.collect()) == sorted(t for _, t, _ in rows if t != "123 456")
    kept = [(r.doc_id, r.text) for r in left.collect() if "$$$" not in r.text]
    near = {prose(600, 60), edited(prose(600, 60), 1, 1)}
    assert len([t for _, t in kept if t in near]) == 1
    expected = [(i, prose(i, 60)) for i in range(60)] + [(None, prose(601, 60)), (None, prose(602, 60)), (8, prose(608, 60))]
    assert sorted(map(repr, expected)) == sorted(repr(x) for x in kept if x[1] not in near)
