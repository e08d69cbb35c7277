"""The corpus pipeline on odd rows: columns stay, each stage works on all that its predecessor kept."""

import corpus_pipeline as pipeline


def test_stages(spark, odd, none, tmp_path):
    docs, kept = odd, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    assert kept[0] == odd.where("text is not null and text rlike '[a-zA-Z]'").count()
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    one = spark.read.parquet(str(tmp_path / "near_duplicates")).where("doc_id in (1, 2)")
    assert [r.doc_id for r in one.collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "secrets")).where("doc_id = 11").first().text == "[assign]\" and [access]"


def test_empty_and_whole(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.selectExpr("max(length)").head()[0] <= 4096
