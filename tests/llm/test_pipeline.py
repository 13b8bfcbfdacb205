from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline has been removed")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before or name == "packing"
    assert docs.count() == pipeline.run(spark, sf_dir).count()
    packed = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "decontamination")).select("doc_id").collect()}
    assert packed == kept


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_odd_rows(spark, sf_dir, tmp_path):
    """Null ids, null, empty and long texts, a repeated row and columns named like results: rows of good texts keep all their columns."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import ODD

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.where("length(text) > 600").orderBy("doc_id").limit(1)
    good = good.union(good).union(good.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.reverse("text")))
    rows = [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    small = docs.where("doc_id % 20 = 7").unionByName(good).unionByName(odd, allowMissingColumns=True)
    small = small.withColumns({c: F.lit(1) for c in ("kept", "component_id", "n_words", "piece", "item_id", "hash")})
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, small, sf_dir)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == small.columns, name
        out.write.parquet(str(tmp_path / name))
        small = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":  # null, empty and short texts fail
            assert not {10**6 + i for i in (0, 1, 2, 3, 5, 6)} & {r["doc_id"] for r in small.select("doc_id").collect()}
    assert small.where("length < 1 or length > 4096").count() == 0 and small.count() > 0
