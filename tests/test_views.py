"""The views give whole texts."""

from __future__ import annotations

from cairn.sources.views import spark_view


def test_texts_are_whole(spark, sf_dir):
    docs = spark_view(spark, sf_dir, "documents").select("doc_id", "text")
    seen = spark_view(spark, sf_dir, "texts").select("doc_id", "text")
    assert docs.where("length(text) > 200").count() > 0
    assert seen.count() == docs.count()
    assert seen.alias("s").join(docs.alias("d"), "doc_id").where("NOT startswith(s.text, d.text)").count() == 0


def test_observations_are_whole(spark, sf_dir):
    turns = spark_view(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS id", "text")
    seen = spark_view(spark, sf_dir, "observations").select("id", "body")
    assert turns.where("length(text) > 30").count() > 0
    assert seen.join(turns, "id").where("NOT startswith(body, text)").count() == 0


def test_views_take_all_keys(spark, sf_dir, tmp_path):
    for t in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.range(1, 201).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 51).selectExpr("id AS event_id", "id % 3 AS user_id", "'click' AS event_type", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert spark_view(spark, str(tmp_path), "tuples").where("subject_type = 'user'").count() == 200
    assert spark_view(spark, str(tmp_path), "labels_bio").select("doc_id").distinct().count() == 200
    assert spark_view(spark, str(tmp_path), "memory_sources").count() == 50
