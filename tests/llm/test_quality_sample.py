"""The quality sample is drawn from narrow rows."""

from pyspark.sql import functions as F

from leadflow.llm import quality


def test_no_whole_text_is_shuffled_to_meet_its_label(spark, monkeypatch):
    plans, sizes = [], []
    monkeypatch.setattr(quality, "_fitted", lambda df: plans.append(df) or sizes.append(df.count()))
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text").unionByName(spark.createDataFrame([(1, "text 1"), (2, None)], "doc_id long, text string"))
    labels = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id < 290 THEN cast(id % 2 AS int) END AS y")
    quality.train_on(docs, labels)
    assert sizes == [291]  # the repeated row once, the null text as a row of its own
    monkeypatch.setattr(quality, "SAMPLE", 100)
    quality.train_on(docs, labels)
    assert 60 < sizes[1] < 140
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        quality.train_on(docs, labels)
        plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [doc_id" in plan, plan
        assert sorted(r.y for r in plans[-1].collect()) == sorted(r.y for r in plans[1].collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert quality.train_on(docs, labels.where("y > 5")) is None
