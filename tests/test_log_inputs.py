"""What it takes to render logs."""

from pyspark.sql import functions as F

from checks import inputs


def _events(spark, path):
    spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
        (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{path}/events.parquet")


def test_log_text_is_not_shuffled(spark, tmp_path):
    _events(spark, tmp_path)
    lines = inputs.log_lines(spark, str(tmp_path))
    assert lines.count() == 40 and lines.first()["value"].startswith("# Time: 2023-")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("# Time: ") < plan.index("Exchange")  # rendered above the exchange
    below = plan[plan.index("Exchange") :].split("+- == Initial Plan ==")[0]
    assert "# Time: " not in below


def test_wanted_logs_alone_are_rendered(spark, tmp_path, monkeypatch):
    _events(spark, tmp_path)
    monkeypatch.setattr(inputs, "EVENTS_PER_LOG", 5)
    kept = inputs.log_lines(spark, str(tmp_path), kinds=(2, 3)).select("chunk").distinct().collect()
    assert sorted(r["chunk"] for r in kept) == [2, 3, 6, 7]
