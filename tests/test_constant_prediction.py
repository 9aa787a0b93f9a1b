"""A constant prediction in the metrics of regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.ml.metrics import regression_metrics


def test_a_constant_prediction_has_no_r2_however_many_tasks_add_it_up(spark):
    rows = spark.range(0, 30000, 1, 24).select((F.col("id") % 30).alias("g"), (F.col("id") * 1.37 % 977).alias("o"))
    constant = rows.withColumn("p", F.lit(25482.917430256) + F.col("g") * 313.7919)
    assert [r["r2"] for r in regression_metrics(constant, "o", "p", ["g"]).collect()] == [None] * 30
    flipped = regression_metrics(constant, "p", "o", ["g"])
    assert flipped.where("r2 is not null").count() == 0
