"""Work that is small in bytes, or many equal rows, is dealt out or combined before it is done."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from obsframe.ml import algorithms as A
from obsframe.plans import stations


def test_archives_of_a_short_list_are_packed_in_several_tasks(spark, monkeypatch):
    seen, pack = [], stations.archives.pack_archives
    monkeypatch.setattr(stations.archives, "pack_archives", lambda rows, product: seen.append(rows) or pack(rows, product))
    out = stations.observation_summary(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len({r["station"] for r in out}) > 0
    assert seen[0].rdd.getNumPartitions() > 1


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_grows_from_combined_rows(spark, monkeypatch, task):
    rows = spark.range(4000).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("noise")
    )
    number = F.col("a") * 3 + F.col("b") * F.col("b") + F.col("noise")
    rows = rows.withColumn("y", (number if task == "regression" else (number > 40).cast("double")).cast("double"))
    pins, pin = [], A.pin
    monkeypatch.setattr(A, "pin", lambda df: pins.append(pin(df)) or pins[-1])
    got = A.fit(rows, "boosted", task, ["a", "b"], "y", maxDepth=3)(rows)
    assert pins[0].count() <= 77 * (1 if task == "regression" else 2)
    assert pins[0].agg(F.sum("weight_")).first()[0] == 4000
    plain = A.estimator("boosted", task, ["a", "b"], "y", maxDepth=3).fit(rows).transform(rows)
    both = got.select("id", F.col("prediction").alias("p")).join(plain.select("id", "prediction"), "id")
    assert both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0
