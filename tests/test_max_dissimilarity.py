"""The summary behind the greedy choice is worked out once."""

from __future__ import annotations

from obsframe.operators import quality


def test_the_summary_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("Z", str(i), float(i * i % 17), float(i % 5)) for i in range(40)], "zone string, station string, a double, b double")
    summary = rows.mapInPandas(counted, rows.schema)
    out = quality.max_dissimilarity(summary, ["zone", "station"], ["a", "b"], start=2, more=4, seed=3).collect()
    assert len(out) == 6 and seen.value == 40
