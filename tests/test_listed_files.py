"""Files are listed and opened by tasks: the driver holds no list of them, and what is found is what Spark's reader finds."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from obsframe.plans import scans
from obsframe.sources import archives, sinks
from test_refresh import found, rows

NAMES = [
    "Station_1.zip", "_Station_2.zip", "a b/Station_3.zip", "a b/.h/Station_4.zip", "a b/_h/Station_5.zip", "a b/_k=1/Station_6.zip",
    "a b/Station_7.zip.part", "a b/Station_8.ZIP", "a%20b/c/d/IDCJAC0010_9_1800.zip",
    "_metadata/Station_10.zip", "_metadata_11.zip", "_common_metadata/_h/Station_12.zip", "a b/Station_13.zip.COPYING/Station_14.zip",
]


def written(folder, names):
    for name in names:
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(name.encode() * 3)


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    written(tmp_path, [f"{p}/Station_{n}.zip" for p in ("first", "second") for n in range(20)])
    listed = archives.list_files(spark, str(tmp_path))
    opened = archives.open_files(spark, str(tmp_path), listed)
    assert listed.count() == opened.count() == 40
    assert listed.inputFiles() == [] and opened.inputFiles() == []


@pytest.mark.parametrize("scheme, below", [("", ""), ("file://", ""), ("file:", "/"), ("", "/a b")])
def test_listing_gives_what_spark_gives(spark, tmp_path, scheme, below):
    written(tmp_path, NAMES)
    for empty in ("Station_20.zip", "a b/Station_21.zip"):
        (tmp_path / empty).touch()
    os.symlink(tmp_path / "Station_1.zip", tmp_path / "a b/Station_22.zip")
    os.symlink(tmp_path / "a%20b", tmp_path / "a b/linked")
    path = f"{scheme}{tmp_path}{below}"
    want = archives._named(archives._files(spark, path)).select("station", "path", "length", F.col("modificationTime").alias("modified"), "content")
    listed = archives.list_files(spark, path)
    got = listed.join(archives.open_files(spark, path, listed).drop("station"), "path").select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_folder_named_by_a_pattern_is_left_to_spark(spark, tmp_path):
    written(tmp_path, ["p1/Station_1.zip", "p2/Station_2.zip", "q/Station_3.zip"])
    listed = archives.list_files(spark, f"{tmp_path}/p*")
    opened = archives.open_files(spark, f"{tmp_path}/p*", listed)
    assert sorted(r["station"] for r in listed.collect()) == sorted(r["station"] for r in opened.collect()) == ["1", "2"]


def test_files_are_dealt_by_number_and_length(spark, tmp_path, monkeypatch):
    written(tmp_path, [f"Station_{n}.zip" for n in range(30)])
    listed = archives.list_files(spark, str(tmp_path))
    chosen = listed.where(F.col("station").cast("int") < 25).unionByName(listed.where("station = '3'"))
    want = sorted(str(n) for n in range(25))
    for limits in ({"FILES_PER_TASK": 2}, {"BYTES_PER_TASK": 80}, {"OPENED_PER_BATCH": 1}, {"OPENED_PER_BATCH": 100}, {"LISTED_PER_BATCH": 3}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(archives, name, value)
            opened = archives.open_files(spark, str(tmp_path), chosen)
            tasks = opened.rdd.getNumPartitions()
            assert sorted(r["station"] for r in opened.collect()) == want
        assert tasks == {"FILES_PER_TASK": 13, "BYTES_PER_TASK": 14}.get(*limits, spark.sparkContext.defaultParallelism)


def test_a_file_that_comes_during_a_refresh_is_read_by_the_next(spark, tmp_path):
    folder, memo = str(tmp_path / "files"), str(tmp_path / "memo")
    scans.landed_archives(spark, rows(spark, {"101": 4}), folder, "first")

    def summarise(changed):
        scans.landed_archives(spark, rows(spark, {"102": 3}), folder, "first")
        opened = archives.load_archives(archives.open_files(spark, folder, changed), archives.RAINFALL, "s")
        return opened.groupBy("path", "station").agg(F.count("value").alias("n_present"), F.max("date").alias("last_date"))

    partial = sinks.refresh(spark, memo, "present", archives.list_files(spark, folder), summarise)
    assert [r["station"] for r in partial.collect()] == ["101"]
    assert found(spark, folder, memo) == {"101": (4, "2000-01-04"), "102": (3, "2000-01-03")}


def test_lists_of_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    folder, memo = str(tmp_path / "files"), str(tmp_path / "memo")
    scans.landed_archives(spark, rows(spark, {"101": 4, "102": 2}), folder, "first")
    found(spark, folder, memo)
    plans = []

    def summarise(changed):
        plans.append(changed._jdf.queryExecution().executedPlan().toString())
        opened = archives.load_archives(archives.open_files(spark, folder, changed), archives.RAINFALL, "s")
        return opened.groupBy("path", "station").agg(F.count("value").alias("n_present"), F.max("date").alias("last_date"))

    sinks.refresh(spark, memo, "present", archives.list_files(spark, folder), summarise)
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
