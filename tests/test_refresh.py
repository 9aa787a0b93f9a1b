"""Refreshing by what changed: what is read again, what is kept, what goes."""

import os

import pytest
from pyspark.sql import functions as F

from obsframe.plans import scans
from obsframe.sources import archives, sinks


def rows(spark, days):
    """(station, line) with a value for each of a station's days."""
    lines = [(s, f"IDCJAC0009,{s},2000,01,{d:02d},{d}.5,1,Y") for s, n in days.items() for d in range(1, n + 1)]
    return spark.createDataFrame(lines, "station string, line string")


def found(spark, folder, memo):
    return {r["station"]: (r["n_present"], str(r["last_date"])) for r in scans.refreshed(spark, folder, memo).collect()}


def test_only_changed_files_are_read(spark, tmp_path):
    folder, memo = str(tmp_path / "files"), str(tmp_path / "memo")
    scans.landed_archives(spark, rows(spark, {"101": 4, "102": 6, "103": 9}), folder, "first")
    assert sorted(os.listdir(f"{folder}/first")) == ["Station_101.zip", "Station_102.zip", "Station_103.zip"]
    want = {"101": (4, "2000-01-04"), "102": (6, "2000-01-06"), "103": (9, "2000-01-09")}
    assert found(spark, folder, memo) == want

    # A file that looks unchanged is not opened: garbage of the same length and time does no harm.
    kept = f"{folder}/first/Station_101.zip"
    stat = os.stat(kept)
    with open(kept, "wb") as f:
        f.write(b"x" * stat.st_size)
    os.utime(kept, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    scans.landed_archives(spark, rows(spark, {"102": 8}), folder, "first")
    scans.landed_archives(spark, rows(spark, {"104": 2}), folder, "later")
    os.remove(f"{folder}/first/Station_103.zip")
    os.utime(f"{folder}/first/Station_102.zip", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))
    assert found(spark, folder, memo) == {"101": (4, "2000-01-04"), "102": (8, "2000-01-08"), "104": (2, "2000-01-02")}
    assert sorted(os.listdir(f"{memo}/present")) == ["1", "2"]


def test_a_state_that_was_not_finished_does_not_count(spark, tmp_path):
    folder, memo = str(tmp_path / "files"), str(tmp_path / "memo")
    scans.landed_archives(spark, rows(spark, {"101": 4}), folder, "first")
    first = found(spark, folder, memo)

    def broken(changed):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sinks.refresh(spark, memo, "present", archives.list_files(spark, folder), broken)
    assert found(spark, folder, memo) == first


def test_two_files_of_a_station_add_up(spark, tmp_path):
    folder, memo = str(tmp_path / "files"), str(tmp_path / "memo")
    scans.landed_archives(spark, rows(spark, {"7": 3}), folder, "a")
    scans.landed_archives(spark, rows(spark, {"7": 5}), folder, "b")
    assert found(spark, folder, memo) == {"7": (8, "2000-01-05")}


def test_landed_files_are_read_as_stations(spark, tmp_path):
    folder = str(tmp_path / "files")
    scans.landed_archives(spark, rows(spark, {"7": 3, "8": 2, "9": 4}), f"file://{folder}", "a", archives.MAX_TEMP)
    wanted = spark.createDataFrame([("7",), ("9",), ("10",)], "station string")
    got = archives.load_stations(spark, folder, archives.MAX_TEMP, wanted, "max_temp")
    assert {(r["station"], r["n"]) for r in got.groupBy("station").agg(F.count("value").alias("n")).collect()} == {("7", 3), ("9", 4)}
