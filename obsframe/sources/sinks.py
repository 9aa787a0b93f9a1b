"""Keeping results: memoised tables, their removal, and the landed observation table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.session import path_exists


def memo_name(name: str, version: int = 1, **params: object) -> str:
    """A folder name that carries the version and every parameter of the result."""
    parts = [f"{k}={params[k]}" for k in sorted(params)]
    return "-".join([name, f"v{version}", *parts]).replace("/", "_").replace(" ", "_")


def memoise(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The saved result if it was written to the end, else compute, save and read it back."""
    path = f"{folder.rstrip('/')}/{name}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rebuild(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Discard a saved result by writing it anew."""
    path = f"{folder.rstrip('/')}/{name}"
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def land_observations(observations: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """One Parquet table, in folders by zone, stations kept together inside each folder.

    Spark balances the tasks by size, with the rows of a station together; a task that grows too large is split,
    whatever station it holds. Sorting lets a reader skip row groups by station.
    """
    (
        observations.hint("rebalance", "zone", "station")
        .sortWithinPartitions("zone", "station", "date")
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("zone").parquet(path)
    )


def read_landed(spark: SparkSession, path: str, stations: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """The landed rows of the wanted stations; zone folders that are not wanted are not read."""
    table = spark.read.parquet(path)
    if zones is not None:
        table = table.where(F.col("zone").isin(zones))
    return table.join(stations.select("zone", "station").distinct(), ["zone", "station"], "left_semi")


def land_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` to ``folder``/``name`` and gives ``path`` and ``length``; the tasks write, nothing passes the driver.

    A file gets its name when it is whole, so a task that is run again leaves the same files. The folder is any that Arrow's
    file systems reach.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            paths, lengths = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                path = f"{root.rstrip('/')}/{name}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{path}.part") as out:
                    out.write(content.as_buffer())
                system.move(f"{path}.part", path)
                paths.append(path)
                lengths.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

    return files.select("name", "content").mapInArrow(write, "path string, length long")


def refresh(
    spark: SparkSession, folder: str, name: str, files: DataFrame, summarise: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Partial results of files, brought up to date by reading only what changed.

    ``files`` lists what is there (``path``, ``length``, ``modified``). ``summarise`` gets the listed files that have to be read and
    gives any number of rows for each, with its ``path``. What it gave is kept beside the manifest of the files it came from. A file
    of the same length and time keeps its rows unread, a changed one has them replaced, one that is gone loses them.
    Each state is a version of its own, written to the end before it counts. The list is written first, so that all that follows sees
    the same files; lists are joined by sorting, since a broadcast one would have to pass the driver.
    """
    root, version = f"{folder.rstrip('/')}/{name}", 0
    while path_exists(spark, f"{root}/{version + 1}/manifest/_SUCCESS"):
        version += 1
    new = f"{root}/{version + 1}"
    files.select("path", "length", "modified").write.mode("overwrite").parquet(f"{new}/listed")
    listed = spark.read.parquet(f"{new}/listed")
    if version:
        known = spark.read.parquet(f"{root}/{version}/manifest").hint("merge")
        same = listed.join(known, ["path", "length", "modified"], "left_semi").select("path")
        kept = spark.read.parquet(f"{root}/{version}/rows").join(same.hint("merge"), "path", "left_semi")
        changed = listed.join(known, ["path", "length", "modified"], "left_anti")
    else:
        kept, changed = None, listed
    found = summarise(changed)
    (found if kept is None else found.unionByName(kept)).write.mode("overwrite").parquet(f"{new}/rows")
    listed.write.mode("overwrite").parquet(f"{new}/manifest")  # last, as it makes the version count
    return spark.read.parquet(f"{new}/rows")
