"""Per-station zip archives of CSV files: decode, load, validate."""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.functions import scalar as S

LINES_PER_BATCH = 20_000  # lines sent on at a time
GATHERED_LINES = 2_000  # lines of short archives sent on together: few, so that Spark parses some while more are read
SHORT_BYTES = 1 << 20  # a member up to this length is unpacked once and kept while its lines are sent
FILES_PER_TASK, BYTES_PER_TASK = 1_000, 32 << 20  # files that a task opens, by number and by length together
LISTED_PER_BATCH, OPENED_PER_BATCH = 10_000, 4 << 20  # files listed, and bytes of content, sent on at a time


@dataclass(frozen=True)
class Product:
    """One kind of archive: the member's name for a station and the heading of its columns."""

    name: str
    member: str
    file_name: str
    value: str
    days: str

    def member_of(self, station: str) -> str:
        return self.member.format(code=station)

    def file_of(self, station: str) -> str:
        return self.file_name.format(code=station)


# File names and column headings of the three daily products.
PRODUCT_CODE, STATION_NUMBER = "Product code", "Bureau of Meteorology station number"
RAINFALL = Product(
    "rainfall", "IDCJAC0009_{code}_1800_Data.csv", "Station_{code}.zip",
    "Rainfall amount (millimetres)", "Period over which rainfall was measured (days)",
)
MAX_TEMP = Product(
    "max_temp", "IDCJAC0010_{code}_1800_Data.csv", "IDCJAC0010_{code}_1800.zip",
    "Maximum temperature (Degree C)", "Days of accumulation of maximum temperature",
)
MIN_TEMP = Product(
    "min_temp", "IDCJAC0011_{code}_1800_Data.csv", "IDCJAC0011_{code}_1800.zip",
    "Minimum temperature (Degree C)", "Days of accumulation of minimum temperature",
)


def heading(product: Product) -> list[str]:
    return [PRODUCT_CODE, STATION_NUMBER, "Year", "Month", "Day", product.value, product.days, "Quality"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("station", F.regexp_extract(name, r"_(\d+)(?:_1800)?\.zip$", 1))


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(station, content) of every zip below a folder; the code is the digits in the file name."""
    return _named(_files(spark, path)).select("station", "content")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers give it, with its scheme."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified folder, and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _reached(folder: str) -> bool:
    """Whether tasks can list and open a folder themselves; any other is left to Spark's reader, whose list of files the driver holds."""
    try:
        system, root = _store(folder)
        return system.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _entries(system: fs.FileSystem, root: str, deep: bool) -> Iterator[fs.FileInfo]:
    """The zips of a folder, and its folders or (``deep``) what they hold; names and empty files that Spark's readers pass over are left out."""
    for info in system.get_file_info(fs.FileSelector(root)):
        name, folder = info.base_name, info.type == fs.FileType.Directory
        if name.startswith(".") or name.startswith("_") and "=" not in name and not (folder and name.startswith(("_metadata", "_common_metadata"))):
            continue
        if folder:
            yield from _entries(system, info.path, True) if deep else [info]
        elif info.is_file and info.size and name.endswith(".zip"):
            yield info


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``station``, ``path``, ``length`` and time (``modified``) of every zip below a folder; no content is read.

    Tasks list the folders, one for each folder at the top, so the driver holds no list of files. Each use lists anew.
    """
    folder = _qualified(spark, path)
    if not _reached(folder):
        return _named(_files(spark, path)).select("station", "path", "length", F.col("modificationTime").alias("modified"))

    names = ["path", "length", "modified"]

    def listed(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = _store(folder)
            for batch in batches:
                is_folder = pa.compute.is_null(batch.column("length"))
                yield pa.RecordBatch.from_arrays(batch.filter(pa.compute.invert(is_folder)).columns, names)
                for start in batch.filter(is_folder).column("path").to_pylist():
                    found = _entries(system, root + start[len(folder):], deep)
                    while held := list(itertools.islice(found, LISTED_PER_BATCH)):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([folder + i.path[len(root):] for i in held], pa.string()),
                            pa.array([i.size if i.is_file else None for i in held], pa.int64()),
                            pa.array([(i.mtime_ns or 0) // 1_000_000 for i in held], pa.int64()),  # milliseconds, as Spark's readers have it
                        ], names)
        return walk

    schema = "path string, length long, modified long"
    top = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("modified"))
    dealt = top.mapInArrow(listed(False), schema).repartition(spark.sparkContext.defaultParallelism, "path")
    return _named(dealt.mapInArrow(listed(True), schema)).select("station", "path", "length", F.timestamp_millis("modified").alias("modified"))


def open_files(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """(station, path, content) of the ``chosen`` files (``path``, ``length``) below a folder; no other file's content is read.

    They are counted first and dealt into as many tasks as they need, which read them. A file that is gone by then is an error.
    """
    folder = _qualified(spark, path)
    if not _reached(folder):
        return _named(_files(spark, path).join(chosen.select("path"), "path", "left_semi")).select("station", "path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(folder)
        paths, contents, held = [], [], 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        for batch in batches:
            for name in batch.column("path").to_pylist():
                with system.open_input_stream(root + name[len(folder):], compression=None) as file:
                    content = file.read()
                if paths and held + len(content) > OPENED_PER_BATCH:
                    yield gathered()
                    paths, contents, held = [], [], 0
                paths.append(name)
                contents.append(content)
                held += len(content)
        if paths:
            yield gathered()

    below = chosen.where(F.startswith("path", F.lit(f"{folder}/")))
    count, length = below.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // FILES_PER_TASK), -(-length // BYTES_PER_TASK))
    dealt = below.select("path").repartition(tasks, "path").dropDuplicates(["path"])
    return _named(dealt.mapInArrow(read, "path string, content binary")).select("station", "path", "content")


# What a damaged, encrypted or unsupported archive can raise.
READ_ERRORS = (zipfile.BadZipFile, zlib.error, KeyError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError)


def _tested(archive: zipfile.ZipFile, member: str) -> bytes | None:
    """Reads a member to its end, where its checksum is compared, and keeps nothing but a short one (else None)."""
    with archive.open(member) as raw:
        kept = raw.read(SHORT_BYTES + 1)
        if len(kept) <= SHORT_BYTES:
            return kept
        while raw.read(1 << 20):
            pass
    return None


def _lines_of(content: bytes, member: str) -> Iterator[list[str]]:
    """The lines of a member in batches; an archive with any fault raises its error before the first of them."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    short = _tested(archive, member)
    with archive, io.BytesIO(short) if short is not None else archive.open(member) as raw:
        lines = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
        while held := [line.rstrip("\r\n") for line in itertools.islice(lines, LINES_PER_BATCH)]:
            yield held


def archive_lines(archives: DataFrame, product: Product) -> DataFrame:
    """The text lines of each archive's member, read as a stream and sent on in batches.

    Gives (station, line, error), and ``path`` where the archives have one. A member is first read through to its checksum, then line by line, so a broken
    archive of any length gives one row with its error and no line. A short member is unpacked once; the lines of short archives go on together.
    """

    named = "path" in archives.columns
    fields = ["station", "line", "error", *["path"] * named]

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[str, str, list[str | None], str | None]] = []  # station, path, lines, error
        waiting = 0

        def gathered() -> pa.RecordBatch:
            counts = np.array([len(p[2]) for p in parts])
            spread = pa.array(np.repeat(np.arange(len(parts)), counts))
            columns = {
                "station": pa.array([p[0] for p in parts], pa.string()).take(spread),
                "line": pa.array(list(itertools.chain.from_iterable(p[2] for p in parts)), pa.string()),
                "error": pa.array([p[3] for p in parts], pa.string()).take(spread),
                "path": pa.array([p[1] for p in parts], pa.string()).take(spread),
            }
            return pa.RecordBatch.from_arrays([columns[f] for f in fields], fields)

        for batch in batches:
            stations = batch.column("station").to_pylist()
            paths = batch.column("path").to_pylist() if named else stations
            for station, content, path in zip(stations, batch.column("content"), paths):
                found = _lines_of(content.as_buffer(), product.member_of(station))
                while True:
                    try:
                        held = next(found, None)
                    except READ_ERRORS as problem:
                        parts.append((station, path, [None], type(problem).__name__))
                        break
                    if held is None:
                        break
                    parts.append((station, path, held, None))
                    waiting += len(held)
                    if waiting >= GATHERED_LINES:
                        yield gathered()
                        parts, waiting = [], 0
                if len(parts) >= GATHERED_LINES:
                    yield gathered()
                    parts, waiting = [], 0
        if parts:
            yield gathered()

    columns = ["station", "content", *["path"] * named]
    return archives.select(*columns).mapInArrow(unzip, "station string, line string, error string" + ", path string" * named)


def _cells(lines: DataFrame) -> DataFrame:
    parts = "code string, number string, year string, month string, day string, value string, days string, quality string"
    data = lines.where(F.col("line").isNotNull() & ~F.col("line").startswith(PRODUCT_CODE) & (F.trim("line") != ""))
    own = [c for c in ("station", "path") if c in lines.columns]
    return data.select(*own, F.from_csv("line", F.lit(parts), {"mode": "PERMISSIVE"}).alias("c")).select(*own, "c.*")


def load_archives(archives: DataFrame, product: Product, source: str, zone: str = "AUS") -> DataFrame:
    """Observations of all archives, with their ``path`` where they have one; an unreadable cell is NULL, an unreadable archive has no rows."""
    return _cells(archive_lines(archives, product)).select(
        *["path"] * ("path" in archives.columns), F.lit(zone).alias("zone"), F.trim("number").alias("station"),
        S.safe_date(S.to_int("year"), S.to_int("month"), S.to_int("day")).alias("date"),
        S.to_double("value").alias("value"), S.to_int("days").alias("measurement_days"), F.lit(source).alias("source"),
    )


def load_stations(spark: SparkSession, path: str, product: Product, stations: DataFrame, source: str) -> DataFrame:
    """Only the archives of the wanted stations are opened; a station without one is skipped."""
    # The names alone are read for the choice; the join then drops whole files before their content travels.
    wanted = list_files(spark, path).join(stations.select("station").distinct(), "station", "left_semi")
    return load_archives(open_files(spark, path, wanted).select("station", "content"), product, source)


def _counted(archives: DataFrame, product: Product) -> DataFrame:
    """(station, rows, error) of each archive; its lines are counted where they are read and go no further."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stations, rows, errors = batch.column("station").to_pylist(), [], []
            for station, content in zip(stations, batch.column("content")):
                n, error = 0, None
                try:
                    for held in _lines_of(content.as_buffer(), product.member_of(station)):
                        n += sum(not line.startswith(PRODUCT_CODE) and line.strip(" ") != "" for line in held)
                except READ_ERRORS as problem:
                    error = type(problem).__name__
                rows.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [pa.array(stations, pa.string()), pa.array(rows, pa.int64()), pa.array(errors, pa.string())], ["station", "rows", "error"]
            )

    return archives.select("station", "content").mapInArrow(count, "station string, rows long, error string")


def validate_archives(stations: DataFrame, archives: DataFrame, product: Product) -> DataFrame:
    """One row per station of the list: status, error and number of data rows; the archives are read once."""
    found = _counted(archives, product).groupBy("station").agg(
        F.sum("rows").alias("rows"), F.max("error").alias("error"), F.lit(True).alias("present")
    )
    status = (
        F.when(F.col("present").isNull(), "Data Missing").when(F.col("error").isNotNull(), "Read Error")
        .when(F.coalesce("rows", F.lit(0)) == 0, "No Data").otherwise("Good")
    )
    listed = stations.select("station").distinct()
    return listed.join(found, "station", "left").select(
        "station", status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def pack_archives(rows: DataFrame, product: Product) -> DataFrame:
    """Station rows (station, line) as zip archives, one per station and Arrow batch.

    The inverse of ``load_archives``. A station's rows may be spread over several archives,
    so none grows with the station.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = ",".join(heading(product))
        for pdf in batches:
            held: dict[str, list[str]] = {}
            for station, line in zip(pdf["station"], pdf["line"]):
                held.setdefault(station, [head]).append(line)
            codes, contents = list(held), []
            for station, lines in held.items():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(product.member_of(station), "\n".join(lines) + "\n")
                contents.append(out.getvalue())
            yield pd.DataFrame({"station": codes, "content": contents})

    return rows.select("station", "line").mapInPandas(pack, "station string, content binary")


def pack_stations(rows: DataFrame, product: Product) -> DataFrame:
    """One zip archive per station, as the files have it; a station's rows are bounded by the calendar."""
    head = ",".join(heading(product))

    def pack(table: pa.Table) -> pa.Table:
        station, out = table["station"][0].as_py(), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(product.member_of(station), "w") as member:
            member.write(f"{head}\n".encode())
            for batch in table.sort_by("line").to_batches(LINES_PER_BATCH):
                member.write("".join(f"{line}\n" for line in batch.column("line").to_pylist()).encode())
        return pa.table({"station": [station], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.select("station", "line").groupBy("station").applyInArrow(pack, "station string, content binary")
