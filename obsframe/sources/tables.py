"""Readers for delimited and fixed-column text: one declared schema per source, no inference.

Every reader has a parsing half that takes a DataFrame, so the same code serves files and
text already held in a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.functions import scalar as S

# Month names as the files spell them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Zonal columns of the annual file and the names they are given.
ZONES = {
    "Glob": "ta_global", "NHem": "ta_nhem", "SHem": "ta_shem",
    "24N-90N": "ta_nband", "24S-24N": "ta_cband", "90S-24S": "ta_sband",
    "64N-90N": "ta_nfrigid", "44N-64N": "ta_ntemperate", "24N-44N": "ta_nsubtropical", "EQU-24N": "ta_ntorrid",
    "24S-EQU": "ta_storrid", "44S-24S": "ta_ssubtropical", "64S-44S": "ta_stemperate", "90S-64S": "ta_sfrigid",
}

# Measure columns of the monthly anomaly file after the year.
MONTHLY_MEASURES = (*[m.lower() for m in MONTHS], "j_d", "d_n", "djf", "mam", "jja", "son")


def schema_of(columns: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()])


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], **options) -> DataFrame:
    """A headed CSV with a declared schema; a cell that does not fit its type becomes NULL."""
    return spark.read.schema(schema_of(columns)).options(header=True, mode="PERMISSIVE", **options).csv(path)


def annual_carbon(spark: SparkSession, path: str, source: str) -> DataFrame:
    columns = {"year": "int", "data_mean_global": "double", "data_mean_nh": "double", "data_mean_sh": "double"}
    return read_csv(spark, path, columns).select(
        F.lit(source).alias("co2_source"), "year", F.col("data_mean_global").alias("co2_global"),
        F.col("data_mean_nh").alias("co2_nhem"), F.col("data_mean_sh").alias("co2_shem"),
    )


def annual_reconstruction(spark: SparkSession, path: str, source: str) -> DataFrame:
    columns = {"Year": "int", "Age": "int", "TempVs61to90": "double", "TempVs50to80": "double"}
    return read_csv(spark, path, columns).select(
        F.lit(source).alias("ta_source"), F.col("Year").alias("year"), F.col("TempVs50to80").alias("ta_global")
    )


def annual_zones(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Zonal table read as text; the missing mark and anything else unreadable become NULL."""
    raw = read_csv(spark, path, {"Year": "int", **{z: "string" for z in ZONES}})
    return raw.select(
        F.lit(source).alias("ta_source"), F.col("Year").alias("year"),
        *[S.to_double(F.col(f"`{z}`")).alias(n) for z, n in ZONES.items()],
    )


def daily_sunspots(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Semicolon-separated, no header, -1 for a missing value."""
    names = ("year", "month", "day", "date_decimal", "sunspots", "sunspot_sd", "obs_count", "definite")
    raw = spark.read.schema(schema_of({n: "string" for n in names})).options(
        sep=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    ).csv(path)
    return raw.select(
        S.safe_date(S.to_int("year"), S.to_int("month"), S.to_int("day")).alias("date"),
        S.null_if(S.to_int("sunspots"), -1).alias("sunspots"), F.lit(source).alias("sunspots_source"),
        S.null_if(S.to_double("sunspot_sd"), -1.0).alias("sunspots_sd"),
        S.to_int("obs_count").alias("sunspots_observations"), S.to_int("definite").alias("sunspots_definite"),
    )


def monthly_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """Files with a title line above the header: only lines that start with a year are data."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    data = lines.where(F.col("value").rlike(r"^\s*\d{4},"))
    cells = F.split("value", ",")
    return data.select(
        "file_name", S.to_int(cells[0]).alias("year"),
        *[S.to_double(F.get(cells, F.lit(i + 1))).alias(n) for i, n in enumerate(MONTHLY_MEASURES)],
    )


def commented_annual(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``#`` comment lines, then the year in columns 3-6 and the value in 7-15."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(
        F.lit(source).alias("co2_source"), S.cut("value", 3, 6).try_cast("int").alias("year"),
        S.cut("value", 7, 15).try_cast("double").alias("co2_global"),
    )


def daily_irradiance(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Prose above fixed columns: date 2-7 (two-digit year), day 8-16, value 17-27, -99 missing.

    Data lines are known by their form, so a file may be split anywhere and needs no line count.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"^.\d{6}\s+-?\d"))
    return lines.select(
        S.century_date(F.substring("value", 2, 6)).alias("date"),
        S.null_if(S.cut("value", 17, 27).try_cast("double"), -99.0).alias("irradiance"),
        F.lit(source).alias("irradiance_source"),
    )


def whitespace_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Country boxes: a name and four numbers between runs of blanks; the heading is no row."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 5)
    numbers = ("longmin", "latmin", "longmax", "latmax")
    return rows.select(
        F.col("p")[0].alias("country"), *[S.to_double(F.col("p")[i + 1]).alias(n) for i, n in enumerate(numbers)]
    ).where("longmin IS NOT NULL")


# Columns of the country centroid file that are not text.
CENTROID_INT = (
    "FID_", "scalerank", "labelrank", "adm0_dif", "level", "geou_dif", "su_dif", "brk_diff", "mapcolor7", "mapcolor8",
    "mapcolor9", "mapcolor13", "pop_est", "pop_year", "lastcensus", "gdp_year", "wikipedia", "woe_id", "adm0_a3_un",
    "adm0_a3_wb", "name_len", "long_len", "abbrev_len", "tiny", "homepart",
)
CENTROID_DOUBLE = ("gdp_md_est", "Longitude", "Latitude")
# All its columns, in file order.
CENTROID_COLUMNS = (
    "FID the_geom FID_ scalerank featurecla labelrank sovereignt sov_a3 adm0_dif level type admin adm0_a3 geou_dif geounit "
    "gu_a3 su_dif subunit su_a3 brk_diff name name_long brk_a3 brk_name brk_group abbrev postal formal_en formal_fr note_adm0 "
    "note_brk name_sort name_alt mapcolor7 mapcolor8 mapcolor9 mapcolor13 pop_est gdp_md_est pop_year lastcensus gdp_year "
    "economy income_grp wikipedia fips_10 iso_a2 iso_a3 iso_n3 un_a3 wb_a2 wb_a3 woe_id adm0_a3_is adm0_a3_us adm0_a3_un "
    "adm0_a3_wb continent region_un subregion region_wb name_len long_len abbrev_len tiny homepart Longitude Latitude"
).split()


def country_centroids(spark: SparkSession, path: str) -> DataFrame:
    """The wide typed country dimension under its own column names."""
    kinds = {c: "int" for c in CENTROID_INT} | {c: "double" for c in CENTROID_DOUBLE}
    return read_csv(spark, path, {c: kinds.get(c, "string") for c in CENTROID_COLUMNS})


def wide_months_annual(df: DataFrame) -> DataFrame:
    """The annual total of a wide station file; text that is no number is left out."""
    return df.select("station", "year", S.to_double("annual").alias("annual")).where("annual IS NOT NULL")


def wide_months_long(df: DataFrame, months: Sequence[str] = tuple(f"m{i}" for i in range(1, 13))) -> DataFrame:
    """Twelve text columns to one row per month, keeping what reads as a number."""
    long = df.unpivot(["station", "year"], list(months), "month", "rain")
    number = F.array_position(F.array(*map(F.lit, months)), F.col("month")).cast("int")
    return long.select("station", "year", number.alias("month"), S.to_double("rain").alias("rain")).where("rain IS NOT NULL")
