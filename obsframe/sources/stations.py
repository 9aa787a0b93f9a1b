"""Fixed-width station lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.functions import scalar as S


def parse_station_lines(lines: DataFrame, zone: str) -> DataFrame:
    """Code 3-7, name 9-48, latitude 49-57, longitude 59-67, first and last month, years, percent, flag.

    A line is a station when its code is a number and both coordinates can be read, which
    headings, rulers and notes never are; so the list needs no line order and may be split.
    """
    code = S.cut("value", 3, 7)
    parsed = lines.select(
        F.lit(zone).alias("zone"), code.alias("station"), S.cut("value", 9, 48).alias("name"),
        S.cut("value", 49, 57).try_cast("double").alias("latitude"),
        S.cut("value", 59, 67).try_cast("double").alias("longitude"),
        F.nullif(S.cut("value", 69, 76), F.lit("")).alias("start_month"),
        F.nullif(S.cut("value", 78, 85), F.lit("")).alias("end_month"),
        S.cut("value", 87, 92).try_cast("double").alias("years"),
        S.cut("value", 95, 97).try_cast("int").alias("percent"),
        F.nullif(S.cut("value", 101, 101), F.lit("")).alias("aws"),
    )
    return parsed.where(
        F.col("station").rlike(r"^\d{4,6}$") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )


def read_stations(spark: SparkSession, path: str, zone: str = "AUS") -> DataFrame:
    """Lines may end in any mix of carriage returns and newlines."""
    return parse_station_lines(spark.read.text(path), zone)
