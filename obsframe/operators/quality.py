"""Station summaries, cleaning rules and baseline-station selection.

All operators expect one row per (zone, station, date). A station then holds at most one
row per calendar day, so the quantiles of a station, decade or year are bounded groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.aggregates import agg_columns, counted_summary, variable_summary
from obsframe.functions.scalar import decade, hash_key, in_years, percent, ratio
from obsframe.operators import ranking
from obsframe.session import pin

KEYS = ["zone", "station"]


@dataclass(frozen=True)
class CleanInfo:
    """What a clean year and a clean station must reach (all limits strict but the box)."""

    name: str
    longitude_lim: tuple[float, float] = (112.0, 155.0)
    latitude_lim: tuple[float, float] = (-44.0, -10.0)
    yearly_n_target: float = 360
    yearly_present_target: float = 360 / 4
    clean_years_target: int = 30


TEMPERATURE = CleanInfo("temperature")
RAINFALL = CleanInfo("rainfall", yearly_present_target=350, clean_years_target=50)


def grain_summary(
    observations: DataFrame, variable: str, grains: tuple[str, ...] = ("all", "decadal", "yearly"), keys: list[str] = KEYS
) -> DataFrame:
    """The variable summary of all stations at several grains.

    The rows become counts of each value per station and year; every grain is rolled up from these counts, exact
    quantiles included. Rows that are dealt by ``keys`` already are not shuffled again.
    """
    sets = {"all": keys, "decadal": [*keys, "decade"], "yearly": [*keys, "year"]}
    df = observations.select(*keys, F.year("date").alias("year"), F.col(variable))
    if len(grains) == 1:
        return df.withColumn("decade", decade("year")).groupBy(*sets[grains[0]]).agg(*agg_columns(variable_summary(variable)))
    cells = df.groupBy(*keys, "year", variable).agg(F.count(F.lit(1)).alias("rows")).withColumn("decade", decade("year"))
    # Not grouping sets, which would forget how the rows are dealt.
    parts = [
        F.struct(F.lit(g).alias("grain"), *[(F.col(c) if c in sets[g] else F.lit(None).cast("int")).alias(c) for c in ("decade", "year")])
        for g in grains
    ]
    spread = cells.select(*keys, variable, "rows", F.inline(F.array(*parts)))
    summary = counted_summary(variable, "rows")
    return spread.groupBy("grain", *keys, "decade", "year").agg(*agg_columns(summary))


def yearly_summary(observations: DataFrame, variable: str) -> DataFrame:
    return (
        observations.groupBy(*KEYS, F.year("date").alias("year"))
        .agg(*agg_columns(variable_summary(variable)))
    )


def yearly_counts(observations: DataFrame, variable: str) -> DataFrame:
    """The counts the cleaning rules read; everything coarser is rolled up from here."""
    x = F.col(variable)
    return observations.groupBy(*KEYS, F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("n_present"),
        F.count_if(x == 0).alias("n_zero"), F.count_if(x != 0).alias("n_nonzero"),
    )


def nested_years(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with its years nested as an ordered array of structs."""
    yearly = df.groupBy(*keys, F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("top")
    )
    return yearly.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "n", "top"))).alias("yearly"))


def observation_summary(stations: DataFrame, observations: DataFrame, variable: str, validated: DataFrame | None = None) -> DataFrame:
    """Status, year range and overall counts of every listed station, loaded or not.

    ``validated`` (station, status, error) is what the validator of the archives found; a station listed twice is
    "Duplicate" whatever it found, and one without observations is never "Good".
    """
    listed = stations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("listed"))
    overall = yearly_counts(observations, variable).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_year"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.sum("n").alias("n"), F.sum("n_present").alias("n_present"),
        F.sum("n_zero").alias("n_zero"), F.sum("n_nonzero").alias("n_nonzero"),
    )
    status = (
        F.when(F.col("listed") > 1, "Duplicate").when(F.col("n").isNull(), "Data Missing").otherwise("Good")
    )
    good = F.col("status") == "Good"
    joined = listed.join(overall, KEYS, "left")
    if validated is not None:
        joined = joined.join(validated.select("station", F.col("status").alias("found"), "error"), "station", "left")
        bad = F.col("found") != "Good"
        status = F.when(F.col("listed") > 1, "Duplicate").when(bad, F.col("found")).otherwise(status)
        joined = joined.withColumns({"status": status, "error": F.coalesce("error", F.lit(""))}).drop("found")
    else:
        joined = joined.withColumn("status", status)
    blank = {c: F.when(good, F.col(c)) for c in ("min_year", "max_year")}
    zero = {c: F.when(good, F.col(c)).otherwise(F.lit(0)) for c in ("n_year", "n", "n_present", "n_zero", "n_nonzero")}
    return joined.withColumns({**blank, **zero}).withColumn("n_na", F.col("n") - F.col("n_present")).drop("listed")


def quality_summary(stations: DataFrame, observations: DataFrame, variable: str) -> DataFrame:
    """The overall summary with coverage percentages and coordinates."""
    summary = observation_summary(stations, observations, variable).withColumns({
        "n_pct": percent("n", F.col("n_year") * 365),
        "na_pct": percent("n_na", "n"),
        "zero_pct": percent("n_zero", F.col("n_zero") + F.col("n_nonzero")),
    })
    return summary.join(stations.select(*KEYS, "latitude", "longitude"), KEYS)


def inside(info: CleanInfo) -> tuple[Column, Column]:
    return (
        F.col("longitude").between(*info.longitude_lim),
        F.col("latitude").between(*info.latitude_lim),
    )


def station_screen(quality: DataFrame, info: CleanInfo, min_years: int = 25, na_percent: float = 25.0) -> DataFrame:
    """Good stations in the box with real readings, enough years and the given NA share or more."""
    lon, lat = inside(info)
    return quality.where(
        (F.col("status") == "Good") & lon & lat & (F.col("n_nonzero") > 0)
        & (F.col("n_year") >= min_years) & (F.col("na_pct") >= na_percent)
    )


def station_consistency(
    stations: DataFrame, observations: DataFrame, variable: str, min_n: int = 350, cutoff: float = 0.25, min_years: int = 30
) -> DataFrame:
    """Stations with more than ``min_years`` years of steady records, and how many they have."""
    steady = (
        yearly_counts(observations, variable)
        .where((F.col("n") > min_n) & (ratio("n_present", "n") > cutoff))
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_consistent"))
    )
    summary = observation_summary(stations, observations, variable)
    return (
        summary.join(steady, KEYS, "left")
        .withColumn("n_consistent", F.coalesce("n_consistent", F.lit(0)))
        .withColumn("present_ratio", ratio("n_present", "n"))
        .where(F.col("n_consistent") > min_years)
    )


def clean_years(yearly: DataFrame, info: CleanInfo) -> DataFrame:
    """Yearly counts with the two targets and the verdict."""
    met = F.col("n") > info.yearly_n_target
    present = F.col("n_present") > info.yearly_present_target
    return yearly.withColumns({"n_target_met": met, "n_present_target_met": present, "year_clean": met & present})


def clean_summary(stations: DataFrame, yearly: DataFrame, info: CleanInfo) -> DataFrame:
    """One verdict per station, from its yearly counts and its place."""
    flagged = clean_years(yearly, info)
    per_station = flagged.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_year"), F.count_if("year_clean").alias("clean_years"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.sum("n_nonzero").alias("n_nonzero"),
    )
    lon, lat = inside(info)
    available = F.col("n_year").isNotNull() & (F.col("listed") == 1)  # a station listed twice is not to be trusted
    known = ranking.first_per_key(stations, KEYS, ["name", "latitude", "longitude"])
    known = known.join(stations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("listed")), KEYS)
    return known.join(per_station, KEYS, "left").select(
        *KEYS, "name", "latitude", "longitude",
        available.alias("data_available"), (available & lon).alias("longitude_target_met"),
        (available & lat).alias("latitude_target_met"),
        F.coalesce(F.col("n_nonzero") > 0, F.lit(False)).alias("is_present_target_met"),
        "n_year", "clean_years", "min_year", "max_year",
        F.coalesce(
            available & lon & lat & (F.col("n_nonzero") > 0) & (F.col("clean_years") > info.clean_years_target),
            F.lit(False),
        ).alias("clean"),
    )


def clean_station_years(stations: DataFrame, observations: DataFrame, variable: str, info: CleanInfo) -> DataFrame:
    yearly = yearly_counts(observations, variable)
    good = clean_summary(stations, yearly, info).where("clean").select(*KEYS)
    return clean_years(yearly, info).where("year_clean").select(*KEYS, "year").join(good, KEYS, "left_semi")


def clean_observations(stations: DataFrame, observations: DataFrame, variable: str, info: CleanInfo) -> DataFrame:
    """The observations made in the clean years of clean stations."""
    wanted = clean_station_years(stations, observations, variable, info)
    return observations.withColumn("year", F.year("date")).join(wanted, [*KEYS, "year"], "left_semi").drop("year")


def baseline_stations(
    stations: DataFrame, observations: DataFrame, variable: str, info: CleanInfo, start: int, end: int,
    needed_years: int | None = None,
) -> DataFrame:
    """Clean stations with at least ``needed_years`` clean years in the baseline (all of them by default)."""
    needed = end - start + 1 if needed_years is None else needed_years
    counted = (
        clean_station_years(stations, observations, variable, info)
        .where(F.col("year").between(start, end))
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_years")).where(F.col("n_years") >= needed)
    )
    return stations.join(counted, KEYS)


def baseline_stations_ratio(
    stations: DataFrame, observations: DataFrame, variable: str, start: int, end: int, qualifying_ratio: float = 0.90
) -> DataFrame:
    """Stations with enough non-missing days in the baseline."""
    days = (end - start) * 365 * qualifying_ratio
    counted = (
        observations.where(F.col(variable).isNotNull() & in_years("date", start, end))
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_days")).where(F.col("n_days") >= days)
    )
    return stations.join(counted, KEYS)


def baseline_stations_span(stations: DataFrame, observations: DataFrame, start: int, end: int) -> DataFrame:
    """Stations whose record covers the baseline from end to end."""
    span = observations.groupBy(*KEYS).agg(
        F.min(F.year("date")).alias("min_year"), F.max(F.year("date")).alias("max_year")
    ).where((F.col("min_year") <= start) & (F.col("max_year") >= end))
    return stations.join(span, KEYS)


def max_dissimilarity(
    summary: DataFrame, keys: list[str], features: list[str], start: int, more: int, seed: int
) -> DataFrame:
    """A hash-ordered start set, then one by one the row farthest from all chosen rows.

    The summary holds one row per station and is worked out once. Each round is one aggregate that returns one
    row; the chosen rows (``start + more`` in all) travel to the tasks as constants.
    """
    summary = pin(summary)  # read for the moments, the points and the answer
    moments = summary.agg(*[f(c).alias(f"{p}_{c}") for c in features for p, f in (("mean", F.avg), ("sd", F.stddev))]).first()
    z = [
        F.coalesce((F.col(c) - F.lit(moments[f"mean_{c}"])) / F.lit(moments[f"sd_{c}"]), F.lit(0.0)).alias(f"z_{c}")
        if moments[f"sd_{c}"] else F.lit(0.0).alias(f"z_{c}")
        for c in features
    ]
    points = pin(summary.select(*keys, *z, hash_key(seed, *keys).alias("hash_key")))
    names = [f"z_{c}" for c in features]

    def apart(rows) -> Column:
        """Distance to the nearest of the given rows, a whole batch of points at a time."""
        places = [[float(r[n]) for n in names] for r in rows]

        @F.pandas_udf("double")
        def nearest(*columns: pd.Series) -> pd.Series:
            point = [c.to_numpy() for c in columns]
            least = np.full(len(point[0]), np.inf)
            for place in places:
                away = np.zeros(len(least))
                for x, at in zip(point, place):
                    away += (at - x) * (at - x)
                least = np.minimum(least, away)
            return pd.Series(np.sqrt(least))

        return nearest(*names)

    chosen = points.orderBy("hash_key").limit(start).collect()
    steps: list[tuple[int, float | None]] = [(i + 1, None) for i in range(len(chosen))]
    for _ in range(more):
        best = (
            points.withColumn("apart", apart(chosen))
            .agg(F.max_by(F.struct(*keys, *names, "apart"), F.struct("apart", "hash_key")).alias("best"))
            .first()["best"]
        )
        if best is None or best["apart"] <= 0:
            break
        chosen.append(best)
        steps.append((len(steps) + 1, best["apart"]))
    rows = [(*[r[k] for k in keys], step, gap) for r, (step, gap) in zip(chosen, steps)]
    schema = ", ".join([f"{k} string" for k in keys] + ["step int", "min_distance double"])
    picked = summary.sparkSession.createDataFrame(rows, schema)
    return summary.join(picked, keys)
