"""Baselines, valuations and anomalies of station observations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.aggregates import sum_or_zero
from obsframe.functions.scalar import in_years, mid_date
from obsframe.operators.quality import KEYS, RAINFALL, TEMPERATURE, CleanInfo
from obsframe.operators.relational import pooled_mean

Expression = Callable[[], Column]


def year_period() -> Column:
    return F.year("date")


def month_period() -> Column:
    return F.month("date")


def day_period() -> Column:
    return F.dayofyear("date")


def constant_period() -> Column:
    return F.lit(0)


@dataclass(frozen=True)
class ValuationInfo:
    """What is valued, over which periods, and against which baseline years.

    ``mutators`` derive columns per observation, ``summarisers`` aggregate them per period
    and ``derived`` adds columns to the period rows; later ones may use earlier ones.
    """

    name: str
    variable: str = "value"
    clean: CleanInfo = TEMPERATURE
    baseline_start: int = 1951
    baseline_end: int = 1980
    major_period: Expression = year_period
    minor_period: Expression = day_period
    mutators: Mapping[str, Expression] = field(default_factory=dict)
    summarisers: Mapping[str, Expression] = field(default_factory=dict)
    derived: Mapping[str, Expression] = field(default_factory=dict)
    output: str | None = None
    scale: bool = False

    @property
    def output_variable(self) -> str:
        return self.output or self.variable

    @property
    def anomaly_variable(self) -> str:
        return f"{self.variable}_anomaly"


def temperature_valuation(**changes) -> ValuationInfo:
    return ValuationInfo("temperature", **changes)


def rainfall_valuation(variable: str = "value", **changes) -> ValuationInfo:
    """Monthly totals, their shifted square root, and a scaled anomaly of that."""
    return ValuationInfo(
        "rainfall", variable=variable, clean=RAINFALL, minor_period=month_period,
        summarisers={"monthly_total": lambda: sum_or_zero(variable)},
        derived={"sqrt_monthly_total": lambda: F.sqrt(F.col("monthly_total") + 0.1)},
        output="sqrt_monthly_total", scale=True, **changes,
    )


def period_values(observations: DataFrame, info: ValuationInfo) -> DataFrame:
    """Observations with their periods and derived columns, summarised if asked for."""
    df = observations.withColumns({"major_period": info.major_period(), "minor_period": info.minor_period()})
    for name, make in info.mutators.items():
        df = df.withColumn(name, make())
    if info.summarisers:
        df = df.groupBy(*KEYS, "major_period", "minor_period").agg(
            *[make().alias(name) for name, make in info.summarisers.items()],
            mid_date(F.min("date"), F.max("date")).alias("median_date"),
            F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        )
    else:
        df = df.withColumns({c: F.col("date") for c in ("median_date", "min_date", "max_date")})
    for name, make in info.derived.items():
        df = df.withColumn(name, make())
    names = [] if info.summarisers else [info.variable, *info.mutators]
    names += [*info.summarisers, *info.derived]
    return df.select(*KEYS, "major_period", "minor_period", *dict.fromkeys(names), "median_date", "min_date", "max_date")


def baselines(observations: DataFrame, info: ValuationInfo) -> DataFrame:
    """Count, mean and spread of the output per station and minor period in the baseline years."""
    if info.major_period is year_period:
        inside = in_years("date", info.baseline_start, info.baseline_end)
    else:
        inside = info.major_period().between(info.baseline_start, info.baseline_end)
    within = observations.where(inside)
    out = info.output_variable
    return period_values(within, info).groupBy(*KEYS, "minor_period").agg(
        F.count(out).alias("baseline_n"), F.avg(out).alias("baseline_mean"), F.stddev(out).alias("baseline_sd")
    )


def valuations(observations: DataFrame, info: ValuationInfo, base: DataFrame | None = None) -> DataFrame:
    """Period values beside their baseline; the anomaly is NULL where there is no baseline."""
    values = period_values(observations, info)
    if base is None:
        return values
    joined = values.join(base.drop("baseline_n"), [*KEYS, "minor_period"], "left")
    gap = F.col(info.output_variable) - F.col("baseline_mean")
    return joined.withColumn(info.anomaly_variable, F.try_divide(gap, F.col("baseline_sd")) if info.scale else gap)


def smoothed_baselines(observations: DataFrame, variable: str, start: int, end: int, k: int = 5) -> DataFrame:
    """Day-of-year baselines pooled over each day and its ``k`` neighbours on both sides."""
    df = observations.withColumn("doy", F.dayofyear("date"))
    return pooled_mean(df, KEYS, ["date"], variable, [*KEYS, "doy"], in_years("date", start, end), k, f"{variable}_baseline")


def smoothed_anomalies(observations: DataFrame, variable: str, base: DataFrame) -> DataFrame:
    """Observations less their pooled baseline; days without a baseline are left out."""
    return (
        observations.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})
        .join(base, [*KEYS, "doy"])
        .withColumn(f"{variable}_anomaly", F.col(variable) - F.col(f"{variable}_baseline"))
    )


def yearly_station_anomaly(values: DataFrame, anomaly: str, stations: DataFrame) -> DataFrame:
    yearly = values.groupBy(*KEYS, "major_period").agg(F.avg(anomaly).alias(anomaly))
    return yearly.join(stations, KEYS)


def yearly_region_anomaly(values: DataFrame, anomaly: str) -> DataFrame:
    """Mean over all station-days of a zone and year, and the number of stations behind it."""
    per_station = values.groupBy("zone", "major_period", "station").agg(
        F.sum(anomaly).alias("anomaly_sum"), F.count(anomaly).alias("anomaly_n")
    )
    return per_station.groupBy("zone", "major_period").agg(
        F.try_divide(F.sum("anomaly_sum"), F.sum("anomaly_n").cast("double")).alias(anomaly),
        F.count(F.lit(1)).alias("n_stations"),
    )


def versus_global(regional: DataFrame, series: DataFrame, year: str, value: str) -> DataFrame:
    """A global series cut to the years the regional one covers, joined to it."""
    span = regional.agg(F.struct(F.min("major_period").alias("first"), F.max("major_period").alias("last")).alias("s")).select("s").scalar()
    cut = series.where(F.col(year).between(span.getField("first"), span.getField("last")))
    return regional.join(cut.select(F.col(year).alias("major_period"), value), "major_period")


def box_trend(values: DataFrame, stations: DataFrame, anomaly: str, after: int, west: float, south: float) -> DataFrame:
    """Mean anomaly per date of the stations east of one meridian and south of one parallel."""
    inside = stations.where((F.col("longitude") > west) & (F.col("latitude") < south)).select(*KEYS)
    return (
        values.where(F.col("major_period") > after).join(inside, KEYS, "left_semi")
        .groupBy("median_date").agg(F.avg(anomaly).alias(anomaly))
    )
