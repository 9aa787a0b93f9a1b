"""Monthly totals, rolling sums, quantile baselines and ratings.

From the monthly totals on, a station holds twelve rows per calendar year, which bounds
every per-station window and every per-month quantile.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions.aggregates import open_breaks, ordered_values, sorted_breaks, sum_or_zero
from obsframe.operators.quality import KEYS
from obsframe.operators.relational import complete_months, find_interval, impute_group_median, rolling_sums

PERIODS = ["major_period", "minor_period"]
MEASURES = ("rainfall", "rainfall_l3", "rainfall_l12", "rainfall_l24")


def monthly_totals(observations: DataFrame, variable: str = "value") -> DataFrame:
    return observations.groupBy(
        *KEYS, F.year("date").alias("major_period"), F.month("date").alias("minor_period")
    ).agg(
        sum_or_zero(variable).alias("rainfall"), F.min_by("source", "date").alias("rainfall_source")
    )


def monthly_observations(observations: DataFrame, variable: str = "value") -> DataFrame:
    """Totals for every month of each station's record, gaps filled, with rolling sums.

    After the totals one shuffle by station serves the densifying, imputing and rolling.
    """
    full = complete_months(monthly_totals(observations, variable), KEYS)
    filled = impute_group_median(full, [*KEYS, "minor_period"], "rainfall").withColumn(
        "date", F.make_date("major_period", "minor_period", F.lit(1))
    )
    return rolling_sums(filled, KEYS, PERIODS, "rainfall", (3, 6, 12, 24)).select(
        *KEYS, "date", *PERIODS, "rainfall", "rainfall_original",
        "rainfall_l3", "rainfall_l6", "rainfall_l12", "rainfall_l24", "rainfall_source",
    )


def rain_baselines(monthly: DataFrame, start: int, end: int, n_quantile: int = 11) -> DataFrame:
    """Extremes, quartiles and quantile breaks of four measures per station and month."""
    levels = F.array(*map(F.lit, [0.25, 0.5, 0.75]))
    aggs = []
    for m in MEASURES:
        aggs += [
            F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min"), F.percentile(m, levels).alias(f"{m}_levels"),
            ordered_values(m).alias(f"{m}_ordered"),
        ]
    out = monthly.where(F.col("major_period").between(start, end)).groupBy(*KEYS, "minor_period").agg(*aggs)
    cols = []
    for m in MEASURES:
        levels_of = F.col(f"{m}_levels")
        breaks = sorted_breaks(F.col(f"{m}_ordered"), n_quantile)
        cols += [
            F.col(f"{m}_max"), F.col(f"{m}_min"),
            levels_of[0].alias(f"{m}_q1"), levels_of[1].alias(f"{m}_median"), levels_of[2].alias(f"{m}_q3"),
            breaks.alias(f"{m}_quantiles"), open_breaks(breaks, n_quantile).alias(f"{m}_open_quantiles"),
        ]
    return out.select(*KEYS, "minor_period", *cols)


def rain_ratings(monthly: DataFrame, base: DataFrame, n_quantile: int = 11) -> DataFrame:
    """Each measure's place among its station's breaks for the month, 0 for the middle bin."""
    breaks = base.select(*KEYS, "minor_period", "rainfall_l12_median", *[f"{m}_open_quantiles" for m in MEASURES])
    return _rated(monthly.join(breaks, [*KEYS, "minor_period"]), n_quantile)


def rate_months(monthly: DataFrame, start: int, end: int, n_quantile: int = 11) -> DataFrame:
    """Baselines and ratings in one pass: the breaks are read beside the rows they rate.

    The same result as ``rain_ratings(monthly, rain_baselines(monthly, ...))``, without a
    second run of everything that leads to the monthly rows.
    """
    w = Window.partitionBy(*KEYS, "minor_period")
    inside = F.col("major_period").between(start, end)
    levels = F.array(*[F.lit(i / n_quantile) for i in range(n_quantile + 1)])
    beside = monthly.withColumns({
        "baseline_rows": F.count_if(inside).over(w),
        "rainfall_l12_median": F.median(F.when(inside, F.col("rainfall_l12"))).over(w),
        **{f"{m}_levels": F.percentile(F.when(inside, F.col(m)), levels).over(w) for m in MEASURES},
        **{f"{m}_within": F.collect_list(F.when(inside, F.col(m)).cast("double")).over(w) for m in MEASURES},
    }).where("baseline_rows > 0")

    def breaks(m: str) -> Column:
        # The last bit of a break matters only to a value beside it; all other rows take the cheaper ones.
        slack = 1e-9 * (1 + F.abs(F.col(m)))
        near = reduce(Column.__or__, [F.abs(F.col(f"{m}_levels")[i] - F.col(m)) <= slack for i in range(1, n_quantile)])
        exact = sorted_breaks(F.sort_array(F.col(f"{m}_within")), n_quantile)
        return open_breaks(F.when(near, exact).otherwise(F.col(f"{m}_levels")), n_quantile)

    return _rated(beside.withColumns({f"{m}_open_quantiles": breaks(m) for m in MEASURES}), n_quantile)


def _rated(beside: DataFrame, n_quantile: int) -> DataFrame:
    middle = math.ceil(n_quantile / 2)
    rated = beside.withColumns({
        f"{m}_rating": find_interval(F.col(m), F.col(f"{m}_open_quantiles")) - middle for m in MEASURES
    })
    measures = [c for m in MEASURES for c in (m, f"{m}_rating")]
    return rated.select(*KEYS, *PERIODS, "date", "rainfall_l12_median", *measures, "rainfall_source")
