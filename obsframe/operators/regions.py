"""Grouping stations into regions and following the regions through time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.functions.scalar import period_index
from obsframe.operators import ranking
from obsframe.operators.quality import KEYS
from obsframe.operators.relational import group_scaled, month_lags, scaled, spread
from obsframe.operators.stats import linear_fit
from obsframe.session import pin


def rating_features(
    stations: DataFrame, ratings: DataFrame, start: int, years: int, month: int, weight: float
) -> DataFrame:
    """One row per station: weighted z-scored place, then one z-scored three-month total per year."""
    span = range(start, start + years)
    rows = ratings.where(
        F.col("major_period").between(start, start + years - 1) & (F.col("minor_period") == month)
    ).select(*KEYS, "major_period", "rainfall_l3").join(stations.select(*KEYS, "latitude", "longitude"), KEYS)
    rows = pin(rows)
    z = scaled(scaled(rows, ["latitude", "longitude"], weight=weight), ["rainfall_l3"])
    return spread(
        z.select(*KEYS, "latitude_scaled", "longitude_scaled", "major_period", "rainfall_l3_scaled"),
        [*KEYS, "latitude_scaled", "longitude_scaled"], "major_period", span, "rainfall_l3_scaled", "rainfall_",
    )


def monthly_features(base: DataFrame, column: str, prefix: str) -> DataFrame:
    """Twelve columns per station: one baseline figure for each month."""
    return spread(base, KEYS, "minor_period", range(1, 13), column, prefix)


def anomaly_features(values: DataFrame, anomaly: str, start: int, end: int) -> DataFrame:
    """One column per baseline month, in order, holding the station's anomaly."""
    rows = values.where(F.col("major_period").between(start, end)).withColumn(
        "period", period_index("major_period", "minor_period", start)
    )
    return spread(rows, KEYS, "period", range(1, (end - start + 1) * 12 + 1), anomaly, "anomaly_")


def _vectors(features: DataFrame) -> DataFrame:
    """Feature columns as a vector; a missing feature stands at 0, the mean of a scaled column.

    One row per station, read once per clustering round, so it is kept in the shared folder.
    """
    names = [c for c in features.columns if c not in KEYS]
    filled = features.fillna(0.0, subset=names)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(filled).select(*KEYS, "features")
    return pin(vectors)


def kmeans_regions(features: DataFrame, centers: int, seed: int = 101) -> DataFrame:
    """Station and region id, 1 to ``centers``."""
    vectors = _vectors(features)
    model = KMeans(k=centers, seed=seed, maxIter=50, predictionCol="region").fit(vectors)
    return model.transform(vectors).select(*KEYS, (F.col("region") + 1).alias("region_id"))


def region_sweep(features: DataFrame, centers: Sequence[int], seed: int = 101) -> DataFrame:
    """The clusterings for several numbers of centres, stacked; the matrix is built once."""
    vectors = _vectors(features)
    out = None
    for k in centers:
        model = KMeans(k=k, seed=seed, maxIter=50, predictionCol="region").fit(vectors)
        part = model.transform(vectors).select(*KEYS, F.lit(k).alias("centers"), (F.col("region") + 1).alias("region_id"))
        out = part if out is None else out.unionByName(part)
    return out


def region_order(regions: DataFrame, stations: DataFrame) -> DataFrame:
    """Regions from west to east by their median longitude."""
    rows = regions.join(stations, KEYS)
    middle = ranking.quantiles(rows, ["region_id"], "longitude", {"median_longitude": 0.5})
    counts = rows.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_stations"))
    return middle.join(counts, "region_id").orderBy("median_longitude", "region_id")


def region_series(ratings: DataFrame, regions: DataFrame, column: str) -> DataFrame:
    """Median of a measure over the stations of each region, by date.

    The monthly rows are kept in the shared folder, as they are read more than once.
    """
    rows = pin(ratings.join(regions, KEYS).select("region_id", "date", column))
    return ranking.quantiles(rows, ["region_id", "date"], column, {f"{column}_median": 0.5})


def region_trend(series: DataFrame, value: str) -> DataFrame:
    return linear_fit(series.withColumn("day", F.unix_date("date")), ["region_id"], "day", value)


def region_anomaly(values: DataFrame, regions: DataFrame, anomaly: str, after: int) -> DataFrame:
    return (
        values.where(F.col("major_period") > after).join(regions, KEYS)
        .groupBy("region_id", "median_date").agg(F.avg(anomaly).alias(anomaly))
    )


def region_index(ratings: DataFrame, regions: DataFrame, index: DataFrame) -> DataFrame:
    """Regional median rain and mean rating, z-scored by region, beside a z-scored monthly index."""
    rows = pin(ratings.join(regions, KEYS).select("region_id", "date", "rainfall", "rainfall_rating"))
    rating = rows.groupBy("region_id", "date").agg(F.avg("rainfall_rating").alias("rating"))
    rain = ranking.quantiles(rows.select("region_id", "date", "rainfall"), ["region_id", "date"], "rainfall", {"rain": 0.5})
    regional = group_scaled(rain.join(rating, ["region_id", "date"]), ["region_id"], ["rain", "rating"])
    return regional.join(scaled(index.select("date", "soi"), ["soi"]), "date").withColumns(
        {"year": F.year("date"), "month": F.month("date")}
    )


def seasonal_adjust(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Residual of the month's mean, moved back to the median, and in units of the spread."""
    series = pin(series)
    months = series.groupBy(*keys, F.month("date").alias("month")).agg(F.avg(value).alias("month_mean"))
    whole = series.groupBy(*keys).agg(F.stddev(value).alias("whole_sd")).join(
        ranking.quantiles(series, keys, value, {"whole_median": 0.5}), keys
    )
    residual = F.col(value) - F.col("month_mean")
    return (
        series.withColumn("month", F.month("date")).join(months, [*keys, "month"]).join(whole, keys)
        .withColumns({
            f"{value}_residual": residual, f"{value}_adjusted": residual + F.col("whole_median"),
            f"{value}_adjusted_scaled": F.try_divide(residual, F.col("whole_sd")),
        })
        .drop("month_mean", "whole_sd", "whole_median")
    )


def lag_experiment(series: DataFrame, y: str, x: str, lags: Sequence[int], fold, k: int) -> DataFrame:
    """Resampled error of a line and of the plain mean for every lag of ``x``.

    ``fold`` is a Column from 0 to k - 1. The sums of each (lag, fold) are enough to fit on
    the other folds and to score the fold, so the whole grid is a single aggregate; the
    fit itself needs one row per lag and fold.
    """
    series = pin(series)  # one row per month, read for every lag
    lagged = series.select("date", F.col(y).alias("y")).join(
        month_lags(series.select("date", x), "date", x, lags).withColumnRenamed(f"{x}_lag", "x"), "date"
    ).where("x IS NOT NULL AND y IS NOT NULL").withColumn("fold", fold)
    X, Y = F.col("x"), F.col("y")
    cells = lagged.groupBy("n_lag", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"),
        F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy"),
    )
    totals = cells.groupBy("n_lag").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    fits = cells.join(totals, "n_lag").select(
        "n_lag", "fold", F.coalesce(slope, F.lit(0.0)).alias("slope"), F.try_divide(sx, n.cast("double")).alias("mx"),
        F.try_divide(sy, n.cast("double")).alias("my"),
    )
    errors = lagged.join(fits, ["n_lag", "fold"]).select(
        "n_lag", "fold", F.explode(F.create_map(
            F.lit("lm"), Y - F.col("my") - F.col("slope") * (X - F.col("mx")), F.lit("null"), Y - F.col("my"),
        )).alias("algorithm", "error"),
    )
    per_fold = errors.groupBy("algorithm", "n_lag", "fold").agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae")
    )
    return per_fold.groupBy("algorithm", "n_lag").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("resamples")
    )
