"""A response against earlier values of an index: hinge models for every lag under bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.ml.resample import Scheme, names_of, shares
from obsframe.operators import mars
from obsframe.operators.relational import month_lags
from obsframe.session import pin


def lag_hinges(series: DataFrame, y: str, x: str, lags: Sequence[int], scheme: Scheme, max_terms: int = 21, penalty: float = 2.0) -> DataFrame:
    """Resampled error of a hinge model and of the plain mean for every lag of ``x``, and the knots that the models use on average.

    One aggregate by (lag, draw, knot interval) holds all that the fits need; every fit is solved in a task, and one more pass scores
    the rows that its draw leaves out. The knots are the distinct values of ``x``.
    """
    series = pin(series)  # one row per month, read for every lag
    lagged = series.select("date", F.col(y).alias("y")).join(
        month_lags(series.select("date", x), "date", x, lags).withColumnRenamed(f"{x}_lag", "x"), "date"
    ).where("x IS NOT NULL AND y IS NOT NULL").select("n_lag", "date", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    marked, per = shares(lagged, scheme, ["date"])
    names = names_of(scheme)
    draws = F.array(*[F.struct(F.lit(name).alias("resample"), w.alias("weight")) for name, w in zip(names, per)])
    rows = pin(marked.select("n_lag", "x", "y", F.inline(draws)))
    knots = mars._candidate_knots(lagged, "x")
    trained = rows.where("weight > 0")
    moments = mars.interval_moments(trained, "x", "y", knots, ["n_lag", "resample"], F.col("weight"))
    fits = mars.fit_groups(moments, ["n_lag", "resample"], knots, max_terms, penalty)
    means = trained.groupBy("n_lag", "resample").agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("mean"))
    held = rows if scheme.method == "none" else rows.where("weight = 0")
    scored = held.join(fits.join(means, ["n_lag", "resample"]), ["n_lag", "resample"])
    both = F.array(
        F.struct(F.lit("earth").alias("algorithm"), (F.col("y") - mars.value_of(F.col("x"))).alias("error"), F.size("terms").alias("terms")),
        F.struct(F.lit("null").alias("algorithm"), (F.col("y") - F.col("mean")).alias("error"), F.lit(0).alias("terms")),
    )
    errors = scored.select("n_lag", "resample", F.inline(both))
    per_draw = errors.groupBy("algorithm", "n_lag", "resample").agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae"), F.max("terms").alias("terms"),
    )
    return per_draw.groupBy("algorithm", "n_lag").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("terms").alias("terms"), F.count(F.lit(1)).alias("resamples")
    )
