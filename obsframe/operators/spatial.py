"""Station values on a regular grid, and ranks within a place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_interpolate(
    stations: DataFrame, value: str, lon: tuple[int, int] = (112, 155), lat: tuple[int, int] = (-44, -10),
    power: float = 5.0,
) -> DataFrame:
    """Inverse-distance weighting onto whole degrees.

    Each batch of stations adds its weights to the grid's running sums and sends only those
    sums on, so neither side is joined or gathered; the grid has a fixed size. A station on
    a grid point decides that point (several: their mean).
    """
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(lon[0], lon[1] + 1), np.arange(lat[0], lat[1] + 1)))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, gx.size))
        for pdf in batches:
            for part in range(0, len(pdf), 256):
                p = pdf.iloc[part:part + 256]
                v = p["v"].to_numpy()[:, None]
                d = np.hypot(p["longitude"].to_numpy()[:, None] - gx, p["latitude"].to_numpy()[:, None] - gy)
                hit = d == 0
                w = np.where(hit, 0.0, 1.0 / np.where(hit, 1.0, d) ** power)
                sums += np.stack([(w * v).sum(0), w.sum(0), (hit * v).sum(0), hit.sum(0)])
        yield pd.DataFrame({"longitude": gx, "latitude": gy, "wv": sums[0], "w": sums[1], "hv": sums[2], "h": sums[3]})

    points = stations.where(F.col(value).isNotNull()).select(
        F.col("longitude").cast("double"), F.col("latitude").cast("double"), F.col(value).cast("double").alias("v")
    )
    parts = points.mapInPandas(add_up, "longitude int, latitude int, wv double, w double, hv double, h double")
    on_point = F.try_divide(F.sum("hv"), F.sum("h"))
    return parts.groupBy("longitude", "latitude").agg(
        F.coalesce(on_point, F.try_divide(F.sum("wv"), F.sum("w"))).alias(value)
    )


def location_percentile(df: DataFrame, periods: list[str], value: str) -> DataFrame:
    """Mean per place and period, then its percent rank within the place.

    A place holds one row per calendar period by then, so the window is bounded.
    """
    place = ["longitude", "latitude"]
    means = df.groupBy(*place, *periods).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())
    w = Window.partitionBy(*place).orderBy(value)
    return means.withColumn("percent", F.percent_rank().over(w) * 100)
