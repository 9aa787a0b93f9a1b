"""Relational building blocks: splice, reshape, densify, windows and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def splice(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, then all of ``new``; gaps become NULL."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def gather(df: DataFrame, ids: list[str], measures: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, measures, name, value)


def spread(
    df: DataFrame, ids: list[str], key: str, keys: Sequence, value: str, prefix: str = ""
) -> DataFrame:
    """Long to wide over a given list of key values; one conditional aggregate per column."""
    cols = [F.max(F.when(F.col(key) == k, F.col(value))).alias(f"{prefix}{k}") for k in keys]
    return df.groupBy(*ids).agg(*cols)


def complete_months(df: DataFrame, keys: list[str], year: str = "major_period", month: str = "minor_period") -> DataFrame:
    """Every month of every year between the first and last year of each key.

    A row also stands for the empty months up to the next one, so a single pass over the
    key's ordered months fills them; nothing is joined and the input is read once.
    """
    w = Window.partitionBy(*keys).orderBy("period_at")
    at = F.col("period_at")
    ends = df.withColumn("period_at", F.col(year) * 12 + F.col(month) - 1).withColumns({
        "fill_from": F.when(F.lag(at).over(w).isNull(), F.col(year) * 12).otherwise(at),
        "fill_to": F.coalesce(F.lead(at).over(w) - 1, F.col(year) * 12 + 11),
    })
    rest = [c for c in df.columns if c not in (*keys, year, month)]
    filled = ends.select("*", F.explode(F.sequence("fill_from", "fill_to")).alias("period_to"))
    return filled.select(
        *keys, F.floor(F.col("period_to") / 12).cast("int").alias(year),
        (F.col("period_to") % 12 + 1).cast("int").alias(month),
        *[F.when(F.col("period_to") == at, F.col(c)).alias(c) for c in rest],
    )


def lag_lead(df: DataFrame, keys: list[str], order: list[str], value: str, n_lag: int, n_lead: int) -> DataFrame:
    """``value_lag1..`` and ``value_lead1..`` within each key; rows of other keys are never read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = {f"{value}_lag{i}": F.lag(value, i).over(w) for i in range(1, n_lag + 1)}
    cols |= {f"{value}_lead{i}": F.lead(value, i).over(w) for i in range(1, n_lead + 1)}
    return df.withColumns(cols)


def rolling_sums(df: DataFrame, keys: list[str], order: list[str], value: str, widths: Sequence[int]) -> DataFrame:
    """Trailing sums over ``k`` rows, NULL until the frame holds ``k`` values."""
    base = Window.partitionBy(*keys).orderBy(*order)
    cols = {}
    for k in widths:
        w = base.rowsBetween(-(k - 1), 0)
        cols[f"{value}_l{k}"] = F.when(F.count(value).over(w) == k, F.sum(value).over(w))
    return df.withColumns(cols)


def month_lags(df: DataFrame, date: str, value: str, lags: Sequence[int]) -> DataFrame:
    """The series once per lag: at each date the value ``n_lag`` months earlier.

    Each row is sent forward to the dates that will read it, so no window spans the series.
    """
    return df.select(
        F.explode(F.array(*[F.lit(n) for n in lags])).alias("n_lag"), F.col(date), F.col(value)
    ).select("n_lag", F.add_months(F.col(date), F.col("n_lag")).alias(date), F.col(value).alias(f"{value}_lag"))


def scaled(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", weight: float = 1.0) -> DataFrame:
    """Whole-column z-scores: one aggregate, read back as a scalar."""
    stats = df.agg(F.struct(*[
        f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev))
    ]).alias("s"))
    s = stats.select("s").scalar()
    out = df
    for c in columns:
        z = F.try_divide(F.col(c) - s.getField(f"mean_{c}"), s.getField(f"sd_{c}")) * weight
        out = out.withColumn(f"{c}{suffix}", z)
    return out


def group_scaled(df: DataFrame, keys: list[str], columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """z-scores within groups; the moments are aggregated and joined back, so no group is gathered."""
    moments = df.groupBy(*keys).agg(*[
        f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev))
    ])
    out = df.join(moments, keys)
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")))
    return out.drop(*[f"{p}_{c}" for c in columns for p in ("mean", "sd")])


def impute_group_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill NULLs with the median of their group and keep the original beside it.

    For groups the calendar bounds (one row per year); on data already spread by part of
    the keys this needs no further shuffle.
    """
    median = F.median(value).over(Window.partitionBy(*keys))
    return df.withColumn(f"{value}_original", F.col(value)).withColumn("group_median", median).withColumn(
        value, F.coalesce(F.col(value), F.col("group_median"))
    ).drop("group_median")


def pooled_mean(
    df: DataFrame, keys: list[str], order: list[str], value: str, by: list[str], keep: Column, k: int, name: str
) -> DataFrame:
    """Mean over a value and its ``k`` neighbours on both sides, pooled over ``by``.

    The frame is read before ``keep`` filters, so the edges see the rows outside it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, k)
    framed = df.withColumns({"frame_sum": F.sum(value).over(w), "frame_n": F.count(value).over(w)})
    return (
        framed.where(keep).groupBy(*by)
        .agg(F.try_divide(F.sum("frame_sum"), F.sum("frame_n").cast("double")).alias(name))
    )


def find_interval(value: Column, breaks: Column) -> Column:
    """How many breaks are at or below the value; NULL for a NULL value."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: b <= value)))
