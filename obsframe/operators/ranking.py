"""Exact order statistics for groups of any size.

First the number of distinct values of the largest group is estimated, in one cheap pass.
While that is small, Spark's own exact aggregate or one window per group serves: equal
values are combined map-side, so a hot group is no larger than its distinct values. Beyond
that no step gathers a group: equal values are counted, each group is cut into value
ranges at approximate quantiles (and the ranges again, until they are small), running
counts are taken within a range and added up over the ranges. Both ways are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.session import pin

WHOLE = "whole_table"


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(WHOLE, F.lit(0)), [WHOLE])


def _range_of(value: Column, cuts: Column, low: int, high: int) -> Column:
    """How many of ``cuts[low:high]``, which are in order, lie below the value, plus ``low``; by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    below = F.get(cuts, F.lit(mid)) < value
    return F.when(below, _range_of(value, cuts, mid + 1, high)).otherwise(_range_of(value, cuts, low, mid))


# Distinct values one task may hold for a group, and how many ranges one cut makes.
DIRECT_LIMIT = 500_000
RANGES = 32


def _distinct_in_largest(df: DataFrame, by: list[str], value: str) -> int:
    sizes = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("d"))
    return sizes.agg(F.max("d")).first()[0] or 0


def _counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _ranged_counts(counts: DataFrame, by: list[str], value: str, levels: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Counts per value with the range they fall in, where each range starts, and the range's keys."""
    inside, keys = counts, list(by)
    steps = [i / RANGES for i in range(1, RANGES)]
    for level in range(levels):
        # Fixed once: the cuts depend on merge order and are read by two branches.
        cuts = pin(inside.groupBy(*keys).agg(F.percentile_approx(value, steps, 1000).alias("cuts")))
        inside = inside.join(cuts, keys).withColumn(
            f"range_{level}", _range_of(F.col(value), F.col("cuts"), 0, RANGES - 1)
        ).drop("cuts")
        keys.append(f"range_{level}")
    sizes = inside.groupBy(*keys).agg(F.sum("n").alias("size"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumns({
        "start": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "total": F.sum("size").over(whole),
    })
    return inside, starts, keys


def _add_up(inside: DataFrame, starts: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    within = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        inside.join(starts, keys)
        .withColumn("below", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
        .select(*by, value, "n", "below", "total")
    )


def _levels(distinct: int, direct_limit: int) -> int:
    levels, left = 0, distinct
    while left > direct_limit:
        levels, left = levels + 1, left // RANGES
    return levels


def value_ranks(df: DataFrame, keys: list[str], value: str, direct_limit: int = DIRECT_LIMIT) -> DataFrame:
    """One row per group and distinct value: ``n``, rows ``below`` it and the group ``total``."""
    counted, by = _keyed(df, keys)
    return _ranked(_counts(counted, by, value), by, value, _distinct_in_largest(counted, by, value), direct_limit).select(*keys, value, "n", "below", "total")


def weighted_ranks(counts: DataFrame, keys: list[str], value: str, weight: str, direct_limit: int = DIRECT_LIMIT) -> DataFrame:
    """``value_ranks`` of rows that are counted already: one row per group and value, which stands for ``weight`` rows."""
    counted, by = _keyed(counts.where(F.col(value).isNotNull()), keys)
    counted = counted.select(*by, value, F.col(weight).alias("n"))
    return _ranked(counted, by, value, _distinct_in_largest(counted, by, value), direct_limit).select(*keys, value, "n", "below", "total")


def _ranked(counts: DataFrame, by: list[str], value: str, distinct: int, direct_limit: int) -> DataFrame:
    levels = _levels(distinct, direct_limit)
    if levels:
        return _add_up(*_ranged_counts(counts, by, value, levels), by, value)
    group = Window.partitionBy(*by)
    earlier = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"below": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(group)})


def _at(value: str, position: Column) -> Column:
    return F.min(F.when(F.col("below") + F.col("n") > position, F.col(value)))


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], direct_limit: int = DIRECT_LIMIT
) -> DataFrame:
    """Exact linearly interpolated quantiles (the same rule as ``percentile``), NULLs ignored.

    On large groups only the ranges that hold a wanted position are sorted.
    """
    df, by = _keyed(df, keys)
    levels = _levels(_distinct_in_largest(df, by, value), direct_limit)
    if not levels:
        found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
            F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs.values()])).alias("found")
        )
        return found.select(*keys, *[F.col("found")[i].alias(n) for i, n in enumerate(probs)])
    inside, starts, parts = _ranged_counts(_counts(df, by, value), by, value, levels)
    places = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    holds = F.lit(False)
    for h in places.values():
        holds = holds | ((F.col("start") <= F.ceil(h)) & (F.col("start") + F.col("size") > F.floor(h)))
    ranks = _add_up(inside, starts.where(holds), parts, by, value)
    aggs: list[Column] = []
    for name, h in places.items():
        aggs += [
            _at(value, F.floor(h)).alias(f"{name}__lo"),
            _at(value, F.ceil(h)).alias(f"{name}__hi"),
            F.max(h - F.floor(h)).alias(f"{name}__w"),
        ]
    out = ranks.groupBy(*by).agg(*aggs)
    cols = [
        (F.col(f"{n}__lo") + F.col(f"{n}__w") * (F.col(f"{n}__hi") - F.col(f"{n}__lo"))).alias(n)
        for n in probs
    ]
    return out.select(*keys, *cols)


def percent_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``below / (total - 1)`` per distinct value; NULL values take no part."""
    return value_ranks(df, keys, value).withColumn(
        "percent_rank",
        F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0)),
    )


def hash_rank(df: DataFrame, keys: list[str], key_text: str, digits: int = 3) -> DataFrame:
    """Number rows 1..n in each group in the order of a unique hexadecimal hash column.

    The hash is uniform, so its first digits cut any group into 16 ** digits even parts.
    """
    df, by = _keyed(df, keys)
    parted = df.withColumn("part", F.substring(key_text, 1, digits))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parted.groupBy(*by, "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            *by, "part",
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
            F.sum("size").over(Window.partitionBy(*by)).alias("group_n"),
        )
    )
    within = Window.partitionBy(*by, "part").orderBy(key_text)
    out = (
        parted.join(starts, [*by, "part"])
        .withColumn("position", F.col("start") + F.row_number().over(within))
        .drop("part", "start")
    )
    return out if keys else out.drop(WHOLE)


def hash_sample(df: DataFrame, key_text: Column, n: int) -> DataFrame:
    """``n`` rows in the order of a hash: a reproducible random sample."""
    return df.withColumn("hash_key", key_text).orderBy("hash_key").limit(n).drop("hash_key")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole; a partial aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return kept.select(*keys, "row.*").select(*df.columns)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties give the smallest."""
    df, by = _keyed(df, keys)
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias("mode")
    out = value_counts(df, by, value).groupBy(*by).agg(best, F.max("n").alias("mode_n"))
    return out if keys else out.drop(WHOLE)


def near_zero_variance(
    df: DataFrame, keys: list[str], value: str, freq_cut: float = 95 / 5, unique_cut: float = 10.0
) -> DataFrame:
    """Frequency ratio of the two commonest values, percentage of distinct values, and the flag."""
    df, by = _keyed(df, keys)
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    present = F.col(value).isNotNull()
    tops = cells.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.col(value)).alias("n_distinct"),
        F.max(F.when(present, F.col("n"))).alias("top"),
    )
    # Only the first two of each task reach the shuffle.
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    first_two = cells.where(present).withColumn("place", ranked).where("place <= 2")
    seconds = first_two.groupBy(*by).agg(F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"))
    second = F.col("second")
    ratio = F.when(F.col("n_distinct") <= 1, F.lit(0.0)).otherwise(
        F.try_divide(F.col("top").cast("double"), second.cast("double"))
    )
    unique = F.col("n_distinct") * 100.0 / F.col("n_rows")
    flag = (F.col("n_distinct") <= 1) | ((ratio > freq_cut) & (unique <= unique_cut))
    out = tops.join(seconds, by, "left").select(
        *by, ratio.alias("freq_ratio"), unique.alias("percent_unique"), flag.alias("near_zero_var")
    )
    return out if keys else out.drop(WHOLE)
