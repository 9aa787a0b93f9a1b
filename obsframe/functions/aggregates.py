"""Aggregate expressions shared by the summaries; each returns Columns for one ``agg`` call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(c: Column | str) -> Column:
    """A sum that is 0 for an all-NULL group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def skew_adjusted(c: str) -> Column:
    """Skewness b1 = g1 * ((n - 1) / n) ** 1.5; NULL without spread."""
    x = F.col(c)
    n = F.count(x).cast("double")
    g1 = F.when(F.stddev(x) > 0, F.skewness(x))
    return g1 * F.pow(F.try_divide(n - 1, n), F.lit(1.5))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once: the product's own rounding error is worked out by halves and added."""
    def halves(x: Column) -> tuple[Column, Column]:
        far = x * 134217729.0
        high = far - (far - x)
        return high, x - high

    (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
    lost = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    total = p + c
    part = total - p
    return total + (((p - (total - part)) + (c - part)) + lost)


def sorted_breaks(values: Column, n: int) -> Column:
    """The n + 1 quantile breaks of an ordered array, NULL of an empty one.

    The weighted lower value is added without rounding it first, as the SQL checks have it: a value that
    equals a break but for its last bit is then counted on the same side.
    """
    def level(own: Column, i: Column) -> Column:
        at = (F.size(own) - 1) * (i / F.lit(float(n)))
        low, share = F.get(own, F.floor(at).cast("int")), at - F.floor(at)
        high = F.get(own, F.ceil(at).cast("int"))
        return F.when(share == 0, low).otherwise(_fused(low, 1.0 - share, high * share))

    # An array of the one array, so that it is worked out once and not at every level.
    levels = F.transform(F.array(values), lambda own: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: level(own, i)))
    return F.when(F.size(values) > 0, levels[0])


def ordered_values(c: Column | str) -> Column:
    """The present values of a group in order, as an array."""
    return F.sort_array(F.collect_list(F.col(c).cast("double") if isinstance(c, str) else c.cast("double")))


def quantile_breaks(c: str, n: int) -> Column:
    """The n + 1 exact quantile breaks 0/n .. n/n as an array.

    One group is held while its breaks are read, so use it where the calendar bounds the
    group (one row per station, year and month); elsewhere use ``operators.ranking``.
    """
    return sorted_breaks(ordered_values(c), n)


def open_breaks(breaks: Column, n: int) -> Column:
    """Widen the first break to 0 and the last to infinity."""
    return F.concat(F.array(F.lit(0.0)), F.slice(breaks, 2, n - 1), F.array(F.lit(float("inf"))))


def variable_summary(variable: str, prefix: str | None = None) -> dict[str, Column]:
    """The summary of one variable, as named aggregate Columns (near-zero variance apart)."""
    x = F.col(variable)
    # One array of quantiles: the three readings of it share one aggregate buffer.
    quarters = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    named = {
        "n": F.count(F.lit(1)),
        "n_na": F.count_if(x.isNull()),
        "n_present": F.count(x),
        "n_zero": F.count_if(x == 0),
        "n_nonzero": F.count_if(x != 0),
        "min": F.min(x),
        "mean": F.avg(x),
        "median": quarters[1],
        "max": F.max(x),
        "first_q": quarters[0],
        "third_q": quarters[2],
        "sd": F.stddev(x),
        "skew": skew_adjusted(variable),
    }
    return {f"{prefix}_{k}" if prefix else k: v for k, v in named.items()}


def counted_summary(value: str, rows: str) -> dict[str, Column]:
    """``variable_summary`` of rows that are counted already: each stands for ``rows`` rows of its ``value``.

    The spread is that of sums of powers, so the values should not lie far from 0 for their spread.
    """
    x, n = F.col(value).cast("double"), F.col(rows)
    weight = F.when(x.isNotNull(), n).otherwise(0)
    quarters = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), weight)
    present = F.sum(weight).cast("double")
    mean = F.try_divide(F.sum(x * n), present)
    second = F.greatest(F.sum(x * x * n) - mean * F.sum(x * n), F.lit(0.0))
    third = F.sum(x * x * x * n) - 3 * mean * F.sum(x * x * n) + 2 * mean * mean * F.sum(x * n)
    sd = F.sqrt(F.try_divide(second, present - 1))
    return {
        "n": F.sum(n), "n_na": F.sum(F.when(x.isNull(), n).otherwise(0)), "n_present": F.sum(weight),
        "n_zero": F.sum(F.when(x == 0, n).otherwise(0)), "n_nonzero": F.sum(F.when(x != 0, n).otherwise(0)),
        "min": F.min(x), "mean": mean, "median": quarters[1], "max": F.max(x), "first_q": quarters[0], "third_q": quarters[2],
        "sd": sd, "skew": F.when(sd > 1e-9 * F.max(F.abs(x)), F.try_divide(F.try_divide(third, present), F.pow(sd, F.lit(3)))),
    }


def agg_columns(named: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in named.items()]
