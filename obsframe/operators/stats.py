"""Statistics for interpreting series: local and linear fits, distributions, principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.functions.aggregates import skew_adjusted
from obsframe.operators import ranking
from obsframe.operators.ranking import WHOLE
from obsframe.session import pin


def loess(df: DataFrame, keys: list[str], x: str, y: str, span: float, name: str) -> DataFrame:
    """Local quadratic smoothing with tricube weights, fitted exactly at every point.

    Gives one row per distinct x. Rows of one x are added up first; the span counts rows, as does the weight of
    an x, so repeated positions are as good as single ones. Every position is sent to those
    that may count it among their q nearest, so the work is spread over (series, position). Meant for series
    on a calendar: the work grows with the square of the number of positions.
    """
    by = keys or [WHOLE]
    points = df if keys else df.withColumn(WHOLE, F.lit(0))
    points = points.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*by, F.col(x).alias("px"), F.col(y).cast("double").alias("py"))
    points = points.groupBy(*by, "px").agg(F.count(F.lit(1)).alias("rows"), F.sum("py").alias("py"))
    ranks = ranking.value_ranks(points, by, "px").select(*by, "px", F.col("below").alias("pos"), "total")
    sizes = points.groupBy(*by).agg(F.sum("rows").alias("all_rows"))
    q = F.greatest(F.lit(4), F.least(F.col("all_rows"), F.floor(F.col("all_rows") * span + 1e-5))).cast("int")
    placed = points.join(ranks, [*by, "px"]).join(sizes, by).withColumn("q", q)
    near = F.sequence(
        F.greatest(F.lit(0), F.col("pos") - F.col("q") + 1).cast("int"),
        F.least(F.col("total") - 1, F.col("pos") + F.col("q") - 1).cast("int"),
    )
    sent = placed.select(*by, "q", F.col("px").alias("nx"), F.col("py").alias("ny"), "rows", F.explode(near).alias("pos"))
    targets = placed.select(*by, F.col("pos").cast("int").alias("pos"), "px")
    distance = F.abs(F.col("nx") - F.col("px")).cast("double")
    at = Window.partitionBy(*by, "pos")
    nearest = (
        sent.join(targets, [*by, "pos"]).withColumn("d", distance)
        .withColumn("before", F.sum("rows").over(at.orderBy("d", "nx").rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("before", F.lit(0)) < F.col("q"))
        .withColumn("h", F.max("d").over(at))
    )
    u = (F.col("nx") - F.col("px")) / F.col("h")
    weighted = nearest.select(
        *by, "pos", "px", "ny", "rows", u.alias("u"), F.pow(1 - F.pow(F.col("d") / F.col("h"), F.lit(3)), F.lit(3)).alias("w")
    )
    U, W, Y = F.col("u"), F.col("w"), F.col("ny")
    powers = [W, W * U, W * U * U, W * U * U * U, W * U * U * U * U]
    sums = weighted.groupBy(*by, "pos", "px").agg(
        *[F.sum(p * F.col("rows")).alias(f"s{i}") for i, p in enumerate(powers)],
        *[F.sum(p * Y).alias(f"t{i}") for i, p in enumerate(powers[:3])],
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"t{i}") for i in range(3))
    top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    bottom = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    return sums.select(*keys, F.col("px").alias(x), F.try_divide(top, bottom).alias(name))


def _cell_cuts(xs: np.ndarray, rows: np.ndarray, most: int) -> list[float]:
    """Cuts of a cell tree: a cell of more than ``most`` rows is halved between the two positions nearest to its middle row."""
    ends, cuts, cells = np.cumsum(rows), [], [(0, int(rows.sum()))]
    while cells:
        low, high = cells.pop()
        if high - low <= most:
            continue
        middle = (low + 1 + high) // 2
        inside = np.flatnonzero((ends > low) & (ends < high))
        if not len(inside):
            continue
        gaps = np.abs(ends[inside] - middle)
        at = int(inside[np.flatnonzero(gaps == gaps.min())[-1]])  # of two as near the upper one
        cuts.append((xs[at] + xs[at + 1]) / 2)
        cells += [(low, int(ends[at])), (int(ends[at]), high)]
    return sorted(cuts)


def loess_vertices(df: DataFrame, keys: list[str], x: str, y: str, span: float, name: str, cell: float = 0.2) -> DataFrame:
    """Local quadratic smoothing fitted at the vertices of a cell tree, with cubic blending between them.

    Gives one row per distinct x. A cell is cut while it holds more than ``cell`` times the span's rows, so a series has some
    ``2 / (cell * span)`` vertices at most and the work grows in proportion to its positions. The cuts of a series come from its positions and
    their row counts, in one task; the fits are sums over (series, vertex), and values and slopes at a position's two vertices are
    blended. Spans count rows, as in ``loess``; the outer vertices lie half a hundredth of the range beyond the ends.
    """
    by = keys or [WHOLE]
    points = df if keys else df.withColumn(WHOLE, F.lit(0))
    points = points.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*by, F.col(x).alias("px"), F.col(y).cast("double").alias("py"))
    points = pin(points.groupBy(*by, "px").agg(F.count(F.lit(1)).alias("rows"), F.sum("py").alias("py")))
    ranks = ranking.value_ranks(points, by, "px").select(*by, "px", F.col("below").cast("int").alias("pos"))
    placed = points.join(ranks, [*by, "px"])
    schema = T.StructType([*[points.schema[c] for c in by], *T.StructType.fromDDL("v double, h double, low int, high int").fields])

    def vertices(table: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy(), kind="stable")
        xs, rows = table["at"].to_numpy()[order], table["rows"].to_numpy()[order]
        n = int(rows.sum())
        q = max(4, min(n, int(np.floor(n * span + 1e-5))))
        margin = 0.005 * max(xs[-1] - xs[0], 1e-3 * max(abs(xs[0]), abs(xs[-1])) + 1e-30)
        out = {"v": [xs[0] - margin, *_cell_cuts(xs, rows, int(n * span * cell)), xs[-1] + margin], "h": [], "low": [], "high": []}
        for v in out["v"]:
            spot = int(np.searchsorted(xs, v))
            start = max(0, spot - q)
            d = np.abs(xs[start : spot + q] - v)
            near = np.argsort(d, kind="stable")
            before = np.cumsum(rows[start : spot + q][near]) - rows[start : spot + q][near]
            near = near[before < q]
            out["h"].append(float(d[near].max()))
            out["low"].append(int(start + near.min()))
            out["high"].append(int(start + near.max()))
        own = pa.table(out, schema=pa.schema([("v", pa.float64()), ("h", pa.float64()), ("low", pa.int32()), ("high", pa.int32())]))
        return pa.Table.from_arrays([*[pa.chunked_array([pa.repeat(table[c][0], own.num_rows)], table[c].type) for c in by], *own.columns], [*by, *own.column_names])

    found = points.select(*by, F.col("px").cast("double").alias("at"), "rows").groupBy(*by).applyInArrow(vertices, schema)
    sent = found.withColumn("pos", F.explode(F.sequence("low", "high"))).join(placed, [*by, "pos"])
    u = (F.col("px") - F.col("v")) / F.col("h")
    weighted = sent.select(*by, "v", "h", "py", "rows", u.alias("u"), F.pow(1 - F.pow(F.abs(u), F.lit(3)), F.lit(3)).alias("w"))
    U, W = F.col("u"), F.col("w")
    powers = [W, W * U, W * U * U, W * U * U * U, W * U * U * U * U]
    sums = weighted.groupBy(*by, "v", "h").agg(
        *[F.sum(p * F.col("rows")).alias(f"s{i}") for i, p in enumerate(powers)], *[F.sum(p * F.col("py")).alias(f"t{i}") for i, p in enumerate(powers[:3])],
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"t{i}") for i in range(3))
    level = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    slope = s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)
    bottom = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    fitted = sums.select(*by, F.struct("v", F.try_divide(level, bottom).alias("f"), F.try_divide(slope, bottom * F.col("h")).alias("g")).alias("node"))
    nodes = fitted.groupBy(*by).agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # as many as the span asks for
    at = F.col("px").cast("double")
    cells = points.select(*by, "px").join(nodes, by).withColumn("k", F.size(F.filter("nodes", lambda n: n["v"] <= at)))
    cells = cells.withColumns({"a": F.get("nodes", F.col("k") - 1), "b": F.get("nodes", F.col("k"))})
    width = F.col("b.v") - F.col("a.v")
    cells = cells.withColumns({"w": width, "t": (at - F.col("a.v")) / width})
    t, w = F.col("t"), F.col("w")
    blend = (2 * t * t * t - 3 * t * t + 1) * F.col("a.f") + (t * t * t - 2 * t * t + t) * w * F.col("a.g")
    blend = blend + (3 * t * t - 2 * t * t * t) * F.col("b.f") + (t * t * t - t * t) * w * F.col("b.g")
    return cells.select(*keys, F.col("px").alias(x), blend.alias(name))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _cosine_area(upper: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The integral of cos(a) ** (dof - 1) from 0 to ``upper``, by Gauss's rule."""
    a = upper[:, None] * (_NODES + 1) / 2
    return upper / 2 * (np.exp((dof - 1)[:, None] * np.log(np.cos(a))) @ _WEIGHTS)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t: with t = sqrt(dof) * tan(a) its density is a power of the cosine.

    Right to about 1e-14; beyond twelve standard deviations the cosine counts as 0.
    """
    most = np.minimum(np.pi / 2 * (1 - 1e-16), 12 / np.sqrt(dof))
    angle = np.minimum(np.arctan(np.abs(t) / np.sqrt(dof)), most)
    return np.clip(1 - _cosine_area(angle, dof) / _cosine_area(most, dof), 0.0, 1.0)


def t_quantile(dof: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Half-width factor of a two-sided interval, by bisection on the p-value."""
    low, high = np.zeros_like(dof), np.full_like(dof, 1e4)
    for _ in range(80):
        mid = (low + high) / 2
        wide = t_two_sided(mid, dof) > 1 - level
        low, high = np.where(wide, mid, low), np.where(wide, high, mid)
    return (low + high) / 2


def _t_tests(slope: Column | str, se: Column | str, n: Column | str) -> Column:
    """t value, p value and interval half-width as a struct; for one row per fit."""

    def tests(slopes: pd.Series, errors: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        ok = ((sizes > 2) & (errors > 0)).to_numpy()
        out = np.full((len(sizes), 3), np.nan)
        if ok.any():
            dof = sizes.to_numpy(dtype=float)[ok] - 2
            s, e = slopes.to_numpy(dtype=float)[ok], errors.to_numpy(dtype=float)[ok]
            out[ok, 0] = s / e
            out[ok, 1] = t_two_sided(np.abs(s / e), dof)
            out[ok, 2] = t_quantile(dof) * e
        return pd.DataFrame(out, columns=["t_value", "p_value", "half_width"])

    return F.pandas_udf(tests, "t_value double, p_value double, half_width double")(slope, se, n)


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares line per group with R2, standard error, t test and 95 % interval of the slope.

    One aggregate over the rows; the t distribution is read on the one row per group left.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    fits = df.groupBy(*keys).agg(
        F.regr_count(Y, X).alias("n"), F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"),
        F.regr_r2(Y, X).alias("r2"), F.regr_sxx(Y, X).alias("sxx"), F.regr_syy(Y, X).alias("syy"), F.regr_sxy(Y, X).alias("sxy"),
        F.regr_avgx(Y, X).alias("mean_x"),
    )
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    sigma = F.sqrt(F.try_divide(rss, (F.col("n") - 2).cast("double")))
    fits = fits.withColumn("sigma", F.when(F.col("n") > 2, sigma)).withColumn("slope_se", F.try_divide(F.col("sigma"), F.sqrt("sxx")))
    tested = fits.withColumn("test", _t_tests("slope", "slope_se", "n"))
    half = F.nanvl(F.col("test.half_width"), F.lit(None).cast("double"))
    return tested.select(
        *keys, "n", "slope", "intercept", "r2", "slope_se", "sigma", "sxx", "mean_x",
        F.nanvl(F.col("test.t_value"), F.lit(None).cast("double")).alias("t_value"),
        F.nanvl(F.col("test.p_value"), F.lit(None).cast("double")).alias("p_value"),
        (F.col("slope") - half).alias("slope_low"), (F.col("slope") + half).alias("slope_high"),
        F.try_divide(half, F.col("slope_se")).alias("t_factor"),
    )


def trend_band(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The fitted line at every row with its 95 % confidence band."""
    fits = linear_fit(df, keys, x, y)
    X = F.col(x).cast("double")
    fit = F.col("intercept") + F.col("slope") * X
    leverage = F.try_divide(F.lit(1.0), F.col("n").cast("double")) + F.try_divide((X - F.col("mean_x")) ** 2, F.col("sxx"))
    half = F.col("t_factor") * F.col("sigma") * F.sqrt(leverage)
    wanted = ["n", "slope", "intercept", "sigma", "sxx", "mean_x", "t_factor"]
    return (
        df.join(fits.select(*keys, *wanted), keys)
        .withColumns({"fit": fit, "fit_low": fit - half, "fit_high": fit + half})
        .drop(*wanted)
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value."""
    s = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).select("s").scalar()
    lo, width = s.getField("lo"), F.try_divide(s.getField("hi") - s.getField("lo"), F.lit(float(bins)))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"bin_start": lo + F.col("bin") * width, "bin_end": lo + (F.col("bin") + 1) * width})


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box-plot numbers of groups of any size."""
    names = {"lowest": 0.0, "first_q": 0.25, "median": 0.5, "third_q": 0.75, "highest": 1.0}
    return ranking.quantiles(df, keys, value, names)


def kernel_density(df: DataFrame, keys: list[str], value: str, points: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, with the usual rule-of-thumb bandwidth.

    The values are first shared out to their two nearest grid points, so the kernel only
    ever meets ``points`` weights per group however many rows the group has.
    """
    present = df.where(F.col(value).isNotNull())
    moments = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    quart = ranking.quantiles(present, keys, value, {"q1": 0.25, "q3": 0.75})
    robust = (F.col("q3") - F.col("q1")) / 1.34
    narrow = F.when(robust > 0, F.least("sd", robust)).otherwise(F.col("sd"))
    setup = (
        moments.join(quart, keys)
        .withColumn("bw", 0.9 * F.when(narrow > 0, narrow).otherwise(F.lit(1.0)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("start", F.col("lo") - cut * F.col("bw"))
        .withColumn("step", (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (points - 1))
        .select(*keys, "n", "bw", "start", "step")
    )
    place = (F.col(value) - F.col("start")) / F.col("step")
    shared = present.join(setup, keys).withColumn("place", place).withColumn("cell", F.floor("place").cast("int"))
    part = F.col("place") - F.col("cell")
    halves = F.array(
        F.struct(F.col("cell").alias("cell"), (1 - part).alias("weight")),
        F.struct((F.col("cell") + 1).alias("cell"), part.alias("weight")),
    )
    weights = shared.select(*keys, F.inline(halves)).groupBy(*keys, "cell").agg(F.sum("weight").alias("weight"))
    packed = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "weight"))).alias("cells")).join(setup, keys)
    height = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda g: F.struct(
            g.alias("point"),
            (F.aggregate(
                "cells", F.lit(0.0),
                lambda acc, c: acc + c["weight"] * F.exp(-0.5 * ((g - c["cell"]) * F.col("step") / F.col("bw")) ** 2),
            ) / (F.col("n") * F.col("bw") * float(np.sqrt(2 * np.pi)))).alias("density"),
        ),
    )
    return packed.select(*keys, "start", "step", F.inline(height)).select(
        *keys, "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"), "density"
    )


def numeric_columns(df: DataFrame) -> list[str]:
    plain = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [n for n, t in df.dtypes if t in plain or t.startswith("decimal")]


def long_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or numeric_columns(df))
    return df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "variable", "value")


def variable_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of distribution figures per numeric column, quantiles exact for any size."""
    long = long_numeric(df, columns)
    plain = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_na"), F.avg("value").alias("mean"),
        F.stddev("value").alias("sd"), skew_adjusted("value").alias("skew"),
    )
    return plain.join(five_numbers(long, ["variable"], "value"), "variable")


def variable_degeneracy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return ranking.near_zero_variance(long_numeric(df, columns), ["variable"], "value")


def data_statistics(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and complete rows of a frame, in one pass."""
    missing = [F.count_if(F.col(c).isNull()) for c in df.columns]
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        sum(missing[1:], missing[0]).alias("n_missing"), F.count_if(complete).alias("n_complete"),
    )


def level_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and share of every level of categorical columns."""
    long = df.select(*columns).unpivot([], list(columns), "variable", "level")
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    return counts.join(totals, "variable").select("variable", "level", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def principal_components(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance, share and running share of each principal component (divisor n).

    Spark adds up the p x p moments in one aggregate; only that matrix is decomposed here.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    spread = np.sort(np.linalg.eigvalsh(cov))[::-1]
    share = spread / spread.sum()
    rows = [(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(spread, share, share.cumsum()))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, pev double, cev double")
