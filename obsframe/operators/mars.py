"""Piecewise-linear trends: hinge terms chosen by forward selection and pruned by GCV or by cross-validation.

Spark sums six moments per interval between knots in one pass, for every group, fold or bootstrap draw at once (``interval_moments``).
A hinge model is linear inside an interval, so every inner product a fit needs is a running sum of these
moments: a step of the forward search costs one pass over the intervals for each term, however many knots there are. A
held-out part is scored from its own moments, without another look at the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.functions.scalar import numbers
from obsframe.operators import ranking

MOMENTS = ("n", "u", "uu", "v", "uv", "vv")
MAX_KNOTS = 20_000
THRESHOLD, TIE = 1e-3, 1e-9


@dataclass(frozen=True)
class HingeModel:
    """``intercept + sum(coef * max(0, side * (x - knot)))``."""

    x: str
    intercept: float
    terms: tuple[tuple[int, float, float], ...]
    gcv: float
    r2: float

    def predict(self) -> Column:
        x = F.col(self.x).cast("double")
        out = F.lit(self.intercept)
        for side, knot, coef in self.terms:
            out = out + F.greatest(F.lit(0.0), F.lit(float(side)) * (x - F.lit(knot))) * F.lit(coef)
        return F.when(x.isNotNull(), out)  # greatest() would pass a missing position over

    def knots(self) -> list[float]:
        return sorted({k for _, k, _ in self.terms})


def _candidate_knots(df: DataFrame, x: str, max_knots: int = MAX_KNOTS) -> list[float]:
    """Every distinct position; of more than ``max_knots`` that many evenly spread exact quantiles.

    Rows do not weigh, so the knots depend on the positions alone and are the same on every run. Only the positions next to a
    quantile come to the driver.
    """
    positions = df.select(F.col(x).cast("double").alias("k")).where("k IS NOT NULL").distinct()
    some = sorted(r["k"] for r in positions.limit(max_knots + 1).collect())
    if not some:
        raise ValueError(f"no row with {x} and a response")
    if len(some) <= max_knots:
        return some
    ranks = ranking.value_ranks(positions, [], "k")
    step = F.lit(float(max_knots - 1)) / (F.col("total") - 1)
    near = F.floor((F.col("below") + 1) * step + 1e-9) >= F.ceil((F.col("below") - 1) * step - 1e-9)
    found = ranks.where(near).select("k", "below", "total").collect()
    at = {r["below"]: r["k"] for r in found}
    places = np.linspace(0, found[0]["total"] - 1, max_knots)
    low = np.floor(places + 1e-9).astype(int)
    high = np.minimum(low + 1, found[0]["total"] - 1)
    share = np.maximum(places - low, 0.0)
    return sorted({float(at[i] + w * (at[j] - at[i])) if w > 1e-9 else float(at[i]) for i, j, w in zip(low.tolist(), high.tolist(), share)})


def with_interval(df: DataFrame, x: str, knots: Sequence[float], name: str, strictly: bool = False) -> DataFrame:
    """Adds how many knots are at or below (``strictly`` below) a value, by halving the sorted knots; a column a step, so that no step is taken twice."""
    if not len(knots):
        return df.withColumn(name, F.lit(0))
    marks, width = numbers([float(k) for k in knots]), 1
    while width * 2 <= len(knots):
        width *= 2
    out = df.withColumn(name, F.lit(0))
    while width:
        mark = F.get(marks, F.col(name) + (width - 1))
        out = out.withColumn(name, F.col(name) + F.when((mark < F.col(x)) if strictly else (mark <= F.col(x)), width).otherwise(0))
        width //= 2
    return out


def interval_moments(df: DataFrame, x: str, y: str, knots: Sequence[float], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``by``, ``b`` (knots at or below) and sums of 1, u, u u, y, u y and y y, where u is x moved and scaled to -1 .. 1 by the knots."""
    centre, scale = _frame(knots)
    u, v = (F.col(x).cast("double") - F.lit(centre)) / F.lit(scale), F.col(y).cast("double")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    plain = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x_"), u.alias("u_"), v.alias("v_"), w.alias("w_"))
    # Equal positions are one row before their interval is looked up.
    per = plain.groupBy(*by, "x_", "u_").agg(F.sum("w_").alias("n"), F.sum(F.col("w_") * F.col("v_")).alias("v"), F.sum(F.col("w_") * F.col("v_") * F.col("v_")).alias("vv"))
    u = F.col("u_")
    return with_interval(per, "x_", knots, "b").groupBy(*by, "b").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * u).alias("u"), F.sum(F.col("n") * u * u).alias("uu"),
        F.sum("v").alias("v"), F.sum(F.col("v") * u).alias("uv"), F.sum("vv").alias("vv"),
    )


def _frame(knots: Sequence[float]) -> tuple[float, float]:
    return (knots[0] + knots[-1]) / 2, max((knots[-1] - knots[0]) / 2, 1e-300) if knots[-1] > knots[0] else 1.0


class HingeFit:
    """The forward search and the backward path over one set of moments (rows of ``MOMENTS``, one per interval)."""

    def __init__(self, moments: np.ndarray, knots: Sequence[float], max_terms: int):
        self.m = dict(zip(MOMENTS, moments))
        self.knots = np.asarray(knots)
        self.centre, self.scale = _frame(self.knots)
        self.k = (self.knots - self.centre) / self.scale
        self.n, self.yy = self.m["n"].sum(), self.m["vv"].sum()
        buckets = len(self.k) + 1
        self.terms: list[tuple[int, int]] = []  # side, knot
        self.a, self.s = np.ones((1, buckets)), np.zeros((1, buckets))
        self._search(max_terms)
        self.path = self._prune()

    def basis(self, side: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Level and slope of a hinge in every interval."""
        on = np.arange(len(self.k) + 1) > j if side > 0 else np.arange(len(self.k) + 1) <= j
        return -side * self.k[j] * on, side * on.astype(float)

    def products(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the terms with each other and with the response, under any moments of the same intervals."""
        a, s = self.a, self.s
        cross = a * m["u"] @ s.T
        return a * m["n"] @ a.T + cross + cross.T + s * m["uu"] @ s.T, a @ m["v"] + s @ m["uv"]

    def _with_hinges(self, level: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of a piecewise line (by interval) with the right and the left hinge at each knot."""
        high, low = level * self.m["u"] + slope * self.m["uu"], level * self.m["n"] + slope * self.m["u"]
        up, base = np.cumsum(high), np.cumsum(low)
        right = (up[-1] - up[:-1]) - self.k * (base[-1] - base[:-1])
        return right, self.k * base[:-1] - up[:-1]

    def _search(self, max_terms: int) -> None:
        m, k = self.m, self.k
        n, u, uu, v, uv = (np.cumsum(m[c]) for c in ("n", "u", "uu", "v", "uv"))
        to_y = [(uv[-1] - uv[:-1]) - k * (v[-1] - v[:-1]), k * v[:-1] - uv[:-1]]
        norms = [(uu[-1] - uu[:-1]) - 2 * k * (u[-1] - u[:-1]) + k * k * (n[-1] - n[:-1]), uu[:-1] - 2 * k * u[:-1] + k * k * n[:-1]]
        cross = [np.array([c]) for c in self._with_hinges(self.a[0], self.s[0])]
        start = current = max(self.yy - m["v"].sum() ** 2 / self.n, 0.0) if self.n else 0.0
        while 1 + len(self.terms) + 2 <= max_terms and current > 0:
            gram, rhs = self.products(m)
            inverse = np.linalg.pinv(gram, rcond=1e-11, hermitian=True)
            solved = [inverse @ c for c in cross]
            rest = [np.maximum(norms[i] - np.einsum("ij,ij->j", cross[i], solved[i]), 0.0) for i in (0, 1)]
            pull = [to_y[i] - rhs @ solved[i] for i in (0, 1)]
            mixed = -np.einsum("ij,ij->j", cross[0], solved[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                alone = [np.where(rest[i] > 1e-9 * np.maximum(norms[i], 1e-300), pull[i] ** 2 / rest[i], 0.0) for i in (0, 1)]
                left_over = rest[1] - mixed**2 / rest[0]
                added = (pull[1] - mixed * pull[0] / rest[0]) ** 2 / left_over
            both = (alone[0] > 0) & (left_over > 1e-7 * rest[1]) & (alone[1] > 0)
            gain = np.where(both, alone[0] + added, np.maximum(alone[0], alone[1]))
            used = [j for _, j in self.terms]
            gain[used] = -1.0
            j = int(np.argmax(gain >= gain.max() - TIE * start))  # of equal knots the first
            if gain[j] <= THRESHOLD * start:
                break
            # A second hinge that the model spans already would only make subsets ambiguous.
            for side in (1, -1) if both[j] else (1,) if alone[0][j] >= alone[1][j] * (1 - 1e-6) else (-1,):
                level, slope = self.basis(side, j)
                self.terms.append((side, j))
                self.a, self.s = np.vstack([self.a, level]), np.vstack([self.s, slope])
                new = self._with_hinges(level, slope)
                cross = [np.vstack([c, x]) for c, x in zip(cross, new)]
            current -= gain[j]

    def _prune(self) -> list[tuple[list[int], np.ndarray, float]]:
        """Columns, coefficients and RSS of the best subset of each size that dropping one term at a time gives, largest first.

        Dropping a term raises the RSS by the square of its coefficient over its place in the inverse.
        """
        gram, rhs = self.products(self.m)
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        gram, rhs = gram / np.outer(scale, scale), rhs / scale
        columns, path = list(range(len(self.terms) + 1)), []
        while True:
            inverse = np.linalg.pinv(gram[np.ix_(columns, columns)], rcond=1e-13, hermitian=True)
            coef = inverse @ rhs[columns]
            rss = max(float(self.yy - 2 * coef @ rhs[columns] + coef @ gram[np.ix_(columns, columns)] @ coef), 0.0)
            path.append((columns, coef / scale[columns], rss))
            if len(columns) == 1:
                return path
            rise = (coef**2 / np.maximum(np.diag(inverse), 1e-300))[1:]
            drop = 1 + int(np.argmax(rise <= rise.min() + TIE * self.yy))
            columns = [c for i, c in enumerate(columns) if i != drop]

    def gcv(self, columns: Sequence[int], rss: float, penalty: float) -> float:
        cost = len(columns) + penalty * (len(columns) - 1) / 2
        return np.inf if cost >= self.n else rss / self.n / (1 - cost / self.n) ** 2

    def best_by_gcv(self, penalty: float) -> int:
        """Its place in the path; of equals the smallest model."""
        scores = [self.gcv(c, rss, penalty) for c, _, rss in self.path]
        return max(i for i, g in enumerate(scores) if g <= min(scores))

    def of_size(self, size: int) -> int:
        """The place of the model with at most ``size`` terms (the intercept counts)."""
        return next(i for i, (columns, *_) in enumerate(self.path) if len(columns) <= max(size, 1))

    def held_out(self, place: int, moments: np.ndarray) -> tuple[float, float]:
        """Rows and squared error of a model of the path on other moments."""
        m = dict(zip(MOMENTS, moments))
        columns, coef, _ = self.path[place]
        gram, rhs = self.products(m)
        return m["n"].sum(), max(float(m["vv"].sum() - 2 * coef @ rhs[columns] + coef @ gram[np.ix_(columns, columns)] @ coef), 0.0)

    def model(self, x: str, place: int, penalty: float) -> HingeModel:
        columns, coef, rss = self.path[place]
        terms = tuple((self.terms[c - 1][0], float(self.knots[self.terms[c - 1][1]]), float(b) / self.scale) for c, b in zip(columns, coef) if c)
        base = self.yy - self.m["v"].sum() ** 2 / self.n
        r2 = 1 - rss / base if base > 0 else 1.0
        return HingeModel(x, float(coef[columns.index(0)]), terms, float(self.gcv(columns, rss, penalty)), float(r2))


def as_array(rows: Sequence, knots: Sequence[float]) -> np.ndarray:
    """Rows of interval moments as ``MOMENTS`` by interval."""
    out = np.zeros((len(MOMENTS), len(knots) + 1))
    for r in rows:
        out[:, r["b"]] = [r[c] for c in MOMENTS]
    return out


def fit_hinges(df: DataFrame, x: str, y: str, max_terms: int = 21, penalty: float = 2.0, max_knots: int = MAX_KNOTS) -> HingeModel:
    """One trend over all rows, pruned by GCV."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    knots = _candidate_knots(data, x, max_knots)
    fit = HingeFit(as_array(interval_moments(data, x, y, knots).collect(), knots), knots, max_terms)
    return fit.model(x, fit.best_by_gcv(penalty), penalty)


def tune_hinges(
    df: DataFrame, x: str, y: str, fold: Column, max_terms: int = 21, sizes: Sequence[int] | None = None, penalty: float = 2.0, max_knots: int = MAX_KNOTS,
) -> tuple[HingeModel, list[tuple[int, float, bool]]]:
    """A trend with as many terms as predict best across the folds, and the error of each number of terms.

    The moments are kept per fold. A fold's model comes from the sums of the others, its error from its own sums, so all sizes
    under all folds take one pass over the rows. The error is the mean over the folds of the root mean squared error;
    of equal ones the smaller size is chosen.
    """
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("fold_", fold)
    knots = _candidate_knots(data, x, max_knots)
    parts: dict[object, list] = {}
    for r in interval_moments(data, x, y, knots, ["fold_"]).collect():
        parts.setdefault(r["fold_"], []).append(r)
    moments = {f: as_array(rows, knots) for f, rows in parts.items()}
    total = sum(moments.values())
    whole = HingeFit(total, knots, max_terms)
    sizes = list(sizes) if sizes is not None else list(range(1, len(whole.terms) + 2))
    errors = np.zeros(len(sizes))
    for own in moments.values():
        fit = HingeFit(total - own, knots, max_terms)
        for i, size in enumerate(sizes):
            n, rss = fit.held_out(fit.of_size(size), own)
            errors[i] += np.sqrt(rss / n) / len(moments)
    best = min(range(len(sizes)), key=lambda i: (round(errors[i], 12), sizes[i]))
    table = [(size, float(e), i == best) for i, (size, e) in enumerate(zip(sizes, errors))]
    return whole.model(x, whole.of_size(sizes[best]), penalty), table


_TERMS = "array<struct<side:int,knot:double,coef:double>>"


def fit_groups(moments: DataFrame, by: Sequence[str], knots: Sequence[float], max_terms: int = 21, penalty: float = 2.0) -> DataFrame:
    """``by``, ``intercept`` and ``terms`` of a trend for every group of interval moments, pruned by GCV; each is solved in a task."""
    schema = T.StructType([*[moments.schema[c] for c in by], *T.StructType.fromDDL(f"intercept double, terms {_TERMS}").fields])
    arrow = pa.schema([("intercept", pa.float64()), ("terms", pa.list_(pa.struct([("side", pa.int32()), ("knot", pa.float64()), ("coef", pa.float64())])))])
    shared = moments.sparkSession.sparkContext.broadcast(np.asarray(knots))

    def solve(table: pa.Table) -> pa.Table:
        fit = HingeFit(as_array(table.select(["b", *MOMENTS]).to_pylist(), shared.value), shared.value, max_terms)
        model = fit.model("x", fit.best_by_gcv(penalty), penalty)
        row = {"intercept": model.intercept, "terms": [dict(zip(("side", "knot", "coef"), t)) for t in model.terms]}
        own = pa.Table.from_pylist([row], schema=arrow)
        return pa.Table.from_arrays([*[table[c].slice(0, 1) for c in by], *own.columns], [*by, *arrow.names])

    return moments.groupBy(*by).applyInArrow(solve, schema)


def value_of(x: Column, intercept: str = "intercept", terms: str = "terms") -> Column:
    """The value of a trend that is kept in columns."""
    return F.aggregate(terms, F.col(intercept), lambda total, t: total + t["coef"] * F.greatest(F.lit(0.0), t["side"] * (x - t["knot"])))


def model_table(df: DataFrame, model: HingeModel) -> DataFrame:
    rows = [("intercept", None, None, model.intercept)] + [
        (f"hinge_{i + 1}", side, knot, coef) for i, (side, knot, coef) in enumerate(model.terms)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, side int, knot double, coefficient double")
