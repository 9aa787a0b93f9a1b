"""Hinge models of several predictors: sums of products of hinges, found by a forward search over (term, predictor, knot).

A candidate multiplies a term that is in the model with both hinges of a predictor at a knot. What its gain needs are sums, per interval of each
predictor, of products of two terms and of those times the predictor; a step adds only the sums of its two new terms, so a
step is one aggregate over the rows and the older sums are kept. Equal rows are one weighted row from the start.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.operators.mars import THRESHOLD, TIE, _candidate_knots, _frame, with_interval
from obsframe.session import pin

Factor = tuple[str, int, float]  # predictor, side, knot


@dataclass(frozen=True)
class ProductModel:
    """``sum(coef * product(max(0, side * (x - knot))))``; the term without factors is the intercept."""

    terms: tuple[tuple[tuple[Factor, ...], float], ...]
    gcv: float
    r2: float

    def predict(self) -> Column:
        out = F.lit(0.0)
        for factors, coef in self.terms:
            part = F.lit(coef)
            for x, side, knot in factors:
                part = part * F.greatest(F.lit(0.0), F.lit(float(side)) * (F.col(x).cast("double") - F.lit(knot)))
            out = out + part
        # A missing predictor leaves no prediction, also where greatest() would pass it over.
        for x in sorted({x for factors, _ in self.terms for x, *_ in factors}):
            out = F.when(F.col(x).isNotNull(), out)
        return out


class _Search:
    """Sums by interval of each predictor for the terms so far, and the candidates' gains from them."""

    def __init__(self, cells: DataFrame, xs: Sequence[str], knots: dict[str, list[float]], degree: int):
        self.cells, self.xs, self.knots, self.degree = cells, list(xs), knots, degree
        self.frames = {x: _frame(knots[x]) for x in xs}
        self.k = {x: (np.array(knots[x]) - self.frames[x][0]) / self.frames[x][1] for x in xs}
        self.terms: list[tuple[tuple[str, int, int], ...]] = []  # predictor, side, number of the knot
        self.s0: dict = {x: {} for x in xs}
        self.s1: dict = {x: {} for x in xs}
        self.s2: dict = {x: {} for x in xs}
        self.y0: dict = {x: {} for x in xs}
        self.y1: dict = {x: {} for x in xs}

    def column(self, term: tuple) -> Column:
        out = F.lit(1.0)
        for x, side, j in term:
            out = out * F.greatest(F.lit(0.0), F.lit(float(side)) * (F.col(f"u_{x}") - F.lit(float(self.k[x][j]))))
        return out

    def add(self, new: list[tuple]) -> None:
        """One pass: the sums of the new terms with all terms."""
        first = len(self.terms)
        self.terms += new
        wide = self.cells.select(
            "w_", "y_", *[self.column(t).alias(f"t{i}") for i, t in enumerate(self.terms)],
            F.inline(F.array(*[F.struct(F.lit(i).alias("x"), F.col(f"b_{x}").alias("b"), F.col(f"u_{x}").alias("u")) for i, x in enumerate(self.xs)])),
        )
        u, sums = F.col("u"), []
        for p in range(first, len(self.terms)):
            t = F.col(f"t{p}")
            for q in range(p + 1):
                both = F.col("w_") * t * F.col(f"t{q}")
                sums += [F.sum(both).alias(f"a{p}_{q}"), F.sum(both * u).alias(f"b{p}_{q}")]
            sums += [F.sum(F.col("w_") * t * t * u * u).alias(f"c{p}"), F.sum(t * F.col("y_")).alias(f"d{p}"), F.sum(t * u * F.col("y_")).alias(f"e{p}")]
        rows = wide.groupBy("x", "b").agg(*sums).collect()
        for i, x in enumerate(self.xs):
            size = len(self.k[x]) + 1
            own = [r for r in rows if r["x"] == i]

            def table(name: str) -> np.ndarray:
                out = np.zeros(size)
                for r in own:
                    out[r["b"]] = r[name]
                return out

            for p in range(first, len(self.terms)):
                for q in range(p + 1):
                    self.s0[x][p, q] = self.s0[x][q, p] = table(f"a{p}_{q}")
                    self.s1[x][p, q] = self.s1[x][q, p] = table(f"b{p}_{q}")
                self.s2[x][p], self.y0[x][p], self.y1[x][p] = table(f"c{p}"), table(f"d{p}"), table(f"e{p}")

    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        x, m = self.xs[0], len(self.terms)
        gram = np.array([[self.s0[x][p, q].sum() for q in range(m)] for p in range(m)])
        return gram, np.array([self.y0[x][p].sum() for p in range(m)])

    def best(self) -> tuple[float, list[tuple]]:
        """The greatest fall of the squared error, and the terms that bring it: both hinges, or one where the model spans the other."""
        gram, rhs = self.normal()
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
        found = (0.0, [])
        for p, parent in enumerate(self.terms):
            if len(parent) >= self.degree:
                continue
            for x in self.xs:
                if any(x == f[0] for f in parent):
                    continue
                k = self.k[x]

                def hinged(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
                    up, base = np.cumsum(high), np.cumsum(low)
                    return [(up[-1] - up[:-1]) - k * (base[-1] - base[:-1]), k * base[:-1] - up[:-1]]

                cross = [np.array(c) for c in zip(*[hinged(self.s1[x][p, q], self.s0[x][p, q]) for q in range(len(self.terms))])]
                to_y = hinged(self.y1[x][p], self.y0[x][p])
                uu, u, n = (np.cumsum(t) for t in (self.s2[x][p], self.s1[x][p, p], self.s0[x][p, p]))
                norms = [(uu[-1] - uu[:-1]) - 2 * k * (u[-1] - u[:-1]) + k * k * (n[-1] - n[:-1]), uu[:-1] - 2 * k * u[:-1] + k * k * n[:-1]]
                solved = [inverse @ c for c in cross]
                rest = [np.maximum(norms[i] - np.einsum("ij,ij->j", cross[i], solved[i]), 0.0) for i in (0, 1)]
                pull = [to_y[i] - rhs @ solved[i] for i in (0, 1)]
                mixed = -np.einsum("ij,ij->j", cross[0], solved[1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    alone = [np.where(rest[i] > 1e-8 * np.maximum(norms[i], 1e-300), pull[i] ** 2 / rest[i], 0.0) for i in (0, 1)]
                    left_over = rest[1] - mixed**2 / rest[0]
                    added = (pull[1] - mixed * pull[0] / rest[0]) ** 2 / left_over
                both = (alone[0] > 0) & (alone[1] > 0) & (left_over > 1e-6 * rest[1])
                gain = np.where(both, alone[0] + added, np.maximum(alone[0], alone[1]))
                j = int(np.argmax(gain >= gain.max() * (1 - TIE)))  # of equal knots the first
                if gain[j] > found[0] * (1 + TIE):
                    sides = (1, -1) if both[j] else (1,) if alone[0][j] >= alone[1][j] * (1 - 1e-6) else (-1,)
                    found = (float(gain[j]), [(*parent, (x, side, j)) for side in sides])
        return found


def fit_products(
    df: DataFrame, xs: Sequence[str], y: str, degree: int = 1, max_terms: int = 21, penalty: float | None = None, max_knots: int = 100,
) -> ProductModel:
    """A hinge model of all predictors, pruned by GCV; ``degree`` is how many predictors a term may multiply.

    The penalty of a knot is 2 for sums and 3 for products unless it is given. Rows with a missing predictor or response are left out.
    """
    data = df.dropna(subset=[*xs, y])
    knots = {x: _candidate_knots(data, x, max_knots) for x in xs}
    rows = data.groupBy(*xs).agg(F.count(F.lit(1)).cast("double").alias("w_"), F.sum(F.col(y).cast("double")).alias("y_"))
    for x in xs:
        rows = with_interval(rows.withColumn(f"x_{x}", F.col(x).cast("double")), f"x_{x}", knots[x], f"b_{x}")
        centre, scale = _frame(knots[x])
        rows = rows.withColumn(f"u_{x}", (F.col(f"x_{x}") - F.lit(centre)) / F.lit(scale))
    search = _Search(pin(rows.select("w_", "y_", *[f"{c}_{x}" for x in xs for c in "bu"])), xs, knots, degree)
    n, yy, total = data.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("double") ** 2), F.sum(F.col(y).cast("double"))).first()
    search.add([()])
    base = current = max(yy - total * total / n, 0.0)
    while len(search.terms) + 2 <= max_terms and current > 0:
        gain, new = search.best()
        if not new or gain <= THRESHOLD * base:
            break
        search.add(new)
        current -= gain
    gram, rhs = search.normal()
    penalty = penalty if penalty is not None else (2.0 if degree == 1 else 3.0)

    def fitted(columns: list[int]) -> tuple[float, np.ndarray]:
        part = gram[np.ix_(columns, columns)]
        scale = np.sqrt(np.maximum(np.diag(part), 1e-300))
        coef = np.linalg.lstsq(part / np.outer(scale, scale), rhs[columns] / scale, rcond=1e-10)[0] / scale
        return max(float(yy - 2 * coef @ rhs[columns] + coef @ part @ coef), 0.0), coef

    def gcv(columns: list[int], rss: float) -> float:
        cost = len(columns) + penalty * (len(columns) - 1) / 2
        return np.inf if cost >= n else rss / n / (1 - cost / n) ** 2

    columns = list(range(len(search.terms)))
    chosen, score = columns, gcv(columns, fitted(columns)[0])
    while len(columns) > 1:
        columns = min(([c for c in columns if c != d] for d in columns if d), key=lambda t: (fitted(t)[0], t))
        now = gcv(columns, fitted(columns)[0])
        if now <= score:
            chosen, score = columns, now
    rss, coef = fitted(chosen)
    terms = []
    for c, b in zip(chosen, coef):
        factors = tuple((x, side, float(knots[x][j])) for x, side, j in search.terms[c])
        terms.append((factors, float(b) / float(np.prod([search.frames[x][1] for x, *_ in factors]))))
    return ProductModel(tuple(terms), score, 1 - rss / base if base > 0 else 1.0)
