"""Resampling schemes, and linear models scored under them from sums alone.

A linear fit needs only the sums of products of its columns, so all folds of a scheme are
fitted from one aggregate with a row per fold, and scored in a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold, hash_key
from obsframe.ml.metrics import regression_metrics


@dataclass(frozen=True)
class Scheme:
    """``none``, ``cv``, ``repeatedcv``, ``boot`` or ``loocv``."""

    method: str = "none"
    number: int = 10
    repeats: int = 3
    seed: int = 7


# The Poisson distribution with mean 1 added up from 0, in 65536ths as hexadecimal.
POISSON_STEPS = tuple(
    f"{round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))):04x}" for i in range(7)
)


def poisson_weight(digits: Column) -> Column:
    """How often a row is drawn in one bootstrap sample, from four digits of its hash (compared as text).

    Four digits tell 65536 chances apart, so seven draws or more (8 in 100 000 rows) count as seven.
    """
    weight = F.lit(len(POISSON_STEPS))
    for i, step in reversed(list(enumerate(POISSON_STEPS))):
        weight = F.when(digits < step, i).otherwise(weight)
    return weight


def _drawn(df: DataFrame, scheme: Scheme, ids: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Rows with their hashes, and how often each bootstrap sample draws a row."""
    # One hash of a row serves eight samples; it is a column of its own so that it is taken once.
    hashed = df.withColumns({f"hash_{i}": hash_key(scheme.seed + i, *ids) for i in range(math.ceil(scheme.number / 8))})
    return hashed, [poisson_weight(F.substring(f"hash_{b // 8}", 1 + 4 * (b % 8), 4)) for b in range(scheme.number)]


def resamples(df: DataFrame, scheme: Scheme, ids: Sequence[str]) -> DataFrame:
    """Adds ``resample`` and ``weight``: rows of weight 0 are held out, the others are drawn."""
    if scheme.method == "none":
        return df.withColumns({"resample": F.lit("Apparent"), "weight": F.lit(1)})
    if scheme.method != "boot":
        raise ValueError(f"{scheme.method} has no drawn rows")
    hashed, per = _drawn(df, scheme, ids)
    draws = [F.struct(F.lit(name).alias("resample"), w.alias("weight")) for name, w in zip(names_of(scheme), per)]
    return hashed.select(*df.columns, F.inline(F.array(*draws)))


def folds(df: DataFrame, scheme: Scheme, ids: Sequence[str]) -> DataFrame:
    """Adds ``resample``, the fold that holds a row out; repeats give a row several times."""
    repeats = scheme.repeats if scheme.method == "repeatedcv" else 1
    names = [
        F.concat(
            F.lit("Fold"), F.lpad((hash_fold(scheme.number, scheme.seed + r, *ids) + 1).cast("string"), 2, "0"),
            F.lit(f".Rep{r + 1}" if repeats > 1 else ""),
        )
        for r in range(repeats)
    ]
    return df.select("*", F.explode(F.array(*names)).alias("resample"))


def names_of(scheme: Scheme) -> list[str]:
    """The resamples of a scheme, in order."""
    if scheme.method == "none":
        return ["Apparent"]
    if scheme.method == "boot":
        return [f"Resample{b + 1:02d}" for b in range(scheme.number)]
    if scheme.method not in ("cv", "repeatedcv"):
        raise ValueError(f"{scheme.method} is no scheme with resamples that are fitted")
    repeats = scheme.repeats if scheme.method == "repeatedcv" else 1
    return [f"Fold{f + 1:02d}" + (f".Rep{r + 1}" if repeats > 1 else "") for r in range(repeats) for f in range(scheme.number)]


def shares(df: DataFrame, scheme: Scheme, ids: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """The rows with helper columns, and for each resample a Column: how often a row is trained on, 0 where it is held out."""
    names = names_of(scheme)
    if scheme.method == "none":
        return df, [F.lit(1)]
    if scheme.method == "boot":
        wide, per = _drawn(df, scheme, ids)
        return wide, per
    repeats = scheme.repeats if scheme.method == "repeatedcv" else 1
    marked = df.withColumns({f"fold_{r}": hash_fold(scheme.number, scheme.seed + r, *ids) for r in range(repeats)})
    return marked, [(F.col(f"fold_{i // scheme.number}") != i % scheme.number).cast("int") for i in range(len(names))]


def held_out(marked: DataFrame, per: Sequence[Column], scheme: Scheme, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every row with each ``resample`` (and its ``number``, from 0) that holds it out; without resampling, of all rows."""
    names = names_of(scheme)
    if scheme.method in ("cv", "repeatedcv"):  # a row is held out once a repeat, by its own fold
        folds_of = [F.col(f"fold_{r}") + r * scheme.number for r in range(len(names) // scheme.number)]
        rows = marked.select(*dict.fromkeys(columns), F.explode(F.array(*[f.cast("int") for f in folds_of])).alias("number"))
        return rows.withColumn("resample", F.get(F.array(*[F.lit(n) for n in names]), F.col("number")))
    pairs = [F.struct(F.lit(name).alias("resample"), F.lit(i).alias("number"), w.alias("weight")) for i, (name, w) in enumerate(zip(names, per))]
    rows = marked.select(*dict.fromkeys(columns), F.inline(F.array(*pairs)))
    return (rows if scheme.method == "none" else rows.where("weight = 0")).drop("weight")


def moments(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), weight: Column | None = None) -> dict:
    """Sums of all products of (1, xs, y) per group, as matrices keyed by group."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    size = len(z)
    rows = df.groupBy(*by).agg(*[F.sum(w * z[i] * z[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]).collect()
    out = {}
    for r in rows:
        m = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by)] = m
    return out


def moments_of(df: DataFrame, models: dict[str, list[str]], y: str, by: Sequence[str], weight: Column | None = None) -> dict[str, dict]:
    """``moments`` of several models in one pass, each over the rows that are complete in its own columns."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    columns, places = [], []
    for n, xs in enumerate(models.values()):
        z = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
        whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*xs, y)])
        places.append([(i, j, f"m{n}_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))])
        columns += [F.sum(F.when(whole, w * z[i] * z[j])).alias(name) for i, j, name in places[-1]]
    rows = df.groupBy(*by).agg(*columns).collect()
    out: dict[str, dict] = {}
    for (name, xs), own in zip(models.items(), places):
        out[name] = {}
        for r in rows:
            m = np.zeros((len(xs) + 2, len(xs) + 2))
            for i, j, cell in own:
                m[i, j] = m[j, i] = r[cell] or 0.0
            out[name][tuple(r[c] for c in by)] = m
    return out


def solve(m: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares coefficients (intercept first) from a matrix of sums."""
    a, b = m[:-1, :-1].copy(), m[:-1, -1]
    if ridge:
        n = a[0, 0]
        sd2 = np.maximum(np.diag(a) / n - (a[0] / n) ** 2, 1e-300)
        a[np.arange(1, len(a)), np.arange(1, len(a))] += ridge * n * sd2[1:]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale


def solve_penalised(m: np.ndarray, penalty: float, mix: float) -> np.ndarray:
    """Coefficients (intercept first) of the elastic net from a matrix of sums, by Spark's objective: columns and response
    at unit spread, the penalty over the response's spread, its share ``mix`` on absolute values; the intercept is free.
    """
    mean = m[0, :-1] / m[0, 0], m[0, -1] / m[0, 0]
    spread = m / m[0, 0] - np.outer(m[0], m[0]) / m[0, 0] ** 2
    own = np.maximum(np.diag(m) / m[0, 0], 1e-300)
    sd = np.sqrt(np.where(np.diag(spread) > 1e-14 * own, np.diag(spread), 0.0))
    used = np.flatnonzero(sd[1:-1]) + 1
    coef = np.zeros(len(m) - 1)
    if sd[-1] and len(used):
        a = spread[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        b = spread[used, -1] / (sd[used] * sd[-1])
        flat, ridge = mix * penalty / sd[-1], (1 - mix) * penalty / sd[-1]
        a = a + ridge * np.eye(len(used))
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        if flat:
            for _ in range(10_000):
                before = w.copy()
                for i in range(len(w)):
                    rest = b[i] - a[i] @ w + a[i, i] * w[i]
                    w[i] = np.sign(rest) * max(abs(rest) - flat, 0.0) / a[i, i]
                if np.abs(w - before).max() <= 1e-13:
                    break
        coef[used] = w * sd[-1] / sd[used]
    coef[0] = mean[1] - coef[1:] @ mean[0][1:]
    return coef


def line(coef: np.ndarray, xs: Sequence[str]) -> Column:
    out = F.lit(float(coef[0]))
    for c, b in zip(xs, coef[1:]):
        out = out + F.lit(float(b)) * F.col(c).cast("double")
    return out


def linear_predictor(df: DataFrame, xs: Sequence[str], y: str, ridge: float = 0.0) -> Column:
    """A linear fit to all rows, as a Column."""
    return line(solve(moments(df, xs, y)[()], ridge), xs)


def _models_by_resample(coefs: dict[str, dict[str, np.ndarray]], models: dict[str, list[str]]) -> Column:
    """(model, prediction) pairs of a row, every model with the coefficients of the row's resample."""
    pairs = []
    for name, xs in models.items():
        table = F.create_map(*[x for k, c in coefs[name].items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in c]))])
        own = F.element_at(table, F.col("resample"))
        fit = own[0]
        for i, c in enumerate(xs):
            fit = fit + own[i + 1] * F.col(c).cast("double")
        pairs.append(F.struct(F.lit(name).alias("model"), fit.alias("prediction")))
    return F.inline(F.array(*pairs))


def resample_models(
    df: DataFrame, models: dict[str, list[str]], y: str, ids: Sequence[str], scheme: Scheme, ridge: float = 0.0
) -> DataFrame:
    """Held-out metrics of several linear models, a row per model and resample.

    A model uses the rows that are complete in its own predictors, whatever models run beside it. One pass sums the
    products of every model's columns, one more pass scores them all. A model without predictors is the plain mean.
    """
    data = df.where(F.col(y).isNotNull())
    if scheme.method in ("cv", "repeatedcv"):
        held = folds(data, scheme, ids)
        sums = {}
        for name, own in moments_of(held, models, y, ["resample"]).items():
            total = sum(own.values()) / (scheme.repeats if scheme.method == "repeatedcv" else 1)
            sums[name] = {k[0]: total - m for k, m in own.items()}
    else:
        drawn = resamples(data, scheme, ids)
        sums = {
            name: {k[0]: m for k, m in own.items()}
            for name, own in moments_of(drawn, models, y, ["resample"], F.col("weight")).items()
        }
        held = drawn if scheme.method == "none" else drawn.where("weight = 0")
    coefs = {name: {k: solve(m, ridge) for k, m in own.items()} for name, own in sums.items()}
    used = sorted({x for xs in models.values() for x in xs})
    scored = held.select(*dict.fromkeys(["resample", y, *used]), _models_by_resample(coefs, models))
    return regression_metrics(scored.where("prediction IS NOT NULL"), y, "prediction", ["model", "resample"])


LINE_METRICS = ("rmse", "mse", "mae", "r2")
MAX_MOMENTS = 30


def score_penalised(
    df: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], k: int, seed: int, penalties: Sequence[tuple[float, float]], metric: str
) -> list[float]:
    """The mean held-out metric over ``k`` folds of every (penalty, mix): one scan sums products per fold, one more scores all fits."""
    data = df.dropna(subset=[*xs, y]).select(*dict.fromkeys([*xs, y]), hash_fold(k, seed, *ids).alias("fold"))
    per = moments(data, xs, y, ["fold"])
    empty = [f for f in range(k) if (f,) not in per]
    if empty:
        raise ValueError(f"fold {empty[0]} has no rows")
    total = sum(per.values())
    observed, parts = F.col(y).cast("double"), []
    for i, (penalty, mix) in enumerate(penalties):
        coefs = [solve_penalised(total - per[f,], penalty, mix) for f in range(k)]
        own = [F.get(F.array(*[F.lit(float(c[j])) for c in coefs]), F.col("fold")) for j in range(len(xs) + 1)]
        error = observed - reduce(Column.__add__, [own[0], *[b * F.col(x).cast("double") for b, x in zip(own[1:], xs)]])
        parts.append(F.avg(F.abs(error) if metric == "mae" else error * error).alias(f"e{i}"))
    rows = data.groupBy("fold").agg(F.var_pop(observed).alias("spread"), *parts).collect()

    def measured(r, i: int) -> float:
        if metric == "r2":
            return 1 - r[f"e{i}"] / r["spread"] if r["spread"] else math.nan
        return math.sqrt(r[f"e{i}"]) if metric == "rmse" else r[f"e{i}"]

    return [sum(measured(r, i) for r in rows) / k for i in range(len(penalties))]


def score_fits(
    df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme
) -> DataFrame:
    """``resample``, the response and ``prediction`` of the held-out rows of any algorithm; ``fit`` is run once for each resample.

    Leaving out one row at a time needs a closed form, which only linear models have.
    """
    marked, per = shares(df.dropna(subset=[*xs, y]), scheme, ids)
    scored = None
    for name, weight in zip(names_of(scheme), per):
        train = marked.where(weight > 0)
        if scheme.method == "boot":
            train = train.select(*df.columns, F.explode(F.array_repeat(F.lit(1), weight)).alias("copy_")).drop("copy_")
        held = marked if scheme.method == "none" else marked.where(weight == 0)
        held = held.select(*df.columns, F.lit(name).alias("resample"))
        part = fit(train.select(*df.columns))(held).select("resample", y, "prediction")
        scored = part if scored is None else scored.unionByName(part)
    return scored


def resample_linear(df: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, ridge: float = 0.0) -> DataFrame:
    """One row of held-out metrics per resample; with no ``xs`` the model is the plain mean."""
    if scheme.method == "loocv":
        return _leave_one_out(df.dropna(subset=[*xs, y]), list(xs), y)
    return resample_models(df, {"model": list(xs)}, y, ids, scheme, ridge).drop("model")


def _leave_one_out(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Errors of the fits without each row, from its leverage: e / (1 - h)."""
    m = moments(df, xs, y)[()]
    inverse = np.linalg.pinv(m[:-1, :-1], rcond=1e-15)
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    leverage = sum(
        (F.lit(float(inverse[i, j])) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0)
    )
    error = (F.col(y) - line(solve(m), xs)) / (1 - leverage)
    scored = df.withColumns({"resample": F.lit("LeaveOneOut"), "prediction": F.col(y) - error})
    return regression_metrics(scored, y, "prediction", ["resample"])
