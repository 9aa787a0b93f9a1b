"""Models of all resamples fitted together from sums, and scored in one scan of the held-out rows.

Trees grow from one aggregate per level (``trees``). The models of classes by means and spreads (the commonest class, linear and quadratic
discriminants, Gaussian naive Bayes) all score a class by a quadratic form of the predictors, whose coefficients follow from
counts, sums and products per resample and class. The one-rule model needs counts per resample, level and class only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.scalar import numbers
from obsframe.ml import trees
from obsframe.ml.metrics import classification_metrics, regression_metrics
from obsframe.ml.resample import Scheme, folds, held_out, moments, names_of, resamples, shares
from obsframe.session import pin

CLASS_FORMS = ("null", "lda", "qda", "nb")
MAX_CLASSES = 1000


def classes_of(df: DataFrame, y: str) -> list:
    """The classes in order; more than ``MAX_CLASSES`` are an error."""
    found = sorted(r[0] for r in df.where(F.col(y).isNotNull()).select(y).distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{y} has more than {MAX_CLASSES} classes")
    return found


def _grown(df: DataFrame, kind: str, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, **params) -> tuple[trees.Trees, DataFrame]:
    """The trees of all resamples, and the rows that each holds out."""
    data = df.dropna(subset=[*xs, y])
    marked, per = shares(data, scheme, ids)
    names = {"maxDepth": "max_depth", "maxBins": "max_bins", "minInstancesPerNode": "min_rows"}
    cfg = trees.TreeSettings(**{names[k]: v for k, v in params.items()})
    labels = classes_of(data, y) if kind == "classification" else None
    targets = [F.col(y)] if labels is None else [(F.col(y) == F.lit(v)).cast("int") for v in labels]
    marks = {"none": [], "boot": None}.get(scheme.method, [c for c in marked.columns if c not in data.columns])
    grown = trees.grow(marked, xs, targets, per, cfg, labels, marks)
    return grown, held_out(marked, per, scheme, [*xs, y])


def score_trees(df: DataFrame, kind: str, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, **params) -> DataFrame:
    """Held-out rows with the prediction of their resample's tree."""
    grown, held = _grown(df, kind, xs, y, ids, scheme, **params)
    return grown.predict(held, F.col("number")).select("resample", y, "prediction")


def score_depths(
    df: DataFrame, kind: str, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, depths: Sequence[int], metric: str, **params,
) -> dict[int, float]:
    """The mean of a metric over the resamples for trees of several depths, which are grown and scored once, at the greatest."""
    grown, held = _grown(df, kind, xs, y, ids, scheme, maxDepth=max(depths), **params)
    wide = grown.predict_depths(held, F.col("number"), depths)
    each = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"prediction_{d}").alias("prediction")) for d in sorted(set(depths))])
    long = wide.select("resample", F.col(y).alias("observed"), F.inline(each))
    measure = classification_metrics if kind == "classification" else regression_metrics
    per = measure(long, "observed", "prediction", ["depth", "resample"])
    return {r["depth"]: r["m"] for r in per.groupBy("depth").agg(F.avg(metric).alias("m")).collect()}


def class_sums(df: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme) -> dict[str, dict]:
    """For each resample and class the sums of products of (1, xs) over its training rows."""
    data = df.withColumn("ones_", F.lit(1.0))
    by = ["resample", y]
    if scheme.method in ("cv", "repeatedcv"):
        own = moments(folds(data, scheme, ids), xs, "ones_", by)
        out: dict[str, dict] = {}
        for name in names_of(scheme):
            repeat = name.rpartition(".")[2] if scheme.method == "repeatedcv" else ""
            others = [(k, m) for k, m in own.items() if k[0] != name and (not repeat or k[0].endswith(f".{repeat}"))]
            out[name] = {c: sum(m for k, m in others if k[1] == c) for c in {k[1] for k, _ in others}}
    else:
        drawn = resamples(data, scheme, ids)
        own = moments(drawn.where("weight > 0"), xs, "ones_", by, F.col("weight"))
        out = {name: {} for name in names_of(scheme)}
        for (name, c), m in own.items():
            out[name][c] = m
    return {name: {c: m[:-1, :-1] for c, m in per.items()} for name, per in out.items()}


def quadratic_form(algorithm: str, sums: dict, p: int) -> dict[object, np.ndarray]:
    """Each class's score as a symmetric matrix over (1, xs), from the class's sums."""
    total = sum(m[0, 0] for m in sums.values())
    counts, means, spreads = {}, {}, {}
    for c, m in sums.items():
        n = m[0, 0]
        counts[c], means[c] = n, m[0, 1:] / n
        spreads[c] = m[1:, 1:] - n * np.outer(means[c], means[c])
    pooled = sum(spreads.values()) / max(total - len(sums), 1)
    # Naive Bayes: variances of the population, kept off 0 by a billionth of the largest overall variance.
    overall = sum(m for m in sums.values())
    widest = float(np.max(np.diag(overall)[1:] / total - (overall[0, 1:] / total) ** 2)) if p else 0.0
    out = {}
    for c in sums:
        form = np.zeros((p + 1, p + 1))
        form[0, 0] = math.log(counts[c] / total)
        if algorithm in ("lda", "qda"):
            cov = pooled if algorithm == "lda" else spreads[c] / max(counts[c] - 1, 1)
            if np.linalg.matrix_rank(cov) < p:
                raise ValueError(f"class {c} has too few or too similar rows for a covariance of {p} predictors")
            inverse = np.linalg.inv(cov)
            form[0, 0] -= 0.5 * means[c] @ inverse @ means[c] + (0.5 * math.log(np.linalg.det(cov)) if algorithm == "qda" else 0.0)
            form[0, 1:] = form[1:, 0] = 0.5 * inverse @ means[c]
            form[1:, 1:] = -0.5 * inverse if algorithm == "qda" else 0.0
        elif algorithm == "nb":
            variance = np.diag(spreads[c]) / counts[c] + 1e-9 * widest
            form[0, 0] -= 0.5 * float(np.sum(np.log(2 * np.pi * variance) + means[c] ** 2 / variance))
            form[0, 1:] = form[1:, 0] = 0.5 * means[c] / variance
            form[1:, 1:] = np.diag(-0.5 / variance)
        out[c] = form
    return out


def score_forms(df: DataFrame, algorithm: str, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, probabilities: bool = False) -> DataFrame:
    """Held-out rows with the class of the highest score (ties: the first class); with ``probabilities`` also those of all classes.

    A class that a resample does not train on is never predicted by it.
    """
    xs = list(xs) if algorithm != "null" else []
    data = df.dropna(subset=[*xs, y])
    centre = data.agg(*[F.avg(c).alias(c) for c in xs]).first() if xs else {}
    shifted = [(F.col(c).cast("double") - F.lit(float(centre[c] or 0.0))).alias(f"x{i}_") for i, c in enumerate(xs)]
    data = data.select("*", *shifted)
    moved = [f"x{i}_" for i in range(len(xs))]
    sums = class_sums(data, moved, y, ids, scheme) if moved else _class_counts(data, y, ids, scheme)
    labels = sorted({c for per in sums.values() for c in per})
    names, p = names_of(scheme), len(xs)
    places = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    table = np.full((len(names), len(labels), len(places)), 0.0)
    table[:, :, 0] = -np.inf
    for r, name in enumerate(names):
        for c, form in quadratic_form(algorithm, sums[name], p).items():
            table[r, labels.index(c)] = [form[i, j] * (1 if i == j else 2) for i, j in places]
    marked, per = shares(data, scheme, ids)
    held = held_out(marked, per, scheme, [*moved, y])
    z = [F.lit(1.0), *[F.col(c) for c in moved]]
    held = held.withColumn("z_", F.array(*[z[i] * z[j] for i, j in places]))
    scores = []
    for k in range(len(labels)):
        own = numbers(table[:, k].ravel().tolist())
        parts = [F.get(own, F.col("number") * len(places) + t) * F.col("z_")[t] for t in range(len(places)) if table[:, k, t].any()]
        scores.append(sum(parts[1:], parts[0]))
    held = held.withColumn("scores_", F.array(*scores)).withColumn("top_", F.array_max("scores_"))
    best = F.get(F.array(*[F.lit(v) for v in labels]), (F.array_position("scores_", F.col("top_")) - 1).cast("int"))
    held = held.withColumn("prediction", best)
    if not probabilities:
        return held.select("resample", y, "prediction")
    odds = F.transform("scores_", lambda s: F.exp(s - F.col("top_")))
    held = held.withColumn("odds_", odds).withColumn("sum_", F.aggregate("odds_", F.lit(0.0), lambda a, b: a + b))
    return held.select("resample", y, "prediction", *[(F.col("odds_")[k] / F.col("sum_")).alias(f"p_{v}") for k, v in enumerate(labels)])


def _class_counts(df: DataFrame, y: str, ids: Sequence[str], scheme: Scheme) -> dict[str, dict]:
    per = class_sums(df.withColumn("zero_", F.lit(0.0)), ["zero_"], y, ids, scheme)
    return {name: {c: m[:1, :1] for c, m in own.items()} for name, own in per.items()}


def score_one_rule(df: DataFrame, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme) -> DataFrame:
    """Held-out rows under the one predictor whose majority rule errs least in their resample's training rows."""
    plain = df.where(F.col(y).isNotNull()).select(*ids, F.col(y).alias("response"), *[F.col(c).cast("string").alias(f"x{i}_") for i, c in enumerate(xs)])
    marked, per = shares(plain, scheme, ids)
    drawn = [F.struct(F.lit(name).alias("resample"), w.alias("weight")) for name, w in zip(names_of(scheme), per)]
    levels = F.array(*[F.struct(F.lit(i).alias("variable"), F.col(f"x{i}_").alias("level")) for i in range(len(xs))])
    # Equal rows are one before they are told off to resamples: a cell for each combination of levels, class and set of weights.
    combined = marked.select("response", levels.alias("levels"), F.array(*per).alias("weights")).groupBy("response", "levels", "weights").agg(F.count(F.lit(1)).alias("rows"))
    long = combined.select("response", "rows", "levels", F.posexplode("weights").alias("number", "weight")).where("weight > 0")
    cells = long.select("number", "response", (F.col("rows") * F.col("weight")).alias("n"), F.inline("levels")).groupBy("number", "variable", "level", "response").agg(F.sum("n").alias("n"))
    answer = F.min_by("response", F.struct(-F.col("n"), F.col("response")))
    rules = pin(cells.groupBy("number", "variable", "level").agg(answer.alias("answer"), F.max("n").alias("right")))
    right = rules.groupBy("number", "variable").agg(F.sum("right").alias("right"))
    best = right.groupBy("number").agg(F.min_by("variable", F.struct(-F.col("right"), F.col("variable"))).alias("variable"))
    common = cells.where("variable = 0").groupBy("number", "response").agg(F.sum("n").alias("n")).groupBy("number").agg(answer.alias("common"))
    chosen = {r["number"]: (r["variable"], r["common"]) for r in best.join(common, "number").collect()}
    held = held_out(marked, per, scheme, ["response", *[f"x{i}_" for i in range(len(xs))]])
    variables = [chosen[i][0] for i in range(len(names_of(scheme)))]
    commons = F.array(*[F.lit(chosen[i][1]) for i in range(len(variables))])
    level = F.get(F.array(*[f"x{i}_" for i in range(len(xs))]), F.get(F.array(*[F.lit(v) for v in variables]), F.col("number")))
    held = held.withColumn("level_", level).withColumn("variable_", F.get(F.array(*[F.lit(v) for v in variables]), F.col("number")))
    own = rules.select(F.col("number").alias("number_"), F.col("variable").alias("rule_"), F.col("level").alias("its_"), "answer")
    same = (held["number"] == own["number_"]) & (held["variable_"] == own["rule_"]) & held["level_"].eqNullSafe(own["its_"])
    scored = held.join(own, same, "left")
    return scored.select("resample", F.col("response").alias(y), F.coalesce("answer", F.get(commons, F.col("number"))).alias("prediction"))


def score_together(df: DataFrame, algorithm: str, kind: str, xs: Sequence[str], y: str, ids: Sequence[str], scheme: Scheme, **params) -> DataFrame | None:
    """``resample``, the response and ``prediction`` of the held-out rows; None where an algorithm has to be fitted once per resample."""
    if scheme.method == "loocv":
        return None
    if algorithm == "rpart" and set(params) <= {"maxDepth", "maxBins", "minInstancesPerNode"}:
        return score_trees(df, kind, xs, y, ids, scheme, **params)
    if kind == "classification" and algorithm in CLASS_FORMS and not params:
        return score_forms(df, algorithm, xs, y, ids, scheme)
    if kind == "classification" and algorithm == "oner":
        return score_one_rule(df, xs, y, ids, scheme)
    return None
