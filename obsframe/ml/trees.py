"""Trees of every resample grown together, a level at a time.

Rows are first added up into cells: one per combination of cut predictors, with a sum of weights and of targets for each resample. A level
is one aggregate over the cells by (resample, node, predictor, cut), from which the best split of every open node of every tree follows;
only the splits come to the driver. A number is one target, classes are one target each (the gain is then Gini's),
so both kinds of trees are grown by the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions.scalar import numbers
from obsframe.operators import ranking
from obsframe.operators.mars import with_interval
from obsframe.session import pin


@dataclass(frozen=True)
class TreeSettings:
    """A node is split while it is above ``max_depth``, both sides keep ``min_rows`` and the gain is positive."""

    max_depth: int = 5
    max_bins: int = 32
    min_rows: float = 1


@dataclass(frozen=True)
class Trees:
    """One tree per resample, as tables of nodes: node i has the children 2 i + 1 and 2 i + 2, a leaf the feature -1."""

    xs: tuple[str, ...]
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    labels: tuple | None = None

    def predict(self, df: DataFrame, resample: Column) -> DataFrame:
        """Adds ``prediction`` by the tree of each row's ``resample`` (a number from 0)."""
        return self.predict_depths(df, resample, [self.depth]).withColumnRenamed(f"prediction_{self.depth}", "prediction")

    def predict_depths(self, df: DataFrame, resample: Column, depths: Sequence[int]) -> DataFrame:
        """Adds ``prediction_<depth>`` of the trees cut off at each depth, in one walk down: a tree of less depth is the top of a deeper one."""
        width = self.value.shape[1]
        x = F.array(*[F.col(c).cast("double") for c in self.xs])
        feature, cut, value = (numbers(t.ravel().tolist(), k) for t, k in ((self.feature, "int"), (self.cut, "double"), (self.value, "double")))
        found = F.get(value, F.col("tree_") + F.col("node_"))
        if self.labels is not None:
            found = F.get(F.array(*[F.lit(v) for v in self.labels]), found.cast("int"))
        out = df.withColumns({"tree_": (resample * width).cast("int"), "node_": F.lit(0)})
        for level in range(self.depth + 1):
            if level in depths:
                out = out.withColumn(f"prediction_{level}", found)
            if level < self.depth:
                out = out.withColumn("feature_", F.get(feature, F.col("tree_") + F.col("node_")))
                right = F.get(x, F.col("feature_")) > F.get(cut, F.col("tree_") + F.col("node_"))
                out = out.withColumn("node_", F.when(F.col("feature_") < 0, F.col("node_")).otherwise(2 * F.col("node_") + 1 + right.cast("int")))
        return out.drop("tree_", "node_", "feature_")


def cut_points(df: DataFrame, xs: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Where each predictor may be cut (at or below, above): every distinct value but the last, or exact quantiles of many."""
    plain = df.select(*[F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(xs)])
    sizes = plain.agg(*[F.approx_count_distinct(c).alias(c) for c in plain.columns]).first()
    few = [c for c in plain.columns if sizes[c] <= 2 * max_bins]
    sets = plain.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    out = {}
    for x, c in zip(xs, plain.columns):
        some = sorted(sets[c]) if c in few else None
        if some is None or len(some) > max_bins:
            probs = {f"q{i}": i / max_bins for i in range(1, max_bins)}
            row = ranking.quantiles(plain.select(c), [], c, probs).first()
            some = [*sorted({float(row[q]) for q in probs}), float("inf")]
        out[x] = some[:-1]
    return out


def _cells(
    df: DataFrame, xs: Sequence[str], cuts: dict[str, list[float]], targets: Sequence[Column], weights: Sequence[Column], marks: Sequence[str] | None,
) -> DataFrame:
    """``x`` (each predictor moved up to its next cut), ``n`` (weight in each resample) and ``s`` (target sums in each resample)."""
    moved = df
    for i, c in enumerate(xs):
        moved = with_interval(moved.withColumn(f"v{i}_", F.col(c).cast("double")), f"v{i}_", cuts[c], f"k{i}_", strictly=True)
    keys = [f"k{i}_" for i in range(len(xs))]
    sums = [f"t{k}_" for k in range(len(targets))]
    if marks is not None:
        # Rows of the same cuts and folds are one before they are told off to resamples.
        moved = moved.groupBy(*keys, *marks).agg(F.count(F.lit(1)).cast("double").alias("c_"), *[F.sum(t.cast("double")).alias(s) for t, s in zip(targets, sums)])
    else:
        moved = moved.withColumns({"c_": F.lit(1.0), **{s: t.cast("double") for t, s in zip(targets, sums)}})
    plain = moved.select(*keys, "c_", *sums, *[w.cast("double").alias(f"w{r}") for r, w in enumerate(weights)])
    totals = [F.sum(F.col(f"w{r}") * F.col("c_")).alias(f"n{r}") for r in range(len(weights))]
    totals += [F.sum(F.col(f"w{r}") * F.col(s)).alias(f"s{r}_{k}") for r in range(len(weights)) for k, s in enumerate(sums)]
    cells = plain.groupBy(*keys).agg(*totals)
    per = [F.struct(F.lit(r).alias("r"), F.col(f"n{r}").alias("n"), F.array(*[f"s{r}_{k}" for k in range(len(targets))]).alias("s")) for r in range(len(weights))]
    bounds = [F.get(numbers([*cuts[c], float("inf")]), F.col(k)) for c, k in zip(xs, keys)]
    return pin(cells.select(F.array(*bounds).alias("x"), F.array(*per).alias("per")))


def _splits(cells: DataFrame, trees: dict, level: int, predictors: int, targets: int, cfg: TreeSettings) -> list:
    """The best split of each open node of a level: predictor, cut, gain and the sums on both sides."""
    width = 2 ** (level + 1) - 1
    feature, cut = (numbers(trees[n][:, :width].ravel().tolist(), k) for n, k in (("feature", "int"), ("cut", "double")))
    rows = cells.select("x", F.inline("per")).where("n > 0").withColumn("node", F.lit(0))
    for _ in range(level):
        at = F.col("r") * width + F.col("node")
        rows = rows.withColumn("f", F.get(feature, at)).withColumn("c", F.get(cut, at))
        below = 2 * F.col("node") + 1 + (F.get("x", F.col("f")) > F.col("c")).cast("int")
        rows = rows.withColumn("node", F.when(F.col("f") < 0, F.lit(-1)).when(F.col("node") < 0, F.lit(-1)).otherwise(below)).where("node >= 0")
    long = rows.select("r", "node", "n", "s", F.posexplode("x").alias("f", "cut")) if predictors > 1 else rows.select(
        "r", "node", "n", "s", F.lit(0).alias("f"), F.get("x", F.lit(0)).alias("cut"))
    sums = long.groupBy("r", "node", "f", "cut").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(targets)])
    whole = Window.partitionBy("r", "node", "f")
    running = whole.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n", *[f"s{k}" for k in range(targets)]]
    sums = sums.select("r", "node", "f", "cut", *[F.sum(c).over(running).alias(f"left_{c}") for c in names], *[F.sum(c).over(whole).alias(f"all_{c}") for c in names])

    def purity(side: str) -> Column:
        n = F.col("all_n") - F.col("left_n") if side == "right" else F.col(f"{side}_n")
        parts = [F.col(f"all_s{k}") - F.col(f"left_s{k}") if side == "right" else F.col(f"{side}_s{k}") for k in range(targets)]
        return F.try_divide(sum((p * p for p in parts), F.lit(0.0)), n)

    enough = (F.col("left_n") >= cfg.min_rows) & (F.col("all_n") - F.col("left_n") >= cfg.min_rows)
    gain = F.when(enough, purity("left") + purity("right") - purity("all"))
    found = sums.withColumn("gain", gain).withColumn("base", purity("all"))
    # Of equal gains, apart from rounding, the first predictor's and the smallest cut.
    order = F.struct(F.round(F.try_divide(F.col("gain"), F.col("base")), 12).alias("g"), (-F.col("f")).alias("f"), (-F.col("cut")).alias("c"))
    row = F.struct("f", "cut", "gain", "base", *[f"left_{c}" for c in names], *[f"all_{c}" for c in names])
    # Nodes without a possible split still tell their sums.
    best = found.groupBy("r", "node").agg(F.max_by(row, F.when(F.col("gain").isNotNull(), order)).alias("best"), F.first(row).alias("any"))
    return best.select("r", "node", F.coalesce("best", "any").alias("b")).select("r", "node", "b.*").collect()


def grow(
    df: DataFrame, xs: Sequence[str], targets: Sequence[Column], weights: Sequence[Column], cfg: TreeSettings = TreeSettings(), labels: Sequence | None = None,
    marks: Sequence[str] | None = None,
) -> Trees:
    """A tree for each column of ``weights``: a row's share in that resample's training rows, 0 for those held out.

    Rows need all predictors and targets. With ``labels`` the targets are indicators of these classes, in order; a leaf gives the
    most frequent one, the first of equals. ``marks`` are the columns that the weights are made of, if these have few values.
    """
    cells = _cells(df, xs, cut_points(df, xs, cfg.max_bins), targets, weights, marks)
    resamples, k = len(weights), len(targets)
    size = 2 ** (cfg.max_depth + 1) - 1
    table = {"feature": np.full((resamples, size), -1), "cut": np.zeros((resamples, size))}
    n, s = np.zeros((resamples, size)), np.zeros((resamples, size, k))
    for level in range(max(cfg.max_depth, 1)):
        rows = _splits(cells, table, level, len(xs), k, cfg)
        for r in rows:
            at = (r["r"], r["node"])
            n[at], s[at] = r["all_n"], [r[f"all_s{j}"] for j in range(k)]
            if cfg.max_depth == 0 or r["gain"] is None or r["gain"] <= 1e-12 * abs(r["base"]):
                continue
            table["feature"][at], table["cut"][at] = r["f"], r["cut"]
            left = (r["r"], 2 * r["node"] + 1)
            right = (r["r"], 2 * r["node"] + 2)
            n[left], s[left] = r["left_n"], [r[f"left_s{j}"] for j in range(k)]
            n[right], s[right] = n[at] - n[left], s[at] - s[left]
        if not (table["feature"][:, 2**level - 1 : 2 ** (level + 1) - 1] >= 0).any():
            break
    value = s.argmax(axis=2).astype(float) if labels is not None else s[:, :, 0] / np.where(n > 0, n, np.nan)
    return Trees(tuple(xs), cfg.max_depth, table["feature"], table["cut"], value, tuple(labels) if labels is not None else None)
