"""Preparing model data: dividing, splitting, selecting and filling columns.

Whatever is learnt from training rows comes back as a ``Fitted``, which applies it to any
frame, so new data never influences what was learnt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_key
from obsframe.operators import ranking
from obsframe.operators.stats import numeric_columns

SEED = 7


@dataclass(frozen=True)
class Fitted:
    """A learnt step: ``apply`` runs it on a frame, ``learnt`` is what it knows."""

    apply: Callable[[DataFrame], DataFrame]
    learnt: dict

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def divide(df: DataFrame, response: str, ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Predictors and response as two frames, each with the ids."""
    return df.drop(response), df.select(*ids, response)


def _strata(df: DataFrame, response: str, groups: int, by: str | None) -> DataFrame:
    """The response itself (``by="value"``, the rule for text) or its quantile group (``by="quantile"``, for numbers)."""
    if (by or ("quantile" if response in numeric_columns(df) else "value")) == "value":
        return df.withColumn("stratum", F.col(response).cast("string"))
    probs = {f"q{i}": i / groups for i in range(1, groups)}
    cuts = ranking.quantiles(df, [], response, probs).first()
    place = sum((F.when(F.col(response) > cuts[q], 1).otherwise(0) for q in probs), F.lit(0))
    return df.withColumn("stratum", place.cast("string"))


def split(df: DataFrame, response: str, ids: Sequence[str], p: float = 0.8, seed: int = SEED, groups: int = 5, by: str | None = None) -> DataFrame:
    """Adds ``part``: test (no response), train (a share ``p`` of each stratum) or validation."""
    known = _strata(df.where(F.col(response).isNotNull()), response, groups, by)
    ranked = ranking.hash_rank(known.withColumn("hash_key", hash_key(seed, *ids)), ["stratum"], "hash_key")
    part = F.when(F.col("position") <= F.ceil(F.col("group_n") * p), "train").otherwise("validation")
    parted = ranked.withColumn("part", part).select(*df.columns, "part")
    return parted.unionByName(df.where(F.col(response).isNull()).withColumn("part", F.lit("test")))


def complete_cases(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(predictors))


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]

    def r(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))

    row = df.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    return {pair: row[f"{pair[0]}|{pair[1]}"] or 0.0 for pair in pairs}


def select_uncorrelated(df: DataFrame, columns: Sequence[str], cutoff: float = 0.9) -> Fitted:
    """While a pair is correlated beyond the cutoff, drop the one closer to all the others."""
    r = {k: abs(v) for k, v in correlations(df, columns).items()}
    kept, dropped = list(columns), []
    while len(kept) > 1:
        pairs = {k: v for k, v in r.items() if k[0] in kept and k[1] in kept}
        worst = max(pairs, key=lambda k: (pairs[k], k))
        if pairs[worst] <= cutoff:
            break
        closeness = {c: sum(v for k, v in pairs.items() if c in k) for c in worst}
        out = max(worst, key=lambda c: (closeness[c], c))
        kept.remove(out)
        dropped.append(out)
    return Fitted(lambda d: d.drop(*dropped), {"dropped": dropped})


def select_varying(df: DataFrame, columns: Sequence[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> Fitted:
    """Drop predictors whose values hardly vary."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    flags = ranking.near_zero_variance(long, ["variable"], "value", freq_cut, unique_cut)
    dropped = sorted(r["variable"] for r in flags.where("near_zero_var").select("variable").collect())
    return Fitted(lambda d: d.drop(*dropped), {"dropped": dropped})


def polynomial(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    return df.withColumns({f"{c}_{d}": F.pow(F.col(c), F.lit(d)) for c in columns for d in range(2, degree + 1)})


def dummies(df: DataFrame, column: str, max_levels: int = 1000) -> Fitted:
    """One 0/1 column per level but the first; too many levels is an error, not a cut."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    levels = sorted(r[0] for r in rows)
    cols = {f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels[1:]}
    return Fitted(lambda d: d.withColumns(cols).drop(column), {"levels": levels})


def _fill(values: dict[str, object]) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def impute_median(df: DataFrame, columns: Sequence[str]) -> Fitted:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    rows = ranking.quantiles(long, ["variable"], "value", {"m": 0.5}).collect()
    values = {r["variable"]: r["m"] for r in rows}
    return Fitted(_fill(values), values)


def impute_mode(df: DataFrame, columns: Sequence[str]) -> Fitted:
    values = {c: ranking.mode(df, [], c).first()["mode"] for c in columns}
    return Fitted(_fill(values), values)


def impute_model(df: DataFrame, column: str, predict: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> Fitted:
    """Fill gaps with a model's prediction. ``predict`` fits on complete rows and returns a
    function that adds a ``prediction`` column."""
    predictor = predict(df.where(F.col(column).isNotNull()))

    def apply(d: DataFrame) -> DataFrame:
        return predictor(d).withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("prediction"))).drop("prediction")

    return Fitted(apply, {"column": column})
