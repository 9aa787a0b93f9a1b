"""Pre-processing transforms, each fitted with one aggregate and applied as plain Columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.ml.prepare import Fitted

LAMBDAS = tuple(round(-2 + 0.1 * i, 1) for i in range(41))


def center_scale(df: DataFrame, columns: Sequence[str], center: bool = True, scale: bool = True) -> Fitted:
    row = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev))]).first()
    mean = {c: (row[f"mean_{c}"] or 0.0) if center else 0.0 for c in columns}
    sd = {c: (row[f"sd_{c}"] or 1.0) if scale else 1.0 for c in columns}
    cols = {c: (F.col(c) - mean[c]) / sd[c] for c in columns}
    return Fitted(lambda d: d.withColumns(cols), {"mean": mean, "sd": sd})


def to_range(df: DataFrame, columns: Sequence[str]) -> Fitted:
    row = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]).first()
    width = {c: (row[f"hi_{c}"] - row[f"lo_{c}"]) or 1.0 for c in columns}
    cols = {c: (F.col(c) - row[f"lo_{c}"]) / width[c] for c in columns}
    return Fitted(lambda d: d.withColumns(cols), {"width": width})


def boxcox_value(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeojohnson_value(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _best_lambda(df: DataFrame, column: str, value, weight: Column) -> float:
    """The power with the highest profile likelihood; all powers in one aggregate."""
    x = F.col(column).cast("double")
    row = df.where(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"),
        *[F.var_pop(value(x, lam)).alias(f"v{i}") for i, lam in enumerate(LAMBDAS)],
    ).first()
    scores = [
        -row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["w"] if row[f"v{i}"] and row[f"v{i}"] > 0 else -math.inf
        for i, lam in enumerate(LAMBDAS)
    ]
    return LAMBDAS[max(range(len(LAMBDAS)), key=scores.__getitem__)]


def boxcox(df: DataFrame, column: str) -> Fitted:
    """For positive values only; a column with others is left as it is."""
    low = df.agg(F.min(column)).first()[0]
    if low is None or low <= 0:
        return Fitted(lambda d: d, {"lambda": None})
    lam = _best_lambda(df, column, boxcox_value, F.ln(F.col(column).cast("double")))
    return Fitted(lambda d: d.withColumn(column, boxcox_value(F.col(column).cast("double"), lam)), {"lambda": lam})


def yeojohnson(df: DataFrame, column: str) -> Fitted:
    x = F.col(column).cast("double")
    lam = _best_lambda(df, column, yeojohnson_value, F.signum(x) * F.log1p(F.abs(x)))
    return Fitted(lambda d: d.withColumn(column, yeojohnson_value(F.col(column).cast("double"), lam)), {"lambda": lam})


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="keep").transform(df)


def pca(df: DataFrame, features: str, k: int) -> Fitted:
    """Scores on the first ``k`` components, as columns pc1, pc2, ..."""
    model = PCA(k=k, inputCol=features, outputCol="pc").fit(df)

    def apply(d: DataFrame) -> DataFrame:
        scored = model.transform(d).withColumn("pc", vector_to_array("pc"))
        return scored.withColumns({f"pc{i + 1}": F.col("pc")[i] for i in range(k)}).drop("pc")

    return Fitted(apply, {"explained": [float(v) for v in model.explainedVariance]})


def spatial_sign(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row divided by its length."""
    unit = Normalizer(p=2.0, inputCol="features", outputCol="unit").transform(assemble(df, columns))
    at = vector_to_array("unit")
    return unit.withColumns({c: at[i] for i, c in enumerate(columns)}).drop("features", "unit")
