"""Model metrics as aggregates over observed and predicted columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.operators import ranking
from obsframe.session import pin


def regression_metrics(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and the squared correlation (NULL for a constant prediction)."""
    e = F.col(observed) - F.col(predicted)
    both = F.covar_pop(observed, predicted)
    # Merged variances of equal values are not always 0, so a constant is told by its extremes.
    varied = (F.min(observed) < F.max(observed)) & (F.min(predicted) < F.max(predicted))
    r2 = F.when(varied, F.try_divide(both * both, F.var_pop(observed) * F.var_pop(predicted)))
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), F.avg(F.abs(e)).alias("mae")
    )


def confusion(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(observed).alias("observed"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and kappa from the table of confusion counts."""
    cells = confusion(df, observed, predicted, by)
    sides = F.array(
        F.struct(F.lit("o").alias("side"), F.col("observed").cast("string").alias("level")),
        F.struct(F.lit("p").alias("side"), F.col("predicted").cast("string").alias("level")),
    )
    margins = cells.select(*by, "n", F.inline(sides)).groupBy(*by, "level").agg(
        F.sum(F.when(F.col("side") == "o", F.col("n")).otherwise(0)).alias("o"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("p"),
    )
    chance = margins.groupBy(*by).agg(F.sum(F.col("o").cast("double") * F.col("p")).alias("op"), F.sum("o").cast("double").alias("n"))
    hits = cells.groupBy(*by).agg(F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    keyed = [*by] or ["all_rows"]
    if not by:
        chance, hits = chance.withColumn("all_rows", F.lit(0)), hits.withColumn("all_rows", F.lit(0))
    po, pe = F.col("hit") / F.col("n"), F.col("op") / (F.col("n") * F.col("n"))
    return chance.join(hits, keyed).select(
        *by, F.col("n").cast("bigint").alias("n"), po.alias("accuracy"),
        F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)).alias("kappa"),
    )


def two_class_metrics(df: DataFrame, observed: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Area under the ROC curve (exact, ties shared), sensitivity and specificity; 1 is the event."""
    ranks = ranking.value_ranks(df, [], score)
    events = df.where(F.col(observed) == 1).groupBy(score).agg(F.count(F.lit(1)).alias("events"))
    rank_sum = ranks.join(events, score).agg(
        F.sum(F.col("events") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.lit(0).alias("k")
    )
    event, called = F.col(observed) == 1, F.col(score) >= threshold
    counts = df.where(F.col(score).isNotNull()).agg(
        F.count_if(event).cast("double").alias("p"), F.count_if(~event).cast("double").alias("q"),
        F.count_if(event & called).alias("tp"), F.count_if(~event & ~called).alias("tn"), F.lit(0).alias("k"),
    )
    p, q = F.col("p"), F.col("q")
    return counts.join(rank_sum, "k").select(
        F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc"),
        F.try_divide(F.col("tp").cast("double"), p).alias("sens"), F.try_divide(F.col("tn").cast("double"), q).alias("spec"),
    )


def per_class(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Sensitivity, specificity, both predictive values, F1, detection rate and balanced accuracy of every class against the rest."""
    cells = confusion(df, observed, predicted)
    sides = F.array(
        F.struct(F.col("observed").alias("level"), F.lit(1).alias("o"), (F.col("observed") == F.col("predicted")).cast("int").alias("p")),
        F.struct(
            F.when(F.col("observed") != F.col("predicted"), F.col("predicted")).alias("level"), F.lit(0).alias("o"), F.lit(1).alias("p")
        ),
    )
    counts = cells.select("n", F.inline(sides)).where("level IS NOT NULL").groupBy("level").agg(
        F.sum(F.when((F.col("o") == 1) & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("o") == 1) & (F.col("p") == 0), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("o") == 0, F.col("n")).otherwise(0)).alias("fp"),
    )
    total = cells.agg(F.sum("n").alias("t")).select("t").scalar()
    tp, fn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "fp"))
    return counts.select(
        "level", F.try_divide(tp, tp + fn).alias("sens"), F.try_divide(total - tp - fn - fp, total - tp - fn).alias("spec"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(total - tp - fn - fp, total - tp - fp).alias("npv"), F.try_divide(tp, total).alias("detection"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(total - tp - fn - fp, total - tp - fn)) / 2).alias("balanced"),
    )


def _by_level(df: DataFrame, observed: str, probabilities: Mapping[object, str]) -> DataFrame:
    """A row per row and class: ``level``, its ``score`` and whether the class was ``event``."""
    rows = [
        F.struct(F.lit(v).alias("level"), F.col(c).cast("double").alias("score"), F.col(observed).eqNullSafe(F.lit(v)).cast("int").alias("event"))
        for v, c in probabilities.items()
    ]
    return df.where(F.col(observed).isNotNull()).select(F.inline(F.array(*rows))).where("score IS NOT NULL")


def class_curves(df: DataFrame, observed: str, probabilities: Mapping[object, str], direct_limit: int = ranking.DIRECT_LIMIT) -> DataFrame:
    """``level``, ``events``, ``roc`` and ``pr``: the areas under the exact curves of each class against the rest.

    A curve has a point at every distinct score. Both areas are sums over the scores that have events, of the rows and the
    events at or above them; these come from running counts over ranges of values, so no class is gathered in one
    place. The area under precision against recall is that of the trapezoids from the first point on.
    """
    long = pin(_by_level(df, observed, probabilities).groupBy("level", "score").agg(F.count(F.lit(1)).alias("rows"), F.sum("event").alias("hits")))
    every = ranking.weighted_ranks(long, ["level"], "score", "rows", direct_limit)
    events = ranking.weighted_ranks(long.where("hits > 0"), ["level"], "score", "hits", direct_limit)
    mine = events.select("level", "score", F.col("n").alias("e"), F.col("below").alias("e_below"), F.col("total").alias("e_total"))
    both = every.join(mine, ["level", "score"])
    e, n, p, q = (F.col(c).cast("double") for c in ("e", "n", "e_total", "total"))
    hit, called = p - F.col("e_below"), q - F.col("below")
    here, before = hit / called, F.try_divide(hit - e, called - n)
    return both.groupBy("level").agg(
        F.max("e_total").alias("events"),
        F.try_divide(F.sum(e * (F.col("below") + (n + 1) / 2)) - F.max(p * (p + 1) / 2), F.max(p * (q - p))).alias("roc"),
        F.coalesce(F.sum(e / p * (here + before) / 2), F.lit(0.0)).alias("pr"),
    )


_RATES = ("sens", "spec", "precision", "npv", "f1", "detection", "balanced")


def multi_class_metrics(df: DataFrame, observed: str, predicted: str, probabilities: Mapping[object, str] | None = None) -> DataFrame:
    """Unweighted means over the classes, beside accuracy and kappa.

    With ``probabilities`` (class to column) also the mean areas under the curves of each class against the rest, and the log loss.
    """
    means = per_class(df, observed, predicted).agg(*[F.avg(c).alias(f"mean_{c}") for c in _RATES], F.lit(0).alias("k"))
    out = classification_metrics(df, observed, predicted).withColumn("k", F.lit(0)).join(means, "k")
    if probabilities:
        areas = class_curves(df, observed, probabilities).agg(F.avg("roc").alias("auc"), F.avg("pr").alias("pr_auc"), F.lit(0).alias("k"))
        loss = class_log_loss(df, observed, probabilities).withColumn("k", F.lit(0))
        out = out.join(areas, "k").join(loss, "k")
    return out.drop("k")


def log_loss(df: DataFrame, observed: str, probability: str) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(-F.ln(F.when(F.col(observed) == 1, p).otherwise(1 - p))).alias("log_loss"))


def class_log_loss(df: DataFrame, observed: str, probabilities: Mapping[object, str]) -> DataFrame:
    """The mean negative log of the probability that the observed class was given."""
    own = F.coalesce(*[F.when(F.col(observed) == F.lit(v), F.col(c).cast("double")) for v, c in probabilities.items()])
    return df.agg(F.avg(-F.ln(F.least(F.greatest(own, F.lit(1e-15)), F.lit(1 - 1e-15)))).alias("log_loss"))


def precision_recall(df: DataFrame, observed: str, predicted: str, probability: str | None = None) -> DataFrame:
    """Precision, recall and F1 of the event 1; with its ``probability`` also the area under their curve."""
    o, p = F.col(observed) == 1, F.col(predicted) == 1
    hit = F.count_if(o & p).cast("double")
    out = df.agg(
        F.try_divide(hit, F.count_if(p).cast("double")).alias("precision"), F.try_divide(hit, F.count_if(o).cast("double")).alias("recall"),
        F.try_divide(2 * hit, (F.count_if(p) + F.count_if(o)).cast("double")).alias("f1"), F.lit(1).alias("level"),
    )
    if probability is None:
        return out.drop("level")
    area = class_curves(df.withColumn(observed, F.col(observed).cast("int")), observed, {1: probability}).select("level", F.col("pr").alias("pr_auc"))
    return out.join(area, "level", "left").drop("level")


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation: the correlation of mean ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    mean_rank = F.col("below") + (F.col("n") + 1) / 2
    ra = ranking.value_ranks(both, [], "a").select("a", mean_rank.alias("rank_a"))
    rb = ranking.value_ranks(both, [], "b").select("b", mean_rank.alias("rank_b"))
    # Equal pairs are one weighted row, so no value brings its rows together; ranks are centred to keep the sums exact.
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")).join(ra, "a").join(rb, "b")
    n = both.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    x, y, w = F.col("rank_a") - (n + 1) / 2, F.col("rank_b") - (n + 1) / 2, F.col("w")
    return cells.agg(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))).alias("spearman"))


def calibration(df: DataFrame, observed: str, probability: str, cuts: int = 10) -> DataFrame:
    """Observed share of events in equal-width bins of the predicted probability."""
    bin_of = F.least(F.floor(F.col(probability) * cuts), F.lit(cuts - 1)).cast("int")
    return df.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"),
        F.avg(F.when(F.col(observed) == 1, 1.0).otherwise(0.0)).alias("observed_share"),
    ).withColumn("midpoint", (F.col("bin") + 0.5) / cuts)
