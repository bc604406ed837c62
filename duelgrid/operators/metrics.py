"""Exact evaluation measures as aggregations.

Nothing here orders all rows in one task or gathers them in one buffer. What needs an order (AUC, quantiles) folds equal
scores first, sorts the folded scores into ranges, and adds up range by range: totals inside a range, plus the totals of
the ranges before it. Scores are read once, and every other measure comes from the folded scores too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.constants import FINISH_TYPES
from duelgrid.functions.numeric import clip_probability
from duelgrid.session import run_dir, written


def _log_loss(y: Column, p: Column) -> Column:
    q = clip_probability(p)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values (of every group `by`) with `sums` and, as `<name>_before`, the totals of all smaller values.

    Equal values are folded before anything moves, so neither one value of most rows nor a group with all its values
    close together makes a large range: ranges hold about as many folded values each, whatever the values are. Rows
    without a value do not count. The sorted ranges are written once; of each only its totals meet those of others.
    """
    keys = [*by, value]
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[column.alias(name) for name, column in sums.items()])
    ranged = cells.repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, run_dir(df.sparkSession, "ranges"))
    inside = Window.partitionBy("range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range", *by).agg(*[F.sum(name).alias(name) for name in sums])
    offsets = totals.select("range", *by, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_offset") for name in sums])
    running = ranged.select("*", *[F.coalesce(F.sum(name).over(inside), F.lit(0)).alias(f"{name}_inside") for name in sums])
    return running.join(offsets, ["range", *by]).select(
        *keys, *sums, *[(F.col(f"{name}_inside") + F.col(f"{name}_offset")).alias(f"{name}_before") for name in sums]
    )


def _folded(df: DataFrame, y: str, p: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores p with n rows, pos positives and neg negatives, and the totals of smaller scores."""
    rows = df.select(*by, F.col(y).alias("y"), p.alias("p"))
    hits, misses = F.sum((F.col("y") == 1).cast("long")), F.sum((F.col("y") != 1).cast("long"))
    return cumulative_by_value(rows, "p", {"n": F.count(F.lit(1)), "pos": hits, "neg": misses}, by)


def _auc() -> Column:
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL if one class is missing."""
    return _folded(df, y, F.col(p)).agg(_auc().alias("roc_auc"))


def _measures() -> list[Column]:
    """n, accuracy at 0.5, log loss, Brier score and ROC-AUC of folded, clipped scores."""
    rows = F.sum(F.col("pos") + F.col("neg"))
    right = F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    loss = -(F.col("pos") * F.log("p") + F.col("neg") * F.log(1 - F.col("p")))
    squares = F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")
    means = [F.try_divide(F.sum(x).cast("double"), rows).alias(name) for name, x in (("accuracy", right), ("log_loss", loss), ("brier", squares))]
    return [F.sum("n").alias("n"), *means, _auc().alias("roc_auc")]


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: n, accuracy at 0.5, log loss, Brier score and ROC-AUC. The scores are read once."""
    return _folded(df, y, clip_probability(F.col(p))).agg(*_measures())


def mean_log_loss(df: DataFrame, y: str = "y", p: str = "p") -> float:
    return mean_log_losses(df, y, [p])[0]


def mean_log_losses(df: DataFrame, y: str, ps: list[str]) -> list[float]:
    """The mean log loss of several predictions of the same rows, in one pass."""
    return list(df.agg(*[F.avg(_log_loss(F.col(y), F.col(p))).alias(p) for p in ps]).first())


def _edges(cells: DataFrame, value: str, fractions: list[float]) -> list[float]:
    total = cells.agg(F.sum("n")).first()[0] or 0
    places = [f * max(0, total - 1) for f in fractions]
    ranks = sorted({int(r) for x in places for r in (math.floor(x), math.ceil(x))})
    within = [(F.col("n_before") <= r) & (F.lit(r) < F.col("n_before") + F.col("n")) for r in ranks]
    held = cells.agg(*[F.max(F.when(w, F.col(value))).alias(f"r{r}") for r, w in zip(ranks, within)]).first()
    at = {r: held[f"r{r}"] for r in ranks}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places] if total else []


def quantile_edges(df: DataFrame, value: str, fractions: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, from the ranks of folded values; none of an empty table."""
    return _edges(cumulative_by_value(df, value, {"n": F.count(F.lit(1))}), value, fractions)


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Mean prediction and share of positives per quantile bin; empty bins do not appear. The scores are read once."""
    cells = written(_folded(df, y, F.col(p)), run_dir(df.sparkSession, "folded"))
    edges = _edges(cells, "p", [i / n_bins for i in range(n_bins + 1)])[1:-1]
    bin_no = sum(((F.lit(e) < F.col("p")).cast("int") for e in edges), F.lit(0))
    return cells.groupBy(bin_no.alias("bin")).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        F.try_divide(F.sum("pos").cast("double"), F.sum(F.col("pos") + F.col("neg"))).alias("fraction_positive"),
    )


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows actual 0 and 1, columns predicted 0 and 1; absent cells are 0."""
    predicted = F.col(p) >= 0.5
    cells = df.agg(
        *[
            F.sum(((F.col(y) == actual) & (predicted if guess else ~predicted)).cast("long")).alias(f"c{actual}{guess}")
            for actual in (0, 1)
            for guess in (0, 1)
        ]
    )
    return cells.selectExpr(
        "inline(array(struct(0 AS actual, c00 AS predicted_0, c01 AS predicted_1), "
        "struct(1 AS actual, c10 AS predicted_0, c11 AS predicted_1)))"
    )


def probability_histogram(df: DataFrame, p: str = "p", bins: int = 20) -> DataFrame:
    """Counts over equal bins of [0, 1], the last one closed; every bin has a row."""
    bin_no = F.least(F.width_bucket(F.col(p), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).cast("int")
    counts = df.filter((F.col(p) >= 0) & (F.col(p) <= 1)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return slots.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def grouped_metrics(df: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """`binary_metrics` of every model, rounded to 4 digits. The scores of all models are read once."""
    named = df.withColumn("model", F.col(model))
    measured = _folded(named, y, clip_probability(F.col(p)), ["model"]).groupBy("model").agg(*_measures())
    return measured.select("model", *[F.round(c, 4).alias(c) for c in ("accuracy", "log_loss", "brier", "roc_auc")], "n")


def _loss(p: Column, floor: float | None = 1e-12) -> Column:
    """Minus the logarithm of a probability. A missing one raises; without a floor, zero costs infinity."""
    given = F.coalesce(p.cast("double"), F.raise_error(F.lit("a probability is missing")).cast("double"))
    if floor is not None:
        return -F.log(F.greatest(F.least(given, F.lit(1.0)), F.lit(floor)))
    return F.when(given > 0, -F.log(given)).otherwise(F.lit(float("inf")))


def multiclass_metrics(df: DataFrame, label: str = "method", probabilities: str = "probabilities") -> DataFrame:
    """Log loss in the fixed class order and accuracy of the first most likely class."""
    classes = F.array(*[F.lit(m) for m in FINISH_TYPES])
    true_p = F.try_element_at(F.col(probabilities), F.array_position(classes, F.col(label)).cast("int"))
    best = F.array_position(F.col(probabilities), F.array_max(probabilities))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_loss(true_p)).alias("log_loss"),
        F.avg((F.element_at(classes, best.cast("int")) == F.col(label)).cast("double")).alias("accuracy"),
    )


def joint_metrics(df: DataFrame) -> DataFrame:
    """Log loss of the actual (winner, finish type) cell.

    Rows hold label (1: A won), p_a, p_method (model) and p_rate (overall rate) of the actual type.
    """
    p_winner = F.when(F.col("label") == 1, F.col("p_a")).otherwise(1 - F.col("p_a"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_loss(p_winner * F.col("p_method"), None)).alias("model_log_loss"),
        F.avg(F.lit(math.log(2 * len(FINISH_TYPES)))).alias("uniform_log_loss"),
        F.avg(_loss(p_winner * F.col("p_rate"), None)).alias("rates_log_loss"),
    )


def round_metrics(df: DataFrame, split: DataFrame, naive: DataFrame) -> DataFrame:
    """Log loss of {round, decision} against smoothed training rates.

    Rows hold scheduled_rounds, outcome (k+1: decision) and p_decision. Rows whose schedule length has no split or
    whose outcome is unknown are left out, of the count too.
    """
    shares = split.select("scheduled_rounds", F.col("round").alias("outcome"), "share")
    rates = naive.select("scheduled_rounds", "outcome", F.col("share").alias("rate"))
    decided = F.col("outcome") == F.col("scheduled_rounds") + 1
    lengths = split.select("scheduled_rounds").distinct()
    known = df.where("outcome IS NOT NULL").join(lengths, "scheduled_rounds", "left_semi")
    joined = known.join(shares, ["scheduled_rounds", "outcome"], "left").join(rates, ["scheduled_rounds", "outcome"], "left")
    p_model = F.when(decided, F.col("p_decision")).otherwise((1 - F.col("p_decision")) * F.col("share"))
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_loss(p_model)).alias("model_log_loss"),
        F.avg(-F.log("rate")).alias("naive_log_loss"),
    )


def reversal_gap(df: DataFrame, p_ab: str = "p_ab", p_ba: str = "p_ba") -> DataFrame:
    """Mean gap between both orientations before they are averaged."""
    return df.agg(F.avg(F.abs(F.col(p_ab) - (1 - F.col(p_ba)))).alias("mean_abs_reversal_gap"))


def refit_agreement(df: DataFrame, evaluated: str = "p_evaluated", deployed: str = "p_deployed") -> DataFrame:
    same = (F.col(evaluated) >= 0.5) == (F.col(deployed) >= 0.5)
    return df.agg(
        F.avg(F.abs(F.col(evaluated) - F.col(deployed))).alias("mean_abs_diff"),
        F.avg(same.cast("double")).alias("same_favourite_rate"),
    )


def date_ranges(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(
        F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.count(F.lit(1)).alias("n_bouts")
    )
