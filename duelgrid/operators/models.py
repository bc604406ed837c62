"""Outcome models: fitting, calibration, chronological validation, refit.

Fits are Spark ML jobs over the whole table. What stays on the driver is a handful of scores and
parameters per model.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import itertools
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from duelgrid.constants import (
    CALIBRATIONS,
    FEATURE_GROUPS,
    FINISH_C_GRID,
    FINISH_FEATURES,
    FINISH_HOLDOUT_YEARS,
    FINISH_TYPES,
    MODEL_FEATURES,
    PLATT_C,
    SEED,
    Periods,
)
from duelgrid.functions.numeric import safe_logit, symmetric_probability
from duelgrid.operators.matchup import mirror
from duelgrid.operators.metrics import mean_log_loss, mean_log_losses, multiclass_metrics

FITS_AT_ONCE = 8  # small fits leave most of a cluster idle, so several run side by side
VALUES_AT_ONCE = 1 << 30  # that the blocks of all fits running side by side may hold, about
NEWTON_PASSES, NEWTON_STEP = 60, 1e-7  # a step this small, in units of the inputs' deviations, is the last one


# ------------------------------------------------------------------------------------ periods
def with_split(table: DataFrame, periods: Periods) -> DataFrame:
    """history, train, validation or test by date; half-open, in one pass."""
    d = F.col("event_date")
    split = (
        F.when(d < F.lit(periods.min_train).cast("date"), "history")
        .when(d < F.lit(periods.validation).cast("date"), "train")
        .when(d < F.lit(periods.test).cast("date"), "validation")
        .otherwise("test")
    )
    return table.withColumn("split", split)


def check_periods(periods: Periods) -> None:
    if not periods.min_train < periods.validation < periods.test:
        raise ValueError("periods overlap")


def between(table: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        table = table.filter(F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        table = table.filter(F.col("event_date") < F.lit(end).cast("date"))
    return table


def median_date(table: DataFrame) -> datetime.date:
    """Date of row n // 2 in date order. Dates are counted first; the running total is over days."""
    days = table.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.sum("n")).first()[0]
    upto = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    running = days.select("event_date", F.sum("n").over(upto).alias("upto"))
    return running.filter(F.col("upto") > total // 2).agg(F.min("event_date")).first()[0]


# --------------------------------------------------------------------------------- calibrators
@dataclass(frozen=True)
class Calibrator:
    """Raw to calibrated probability: identity, sigmoid on the logit, or isotonic."""

    method: str = "none"
    slope: float = 1.0
    intercept: float = 0.0
    model: object = None

    def apply(self, df: DataFrame, source: str, target: str) -> DataFrame:
        if self.method == "sigmoid":
            z = F.lit(self.intercept) + F.lit(self.slope) * safe_logit(F.col(source))
            return df.withColumn(target, 1 / (1 + F.exp(-z)))
        if self.method == "isotonic":
            scored = self.model.transform(
                df, {self.model.featuresCol: source, self.model.predictionCol: target}
            )
            return scored.withColumn(target, F.greatest(F.least(target, F.lit(0.99)), F.lit(0.01)))
        return df.withColumn(target, F.col(source))


def fit_calibrator(method: str, scored: DataFrame, p: str = "p_raw", y: str = "label") -> Calibrator:
    """Sigmoid is nearly unregularised. Isotonic is offered but no candidate: its steps would make
    most occlusion impacts zero."""
    if method == "sigmoid":
        narrow = scored.select(safe_logit(F.col(p)).alias("z"), F.col(y).cast("double").alias("y"))
        narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)  # two numbers a row; scoring again for each pass costs more
        try:
            rows = VectorAssembler(inputCols=["z"], outputCol="zv").transform(narrow)
            fitted = LogisticRegression(
                featuresCol="zv", labelCol="y", regParam=1.0 / (PLATT_C * narrow.count()), standardization=False, maxIter=1000
            ).fit(rows)
        finally:
            narrow.unpersist()
        return Calibrator("sigmoid", float(fitted.coefficients[0]), float(fitted.intercept))
    if method == "isotonic":
        rows = scored.select(F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
        return Calibrator("isotonic", model=IsotonicRegression(featuresCol="p", labelCol="y").fit(rows))
    return Calibrator()


# -------------------------------------------------------------------------------------- models
@dataclass(frozen=True)
class BoutModel:
    """P(A beats B): a fitted classifier, its inputs and a calibrator."""

    kind: str
    params: dict
    features: list[str]
    model: object
    calibrator: Calibrator = field(default_factory=Calibrator)


def make_classifier(kind: str, params: dict, n_rows: int):
    """An unfitted classifier. C counts the summed loss, regParam the mean one: regParam = 1/(C n)."""
    columns = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic_regression":
        return LogisticRegression(
            regParam=1.0 / (params["C"] * n_rows), elasticNetParam=0.0, standardization=True, maxIter=2000,
            **columns,
        )
    if kind == "random_forest":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", seed=SEED, **columns, **params)
    if kind == "boosted_trees":
        return GBTClassifier(
            stepSize=0.03, subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=10, seed=SEED,
            **columns, **params,
        )
    raise ValueError(kind)


def assemble(table: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=output).transform(table)


def vectors_of(table: DataFrame, features: list[str]) -> DataFrame:
    """Both views of every bout as (event_date, mirrored, label, features).

    Mirroring never crosses a period, and dates are cut before it: a filter on these rows would come behind it. They are
    not kept: a fit keeps its own blocks or bags of them, and a second copy of the rows would push those out of memory.
    """
    views = assemble(mirror(table.select("event_date", "label", *features)), features)
    return views.select("event_date", "mirrored", F.col("label").cast("double").alias("label"), "features")


def fits_at_once(rows: int, features: list[str]) -> int:
    """How many fits on `rows` rows may run side by side: large ones fill the cluster, and its memory, alone."""
    return max(1, min(FITS_AT_ONCE, VALUES_AT_ONCE // max(1, rows * len(features))))


def yearly_rows(table: DataFrame) -> dict[int, int]:
    """Rows per year in both views, counted on the table itself."""
    counted = table.groupBy(F.year("event_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return {r["year"]: 2 * r["n"] for r in counted.collect()}


def blocks_of(table: DataFrame, features: list[str], part: Column | None = None) -> RDD:
    """(part, inputs, labels) as numpy arrays of many rows; `part` is a whole number that all rows of a block share."""

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                parts, y, *inputs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.column_stack(inputs)
                if np.isnan(x).any() or np.isnan(y).any():
                    raise ValueError("a label or an input of a fit is missing")
                for one in np.unique(parts):
                    held = parts == one
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([one], pa.int32()), "x": pa.array([x[held].tobytes()], pa.binary()), "y": pa.array([y[held].tobytes()], pa.binary()),
                    })

    part, width = F.lit(0) if part is None else part, len(features)
    rows = table.select(part.cast("int").alias("part"), *[F.col(c).cast("double") for c in ("label", *features)])
    packs = rows.mapInArrow(packed, "part int, x binary, y binary").rdd
    return packs.map(lambda r: (r["part"], np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["y"])))


def over_blocks(blocks: RDD, of_rows: Callable, merged: Callable, signs: list[float] | None = None):
    """of_rows(part, x, y) of every block, merged in its task and then in a tree; None without blocks.

    With `signs` a block gets its mirror images: inputs times signs, the other label.
    """

    def of_block(block):
        part, x, y = block
        if signs is not None:
            x, y = np.vstack([x, x * np.array(signs)]), np.concatenate([y, 1 - y])
        return of_rows(part, x, y.astype(int))

    def both(a, b):
        return b if a is None else a if b is None else merged(a, b)

    return blocks.map(of_block).treeAggregate(None, both, both)


def logistic_moments(blocks: RDD, classes: int, signs: list[float] | None = None, before: list[int | None] | None = None) -> list[dict | None]:
    """For every `before`, over the parts below it (None: all): rows per class, mean, sum of squared deviations, least and
    largest value of every input; None without rows."""

    def of_batch(part, x, y):
        mean = x.mean(0)
        return {part: {"n": np.bincount(y, minlength=classes), "mean": mean, "m2": ((x - mean) ** 2).sum(0), "low": x.min(0), "high": x.max(0)}}

    def together(a, b):
        n, m, gap = a["n"].sum(), b["n"].sum(), b["mean"] - a["mean"]
        return {
            "n": a["n"] + b["n"], "mean": a["mean"] + gap * m / (n + m), "m2": a["m2"] + b["m2"] + gap**2 * n * m / (n + m),
            "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"]),
        }

    def merged(a, b):
        return {p: together(a[p], b[p]) if p in a and p in b else a.get(p) or b[p] for p in a.keys() | b.keys()}

    parts = over_blocks(blocks, of_batch, merged, signs) or {}
    seen = [[parts[p] for p in sorted(parts) if end is None or p < end] for end in before or [None]]
    return [reduce(together, some) if some else None for some in seen]


def logistic_steps(blocks: RDD, points: list[tuple], signs: list[float] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Summed loss, gradient and Hessian at every point (at, mean, scale, before), from one pass over the blocks.

    `at` are weights, one row per class and one for all but the first of two. Inputs are centred and divided by `scale`
    (0: left out); the last weight of a row is the intercept. A point sees the parts below `before`, or all (None).
    """

    def of_point(at, mean, scale, x, y):
        used = scale > 0
        z = np.column_stack([(x[:, used] - mean[used]) / scale[used], np.ones(len(y))])
        margins = z @ at.T
        if len(at) == 1:
            margins = np.column_stack([np.zeros(len(y)), margins])
        margins -= margins.max(1, keepdims=True)
        chances = np.exp(margins)
        totals = chances.sum(1, keepdims=True)
        chances /= totals
        loss = (np.log(totals[:, 0]) - margins[np.arange(len(y)), y]).sum()
        off = chances.copy()
        off[np.arange(len(y)), y] -= 1
        first = chances.shape[1] - len(at)
        chances, off = chances[:, first:], off[:, first:]
        hessian = np.empty((*at.shape, *at.shape))
        for k in range(len(at)):
            for j in range(k + 1):
                weight = chances[:, k] * (float(k == j) - chances[:, j])
                hessian[k, :, j, :] = hessian[j, :, k, :] = z.T @ (weight[:, None] * z)
        return np.concatenate([[loss], (off.T @ z).ravel(), hessian.ravel()])

    def of_batch(part, x, y):
        return [of_point(at, mean, scale, x, y) if before is None or part < before else 0.0 for at, mean, scale, before in points]

    def split(sums, size):
        return float(sums[0]), sums[1 : size + 1], sums[size + 1 :].reshape(size, size)

    sums = over_blocks(blocks, of_batch, lambda a, b: [v + w for v, w in zip(a, b)], signs)
    return [split(v, at.size) for v, (at, *_) in zip(sums, points)]


def newton_search(seen: dict | None, classes: int, penalty: float, multinomial: bool, before: int | None = None):
    """Asks (yields) for points and is sent `logistic_steps` of them; returns weights (one row per class, or one) and
    intercepts of least mean loss plus penalty / 2 on squared weights in units of each input's standard deviation, which
    `LogisticRegression` minimises too.

    None where a class has no rows or the steps do not end: there is then no such point, or it is not found.
    """
    if seen is None or len(seen["n"]) != classes or not seen["n"].all():
        return None
    n = int(seen["n"].sum())
    scale = np.where(seen["high"] > seen["low"], np.sqrt(seen["m2"] / (n - 1)), 0.0)
    used = scale > 0
    start = np.log(seen["n"] / n)
    at = np.zeros((classes if multinomial else 1, int(used.sum()) + 1))
    at[:, -1] = start - start.mean() if multinomial else start[1] - start[0]
    ridge = np.full(at.shape, penalty)
    ridge[:, -1] = 0.0
    # one number added to all intercepts changes nothing; holding their mean takes the Hessian's null direction away
    held = np.zeros((*at.shape, *at.shape))
    held[:, -1, :, -1] = float(multinomial)
    best, least, step = None, math.inf, at
    for _ in range(NEWTON_PASSES):
        loss, gradient, hessian = yield at, seen["mean"], scale, before
        value = loss / n + (ridge * at**2).sum() / 2
        if not value <= least + 1e-12 * abs(least):
            step = step / 2
            at = best + step
            continue
        best, least = at, min(value, least)
        slope = gradient / n + (ridge * at).ravel()
        try:
            step = -np.linalg.solve(hessian / n + np.diag(ridge.ravel()) + held.reshape(at.size, at.size), slope).reshape(at.shape)
        except np.linalg.LinAlgError:
            return None
        at = best + step
        if np.abs(step).max() < NEWTON_STEP:
            weights = np.zeros((len(at), len(used)))
            weights[:, used] = at[:, :-1] / scale[used]
            intercepts = at[:, -1] - weights @ seen["mean"]
            return weights, intercepts - intercepts.mean() if multinomial else intercepts
    return None


def logistic_optima(
    blocks: RDD, classes: int, fits: list[tuple[float, int | None]], multinomial: bool, signs: list[float] | None = None
) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """What `newton_search` finds for every (penalty, before) of `fits`: all fits take their steps together, each step one pass."""
    moments = logistic_moments(blocks, classes, signs, [before for _, before in fits])
    searches = [newton_search(seen, classes, penalty, multinomial, before) for seen, (penalty, before) in zip(moments, fits)]
    found, asked, sums = [None] * len(fits), dict.fromkeys(range(len(fits))), [None] * len(fits)
    while asked:
        for i, v in zip(list(asked), sums):
            try:
                asked[i] = searches[i].send(v)
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
        sums = logistic_steps(blocks, list(asked.values()), signs) if asked else []
    return found


def fit_logistics(
    estimators: list[LogisticRegression], table: DataFrame, features: list[str], classes: int = 2, mirrored: bool = False,
    before: list[int | None] | None = None,
) -> list[LogisticRegressionModel]:
    """The models that `estimators` (ridge penalty, standardized inputs, intercept) tend to on `table`, and with `mirrored`
    on its mirror image too. `before` holds for each the first year that it does not see, or None.

    Their own search takes hundreds of passes where inputs depend on each other; Newton steps take about ten, over one copy
    of the rows in blocks, for all models together. An estimator then gives its model: bounds leave it that point alone.
    Where the steps find none, it searches itself.
    """
    signs = [-1.0 if f.endswith("_diff") else 1.0 for f in features] if mirrored else None
    years = [None] * len(estimators) if before is None else before
    blocks = blocks_of(table, features, None if before is None else F.year("event_date")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = [(e.getRegParam(), y) for e, y in zip(estimators, years)]
        found = logistic_optima(blocks, classes, fits, estimators[0].getFamily() == "multinomial", signs)
    finally:
        blocks.unpersist()

    def model(estimator, point, year):
        if point is None:
            seen = table if year is None else between(table, None, f"{year}-01-01")
            plain = assemble(mirror(seen.select("label", *features)) if mirrored else seen, features)
            return estimator.fit(plain.select("features", F.col("label").cast("double").alias("label")))
        weights, intercepts = DenseMatrix(*point[0].shape, point[0].ravel(order="F")), Vectors.dense(point[1])
        at = estimator.copy({
            estimator.lowerBoundsOnCoefficients: weights, estimator.upperBoundsOnCoefficients: weights,
            estimator.lowerBoundsOnIntercepts: intercepts, estimator.upperBoundsOnIntercepts: intercepts,
        })
        return at.fit(apart)

    # inputs that do not vary get no weight
    rows = [(Vectors.dense(np.full(len(features), float(k))), float(k)) for k in range(classes)]
    apart = table.sparkSession.createDataFrame(rows, ["features", "label"])
    return concurrently(table.sparkSession, [partial(model, *x) for x in zip(estimators, found, years)])


def fit_vectors(kind: str, params: dict, vectors: DataFrame, n_rows: int, features: list[str]) -> BoutModel:
    return BoutModel(kind, params, list(features), make_classifier(kind, params, n_rows).fit(vectors.select("features", "label")))


def fit_years(table: DataFrame, features: list[str], fits: list[tuple[dict, int, int | None]]) -> list[BoutModel]:
    """Logistic models of (params, rows in both views, first year not seen, or None), all from one copy of the rows."""
    kind, years = "logistic_regression", [year for *_, year in fits]
    estimators = [make_classifier(kind, params, n) for params, n, _ in fits]
    fitted = fit_logistics(estimators, table, features, mirrored=True, before=years if any(years) else None)
    return [BoutModel(kind, params, list(features), model) for (params, *_), model in zip(fits, fitted)]


def fit_views(kind: str, params: dict, table: DataFrame, n_rows: int, features: list[str]) -> BoutModel:
    """Fit on every bout of `table` and its mirror image, `n_rows` together."""
    if kind == "logistic_regression":
        return fit_years(table, features, [(params, n_rows, None)])[0]
    return fit_vectors(kind, params, vectors_of(table, features), n_rows, features)


def concurrently(spark: SparkSession, jobs: list[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """The results of independent jobs, in order; the cluster shares its slots among `at_once` of them."""
    bound = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), bound))


def fit_bout_model(kind: str, params: dict, train: DataFrame, features: list[str] = MODEL_FEATURES) -> BoutModel:
    """Fit on every training bout and its mirror image."""
    return fit_views(kind, params, train, 2 * train.count(), features)


def with_turned_vector(df: DataFrame, features: list[str], source: str, target: str) -> DataFrame:
    """The input vector of the B-versus-A view: differences negated."""
    signs = Vectors.dense([-1.0 if f.endswith("_diff") else 1.0 for f in features])
    return ElementwiseProduct(scalingVec=signs, inputCol=source, outputCol=target).transform(df)


def raw_probability(model: BoutModel, df: DataFrame, source: str, target: str) -> DataFrame:
    """Uncalibrated P(A wins) of the vectors in `source`."""
    m = model.model
    names = {m.featuresCol: source, m.probabilityCol: f"{target}_v", m.rawPredictionCol: f"{target}_r", m.predictionCol: f"{target}_c"}
    scored = m.transform(df, names)
    return scored.withColumn(target, vector_to_array(f"{target}_v")[1]).drop(f"{target}_v", f"{target}_r", f"{target}_c")


def score_vectors(model: BoutModel, df: DataFrame, source: str = "features", target: str = "p_a") -> DataFrame:
    """Symmetric P(A wins) of the vectors in `source`, both orientations scored in the same row."""
    out = with_turned_vector(df, model.features, source, "turned")
    out = raw_probability(model, raw_probability(model, out, source, "raw_ab"), "turned", "raw_ba")
    out = model.calibrator.apply(model.calibrator.apply(out, "raw_ab", "p_ab"), "raw_ba", "p_ba")
    return out.withColumn(target, symmetric_probability(F.col("p_ab"), F.col("p_ba"))).drop("turned", "raw_ab", "raw_ba")


def score_symmetric(model: BoutModel, table: DataFrame) -> DataFrame:
    """The table with p_ab, p_ba (calibrated, one orientation each) and p_a (symmetric).

    Narrow: no shuffle, no second pass.
    """
    return score_vectors(model, assemble(table, model.features)).drop("features")


def mirrored_raw(model: BoutModel, table: DataFrame) -> DataFrame:
    """(p_raw, label) of every row and its mirror image: what a calibrator is fitted on."""
    rows = assemble(mirror(table.select("label", *model.features)), model.features)
    return raw_probability(model, rows, "features", "p_raw").select("p_raw", "label")


def symmetric_log_loss(model: BoutModel, table: DataFrame) -> float:
    return mean_log_loss(score_symmetric(model, table), "label", "p_a")


# ---------------------------------------------------------------------------------- validation
@dataclass(frozen=True)
class Fold:
    """One search point in one year: log loss of a model fitted on everything strictly before that year."""

    kind: str
    params: dict
    year: int
    log_loss: float


def walk_forward(
    grids: dict[str, list[dict]], train: DataFrame, years: tuple[int, ...], features: list[str] = MODEL_FEATURES
) -> list[Fold]:
    """All folds of all families and search points, from one assembled table, several fits at a time.

    A year without bouts, or without any before it, has no fold.
    """
    sizes = yearly_rows(train)
    used = [y for y in years if y in sizes and any(z < y for z in sizes)]
    before = {y: sum(n for z, n in sizes.items() if z is not None and z < y) for y in used}

    def losses(models: list[BoutModel], year: int) -> list[Fold]:
        """All models of a year meet its rows in one pass; the rows of other years are left out before they are assembled."""
        scored = assemble(between(train, f"{year}-01-01", f"{year + 1}-01-01").select("label", *features), features)
        names = [f"p_{i}" for i in range(len(models))]
        for name, model in zip(names, models):
            scored = score_vectors(model, scored, target=name).drop("p_ab", "p_ba")
        return [Fold(m.kind, m.params, year, v) for m, v in zip(models, mean_log_losses(scored, "label", names))]

    def fold(kind: str, params: dict, year: int) -> list[Fold]:
        return losses([fit_views(kind, params, between(train, None, f"{year}-01-01"), before[year], features)], year)

    points = [(kind, params, year) for kind, grid in grids.items() for params in grid for year in used]
    # the families come from cheap to dear, and the dear fits must not be left to the end
    jobs = [partial(fold, *p) for p in points[::-1] if p[0] != "logistic_regression"]
    folds = concurrently(train.sparkSession, jobs, fits_at_once(sum(sizes.values()), features))
    if plain := [(params, before[year], year) for kind, params, year in points if kind == "logistic_regression"]:
        fitted = fit_years(between(train, None, f"{max(used)}-01-01"), features, plain)
        by_year = {y: [m for m, (*_, year) in zip(fitted, plain) if year == y] for y in used}
        folds += concurrently(train.sparkSession, [partial(losses, ms, y) for y, ms in by_year.items()])
    held = {(f.kind, str(f.params), f.year): f for fs in folds for f in fs}
    return [held[kind, str(params), year] for kind, params, year in points]


def best_points(folds: list[Fold]) -> dict[str, tuple[dict, float]]:
    """Per family the parameters of lowest mean loss over the years, and that loss; the first of equals."""
    losses: dict[str, list[tuple[dict, list[float]]]] = {}
    for f in folds:
        of_kind = losses.setdefault(f.kind, [])
        if not of_kind or of_kind[-1][0] != f.params:
            of_kind.append((f.params, []))
        of_kind[-1][1].append(f.log_loss)
    means = {kind: [(params, sum(v) / len(v)) for params, v in points] for kind, points in losses.items()}
    return {kind: min(points, key=lambda point: point[1]) for kind, points in means.items()}


def choose_calibration(
    model: BoutModel, validation: DataFrame, candidates: tuple[str, ...] = CALIBRATIONS
) -> tuple[str, dict[str, float]]:
    """Mean log loss of every candidate when either half of the period, by date, is calibrated on the other.

    The raw scores of both orientations are computed once; a half is a filter on them.
    """
    late = (F.col("event_date") >= F.lit(median_date(validation))).alias("late")
    rows = with_turned_vector(assemble(validation, model.features), model.features, "features", "turned")
    rows = raw_probability(model, raw_probability(model, rows, "features", "raw_ab"), "turned", "raw_ba")
    raw = rows.select(late, F.col("label").cast("double").alias("label"), "raw_ab", "raw_ba").persist(StorageLevel.MEMORY_AND_DISK)

    def loss(method: str, side: bool) -> float:
        fit_on = raw.filter(F.col("late") == side).selectExpr(
            "inline(array(struct(raw_ab AS p_raw, label), struct(raw_ba AS p_raw, 1 - label AS label)))"
        )
        calibrator = fit_calibrator(method, fit_on)
        other = calibrator.apply(calibrator.apply(raw.filter(F.col("late") != side), "raw_ab", "p_ab"), "raw_ba", "p_ba")
        return mean_log_loss(other.withColumn("p_a", symmetric_probability(F.col("p_ab"), F.col("p_ba"))), "label", "p_a")

    try:
        scores = {method: (loss(method, False) + loss(method, True)) / 2 for method in candidates}
    finally:
        raw.unpersist()
    return min(scores, key=scores.get), scores


def calibrated(model: BoutModel, validation: DataFrame) -> tuple[BoutModel, dict[str, float]]:
    method, scores = choose_calibration(model, validation)
    return replace(model, calibrator=fit_calibrator(method, mirrored_raw(model, validation))), scores


def fit_baselines(train: DataFrame) -> dict[str, Column]:
    """P(A wins) of naive predictors as columns: one half, win rate, experience and record.

    Logistic without intercept, on unscaled differences, not symmetrised.
    """
    out = {"baseline_always_50": F.lit(0.5)}
    inputs = {"baseline_win_pct_diff": ["win_pct_diff"], "baseline_experience_record": ["n_fights_diff", "win_pct_diff"]}
    for name, columns in inputs.items():
        rows = assemble(mirror(train.select("label", *columns)), columns).select(
            "features", F.col("label").cast("double").alias("label")
        )
        n = rows.count()
        fitted = LogisticRegression(
            fitIntercept=False, standardization=False, regParam=1.0 / n, maxIter=1000
        ).fit(rows)
        z = sum((F.lit(float(w)) * F.col(c) for w, c in zip(fitted.coefficients, columns)), F.lit(0.0))
        out[name] = 1 / (1 + F.exp(-z))
    return out


def production_refit(
    kind: str, params: dict, calibration: str, table: DataFrame, periods: Periods, features: list[str] = MODEL_FEATURES
) -> BoutModel:
    """The chosen configuration on every bout since the training start.

    The calibrator sees out-of-time predictions only: each year since the validation start is
    scored by a model of the years before it.
    """
    used = between(table, periods.min_train, None)
    sizes = yearly_rows(used)
    years = [y for y in sorted(sizes) if y >= int(periods.validation[:4]) and any(z < y for z in sizes)] if calibration != "none" else []
    rows = {y: sum(n for z, n in sizes.items() if y is None or z < y) for y in (None, *years)}
    if kind == "logistic_regression":
        model, *earlier = fit_years(used, features, [(params, n, y) for y, n in rows.items()])
    else:
        def fit(year: int | None, n: int) -> BoutModel:
            return fit_views(kind, params, used if year is None else between(used, None, f"{year}-01-01"), n, features)

        at_once = fits_at_once(sum(sizes.values()), features)
        model, *earlier = concurrently(table.sparkSession, [partial(fit, y, n) for y, n in rows.items()], at_once)
    if calibration == "none":
        return model

    def out_of_time(before: BoutModel, year: int) -> DataFrame:
        ahead = vectors_of(between(used, f"{year}-01-01", f"{year + 1}-01-01"), features)
        return raw_probability(before, ahead, "features", "p_raw").select("p_raw", "label")

    parts = [out_of_time(before, y) for before, y in zip(earlier, years)]
    return replace(model, calibrator=fit_calibrator(calibration, reduce(DataFrame.unionByName, parts)))


# --------------------------------------------------------------------------------- importances
def standardized_coefficients(model: BoutModel, train: DataFrame) -> list[tuple[str, float]]:
    """Coefficients in units of each input's standard deviation over the mirrored rows."""
    spread = mirror(train.select("label", *model.features)).agg(
        *[F.stddev_samp(c).alias(c) for c in model.features]
    ).first()
    return [(f, float(c) * (spread[f] or 0.0)) for f, c in zip(model.features, model.model.coefficients)]


def feature_importance(model: BoutModel, train: DataFrame) -> list[tuple[str, float]]:
    if model.kind == "logistic_regression":
        return standardized_coefficients(model, train)
    return [(f, float(v)) for f, v in zip(model.features, model.model.featureImportances)]


def with_row_index(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """A dense 0-based index in a repeatable random order: by the MD5 of (key, seed), then the key.

    Keys are unique, so the leading three digits cut the rows into 4,096 even slices; each slice is numbered on its own
    and starts where the slices before it end. Slice totals are at most 4,096 rows.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    sliced = df.withColumn("draw", draw).withColumn("slice", F.substring("draw", 1, 3))
    totals = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy("draw", key)
    return (
        sliced.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, "slice")
        .withColumn(name, F.col("start") + F.col("at"))
        .drop("draw", "slice", "at", "start")
    )


def permutation_rule(n: int, label: str) -> tuple[int, int]:
    """Factor and shift of a bijection i -> (factor * i + shift) mod n that depends on `label` alone.

    The factor is the first number from a drawn one on that has no divisor in common with n. Both stay near 2^20, so
    that products with row indexes fit into 64 bits up to 2^42 rows.
    """
    digits = hashlib.md5(label.encode()).hexdigest()
    factor = next(f for f in itertools.count(1 + int(digits[:5], 16)) if math.gcd(f, n) == 1)
    return factor, int(digits[5:10], 16)


def permuted_values(
    indexed: DataFrame, n: int, columns: dict[str, list[str]], n_repeats: int = 5, seed: int = SEED, index: str = "i"
) -> DataFrame:
    """(repeat, group, receiver, donated) for every row, repeat and group: a permutation of its own for each of them.

    `donated` are the donor's values of the group's columns; `receiver` is the index of the row that gets them. Rows are
    narrow and no row is compared with another: the receiver follows from the donor's own index.
    """
    sent = []
    for repeat in range(n_repeats):
        for group, names in columns.items():
            factor, shift = permutation_rule(n, f"{seed}:{group}:{repeat}")
            sent.append(F.struct(
                F.lit(repeat).alias("repeat"), F.lit(group).alias("group"),
                ((F.col(index) * F.lit(factor) + F.lit(shift)) % F.lit(n)).alias("receiver"),
                F.array(*[F.col(c) for c in names]).alias("donated"),
            ))
    return indexed.select(F.inline(F.array(*sent)))


def permutation_importance(
    model: BoutModel, table: DataFrame, key: str = "bout_id", n_repeats: int = 5, groups: dict[str, list[str]] = FEATURE_GROUPS
) -> list[tuple[str, float]]:
    """Mean increase in log loss when a group's columns are shuffled together, each group in its own order.

    Rows are indexed once and meet the values of all groups and repeats over one join on the index; all variants are
    scored in one pass over it.
    """
    used = {g: [f"{f}_diff" for f in fs if f"{f}_diff" in model.features] for g, fs in groups.items()}
    used = {g: fs for g, fs in used.items() if fs}
    indexed = with_row_index(table.select(key, "label", *model.features), key, SEED, "i").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = indexed.count()
        base = symmetric_log_loss(model, indexed)
        donors = permuted_values(indexed, n, used, n_repeats)
        joined = donors.join(indexed.withColumnRenamed("i", "receiver"), "receiver")
        place = {c: (g, i) for g, fs in used.items() for i, c in enumerate(fs)}
        inputs = [
            F.when(F.col("group") == place[c][0], F.col("donated")[place[c][1]]).otherwise(F.col(c)).alias(c) if c in place else F.col(c)
            for c in model.features
        ]
        scored = score_symmetric(model, joined.select("group", "label", *inputs))
        q = F.greatest(F.least("p_a", F.lit(1 - 1e-6)), F.lit(1e-6))
        loss = -F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))
        rows = scored.groupBy("group").agg(F.avg(loss).alias("loss")).collect()
    finally:
        indexed.unpersist()
    return sorted(((r["group"], r["loss"] - base) for r in rows), key=lambda t: -t[1])


# --------------------------------------------------------------------------------- finish type
@dataclass(frozen=True)
class FinishModel:
    """P(finish type | winner beat loser)."""

    features: list[str]
    model: object


def fit_finish_model(train: DataFrame, C: float, features: list[str] = FINISH_FEATURES) -> FinishModel:
    return fit_finish_models(train, (C,), features)[0]


def fit_finish_models(train: DataFrame, grid: tuple[float, ...], features: list[str] = FINISH_FEATURES) -> list[FinishModel]:
    """A model for every C, all from one copy of the rows."""
    classes = F.array(*[F.lit(m) for m in FINISH_TYPES])
    label = (F.array_position(classes, F.col("method")) - 1).cast("double")
    rows = train.select(*features, label.alias("label"))
    n = train.count()
    estimators = [LogisticRegression(family="multinomial", regParam=1.0 / (C * n), standardization=True, maxIter=3000) for C in grid]
    return [FinishModel(list(features), model) for model in fit_logistics(estimators, rows, features, len(FINISH_TYPES))]


def score_finish(model: FinishModel, df: DataFrame, target: str = "probabilities", source: str | None = None) -> DataFrame:
    """Probabilities in finish-type order. `source` names a ready vector column."""
    rows = df if source else assemble(df, model.features, "finish_features")
    m = model.model
    names = {m.featuresCol: source or "finish_features", m.probabilityCol: "finish_v", m.rawPredictionCol: "finish_r", m.predictionCol: "finish_c"}
    scored = m.transform(rows, names)
    return scored.withColumn(target, vector_to_array("finish_v")).drop("finish_v", "finish_r", "finish_c", "finish_features")


def finish_c_search(
    table: DataFrame, periods: Periods, grid: tuple[float, ...] = FINISH_C_GRID, holdout_years: int = FINISH_HOLDOUT_YEARS
) -> list[tuple[float, float]]:
    """Holdout log loss of every C, on the last years inside the training period."""
    start = datetime.date.fromisoformat(periods.validation)
    last = calendar.monthrange(start.year - holdout_years, start.month)[1]  # 29 February has no match in most years
    cut = start.replace(year=start.year - holdout_years, day=min(start.day, last)).isoformat()
    inner = between(table, periods.finish_min_train, cut)
    holdout = between(table, cut, periods.validation)

    def loss(c: float, model: FinishModel) -> tuple[float, float]:
        return c, multiclass_metrics(score_finish(model, holdout)).first()["log_loss"]

    return concurrently(table.sparkSession, [partial(loss, *x) for x in zip(grid, fit_finish_models(inner, grid))])


class ModelCodeMismatch(RuntimeError):
    """A saved model and the current feature list do not fit together."""


def schema_mismatches(df_columns: list[str], saved: list[str], current: list[str]) -> list[tuple[str, str]]:
    """(column, problem) for a saved input list against the current one and the data at hand."""
    out = [(c, "not in current features") for c in saved if c not in current]
    out += [(c, "not in saved model") for c in current if c not in saved]
    out += [(c, "not in data") for c in saved if c not in df_columns]
    if not out and saved != current:
        out.append((saved[0], "other order"))
    return out


def require_same_features(saved: list[str], current: list[str]) -> None:
    bad = schema_mismatches(current, saved, current)
    if bad:
        raise ModelCodeMismatch(f"saved model and code differ: {bad[:3]}")
