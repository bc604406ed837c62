import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.operators import metrics, models, monitor


def data(spark, seed, n=700):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.choice([0.0, 0.25, 0.5, 1.0, 0.5 + rng.random() * 1e-7, rng.random()])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "y int, p double")


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_and_quantiles(spark, seed):
    rows, df = data(spark, seed)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    cuts = [i / 10 for i in range(11)]
    assert metrics.quantile_edges(df, "p", cuts) == pytest.approx(list(np.percentile([p for _, p in rows], [c * 100 for c in cuts])))
    curve = metrics.calibration_curve(df).orderBy("bin").collect()
    edges = np.percentile([p for _, p in rows], np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], [p for _, p in rows])
    assert [(r["bin"], r["n"]) for r in curve] == [(b, int((bins == b).sum())) for b in sorted(set(bins))]


def test_one_class_has_no_auc(spark):
    assert metrics.binary_metrics(spark.createDataFrame([(1, 0.4), (1, 0.7)], "y int, p double")).first()["roc_auc"] is None


def test_totals_of_narrow_and_flat_models(spark):
    """One model keeps to a narrow range, one gives nearly all rows one score."""
    rng = random.Random(3)
    rows = [("narrow", rng.randrange(2), 0.5 + rng.random() * 1e-9) for _ in range(4000)]
    rows += [("flat", rng.randrange(2), 0.25 if rng.random() < 0.9 else rng.random()) for _ in range(4000)]
    rows += [("wide", rng.randrange(2), rng.random()) for _ in range(4000)] + [("wide", 1, None)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    cells = metrics.cumulative_by_value(df, "p", {"n": F.count(F.lit(1))}, ["model"])
    assert cells.where("n_before + n > 4000").count() == 0 and cells.where("model = 'flat' AND p = 0.25 AND n > 3000").count() == 1
    got = {r["model"]: r for r in metrics.grouped_metrics(df).collect()}
    for model in ("narrow", "flat", "wide"):
        scored = [(y, p) for m, y, p in rows if m == model and p is not None]
        pos, neg = (np.sort([p for y, p in scored if y == k]) for k in (1, 0))
        won = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
        assert got[model]["roc_auc"] == pytest.approx(won / len(pos) / len(neg), abs=1e-4) and got[model]["n"] == 4000


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "y int, p double")
    assert metrics.quantile_edges(none, "p", [0.5]) == [] and metrics.calibration_curve(none).count() == 0


def test_histogram_closes_the_last_bin(spark):
    got = {r["bin"]: r["n"] for r in metrics.probability_histogram(spark.createDataFrame([(0.0,), (0.05,), (1.0,)], "p double")).collect()}
    assert len(got) == 20 and (got[1], got[2], got[20]) == (1, 1, 1)


def test_row_index_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    one, two = [[r["i"] for r in models.with_row_index(df, "k", s, "i").orderBy("k").collect()] for s in (1, 2)]
    assert sorted(one) == sorted(two) == list(range(5000)) and one != two


def test_gate_names_every_fault(spark):
    good = (1, 0.63, 0.66, 0.65, 9000, "2026-01-01", "2026-01-01", 0.01, 0.95)
    bad = (2, 0.69, 0.66, 0.70, 100, "2025-01-01", "2026-01-01", 0.20, 0.60)
    runs = spark.createDataFrame(
        [good, bad, (*bad[:7], None, None)[:9]],
        "run_no int, test_log_loss double, best_baseline_log_loss double, validation_log_loss double, n_bouts long, refit_end string, "
        "newest_date string, mean_abs_diff double, same_favourite_rate double")
    got = [r["failures"] for r in monitor.quality_gate(runs.limit(2)).orderBy("run_no").collect()]
    assert got[0] == [] and len(got[1]) == 8
    assert "refit is unchecked" in monitor.quality_gate(runs.filter("mean_abs_diff IS NULL")).first()["failures"]
