import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.constants import FEATURE_GROUPS, FINISH_TYPES, MODEL_FEATURES, SIMPLICITY_MARGIN
from duelgrid.operators import matchup, models, outcomes, scoring
from duelgrid.plans import adapter, derived, pipeline, workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return derived.training_table(spark, SF)


@pytest.fixture(scope="module")
def model(table):
    fitted = models.fit_bout_model("logistic_regression", {"C": 0.1}, models.between(table, None, "2000-01-01"), MODEL_FEATURES)
    return models.calibrated(fitted, models.between(table, "2000-01-01", None))[0]


def test_both_sides_sum_to_one(model, table):
    ab = models.score_symmetric(model, table).select("bout_id", F.col("p_a").alias("ab"))
    ba = models.score_symmetric(model, matchup.swapped(table)).select("bout_id", F.col("p_a").alias("ba"))
    worst = ab.join(ba, "bout_id").agg(F.max(F.abs(F.col("ab") + F.col("ba") - 1)), F.min("ab"), F.max("ab")).first()
    assert worst[0] < 1e-12 and 0 < worst[1] and worst[2] < 1


def test_fit_reduces_the_training_loss(model, table):
    """Before calibration, which is fitted on later bouts."""
    raw = replace(model, calibrator=models.Calibrator())
    assert models.symmetric_log_loss(raw, models.between(table, None, "2000-01-01")) < 0.6931


def test_occlusion_mirrors(model, table):
    a = scoring.explain_occlusion(model, table, ["bout_id"])
    b = scoring.explain_occlusion(model, matchup.swapped(table), ["bout_id"]).withColumnRenamed("impact", "turned")
    gap = a.join(b.drop("favors"), ["bout_id", "group"]).agg(F.max(F.abs(F.col("impact") + F.col("turned"))), F.count(F.lit(1))).first()
    assert gap[0] < 1e-12 and gap[1] == table.count() * len(FEATURE_GROUPS)


@pytest.mark.parametrize("kind, params", [("logistic_regression", {"C": 0.1}), ("random_forest", {"numTrees": 3, "maxDepth": 3})])
def test_factors_in_the_row_equal_occlusion(spark, model, table, kind, params):
    """Also for a model that has no closed form; the plan neither generates rows nor exchanges them."""
    if kind != model.kind:
        model = replace(models.fit_bout_model(kind, params, table, MODEL_FEATURES), calibrator=model.calibrator)
    rows = models.assemble(table, MODEL_FEATURES, "win_input")
    got = scoring.with_factors(model, rows).select("bout_id", "p_a", "inputs", "factors")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    flat = got.selectExpr("bout_id", "inline(factors)").join(
        scoring.explain_occlusion(model, table, ["bout_id"]).withColumnsRenamed({"impact": "want", "favors": "side"}), ["bout_id", "group"]
    )
    # at an impact of nearly 0 the last digit decides which side is named
    wrong = (F.abs(F.col("impact") - F.col("want")) > 1e-12) | ((F.col("favors") != F.col("side")) & (F.abs("want") > 1e-12))
    seen = flat.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).first()
    assert (seen["n"], seen["wrong"]) == (table.count() * len(FEATURE_GROUPS), 0)
    one = got.orderBy("bout_id").first()
    assert [f["rank"] for f in one["factors"]] == sorted(f["rank"] for f in one["factors"])
    place = {f: i for i, f in enumerate(MODEL_FEATURES)}
    assert all(f["input_values"] == [one["inputs"][place[f"{c}_diff"]] for c in FEATURE_GROUPS[f["group"]] if f"{c}_diff" in place] for f in one["factors"])


@pytest.mark.parametrize("n", [1, 2, 12, 97, 5040])
def test_every_group_is_permuted_on_its_own(spark, n):
    rows = spark.range(n).selectExpr("id AS i", "id * 10D AS x", "id * 100D AS y")
    sent = models.permuted_values(rows, n, {"one": ["x"], "two": ["y", "x"]}, 3).collect()
    orders = {}
    for r in sent:
        orders.setdefault((r["group"], r["repeat"]), {})[r["receiver"]] = tuple(r["donated"])
    assert len(orders) == 6 and all(sorted(o) == list(range(n)) for o in orders.values())
    assert all(sorted(o.values()) == [(10.0 * i,) if g == "one" else (100.0 * i, 10.0 * i) for i in range(n)] for (g, _), o in orders.items())
    if n > 90:
        assert len({tuple(int(v[-1]) for _, v in sorted(o.items())) for o in orders.values()}) == 6


def test_permutation_importance_equals_the_plain_definition(spark, table):
    """Groups are exchanged one by one with numpy, in the orders that the rules give."""
    rows = models.between(table, "2000-06-01", None)
    fitted = models.fit_bout_model("logistic_regression", {"C": 1.0}, models.between(table, None, "2000-01-01"), MODEL_FEATURES)
    got = dict(models.permutation_importance(fitted, rows, n_repeats=2))
    frame = models.with_row_index(rows.select("bout_id", "label", *MODEL_FEATURES), "bout_id", models.SEED, "i").toPandas().sort_values("i", ignore_index=True)
    n, weights, bias = len(frame), fitted.model.coefficients.toArray(), fitted.model.intercept
    signs = np.array([-1.0 if f.endswith("_diff") else 1.0 for f in MODEL_FEATURES])

    def loss(x):
        ab, ba = (1 / (1 + np.exp(-(v @ weights + bias))) for v in (x, x * signs))
        p = np.clip((ab + 1 - ba) / 2, 1e-6, 1 - 1e-6)
        return -np.where(frame["label"] == 1, np.log(p), np.log(1 - p)).mean()

    base, matrix = loss(frame[MODEL_FEATURES].to_numpy(float)), frame[MODEL_FEATURES].to_numpy(float)
    for group, names in FEATURE_GROUPS.items():
        at = [MODEL_FEATURES.index(f"{c}_diff") for c in names if f"{c}_diff" in MODEL_FEATURES]
        if not at:
            continue
        rises = []
        for repeat in range(2):
            factor, shift = models.permutation_rule(n, f"{models.SEED}:{group}:{repeat}")
            mixed = matrix.copy()
            mixed[np.ix_((factor * np.arange(n) + shift) % n, at)] = matrix[:, at]
            rises.append(loss(mixed) - base)
        assert got[group] == pytest.approx(np.mean(rises), abs=1e-9), group


def test_joint_outcome_sums_to_one_and_mirrors(spark):
    row = spark.sql("SELECT 0.7D AS p, array(0.2D, 0.3D, 0.5D) AS ga, array(0.6D, 0.1D, 0.3D) AS gb")
    ab = row.select(outcomes.six_way(F.col("p"), F.col("ga"), F.col("gb")).alias("j")).first()["j"]
    ba = row.select(outcomes.six_way(1 - F.col("p"), F.col("gb"), F.col("ga")).alias("j")).first()["j"]
    assert sum(ab["a"]) + sum(ab["b"]) == pytest.approx(1)
    assert ab["a"] == pytest.approx(ba["b"]) and ab["overall"] == pytest.approx(ba["overall"])
    even = row.select(
        outcomes.most_likely(outcomes.six_way(F.lit(0.5), F.col("gb"), F.col("gb"))).alias("m")
    ).first()["m"]
    assert (even["winner"], even["method"], even["prob"]) == ("A", "KO/TKO", 0.3)


def test_round_odds_sum_to_one(spark):
    split = spark.createDataFrame([(3, 1, 0.5), (3, 2, 0.3), (3, 3, 0.2)], "scheduled_rounds int, round int, share double")
    rows = spark.createDataFrame([(3, 0.4), (4, 0.4)], "scheduled_rounds int, p_decision double")
    got = {r["scheduled_rounds"]: r for r in outcomes.round_odds(rows, split).collect()}
    assert got[3]["distance"] + sum(got[3]["by_round"]) == pytest.approx(1)
    assert got[4]["distance"] is None and got[4]["by_round"] is None


def test_calibration_cut_is_the_middle_row(spark):
    df = spark.createDataFrame([("2020-01-01",)] * 3 + [("2020-01-02",)] * 2 + [("2020-02-01",)], "d string").selectExpr("date(d) AS event_date")
    assert str(models.median_date(df)) == "2020-01-02"


SMALL_GRIDS = {
    "logistic_regression": [{"C": 0.01}, {"C": 1.0}],
    "random_forest": [{"numTrees": 4, "maxDepth": 3, "minInstancesPerNode": 20}],
    "boosted_trees": [{"maxIter": 3, "maxDepth": 2}],
}


def test_walk_forward_equals_single_fits(table):
    """Every fold of every family against a model fitted alone; a year without bouts has no fold."""
    train = models.between(table, adapter.PERIODS.min_train, adapter.PERIODS.validation)
    folds = models.walk_forward(SMALL_GRIDS, train, (1998, 1999, 2050), MODEL_FEATURES)
    assert [(f.kind, f.params, f.year) for f in folds] == [(k, p, y) for k, grid in SMALL_GRIDS.items() for p in grid for y in (1998, 1999)]
    for f in folds:
        alone = models.fit_bout_model(f.kind, f.params, models.between(train, None, f"{f.year}-01-01"), MODEL_FEATURES)
        ahead = models.between(train, f"{f.year}-01-01", f"{f.year + 1}-01-01")
        assert f.log_loss == pytest.approx(models.symmetric_log_loss(alone, ahead), abs=1e-7)
    best = models.best_points(folds)
    means = [(a.log_loss + b.log_loss) / 2 for a, b in zip(folds[::2], folds[1::2])]
    assert best["logistic_regression"][1] == pytest.approx(min(means[:2])) and [best[k][1] for k in list(best)[1:]] == pytest.approx(means[2:])


def test_rows_of_other_years_are_never_mirrored(table, monkeypatch):
    """Scores of a year read that year: cut before rows get their mirror image, as a filter does not pass below it."""
    seen, held = [], models.assemble
    monkeypatch.setattr(models, "assemble", lambda rows, *args: seen.append(rows) or held(rows, *args))
    train = models.between(table, adapter.PERIODS.min_train, adapter.PERIODS.validation)
    models.walk_forward({"logistic_regression": [{"C": 0.1}]}, train, (1998, 1999), MODEL_FEATURES)
    want = [models.between(train, f"{y}-01-01", f"{y + 1}-01-01").count() for y in (1998, 1999)]
    assert sorted(rows.count() for rows in seen) == sorted(want)
    seen.clear()
    models.production_refit("logistic_regression", {"C": 0.1}, "sigmoid", table, adapter.PERIODS, MODEL_FEATURES)
    years = [n for y, n in models.yearly_rows(models.between(table, adapter.PERIODS.min_train, None)).items() if y >= 2000]
    assert sorted(rows.count() for rows in seen if "mirrored" in rows.columns) == sorted(years)


def test_the_first_of_equal_search_points_is_taken():
    folds = [models.Fold("x", {"a": a}, y, v) for a, losses in ((1, (3, 5)), (2, (5, 1)), (3, (2, 4))) for y, v in zip((1, 2), losses)]
    assert models.best_points(folds) == {"x": ({"a": 2}, 3.0)}


def test_calibration_halves_equal_separate_fits(table):
    fitted = models.fit_bout_model("logistic_regression", {"C": 0.1}, models.between(table, None, "2000-01-01"), MODEL_FEATURES)
    later = models.between(table, "2000-01-01", None)
    best, scores = models.choose_calibration(fitted, later)
    cut = str(models.median_date(later))
    halves = [models.between(later, None, cut), models.between(later, cut, None)]
    for method, score in scores.items():
        losses = [
            models.symmetric_log_loss(replace(fitted, calibrator=models.fit_calibrator(method, models.mirrored_raw(fitted, a))), b)
            for a, b in (halves, halves[::-1])
        ]
        assert score == pytest.approx(sum(losses) / 2, abs=1e-9)
    assert best == min(scores, key=scores.get)


def test_a_run_selects_between_three_families(spark):
    run = pipeline.training_run(derived.bouts(spark, SF), derived.day_profiles(spark, SF), adapter.PERIODS, SMALL_GRIDS)
    report = run.report
    assert set(report["validation"]) == set(SMALL_GRIDS) and len(report["search"]) == 4 * len(adapter.PERIODS.walk_forward_years)
    losses = {k: v["validation_log_loss"] for k, v in report["validation"].items()}
    best = min(losses, key=losses.get)
    simple = losses["logistic_regression"] - losses[best] < SIMPLICITY_MARGIN
    assert report["selected_model"] == run.selected.kind == run.deployed.kind == ("logistic_regression" if simple else best)
    assert {r["model"] for r in report["test_results"]} >= set(SMALL_GRIDS)


def test_periods_and_features_are_checked():
    with pytest.raises(ValueError):
        models.check_periods(adapter.Periods("2001-01-01", "2000-01-01", "2002-01-01"))
    with pytest.raises(models.ModelCodeMismatch):
        models.require_same_features(["a", "b"], ["a", "c"])
    with pytest.raises(models.ModelCodeMismatch):
        models.require_same_features(["b", "a"], ["a", "b"])
    models.require_same_features(["a", "b"], ["a", "b"])


def test_same_entity_is_rejected(spark):
    pairs = spark.createDataFrame([("x", "x"), ("x", "y")], "a_id string, b_id string")
    valid, rejected = scoring.split_same_entity(pairs)
    assert valid.count() == rejected.count() == 1


def test_the_finish_model_sees_real_ratings(spark):
    """Differences of the finish rows are those of the rating pass, and profiles of a later day carry its last state."""
    entered = derived.day_profiles(spark, SF).select("entity_id", "event_date", "glicko_rating")
    bouts = derived.bouts(spark, SF).where("winner_side IS NOT NULL").selectExpr(
        "bout_id", "event_date", "IF(winner_side = 1, entity_1_id, entity_2_id) AS w", "IF(winner_side = 1, entity_2_id, entity_1_id) AS l"
    )
    for side in ("w", "l"):
        bouts = bouts.join(entered.withColumnsRenamed({"entity_id": side, "glicko_rating": f"{side}_rating"}), [side, "event_date"])
    rows = derived.finish_table(spark, SF).join(bouts, "bout_id").select("wl_glicko_rating_diff", (F.col("w_rating") - F.col("l_rating")).alias("want")).collect()
    assert rows and all(r[0] == pytest.approx(r[1]) for r in rows) and any(abs(r[0]) > 1 for r in rows)
    last = derived.rating_states(spark, SF).groupBy("entity_id").agg(F.max_by("rating", "last_day").alias("rating"))
    now = derived.current_profiles(spark, SF).join(last, "entity_id").collect()
    assert now and all(r["glicko_rating"] == pytest.approx(r["rating"]) for r in now) and len({r["rating"] for r in now}) > 1


def test_fits_keep_no_second_copy_of_their_rows(spark, table, monkeypatch):
    """Classifiers keep blocks or bags of their own; large fits run one at a time."""
    finish = derived.finish_table(spark, SF)

    def refuse(*_):
        raise AssertionError("rows are kept twice")

    monkeypatch.setattr(type(table), "persist", refuse)
    models.fit_bout_model("logistic_regression", {"C": 0.1}, models.between(table, None, "2000-01-01"), MODEL_FEATURES)
    models.fit_finish_model(finish, 0.001)
    models.production_refit("logistic_regression", {"C": 0.1}, "none", table, adapter.PERIODS, MODEL_FEATURES)
    assert models.fits_at_once(1000, MODEL_FEATURES) == models.FITS_AT_ONCE and models.fits_at_once(50_000_000, MODEL_FEATURES) == 1
    assert models.fits_at_once(0, MODEL_FEATURES) == models.FITS_AT_ONCE


def close_inputs(spark, labels):
    """Two inputs that nearly depend on each other, one that does not vary, and a label."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    x = np.column_stack([a, a + 0.01 * rng.normal(size=400), np.full(400, 1.1), 50 + 9 * rng.normal(size=400)])
    names = ["a_diff", "b_diff", "same", "c"]
    return x, names, spark.createDataFrame([(*r, y) for r, y in zip(x.tolist(), labels)], [*names, "label"]).withColumn("event_date", F.current_date())


def test_a_logistic_fit_ends_at_the_least_loss(spark):
    """The gradient over both views vanishes; the search that stops at a relative gain of 1e-6 leaves 1e-5 and more."""
    y = np.random.default_rng(4).integers(0, 2, 400)
    x, names, rows = close_inputs(spark, y.tolist())
    fitted = models.fit_bout_model("logistic_regression", {"C": 1.0}, rows, names).model
    both, labels = np.vstack([x, x * [-1, -1, 1, 1]]), np.concatenate([y, 1 - y])
    off = 1 / (1 + np.exp(-(both @ fitted.coefficients.toArray() + fitted.intercept))) - labels
    scale = both.std(0, ddof=1)
    scale[2] = 1.0
    slope = ((both - both.mean(0)) / scale).T @ off / 800 + scale * fitted.coefficients.toArray() / 800
    assert abs(off.mean()) < 1e-9 and np.abs(slope).max() < 1e-9 and fitted.coefficients[2] == 0


def test_a_finish_fit_ends_at_the_least_loss(spark):
    y = np.random.default_rng(5).integers(0, 3, 400)
    x, names, rows = close_inputs(spark, y.tolist())
    methods = F.element_at(F.array(*[F.lit(m) for m in FINISH_TYPES]), (F.col("label") + 1).cast("int"))
    fitted = models.fit_finish_model(rows.withColumn("method", methods).drop("label"), 0.1, names).model
    weights = fitted.coefficientMatrix.toArray()
    margins = np.exp(x @ weights.T + fitted.interceptVector.toArray())
    off = margins / margins.sum(1, keepdims=True) - np.eye(3)[y]
    scale = x.std(0, ddof=1)
    scale[2] = 1.0
    slope = off.T @ ((x - x.mean(0)) / scale) / 400 + weights * scale / 40
    assert np.abs(off.mean(0)).max() < 1e-9 and np.abs(slope).max() < 1e-9 and abs(fitted.interceptVector.toArray().sum()) < 1e-9


def test_a_logistic_fit_takes_few_jobs(spark):
    """Each pass of a search is a job; near dependence of the inputs does not add passes."""
    _, names, rows = close_inputs(spark, np.random.default_rng(4).integers(0, 3, 400).tolist())
    methods = F.element_at(F.array(*[F.lit(m) for m in FINISH_TYPES]), (F.col("label") + 1).cast("int"))
    context = spark.sparkContext
    context.setJobGroup("newton", "newton")
    try:
        models.fit_finish_model(rows.withColumn("method", methods).drop("label").coalesce(1), 1000.0, names)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("newton")) <= 16


def test_fits_on_nested_rows_share_one_copy(spark, table, monkeypatch):
    """All logistic fits of a search or a refit take their steps together; each model is the one of a fit alone."""
    packed, held = [], models.blocks_of
    monkeypatch.setattr(models, "blocks_of", lambda *args: packed.append(1) or held(*args))
    train = models.between(table, adapter.PERIODS.min_train, adapter.PERIODS.validation)
    grid = [{"C": 0.01}, {"C": 1.0}]
    folds = models.walk_forward({"logistic_regression": grid}, train, (1997, 1998, 1999), MODEL_FEATURES)
    assert len(packed) == 1 and [(f.params["C"], f.year) for f in folds] == [(c, y) for c in (0.01, 1.0) for y in (1997, 1998, 1999)]
    models.production_refit("logistic_regression", grid[0], "sigmoid", table, adapter.PERIODS, MODEL_FEATURES)
    assert len(packed) == 2
    models.finish_c_search(derived.finish_table(spark, SF), adapter.PERIODS, (0.001, 0.01, 0.1))
    assert len(packed) == 3
    sizes = models.yearly_rows(train)
    n = sum(v for y, v in sizes.items() if y < 1998)
    together = models.fit_years(train, MODEL_FEATURES, [(grid[0], n, 1998), (grid[1], sum(sizes.values()), None)])
    alone = [models.fit_bout_model("logistic_regression", grid[0], models.between(train, None, "1998-01-01")), models.fit_bout_model("logistic_regression", grid[1], train)]
    for a, b in zip(together, alone):
        assert a.model.coefficients.toArray() == pytest.approx(b.model.coefficients.toArray(), abs=1e-9) and a.model.intercept == pytest.approx(b.model.intercept, abs=1e-9)


def test_a_finish_type_without_rows_leaves_the_fit_to_the_estimator(spark):
    y = np.random.default_rng(6).integers(0, 2, 400)
    _, names, rows = close_inputs(spark, y.tolist())
    methods = F.element_at(F.array(*[F.lit(m) for m in FINISH_TYPES]), (F.col("label") + 1).cast("int"))
    assert models.fit_finish_model(rows.withColumn("method", methods).drop("label"), 0.1, names).model.numClasses == 2


def test_the_kept_table_writes_no_pairs_on_the_way(spark, tmp_path):
    """Jobs that only fit winners write the columns they read, and not the inputs of both sides besides."""
    source = f"{tmp_path}/source"
    shutil.copytree(SF, source)
    kept = derived.kept_training_table(spark, source)
    assert workspace.staged(spark, source, "training_table") and not workspace.staged(spark, source, "pair_inputs")
    want = derived.training_table(spark, source).select(*kept.columns)
    assert workspace.staged(spark, source, "pair_inputs") and sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))


def test_a_missing_input_ends_a_fit(spark):
    rows = spark.createDataFrame([(0.5, 1), (None, 0), (0.2, 0)], "a_diff double, label int").withColumn("event_date", F.current_date())
    with pytest.raises(Exception, match="missing"):
        models.fit_bout_model("logistic_regression", {"C": 1.0}, rows, ["a_diff"])
