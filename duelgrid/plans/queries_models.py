"""Fitted models: rows-only queries on the training tables of the contract data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from duelgrid.constants import FINISH_TYPES, MODEL_FEATURES, MODEL_GRIDS, SEED
from duelgrid.operators import canonical, matchup, metrics, models, monitor, outcomes, resolve, roster, scoring
from duelgrid.plans import adapter, derived, pipeline
from duelgrid.plans import sqlbase as S
from duelgrid.plans.registry import query
from duelgrid.session import run_dir, written
from duelgrid.sources import model_store, pages, raw

P = adapter.PERIODS
LOGISTIC = MODEL_GRIDS["logistic_regression"][0]


def _periods(spark, sf, table=None):
    table = derived.training_table(spark, sf) if table is None else table
    return (
        models.between(table, P.min_train, P.validation),
        models.between(table, P.validation, P.test),
        models.between(table, P.test, None),
    )


def _fit(spark, sf, kind="logistic_regression", params=None, table=None):
    train, _, _ = _periods(spark, sf, table)
    return models.fit_bout_model(kind, params or LOGISTIC, train, MODEL_FEATURES)


def _test_metrics(spark, sf, model):
    _, _, test = _periods(spark, sf)
    out = metrics.binary_metrics(models.score_symmetric(model, test), "label", "p_a")
    return out.select(F.lit(model.kind).alias("model"), *out.columns)


@query()
def model_logistic(spark, sf):
    return _test_metrics(spark, sf, _fit(spark, sf))


@query()
def model_forest(spark, sf):
    return _test_metrics(spark, sf, _fit(spark, sf, "random_forest", MODEL_GRIDS["random_forest"][0]))


@query()
def model_boosted(spark, sf):
    return _test_metrics(spark, sf, _fit(spark, sf, "boosted_trees", MODEL_GRIDS["boosted_trees"][0]))


def _finish(spark, sf, C=0.001):
    train = models.between(derived.finish_table(spark, sf), P.finish_min_train, P.validation)
    return models.fit_finish_model(train, C)


@query()
def model_finish_type(spark, sf):
    """The finish-type model next to both naive predictions on the test period, mean and actual shares."""
    table = derived.finish_table(spark, sf)
    train, test = models.between(table, P.finish_min_train, P.validation), models.between(table, P.test, None)
    overall = outcomes.finish_rates(train).select("rates").scalar()
    scored = {
        "model": models.score_finish(_finish(spark, sf), test, "rates"),
        "overall rates": test.withColumn("rates", overall),
        "class rates": outcomes.class_rates_fallback(test, train, ["weight_lbs", "is_female"]),
    }
    out = None
    for name, df in scored.items():
        row = metrics.multiclass_metrics(df, "method", "rates").withColumn("name", F.lit(name))
        shares = df.agg(
            *[F.avg(F.col("rates")[i]).alias(f"predicted_{i}") for i in range(3)],
            *[F.avg((F.col("method") == m).cast("double")).alias(f"actual_{i}") for i, m in enumerate(FINISH_TYPES)],
        )
        row = row.withColumns({c: shares.select(c).scalar() for c in shares.columns})
        out = row if out is None else out.unionByName(row)
    return out


@query()
def finish_type_c_search(spark, sf):
    losses = models.finish_c_search(derived.finish_table(spark, sf), P)
    return spark.createDataFrame(losses, "C double, holdout_log_loss double")


@query()
def walk_forward_cv(spark, sf):
    """Loss of every search point of the logistic family in every walk-forward year."""
    train, _, _ = _periods(spark, sf, derived.kept_training_table(spark, sf))
    grid = {"logistic_regression": MODEL_GRIDS["logistic_regression"]}
    rows = [(f.params["C"], f.year, f.log_loss) for f in models.walk_forward(grid, train, P.walk_forward_years, MODEL_FEATURES)]
    return spark.createDataFrame(rows, "C double, year int, log_loss double")


def _calibrated(spark, sf, method):
    _, validation, test = _periods(spark, sf)
    model = _fit(spark, sf)
    calibrator = models.fit_calibrator(method, models.mirrored_raw(model, validation))
    scored = models.score_symmetric(replace(model, calibrator=calibrator), test)
    return scored.select("bout_id", "label", "p_ab", "p_ba", "p_a")


@query()
def calibrate_sigmoid(spark, sf):
    return _calibrated(spark, sf, "sigmoid")


@query()
def calibrate_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic")


@query()
def choose_calibration(spark, sf):
    _, validation, _ = _periods(spark, sf)
    best, scores = models.choose_calibration(_fit(spark, sf), validation)
    return spark.createDataFrame([(m, v, m == best) for m, v in scores.items()], "method string, log_loss double, chosen boolean")


@query()
def symmetric_scores(spark, sf):
    """Every bout since the validation start, both orientations and their symmetric mean."""
    rows = models.between(derived.training_table(spark, sf), P.validation, None)
    return models.score_symmetric(_fit(spark, sf), rows).select("bout_id", "label", "p_ab", "p_ba", "p_a")


@query()
def baselines(spark, sf):
    train, _, test = _periods(spark, sf)
    columns = models.fit_baselines(train)
    rows = test.select(
        F.col("label").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in columns.items()])).alias("s"),
    ).select("y", "s.*")
    return metrics.grouped_metrics(rows)


@query()
def production_refit(spark, sf):
    """Agreement of the refit with the evaluated model over the test period."""
    table = derived.kept_training_table(spark, sf)
    _, _, test = _periods(spark, sf, table)
    evaluated = models.score_symmetric(_fit(spark, sf, table=table), test).withColumnRenamed("p_a", "p_evaluated").drop("p_ab", "p_ba")
    refit = models.production_refit("logistic_regression", LOGISTIC, "sigmoid", table, P, MODEL_FEATURES)
    return metrics.refit_agreement(models.score_symmetric(refit, evaluated).withColumnRenamed("p_a", "p_deployed"))


@query()
def feature_importance(spark, sf):
    train, _, _ = _periods(spark, sf)
    rows = models.feature_importance(_fit(spark, sf), train)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.abs("importance").desc())


@query()
def top_coefficients(spark, sf):
    """The 15 largest standardized coefficients by magnitude."""
    return feature_importance(spark, sf).orderBy(F.abs("importance").desc()).limit(15)


@query()
def permutation_importance(spark, sf):
    _, validation, _ = _periods(spark, sf)
    return spark.createDataFrame(models.permutation_importance(_fit(spark, sf), validation), "feature_group string, log_loss_increase double")


_DRAWN_GROUPS = ["age", "experience", "recent form"]
_DRAWN = " UNION ALL ".join(f"SELECT '{g}' AS feature_group, {k} AS repeat" for g in _DRAWN_GROUPS for k in range(2))


@query(f"""WITH {S.BOUTS}, held AS (SELECT bout_id FROM bouts WHERE winner_side IS NOT NULL AND event_date >= DATE '{P.validation}' AND event_date < DATE '{P.test}'),
numbered AS (SELECT bout_id, row_number() OVER (ORDER BY md5(bout_id || ':{SEED}'), bout_id) - 1 AS i, count(*) OVER () AS n FROM held),
size AS (SELECT count(*) AS n FROM held), drawn AS ({_DRAWN}), digits AS (SELECT *, md5('{SEED}:' || feature_group || ':' || repeat) AS h FROM drawn),
rules AS (SELECT feature_group, repeat, CAST('0x' || substr(h, 6, 5) AS BIGINT) AS shift,
  (SELECT min(f) FROM (SELECT unnest(range(1 + CAST('0x' || left(h, 5) AS BIGINT), 2000 + CAST('0x' || left(h, 5) AS BIGINT))) AS f) c, size WHERE gcd(f, size.n) = 1) AS factor
  FROM digits)
SELECT r.feature_group, CAST(r.repeat AS INTEGER) AS repeat, a.bout_id AS donor_id, b.bout_id AS receiver_id
FROM rules r, numbered a JOIN numbered b ON b.i = (r.factor * a.i + r.shift) % a.n""")
def permutation_draws(spark, sf):
    """Which bout's values every validation bout gets, for three groups of inputs and two repeats."""
    _, validation, _ = _periods(spark, sf)
    indexed = written(models.with_row_index(validation.select("bout_id"), "bout_id", SEED, "i"), run_dir(spark, "indexed"))
    sent = models.permuted_values(indexed, indexed.count(), {g: ["bout_id"] for g in _DRAWN_GROUPS}, 2)
    return sent.join(indexed.select(F.col("i").alias("receiver"), F.col("bout_id").alias("receiver_id")), "receiver").select(
        F.col("group").alias("feature_group"), "repeat", F.col("donated")[0].alias("donor_id"), "receiver_id"
    )


@query()
def explain_occlusion(spark, sf):
    """Notable factors of every test bout, by group."""
    _, _, test = _periods(spark, sf)
    return scoring.notable_factors(scoring.explain_occlusion(_fit(spark, sf), test, ["bout_id"]))


@query()
def score_card(spark, sf):
    """Card pages -> records -> ids -> profiles -> win, finish-type and round probabilities with notes.

    The models are the deployed ones of the newest training run; nothing is fitted here.
    """
    from duelgrid.plans.queries_ingest import card_pages

    app, known = derived.appearances(spark, sf), adapter.entities(spark, sf)
    people = roster.build_roster(app, known)
    read = written(pages.read_cards(card_pages(spark, sf)), run_dir(spark, "card-pages"))
    pages.require_parsed(pages.extraction_guard(read))
    bout = ["page_id", "section_no", "place"]
    card = pages.card_context(read)
    sides = card.selectExpr(
        *bout, "weight_class", "inline(array(struct(1 AS side, entity_1 AS name), struct(2 AS side, entity_2 AS name)))"
    )
    ids = resolve.match_mentions(sides, known, people).groupBy(*bout).agg(
        *[F.max(F.when(F.col("side") == s, F.col("entity_id"))).alias(f"{side}_id") for s, side in ((1, "a"), (2, "b"))]
    )
    klass = "weight_class"
    from duelgrid.functions.text import weight_class

    matchups = written(card.join(ids, bout).select(
        *bout, "entity_1", "entity_2", klass, "a_id", "b_id", derived.next_day(spark, sf).alias("as_of"),
        weight_class(F.col(klass))["lbs"].alias("weight_lbs"), weight_class(F.col(klass))["is_female"].alias("is_female"),
        "is_title", "scheduled_rounds",
    ), run_dir(spark, "card-matchups"))
    on_cards = matchups.select("as_of", F.explode(F.array("a_id", "b_id")).alias("entity_id")).distinct()
    canonical.require_none(canonical.forecast_quality(app, people, on_cards))
    # names that nobody carries are debutants: they have no row and no history, so their profile is all priors
    debutants = on_cards.select("entity_id").distinct().join(known, "entity_id", "left_anti")
    profiles = derived.rated_profiles_as_of(spark, sf, known.unionByName(debutants, allowMissingColumns=True), on_cards)
    saved = derived.forecaster(spark, sf)
    valid, _ = scoring.split_same_entity(matchups)
    scored = scoring.score_matchups(valid, profiles, saved.win, saved.finish, saved.round_split)
    notes = F.filter(
        F.array(
            scoring.card_notes(F.col("entity_1"), F.col("a_id"), F.col("a_prior_fights")),
            scoring.card_notes(F.col("entity_2"), F.col("b_id"), F.col("b_prior_fights")),
        ),
        lambda x: x.isNotNull(),
    )
    return scored.select(
        *bout, "entity_1", "entity_2", "p_a", "p_b", F.col("most_likely.winner").alias("winner"), F.col("most_likely.method").alias("method"),
        F.col("most_likely.prob").alias("prob"), "distance", "by_round", F.array_join(notes, "; ").alias("notes"),
    )


@query()
def prediction_record(spark, sf):
    """Every pair that has met, predicted for the day after the newest bout in its default class."""
    b = derived.bouts(spark, sf)
    pairs = b.groupBy(F.col("entity_1_id").alias("a_id"), F.col("entity_2_id").alias("b_id")).agg(
        F.min("entity_1_name").alias("a_name"), F.min("entity_2_name").alias("b_name")
    )
    context = matchup.bout_context(pairs, matchup.latest_division(derived.appearances(spark, sf)))
    asked = context.select(
        "*", derived.next_day(spark, sf).alias("as_of"), F.lit(3).alias("scheduled_rounds"), F.lit(False).alias("is_title")
    )
    saved = derived.forecaster(spark, sf)
    out = scoring.prediction_records(asked, derived.current_profiles(spark, sf), saved.win, saved.finish, saved.round_split)
    return out.select(
        "a_id", "b_id", "as_of", "weight_class", "p_a", "p_b", "p_ab", "p_ba", "side_a", "side_b", "warnings", "most_likely", "distance", "by_round",
        "inputs", "factors", "model_type"
    )


@query()
def schema_guard(spark, sf):
    """Inputs of every saved model next to the columns of the table at hand, problems named.

    The winner models fit the training table and the finish models do not, except for inputs that both tables hold.
    """
    derived.forecaster(spark, sf)
    return model_store.input_problems(spark, derived.training_store(spark, sf), derived.training_table(spark, sf))


@query()
def training_run(spark, sf):
    """Raw text to gate: ingest, yearly ratings, all 40 inputs, search, calibration, test, refit, saved models and report.

    Gated against the run before it in the store, if there is one.
    """
    data = pipeline.ingest(*[
        raw.clean_cells(t(spark, sf))
        for t in (adapter.raw_events, adapter.raw_results, adapter.raw_stats, adapter.raw_entities)
    ])
    yearly = replace(data, appearances=data.appearances.withColumn("period", F.trunc("event_date", "year")))
    run = pipeline.training_run(data.bouts, pipeline.rated_profiles(yearly, "period"), P, derived.GRIDS)
    return pipeline.save_run(run, derived.training_store(spark, sf), spark)


@query()
def run_report(spark, sf):
    """The nested report of the newest training run, read back from the table of runs, as JSON."""
    derived.forecaster(spark, sf)
    held = pipeline.runs(spark, derived.training_store(spark, sf))
    newest = held.orderBy(F.desc("run_no")).limit(1).drop("saved_at", "build")
    return monitor.run_document(newest)
