"""End-to-end jobs: raw tables to canonical tables, and a chronological training run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.constants import (
    FINISH_FEATURES, MODEL_FEATURES, MODEL_GRIDS, PERIODS, PROFILE_FEATURES, SIMPLICITY_MARGIN, Periods,
)
from duelgrid.operators import canonical, history, matchup, metrics, models, monitor, outcomes, ratings, resolve
from duelgrid.session import path_exists, run_dir, written
from duelgrid.sources import model_store, raw


@dataclass(frozen=True)
class Canonical:
    bouts: DataFrame
    appearances: DataFrame
    entities: DataFrame


def ingest(events: DataFrame, results: DataFrame, stats: DataFrame, entities: DataFrame) -> Canonical:
    """Raw text tables (missing cells already NULL) to the canonical tables, written once.

    A bout of one entity with itself, statistics under a name that is not in their bout, and a round listed twice
    for one side end the job before anything is summed.
    """
    spark = results.sparkSession
    root = run_dir(spark, "ingest")
    typed = canonical.canonical_bouts(raw.project_results(results), raw.project_events(events))
    typed = written(typed, f"{root}/typed")
    bouts, known = resolve.resolve_bouts(typed, raw.project_entities(entities))
    bouts = written(bouts, f"{root}/bouts")
    attached = written(canonical.attach_stats(raw.project_stats(stats), bouts), f"{root}/attached")
    canonical.require_none(canonical.source_quality(bouts, attached))
    totals = canonical.sum_rounds(attached)
    appearances = written(canonical.build_appearances(bouts, totals), f"{root}/appearances")
    return Canonical(bouts, appearances, written(known, f"{root}/entities"))


def rated_profiles(data: Canonical, period_col: str | None = None) -> DataFrame:
    """Profiles per entity-day with ratings, computed and written once for the whole run.

    `period_col` names a DATE column of the appearances as rating period; by default every date is
    one. A profile that had to be filled in with the starting rating ends the job.
    """
    spark = data.appearances.sparkSession
    period = period_col or "event_date"
    app = data.appearances
    states = ratings.rate_periods(app, period)
    keys = ["entity_id", "event_date"] + ([period] if period_col else [])
    before = ratings.ratings_before(app.select(*keys), states, "event_date", period)
    profiles = history.day_profiles(app, data.entities, before, mark_rated=True)
    rules = {"appearance without rating": ~F.col("has_rating")}
    return written(profiles, f"{run_dir(spark, 'profiles')}/day", rules).drop("has_rating")


@dataclass(frozen=True)
class TrainingRun:
    selected: models.BoutModel
    deployed: models.BoutModel
    candidates: dict[str, models.BoutModel]
    evaluated_finish: models.FinishModel
    finish: models.FinishModel
    evaluated_split: DataFrame
    round_split: DataFrame
    report: dict


def training_run(
    bouts: DataFrame,
    profiles: DataFrame | None,
    periods: Periods = PERIODS,
    grids: dict[str, list[dict]] = MODEL_GRIDS,
    profile_features: list[str] = PROFILE_FEATURES,
    refit: bool = True,
    tables: tuple[DataFrame, DataFrame] | None = None,
) -> TrainingRun:
    """Search, calibrate and select on earlier periods, score the test period once, refit on all.

    The feature tables are built once. Only scores, parameters and coefficients reach the driver. Without `refit` the
    evaluated models are the deployed ones. `tables` are the training and the finish table, where a caller has them;
    otherwise they are made of `profiles`.
    """
    models.check_periods(periods)
    spark: SparkSession = bouts.sparkSession
    root = run_dir(spark, "training")
    features = MODEL_FEATURES if profile_features == PROFILE_FEATURES else matchup.input_columns(profile_features)
    if tables is None:
        tables = matchup.training_table(bouts, profiles, profile_features), matchup.finish_table(bouts, profiles)
    table, finish_rows = written(tables[0], f"{root}/table"), written(tables[1], f"{root}/finish")
    train = models.between(table, periods.min_train, periods.validation)
    validation = models.between(table, periods.validation, periods.test)
    test = models.between(table, periods.test, None)

    folds = models.walk_forward(grids, train, periods.walk_forward_years, features)
    fitted, report = {}, {}
    for kind, (params, cv) in models.best_points(folds).items():
        model, cross = models.calibrated(models.fit_bout_model(kind, params, train, features), validation)
        fitted[kind] = model
        report[kind] = {"params": params, "walk_forward_log_loss": cv, "calibration": model.calibrator.method,
                        "validation_log_loss": cross[model.calibrator.method]}
    losses = {k: v["validation_log_loss"] for k, v in report.items()}
    chosen = min(losses, key=losses.get)
    if "logistic_regression" in losses and losses["logistic_regression"] - losses[chosen] < SIMPLICITY_MARGIN:
        chosen = "logistic_regression"
    selected = fitted[chosen]

    scored = [
        test.select(F.lit(name).alias("model"), F.col("label").alias("y"), p.alias("p"))
        for name, p in models.fit_baselines(train).items()
    ] + [
        models.score_symmetric(m, test).select(F.lit(k).alias("model"), F.col("label").alias("y"), F.col("p_a").alias("p"))
        for k, m in fitted.items()
    ]
    stacked = written(reduce(DataFrame.unionByName, scored), f"{root}/scores")
    test_rows = [r.asDict() for r in metrics.grouped_metrics(stacked).collect()]

    finish_losses = models.finish_c_search(finish_rows, periods)
    finish_c = min(finish_losses, key=lambda t: t[1])[0]
    finish_train = models.between(finish_rows, periods.finish_min_train, periods.validation)
    finish_test = models.between(finish_rows, periods.test, None)
    evaluated_finish = models.fit_finish_model(finish_train, finish_c)
    finish_scores = metrics.multiclass_metrics(models.score_finish(evaluated_finish, finish_test)).first().asDict()

    evaluated_split = written(outcomes.round_split(bouts, periods.finish_min_train, periods.validation), f"{root}/evaluated_split")
    deployed, deployed_finish, split = selected, evaluated_finish, evaluated_split
    if refit:
        params, calibration = report[chosen]["params"], selected.calibrator.method
        deployed = models.production_refit(chosen, params, calibration, table, periods, features)
        deployed_finish = models.fit_finish_model(models.between(finish_rows, periods.finish_min_train, None), finish_c)
        split = written(outcomes.round_split(bouts, periods.finish_min_train, None), f"{root}/round_split")
    both = models.score_symmetric(selected, test).withColumnRenamed("p_a", "p_evaluated").drop("p_ab", "p_ba")
    both = models.score_symmetric(deployed, both).withColumnRenamed("p_a", "p_deployed")
    agreement = metrics.refit_agreement(both).first().asDict()
    ranges = {r["split"]: r.asDict() for r in metrics.date_ranges(models.with_split(table, periods)).collect()}
    return TrainingRun(
        selected,
        deployed,
        fitted,
        evaluated_finish,
        deployed_finish,
        evaluated_split,
        split,
        {
            "selected_model": chosen,
            "search": [{"model": f.kind, "params": f.params, "year": f.year, "log_loss": f.log_loss} for f in folds],
            "validation": report,
            "test_results": test_rows,
            "finish_type": {"C": finish_c, "test": finish_scores},
            "agreement": agreement,
            "periods": ranges,
            "refit_on_all_data": refit,
            "refit_end": (table if refit else validation).agg(F.max("event_date")).first()[0],
            "newest_date": bouts.agg(F.max("event_date")).first()[0],
            "n_bouts": bouts.count(),
            "feature_names": features,
        },
    )


RUN_SCHEMA = """saved_at timestamp, run_no int, build string, selected_model string, feature_names array<string>, n_bouts long,
  newest_date date, refit_on_all_data boolean, refit_end date, mean_abs_diff double, same_favourite_rate double,
  test_log_loss double, best_baseline_log_loss double, validation_log_loss double,
  search array<struct<model string, params map<string, double>, year int, log_loss double>>,
  validation array<struct<model string, params map<string, double>, walk_forward_log_loss double, calibration string,
    validation_log_loss double>>,
  test_results array<struct<model string, accuracy double, log_loss double, brier double, roc_auc double, n long>>,
  finish_type struct<C double, n long, log_loss double, accuracy double>,
  periods array<struct<split string, start_date date, end_date date, n_bouts long>>"""


def run_row(run: TrainingRun, run_no: int, spark: SparkSession, build: str | None = None) -> DataFrame:
    """The report of a run as one nested row; its plain columns are what the quality gate reads."""
    report = run.report
    results = {r["model"]: r for r in report["test_results"]}
    naive = min(r["log_loss"] for m, r in results.items() if m.startswith("baseline_") and m != "baseline_always_50")
    chosen = report["selected_model"]

    def numbers(params: dict) -> dict:
        return {k: float(v) for k, v in params.items()}

    row = {
        **{c: report[c] for c in ("selected_model", "feature_names", "n_bouts", "newest_date", "refit_on_all_data", "refit_end")},
        **report["agreement"],
        "run_no": run_no,
        "build": build,
        "test_log_loss": results[chosen]["log_loss"],
        "best_baseline_log_loss": naive,
        "validation_log_loss": report["validation"][chosen]["validation_log_loss"],
        "search": [{**f, "params": numbers(f["params"])} for f in report["search"]],
        "validation": [{"model": m, **v, "params": numbers(v["params"])} for m, v in report["validation"].items()],
        "test_results": report["test_results"],
        "finish_type": {"C": report["finish_type"]["C"], **report["finish_type"]["test"]},
        "periods": list(report["periods"].values()),
    }
    return spark.createDataFrame([row], RUN_SCHEMA).withColumn("saved_at", F.current_timestamp())


def gate_row(run: TrainingRun, run_no: int, spark: SparkSession) -> DataFrame:
    """The run as one row for the quality gate."""
    return run_row(run, run_no, spark).select("run_no", *monitor.GATE_COLUMNS)


def save_run(run: TrainingRun, store: str, spark: SparkSession) -> DataFrame:
    """Append the report to the store's table of runs, gate it against the run before it, and save its models.

    Returns the gate's row. A run that fails the gate leaves its report, but its models are not made current, so
    forecasts go on with those of the last run that passed; the first run of a store has nothing to fall back on and
    is saved in any case.
    """
    held = runs(spark, store)
    last = held.agg(F.max("run_no")).first()[0] if held is not None else None
    row = run_row(run, (last or 0) + 1, spark)
    judged = monitor.quality_gate(row if held is None else held.unionByName(row)).filter(F.col("run_no") == (last or 0) + 1)
    judged = judged.select("run_no", *monitor.GATE_COLUMNS, "failures")
    verdict = judged.first()
    build = None
    if not verdict["failures"] or model_store.current(spark, store) is None:
        fitted = {f"candidate_{kind}": model for kind, model in run.candidates.items()}
        fitted |= {"evaluated": run.selected, "deployed": run.deployed}
        fitted |= {"evaluated_finish": run.evaluated_finish, "deployed_finish": run.finish}
        build = model_store.save(spark, store, fitted, {"evaluated_split": run.evaluated_split, "round_split": run.round_split})
    monitor.append_run(run_row(run, (last or 0) + 1, spark, build), store)
    return spark.createDataFrame([verdict], judged.schema)


def runs(spark: SparkSession, store: str) -> DataFrame | None:
    """All reports of a store, None before the first."""
    if not path_exists(spark, f"{store}/runs/_SUCCESS"):
        return None
    return spark.read.schema(RUN_SCHEMA).parquet(f"{store}/runs")


@dataclass(frozen=True)
class Forecaster:
    """What a forecast needs of a saved run."""

    win: models.BoutModel
    finish: models.FinishModel
    round_split: DataFrame


def load_forecaster(
    spark: SparkSession, store: str, features: list[str] = MODEL_FEATURES, finish_features: list[str] = FINISH_FEATURES
) -> Forecaster:
    """The deployed models of a store; refused if they were fitted on other inputs than the ones asked for."""
    saved = model_store.current(spark, store)
    if saved is None:
        raise FileNotFoundError(f"no saved training run below {store}")
    return Forecaster(
        saved.bout_model("deployed", features), saved.finish_model("deployed_finish", finish_features), saved.table("round_split")
    )
