"""Rates, joint outcomes, evaluation measures, gates: on probabilities given by the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.constants import FINISH_TYPES, GATE
from duelgrid.functions import numeric as N
from duelgrid.operators import matchup, metrics, models, monitor, outcomes
from duelgrid.plans import adapter, derived
from duelgrid.plans import sqlbase as S
from duelgrid.plans.registry import query, rounded

P = adapter.PERIODS


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression} + 1e-9, {digits})"


# ---------------------------------------------------------------------- rates and round splits
_WON = "winner_side IS NOT NULL AND method IN ('KO/TKO', 'SUB', 'DEC')"
_TRAIN = f"{_WON} AND event_date >= DATE '{P.finish_min_train}' AND event_date < DATE '{P.validation}'"
_SHARES = ", ".join(
    r(f"coalesce(count(*) FILTER (method = '{m}') / nullif(count(*), 0), 0)") + f" AS {n}" for m, n in zip(FINISH_TYPES, ("ko", "sub", "dec"))
)


def _train_bouts(spark, sf):
    return outcomes.finished(derived.bouts(spark, sf), P.finish_min_train, P.validation, FINISH_TYPES)


def _test_bouts(spark, sf):
    return outcomes.finished(derived.bouts(spark, sf), P.validation, None, FINISH_TYPES)


def _wide(df, *keys):
    return rounded(df.select(*keys, *[F.col("rates")[i].alias(n) for i, n in enumerate(("ko", "sub", "dec"))]))


@query(f"WITH {S.BOUTS} SELECT {_SHARES} FROM bouts WHERE {_TRAIN}")
def finish_rates(spark, sf):
    return _wide(outcomes.finish_rates(_train_bouts(spark, sf)))


@query(f"WITH {S.BOUTS} SELECT weight_class, is_female, {_SHARES} FROM bouts WHERE {_TRAIN} GROUP BY weight_class, is_female")
def class_rates(spark, sf):
    return _wide(outcomes.finish_rates(_train_bouts(spark, sf), ["weight_class", "is_female"]), "weight_class", "is_female")


_RAW_SHARES = ", ".join(f"count(*) FILTER (method = '{m}') / count(*) AS r{i}" for i, m in enumerate(FINISH_TYPES))
_FALLBACK = f"""{S.BOUTS}, train AS (SELECT * FROM bouts WHERE {_TRAIN} AND weight_class <> 'Heavyweight'),
overall AS (SELECT {_RAW_SHARES} FROM train), groups AS (SELECT weight_class, is_female, {_RAW_SHARES} FROM train GROUP BY ALL),
test AS (SELECT * FROM bouts WHERE {_WON} AND event_date >= DATE '{P.validation}'),
raw_rates AS (SELECT t.bout_id, t.method, {', '.join(f'greatest(coalesce(g.r{i}, o.r{i}), 1e-3) AS f{i}' for i in range(3))}
  FROM test t LEFT JOIN groups g USING (weight_class, is_female) CROSS JOIN overall o),
class_p AS (SELECT bout_id, method, {', '.join(f'f{i} / (f0 + f1 + f2) AS p{i}' for i in range(3))} FROM raw_rates)"""


def _fallback(spark, sf):
    """The training period has no heavyweights, so theirs are the overall rates."""
    train = _train_bouts(spark, sf).filter("weight_class <> 'Heavyweight'")
    return train, outcomes.class_rates_fallback(_test_bouts(spark, sf), train, ["weight_class", "is_female"])


@query(f"WITH {_FALLBACK} SELECT bout_id, {r('p0')} AS ko, {r('p1')} AS sub, {r('p2')} AS dec FROM class_p")
def class_rates_fallback(spark, sf):
    return _wide(_fallback(spark, sf)[1], "bout_id")


_CLASS_LOSS = "CASE method WHEN 'KO/TKO' THEN {p}0 WHEN 'SUB' THEN {p}1 ELSE {p}2 END"
_CLASS_BEST = "CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 THEN 'KO/TKO' WHEN {p}1 >= {p}2 THEN 'SUB' ELSE 'DEC' END"


def _report_sql(name: str, p: str, source: str) -> str:
    return f"""SELECT '{name}' AS model, count(*) AS n, {r(f"avg(-ln(greatest({_CLASS_LOSS.format(p=p)}, 1e-12)))")} AS log_loss,
  {r(f"avg(CAST({_CLASS_BEST.format(p=p)} = method AS DOUBLE))")} AS accuracy FROM {source}"""


@query(f"WITH {_FALLBACK} {_report_sql('overall rates', 'r', 'test CROSS JOIN overall')} UNION ALL {_report_sql('class rates', 'p', 'class_p')}")
def finish_type_baselines(spark, sf):
    """Both naive finish-type predictions of the later bouts."""
    train, by_class = _fallback(spark, sf)
    overall = _test_bouts(spark, sf).withColumn("rates", outcomes.finish_rates(train).select("rates").scalar())
    rows = [
        metrics.multiclass_metrics(df, "method", "rates").select(F.lit(name).alias("model"), "n", "log_loss", "accuracy")
        for name, df in (("overall rates", overall), ("class rates", by_class))
    ]
    return rounded(rows[0].unionByName(rows[1]))


def _smoothed_sql(where: str, slot: str, extra: int) -> str:
    return f"""slots AS (SELECT k AS scheduled_rounds, unnest(range(1, k + {extra} + 1)) AS slot FROM (SELECT unnest([3, 5]) AS k)),
counted AS (SELECT scheduled_rounds, {slot} AS slot, count(*) AS n FROM bouts WHERE {where} GROUP BY 1, 2),
filled AS (SELECT scheduled_rounds, slot, coalesce(n, 0) + 1 AS n FROM slots LEFT JOIN counted USING (scheduled_rounds, slot)),
shares AS (SELECT scheduled_rounds, slot, n / sum(n) OVER (PARTITION BY scheduled_rounds) AS share FROM filled)"""


_EARLY = _smoothed_sql(_TRAIN.replace(", 'DEC')", ")"), "greatest(least(end_round, scheduled_rounds), 1)", 0)
_OUTCOME = "CASE WHEN method = 'DEC' THEN scheduled_rounds + 1 ELSE least(end_round, scheduled_rounds) END"
_NAIVE = _smoothed_sql(_TRAIN, _OUTCOME, 1)


@query(f"WITH {S.BOUTS}, {_EARLY} SELECT scheduled_rounds, slot AS round, {r('share')} AS share FROM shares")
def round_split(spark, sf):
    return rounded(outcomes.round_split(derived.bouts(spark, sf), P.finish_min_train, P.validation))


@query(f"WITH {S.BOUTS}, {_NAIVE} SELECT scheduled_rounds, slot AS outcome, {r('share')} AS share FROM shares")
def round_outcome_rates(spark, sf):
    return rounded(outcomes.round_outcome_rates(derived.bouts(spark, sf), P.finish_min_train, P.validation))


_SPLIT = f"""CASE WHEN event_date < DATE '{P.min_train}' THEN 'history' WHEN event_date < DATE '{P.validation}' THEN 'train'
  WHEN event_date < DATE '{P.test}' THEN 'validation' ELSE 'test' END"""


@query(f"WITH {S.BOUTS} SELECT {_SPLIT} AS split, min(event_date) AS start_date, max(event_date) AS end_date, count(*) AS n_bouts FROM bouts WHERE winner_side IS NOT NULL GROUP BY 1")
def split_ranges(spark, sf):
    return metrics.date_ranges(models.with_split(matchup.oriented(derived.bouts(spark, sf)), P))


# ------------------------------------------------------------------------------ joint outcome
_K = "CAST(bout_id AS BIGINT)"
_GIVEN = f"""given AS (SELECT *, ({_K} % 997 + 0.5) / 997 AS p_a,
  {', '.join(f'CAST({_K} % {m} + 1 AS DOUBLE) / ({_K} % 3 + {_K} % 5 + {_K} % 7 + 3) AS ga{i}' for i, m in enumerate((3, 5, 7)))},
  {', '.join(f'CAST({_K} % {m} + 1 AS DOUBLE) / ({_K} % 11 + {_K} % 4 + {_K} % 9 + 3) AS gb{i}' for i, m in enumerate((11, 4, 9)))} FROM bouts),
joint AS (SELECT *, {', '.join(f'ga{i} * CAST(p_a AS DOUBLE) AS a{i}, gb{i} * (1 - CAST(p_a AS DOUBLE)) AS b{i}' for i in range(3))} FROM given)"""


def _given(bouts):
    """Bouts with a win probability and conditional finish types given by their id."""
    k = F.col("bout_id").cast("long")

    def simplex(mods):
        total = sum((k % m for m in mods), F.lit(len(mods))).cast("double")
        return F.array(*[(k % m + 1).cast("double") / total for m in mods])

    return bouts.select(
        "*", ((k % 997 + F.lit(0.5)) / F.lit(997.0)).alias("p_a"), simplex((3, 5, 7)).alias("given_a"), simplex((11, 4, 9)).alias("given_b")
    )


def _joint(spark, sf):
    given = _given(derived.bouts(spark, sf))
    return given.withColumn("joint", outcomes.six_way(F.col("p_a"), F.col("given_a"), F.col("given_b")))


_SIX = ", ".join(f"{r(f'{s}{i}')} AS {s}_{n}" for s in "ab" for i, n in enumerate(("ko", "sub", "dec")))
_ALL = ", ".join(f"{r(f'a{i} + b{i}')} AS all_{n}" for i, n in enumerate(("ko", "sub", "dec")))


@query(f"WITH {S.BOUTS}, {_GIVEN} SELECT bout_id, {_SIX}, {_ALL} FROM joint")
def six_way_outcome(spark, sf):
    cells = [
        F.col(f"joint.{field}")[i].alias(f"{label}_{n}")
        for field, label in (("a", "a"), ("b", "b"), ("overall", "all"))
        for i, n in enumerate(("ko", "sub", "dec"))
    ]
    return rounded(_joint(spark, sf).select("bout_id", *cells))


_CELLS = [("A", "a0", "KO/TKO"), ("A", "a1", "SUB"), ("A", "a2", "DEC"), ("B", "b0", "KO/TKO"), ("B", "b1", "SUB"), ("B", "b2", "DEC")]
_BEST = "greatest(a0, a1, a2, b0, b1, b2)"


@query(f"""WITH {S.BOUTS}, {_GIVEN} SELECT bout_id, CASE {' '.join(f"WHEN {c} = {_BEST} THEN '{w}'" for w, c, _ in _CELLS)} END AS winner,
  CASE {' '.join(f"WHEN {c} = {_BEST} THEN '{m}'" for _, c, m in _CELLS)} END AS method, {r(_BEST)} AS prob FROM joint""")
def most_likely_outcome(spark, sf):
    best = outcomes.most_likely(F.col("joint"))
    return rounded(_joint(spark, sf).select("bout_id", best.alias("m")).select("bout_id", "m.winner", "m.method", "m.prob"))


@query(f"""WITH {S.BOUTS}, {_GIVEN}, {_EARLY} SELECT bout_id, {r('a2 + b2')} AS distance, slot AS round, {r('(1 - (a2 + b2)) * share')} AS probability
FROM joint JOIN shares USING (scheduled_rounds)""")
def round_odds(spark, sf):
    """P(distance) and P(ends in round r), one row per bout and round."""
    rows = _joint(spark, sf).select("bout_id", "scheduled_rounds", F.col("joint.overall")[2].alias("p_decision"))
    split = outcomes.round_split(derived.bouts(spark, sf), P.finish_min_train, P.validation)
    odds = outcomes.round_odds(rows, split)
    long = odds.select("bout_id", "distance", F.posexplode("by_round").alias("pos", "probability"))
    return rounded(long.select("bout_id", "distance", (F.col("pos") + 1).alias("round"), "probability"))


_TESTED = f"{_WON} AND event_date >= DATE '{P.validation}'"
_PICK = "CASE method WHEN 'KO/TKO' THEN {0}0 WHEN 'SUB' THEN {0}1 ELSE {0}2 END"


@query(f"""WITH {S.BOUTS}, {_GIVEN}, rates AS (SELECT {_RAW_SHARES} FROM bouts WHERE {_TRAIN}),
v AS (SELECT CASE winner_side WHEN 1 THEN p_a ELSE 1 - p_a END AS p_w, CASE winner_side WHEN 1 THEN {_PICK.format('ga')} ELSE {_PICK.format('gb')} END AS p_m,
  {_PICK.format('r')} AS p_r FROM joint CROSS JOIN rates WHERE {_TESTED})
SELECT count(*) AS n, {r('avg(-ln(p_w * p_m))')} AS model_log_loss, {r('ln(6)')} AS uniform_log_loss, {r('avg(-ln(p_w * p_r))')} AS rates_log_loss FROM v""")
def joint_metrics(spark, sf):
    place = F.array_position(F.array(*[F.lit(m) for m in FINISH_TYPES]), F.col("method")).cast("int")
    rates = outcomes.finish_rates(_train_bouts(spark, sf)).select("rates").scalar()
    first = F.col("winner_side") == 1
    rows = _given(_test_bouts(spark, sf)).withColumn("rates", rates).select(
        first.cast("int").alias("label"), "p_a",
        F.element_at(F.when(first, F.col("given_a")).otherwise(F.col("given_b")), place).alias("p_method"),
        F.element_at("rates", place).alias("p_rate"),
    )
    return rounded(metrics.joint_metrics(rows))


@query(f"""WITH {S.BOUTS}, {_GIVEN}, {_EARLY}, {_NAIVE.replace('slots AS', 'slots2 AS').replace('counted AS', 'counted2 AS').replace('filled AS', 'filled2 AS').replace('shares AS', 'naive AS').replace('FROM slots LEFT JOIN counted ', 'FROM slots2 LEFT JOIN counted2 ').replace('FROM filled)', 'FROM filled2)')},
v AS (SELECT CASE WHEN method = 'DEC' THEN a2 + b2 ELSE (1 - (a2 + b2)) * s.share END AS p, n.share AS q FROM joint j
  LEFT JOIN shares s ON s.scheduled_rounds = j.scheduled_rounds AND s.slot = {_OUTCOME.replace('scheduled_rounds', 'j.scheduled_rounds')}
  LEFT JOIN naive n ON n.scheduled_rounds = j.scheduled_rounds AND n.slot = {_OUTCOME.replace('scheduled_rounds', 'j.scheduled_rounds')} WHERE {_TESTED})
SELECT count(*) AS n, {r('avg(-ln(greatest(p, 1e-12)))')} AS model_log_loss, {r('avg(-ln(q))')} AS naive_log_loss FROM v""")
def round_metrics(spark, sf):
    all_bouts = derived.bouts(spark, sf)
    given = _given(_test_bouts(spark, sf))
    joint = given.withColumn("joint", outcomes.six_way(F.col("p_a"), F.col("given_a"), F.col("given_b")))
    rows = joint.select(
        F.col("scheduled_rounds").cast("int").alias("scheduled_rounds"),
        outcomes.round_outcome(F.col("method"), F.col("end_round"), F.col("scheduled_rounds")).alias("outcome"),
        F.col("joint.overall")[2].alias("p_decision"),
    )
    split = outcomes.round_split(all_bouts, P.finish_min_train, P.validation)
    naive = outcomes.round_outcome_rates(all_bouts, P.finish_min_train, P.validation)
    return rounded(metrics.round_metrics(rows, split, naive))


# --------------------------------------------------------------------------------- evaluation
_LINES = "lines AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y, (l_partkey % 997 + 0.5::DOUBLE) / 997 AS p, (l_suppkey % 89 + 0.5::DOUBLE) / 89 AS p2 FROM lineitem)"


def _scored(spark, sf):
    """Lines with a label and two probabilities given by their keys."""
    return adapter.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag",
        "int(l_returnflag = 'R') AS y", "(l_partkey % 997 + 0.5D) / 997D AS p", "(l_suppkey % 89 + 0.5D) / 89D AS p2",
    )


_AUC = "(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))"
_RANKED = "ranked AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM lines)"
_LOSS = "-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END"


@query(f"""WITH {_LINES}, {_RANKED} SELECT count(*) AS n, {r('avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE))')} AS accuracy, {r(f'avg({_LOSS})')} AS log_loss,
  {r('avg((p - y) * (p - y))')} AS brier, {r(_AUC)} AS roc_auc FROM ranked""")
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(_scored(spark, sf)))


@query(f"WITH {_LINES}, {_RANKED} SELECT {r(_AUC)} AS roc_auc FROM ranked")
def auc_exact(spark, sf):
    return rounded(metrics.roc_auc(_scored(spark, sf)))


@query(f"""WITH {_LINES}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lines),
b AS (SELECT len([x FOR x IN edges IF x < p]) AS bin, p, y FROM lines CROSS JOIN e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r('avg(p)')} AS mean_predicted, {r('avg(CAST(y AS DOUBLE))')} AS fraction_positive FROM b GROUP BY bin""")
def calibration_curve(spark, sf):
    return rounded(metrics.calibration_curve(_scored(spark, sf)))


@query(f"""WITH {_LINES} SELECT a AS actual, count(*) FILTER (y = a AND p < 0.5) AS predicted_0, count(*) FILTER (y = a AND p >= 0.5) AS predicted_1
FROM lines CROSS JOIN (SELECT unnest([0, 1]) AS a) GROUP BY a""")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_scored(spark, sf))


@query(f"""WITH {_LINES} SELECT b AS bin, count(p) AS n FROM (SELECT unnest(range(1, 21)) AS b) LEFT JOIN lines
  ON least(CAST(floor(p * 20) AS INTEGER) + 1, 20) = b GROUP BY b""")
def probability_histogram(spark, sf):
    return metrics.probability_histogram(_scored(spark, sf))


@query(f"""WITH {_LINES}, m AS (SELECT 'by part' AS model, y, p FROM lines UNION ALL SELECT 'by supplier', y, p2 FROM lines UNION ALL SELECT 'half', y, 0.5 FROM lines),
k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS rk FROM m)
SELECT model, count(*) AS n, {r('avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE))', 4)} AS accuracy, {r(f'avg({_LOSS})', 4)} AS log_loss,
  {r('avg((p - y) * (p - y))', 4)} AS brier, {r(_AUC, 4)} AS roc_auc FROM k GROUP BY model""")
def model_comparison(spark, sf):
    rows = _scored(spark, sf).selectExpr(
        "y", "inline(array(struct('by part' AS model, p), struct('by supplier' AS model, p2 AS p), struct('half' AS model, 0.5D AS p)))"
    )
    return rounded(metrics.grouped_metrics(rows))


@query(f"""WITH c AS (SELECT CASE l_returnflag WHEN 'R' THEN 'KO/TKO' WHEN 'A' THEN 'SUB' ELSE 'DEC' END AS method,
  {', '.join(f'CAST(l_partkey % {m} + 1 AS DOUBLE) / (l_partkey % 3 + l_partkey % 5 + l_partkey % 7 + 3) AS p{i}' for i, m in enumerate((3, 5, 7)))} FROM lineitem)
SELECT count(*) AS n, {r(f"avg(-ln({_CLASS_LOSS.format(p='p')}))")} AS log_loss, {r(f"avg(CAST({_CLASS_BEST.format(p='p')} = method AS DOUBLE))")} AS accuracy FROM c""")
def multiclass_metrics(spark, sf):
    k = F.col("l_partkey")
    total = (k % 3 + k % 5 + k % 7 + 3).cast("double")
    flag = F.col("l_returnflag")
    rows = _scored(spark, sf).select(
        F.when(flag == "R", "KO/TKO").when(flag == "A", "SUB").otherwise("DEC").alias("method"),
        F.array(*[(k % m + 1).cast("double") / total for m in (3, 5, 7)]).alias("probabilities"),
    )
    return rounded(metrics.multiclass_metrics(rows))


@query(f"WITH {_LINES} SELECT {r('avg(abs(p - (1 - p2)))')} AS mean_abs_reversal_gap FROM lines")
def reversal_gap(spark, sf):
    return rounded(metrics.reversal_gap(_scored(spark, sf), "p", "p2"))


@query(f"WITH {_LINES} SELECT {r('avg(abs(p - p2))')} AS mean_abs_diff, {r('avg(CAST((p >= 0.5) = (p2 >= 0.5) AS DOUBLE))')} AS same_favourite_rate FROM lines")
def refit_agreement(spark, sf):
    return rounded(metrics.refit_agreement(_scored(spark, sf), "p", "p2"))


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, l_partkey, {r('0.5 * (p + 1 - p2)')} AS p_a FROM lines")
def symmetric_rule(spark, sf):
    p_a = N.symmetric_probability(F.col("p"), F.col("p2"))
    return rounded(_scored(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", p_a.alias("p_a")))


# --------------------------------------------------------------------------------- monitoring
_MONTH = "CAST(strftime(l_shipdate, '%Y%m') AS INTEGER)"
_RUNS = f"""runs AS (SELECT {_MONTH} AS run_no, {r('avg(l_tax) * 16')} AS test_log_loss, {r('avg(l_discount) * 13')} AS best_baseline_log_loss,
  {r('avg(l_quantity) / 38')} AS validation_log_loss, count(*) * 10 AS n_bouts, CAST(max(l_shipdate) FILTER (l_linestatus = 'F') AS DATE) AS refit_end,
  CAST(max(l_shipdate) AS DATE) AS newest_date, {r('avg(l_discount)')} AS mean_abs_diff, {r('avg(CAST(l_tax < 0.08 AS DOUBLE))')} AS same_favourite_rate
  FROM lineitem GROUP BY 1)"""


def _runs(spark, sf):
    """One report row per shipping month."""
    return rounded(
        adapter.table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").cast("int").alias("run_no")).agg(
            (F.avg("l_tax") * 16).alias("test_log_loss"),
            (F.avg("l_discount") * 13).alias("best_baseline_log_loss"),
            (F.avg("l_quantity") / 38).alias("validation_log_loss"),
            (F.count(F.lit(1)) * 10).alias("n_bouts"),
            F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).cast("date").alias("refit_end"),
            F.max("l_shipdate").cast("date").alias("newest_date"),
            F.avg("l_discount").alias("mean_abs_diff"),
            F.avg((F.col("l_tax") < 0.08).cast("double")).alias("same_favourite_rate"),
        )
    )


_RULES = [
    ("does not beat the best baseline", f"test_log_loss > best_baseline_log_loss - {GATE.baseline_margin}"),
    ("validation log loss too high", f"validation_log_loss > {GATE.max_validation_log_loss}"),
    ("too few bouts", f"n_bouts < {GATE.min_bouts}"),
    ("refit ends before the data", "refit_end IS DISTINCT FROM newest_date"),
    ("refit differs from the evaluated model", f"mean_abs_diff > {GATE.max_refit_mean_abs_diff}"),
    ("refit picks other favourites", f"same_favourite_rate < {GATE.min_refit_same_favourite}"),
    ("dataset shrank", "n_bouts < prev_n"),
    ("test log loss rose", f"test_log_loss > prev_loss + {GATE.max_test_log_loss_increase}"),
]


@query(f"""WITH {_RUNS}, l AS (SELECT *, lag(n_bouts) OVER (ORDER BY run_no) AS prev_n, lag(test_log_loss) OVER (ORDER BY run_no) AS prev_loss FROM runs)
SELECT run_no, array_to_string([f FOR f IN [{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES)}] IF f IS NOT NULL], '; ') AS failures FROM l""")
def quality_gate(spark, sf):
    return monitor.quality_gate(_runs(spark, sf)).select("run_no", F.array_join("failures", "; ").alias("failures"))


@query(f"""WITH {_RUNS} SELECT run_no, CAST(DATE '2001-06-01' - newest_date AS INTEGER) AS age_days,
  CASE WHEN DATE '2001-06-01' - newest_date >= 365 THEN 'retrain' WHEN DATE '2001-06-01' - newest_date >= 180 THEN 'recalibrate' ELSE 'ok' END AS status FROM runs""")
def staleness(spark, sf):
    return monitor.staleness(_runs(spark, sf), F.lit("2001-06-01").cast("date"), "newest_date").select("run_no", "age_days", "status")


@query(f"""WITH v AS (SELECT {_MONTH} AS run_no, CASE l_returnflag WHEN 'A' THEN 'logistic_regression' WHEN 'N' THEN 'random_forest' ELSE 'boosted_trees' END AS model,
  {r('avg(l_tax)')} AS loss FROM lineitem GROUP BY 1, 2),
b AS (SELECT run_no, min(loss) AS best_log_loss, arg_min(model, (loss, model)) AS best, min(loss) FILTER (model = 'logistic_regression') AS simple FROM v GROUP BY run_no)
SELECT run_no, CASE WHEN simple - best_log_loss < 0.002 THEN 'logistic_regression' ELSE best END AS selected, best_log_loss FROM b""")
def select_model(spark, sf):
    """Model selection per shipping month, on losses that the data gives."""
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "logistic_regression").when(flag == "N", "random_forest").otherwise("boosted_trees")
    report = adapter.table(spark, sf, "lineitem").groupBy(
        F.date_format("l_shipdate", "yyyyMM").cast("int").alias("run_no"), name.alias("model")
    ).agg(F.avg("l_tax").alias("validation_log_loss"))
    return monitor.select_model(rounded(report), "run_no")
