"""Missing and odd values that must not change a measure silently."""

import math

import pytest
from pyspark.sql import functions as F

from duelgrid.operators import metrics, monitor, outcomes, roster


def test_a_length_without_split_is_left_out(spark):
    split = spark.createDataFrame([(3, 1, 0.5), (3, 2, 0.25), (3, 3, 0.25)], "scheduled_rounds int, round int, share double")
    naive = spark.createDataFrame([(3, k, 0.25) for k in (1, 2, 3, 4)], "scheduled_rounds int, outcome int, share double")
    rows = spark.createDataFrame([(3, 1, 0.0), (4, 1, 0.0), (3, None, 0.0)], "scheduled_rounds int, outcome int, p_decision double")
    got = metrics.round_metrics(rows, split, naive).first()
    assert (got["n"], got["model_log_loss"]) == (1, pytest.approx(math.log(2)))


def test_missing_probabilities_raise_and_impossible_cells_cost_infinity(spark):
    cells = "label int, p_a double, p_method double, p_rate double"
    got = metrics.joint_metrics(spark.createDataFrame([(1, 0.5, 0.5, 0.5), (1, 0.5, 0.0, 0.5)], cells)).first()
    assert got["n"] == 2 and got["model_log_loss"] == math.inf and got["rates_log_loss"] == pytest.approx(math.log(4))
    with pytest.raises(Exception, match="probability is missing"):
        metrics.joint_metrics(spark.createDataFrame([(1, None, 0.5, 0.5)], cells)).collect()
    with pytest.raises(Exception, match="probability is missing"):
        metrics.multiclass_metrics(spark.createDataFrame([("SUB", [0.2, None, 0.3])], "method string, probabilities array<double>")).collect()


def test_round_of_an_early_finish(spark):
    rows = [("SUB", None, 3), ("SUB", 0, 3), ("SUB", 9, 3), ("DEC", None, 5)]
    df = spark.createDataFrame(rows, "m string, e int, s int").select(outcomes.round_outcome(F.col("m"), F.col("e"), F.col("s")))
    assert [r[0] for r in df.collect()] == [None, 1, 3, 6]


def test_the_gate_fails_on_missing_figures(spark):
    schema = (
        "run_no int, test_log_loss double, best_baseline_log_loss double, validation_log_loss double, n_bouts long, refit_end date, newest_date date, "
        "mean_abs_diff double, same_favourite_rate double"
    )
    got = monitor.quality_gate(spark.createDataFrame([(1, *[None] * 8)], schema)).first()["failures"]
    assert set(got) >= {"does not beat the best baseline", "validation log loss too high", "too few bouts", "refit ends before the data", "refit is unchecked"}
    assert "dataset shrank" not in got and "test log loss rose" not in got


def test_entities_without_a_name_keep_a_label(spark):
    rows = [("a", None), ("b", "Bo"), ("c", "Bo"), ("d", None), ("e", "Di")]
    df = spark.createDataFrame(rows, "entity_id string, name string").withColumns(
        {"last_weight_class": F.lit("Flyweight"), "last_date": F.lit("2020-01-01").cast("date")}
    )
    labels = {r["entity_id"]: r["display_name"] for r in roster.with_display_names(df).collect()}
    assert labels["a"] == "a" and labels["d"] == "d" and labels["e"] == "Di" and len(set(labels.values())) == 5


@pytest.mark.parametrize("sizes", [{"X": 3, "Y": 1}, {"X": 4}, {"X": 1, "Y": 1, "Z": 1}, {"X": 1, "Y": 1, "Z": 1, "W": 2}, {"X": 1}, {"X": 501, "Y": 2}, {}])
def test_everybody_gets_an_opponent(spark, sizes):
    rows = [(f"{d}{i}", d) for d, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, division string")
    pairs = [(r["pool"], r["a_id"], r["b_id"]) for r in roster.random_matchups(df, 5).collect()]
    met = {x for _, a, b in pairs for x in (a, b)}
    assert all(a != b for _, a, b in pairs) and len(pairs) <= len(rows)
    if len(rows) > 1 and list(sizes.values()) != [1, 1, 1]:
        assert met == {e for e, _ in rows}
    assert all(pool == "rest" or (a[0] == b[0] == pool) for pool, a, b in pairs)
