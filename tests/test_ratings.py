"""Ratings against the published formulas, written as definitions that call each other."""

import functools
import math

import pytest
from fixtures import appearances_of, calendar_of, pairings
from pyspark.sql import functions as F

from duelgrid.operators import ratings

START, WIDEST, NARROWEST = 1500.0, 350.0, 30.0
POINTS = {"W": 1.0, "D": 0.5, "L": 0.0}


def entered(spark, bouts, **options):
    """What each side brought into each bout, and all states."""
    app = ratings.opponents(appearances_of(spark, bouts))
    states = ratings.rate_periods(app, **options)
    found = app.select("bout_id", "entity_id", "event_date").join(
        ratings.ratings_before(app.select("entity_id", "event_date"), states), ["entity_id", "event_date"]
    )
    return {(r["bout_id"], r["entity_id"]): (r["glicko_rating"], r["glicko_rd"]) for r in found.collect()}, states


class Definition:
    """Rating and deviation of an entity before a date, straight from the formulas of the rating system."""

    def __init__(self, bouts):
        self.met = {}
        for b in bouts:
            for own, other, points in ((b.one, b.two, b.first), (b.two, b.one, b.second)):
                self.met.setdefault(own, {}).setdefault(b.date, []).append((other, POINTS.get(points)))

    def scored_days(self, who, before):
        return [d for d, all_ in sorted(self.met.get(who, {}).items()) if d < before and any(s is not None for _, s in all_)]

    @functools.cache
    def before(self, who, date):
        days = self.scored_days(who, date)
        if not days:
            return START, WIDEST
        rating, rd = self.after(who, days[-1])
        idle = (date - days[-1]).days
        return rating, min(WIDEST, math.sqrt(rd**2 + idle * (WIDEST**2 - NARROWEST**2) / 1825))

    @functools.cache
    def after(self, who, date):
        q = math.log(10) / 400
        rating, rd = self.before(who, date)
        met = [(*self.before(other, date), s) for other, s in self.met[who][date] if s is not None]
        weigh = [1 / math.sqrt(1 + 3 * (q * dev / math.pi) ** 2) for _, dev, _ in met]
        chance = [1 / (1 + 10 ** (g * (r - rating) / 400)) for g, (r, _, _) in zip(weigh, met)]
        d_squared = 1 / (q * q * sum(g * g * e * (1 - e) for g, e in zip(weigh, chance)))
        spread = 1 / rd**2 + 1 / d_squared
        gain = sum(g * (s - e) for g, e, (_, _, s) in zip(weigh, chance, met))
        return rating + q / spread * gain, max(NARROWEST, spread**-0.5)


@pytest.mark.parametrize(("seed", "compact_every", "batch_rows"), [(11, 2, 1), (12, 16, 40), (14, 3, 100_000)])
def test_ratings_follow_the_formulas(spark, seed, compact_every, batch_rows):
    """Every date spread over the cluster, several jobs of a few dates each, and all dates in one job."""
    bouts = calendar_of(seed, bouts=70, dates=9)
    got, _ = entered(spark, bouts, compact_every=compact_every, batch_rows=batch_rows)
    truth = Definition(bouts)
    want = {(b.id, who): truth.before(who, b.date) for b in bouts for who in (b.one, b.two)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_who_beats_the_stronger_gains_more(spark):
    """Three days: kim builds a rating, then two newcomers win, one against kim and one against another newcomer."""
    bouts = pairings("2018-03-03 kim W lee; 2018-04-07 kim W mia; 2018-05-05 ned W kim; 2018-05-05 oda W pat; 2018-06-02 ned D oda")
    got, states = entered(spark, bouts)
    last = bouts[-1].id
    assert got[last, "ned"][0] > got[last, "oda"][0] > START
    assert states.where("entity_id = 'ned'").count() == 2 and got[bouts[2].id, "kim"][0] > START


def test_unscored_bouts_only_let_time_pass(spark):
    bouts = pairings("2017-01-07 uma W vic; 2017-07-08 uma NC vic; 2018-01-06 uma NA wes; 2019-01-05 uma W vic")
    got, states = entered(spark, bouts)
    seen = [got[b.id, "uma"] for b in bouts]
    assert len({round(r, 9) for r, _ in seen[1:]}) == 1 and seen[1][1] < seen[2][1] < seen[3][1]
    assert states.where("entity_id = 'wes'").count() == 0 and got[bouts[2].id, "wes"] == (START, WIDEST)


def test_a_run_can_be_resumed(spark):
    bouts = calendar_of(13, bouts=60, dates=8)
    app = ratings.opponents(appearances_of(spark, bouts))
    cut = sorted({b.date for b in bouts})[4]
    early_rows = app.where(F.col("event_date") < F.lit(cut))
    early, full = ratings.rate_periods(early_rows), ratings.rate_periods(app)
    shown = ["entity_id", "last_day", F.round("rating", 8), F.round("rd", 8)]
    resumed = ratings.rate_periods(app, initial_state=early)
    assert sorted(resumed.select(*shown).collect()) == sorted(full.select(*shown).collect())
    late = ratings.late_bouts(app, early, early_rows.where("bout_id <> 'b0000'"))
    assert {r["bout_id"] for r in late.collect()} <= {"b0000"}


def test_an_empty_state_is_no_state(spark):
    app = ratings.opponents(appearances_of(spark, pairings("2020-02-01 ann W bob")))
    nothing = spark.createDataFrame([], ratings.STATE_SCHEMA)
    assert ratings.rate_periods(app, initial_state=nothing).count() == 2


def test_batches_hold_consecutive_periods_up_to_a_size():
    sizes = [("a", 3), ("b", 3), ("c", 9), ("d", 1), ("e", 5), ("f", 1)]
    assert ratings.batches_of(sizes, 6) == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert ratings.batches_of([], 6) == []


def test_a_lookup_cuts_the_log_down_before_it_aggregates(spark, tmp_path):
    log = ratings.StateLog(spark, str(tmp_path), 2)
    for day in ("2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01"):
        log.add(spark.sql(f"SELECT id AS entity_id, 1500D + month(DATE '{day}') AS rating, 50D AS rd, DATE '{day}' AS last_day FROM VALUES ('x'), ('y') AS t(id)"))
    assert [len(t) for t in log.tiers] == [0, 0, 1]
    found = log.latest(spark.sql("SELECT 'x' AS entity_id"))
    assert [tuple(r)[:2] for r in found.collect()] == [("x", 1504.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")  # the join stands below


@pytest.mark.parametrize("batch_rows", [1, 30])
def test_late_bouts_rerate_from_their_period_on(spark, batch_rows):
    bouts = calendar_of(15, bouts=60, dates=8)
    app = ratings.opponents(appearances_of(spark, bouts)).cache()
    cut = sorted({b.date for b in bouts})[6]
    dates = sorted({b.date for b in bouts})
    late = [b.id for b in bouts if b.date in (dates[3], dates[5])][::2]
    known = app.where(F.col("event_date") < F.lit(cut)).where(~F.col("bout_id").isin(late))
    states = ratings.rate_periods(known, batch_rows=batch_rows)
    again = ratings.rerated(app, states, known.select("bout_id"), batch_rows=batch_rows)
    shown = ["entity_id", "last_day", F.round("rating", 8), F.round("rd", 8)]
    assert sorted(again.select(*shown).collect()) == sorted(ratings.rate_periods(app).select(*shown).collect())
    before = [r["last_day"] for r in states.where(F.col("last_day") < F.lit(dates[3])).select("last_day").distinct().collect()]
    assert before, "some periods are kept as they were"


def test_a_bounded_lookup_moves_only_what_it_asks_for(spark, tmp_path, monkeypatch):
    """The log itself is not shuffled for a batch of a bounded number of rows, however long it gets."""
    log = ratings.StateLog(spark, str(tmp_path), 4)
    log.add(spark.sql("SELECT string(id) AS entity_id, 1500D AS rating, 50D AS rd, DATE '2020-01-01' AS last_day FROM range(50)"))
    asked = spark.range(3).selectExpr("string(id) AS entity_id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = log.latest(asked, few=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    plain, said = ratings.StateLog.latest, []
    monkeypatch.setattr(ratings.StateLog, "latest", lambda self, ids, few=False: said.append(few) or plain(self, ids, few))
    app = ratings.opponents(appearances_of(spark, calendar_of(15, bouts=40, dates=6)))
    ratings.rate_periods(app, batch_rows=1)
    assert said and not any(said)
    said.clear()
    ratings.rate_periods(app, batch_rows=1000)
    assert said == [True]
