import datetime
import random

import pytest
from fixtures import appearances_of, calendar_of, day, people_of
from pyspark.sql import functions as F

from duelgrid.constants import RAW_ENTITIES, RAW_EVENTS, RAW_RESULTS, RAW_STATS
from duelgrid.operators import canonical, history, resolve
from duelgrid.plans import pipeline
from duelgrid.session import run_dir, written
from duelgrid.sources import raw, tables

PAIR = "10 of 20"


def frames(spark):
    def df(columns, rows):
        return raw.clean_cells(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)))

    def result(event, bout, outcome, url, method="KO/TKO"):
        return (event, bout, outcome, "Lightweight Bout", method, "3", "5:00", "3 Rnd (5-5-5)", "--", "---", f"http://b/{url}")

    def stat(event, bout, rnd, name, ctrl="1:00"):
        return (event, bout, rnd, name, "1", PAIR, "---", PAIR, PAIR, "---", "0", "0", ctrl, *[PAIR] * 6)

    events = df(RAW_EVENTS, [("One", "http://e/1", "March 5, 2020", "X"), ("Two", "http://e/2", "April 05, 2020", "Y")])
    results = df(RAW_RESULTS, [
        result("One", "Ann A vs. Bea B", "W/L", "b1"), result("Renamed", "Ann A vs. Bea B", "W/L", "b1"),
        result("Two", "Ann A vs. Cid C", "D/D", "b2"), result("Lost", "Ann A vs. Cid C", "L/W", "b3"),
        result("Two", "Bea B vs. New N", "NC/NC", "b4"), result("Two", "Twin T vs. Cid C", "L/W", "b5"),
        result("Two", "Cid C vs. Bea B", "W/L", "b6"), result("Two", "Cid C vs. Bea B", "W/L", "b7"),
    ])
    stats = df(RAW_STATS, [
        stat("One", "Ann A vs. Bea B", "Round 1", "Ann A"), stat("One", "Ann A vs. Bea B", "Round 2", "Ann A", "--"),
        stat("One", "Ann A vs. Bea B", "Round 1", "Bea B"), stat("Two", "Cid C vs. Bea B", "Round 1", "Cid C"),
        stat("Two", "Ann A vs. Cid C", "", ""),
    ])
    entities = df(RAW_ENTITIES, [
        ("Ann A", "5' 11\"", "155 lbs.", '72"', "Southpaw", "Jan 01, 1990", "http://f/a"),
        ("Bea B", "--", "155 lbs.", "--", "", "--", "http://f/b"), ("Cid C", "6' 0\"", "155 lbs.", "--", "Switch", "bad", "http://f/c"),
        ("Twin T", "--", "170 lbs.", "--", "", "Jan 01, 1990", "http://f/t1"), ("Twin T", "--", "155 lbs.", "--", "", "Jan 01, 1990", "http://f/t2"),
    ])
    return events, results, stats, entities


def test_ingest(spark):
    data = pipeline.ingest(*frames(spark))
    bouts = {r["bout_id"]: r for r in data.bouts.collect()}
    assert sorted(bouts) == ["b1", "b2", "b4", "b5", "b6", "b7"]
    assert (bouts["b1"]["event"], bouts["b1"]["event_date"], bouts["b1"]["winner_side"]) == ("One", day("2020-03-05"), 1)
    assert (bouts["b1"]["duration_s"], bouts["b1"]["weight_lbs"], bouts["b1"]["scheduled_rounds"]) == (900, 155, 3)
    assert bouts["b4"]["entity_2_id"] == "unk_newn" and bouts["b5"]["entity_1_id"] == "t2"
    app = {(r["bout_id"], r["side"]): r for r in data.appearances.collect()}
    assert len(app) == 12
    assert app["b1", 1]["sig_landed"] == 20 and app["b1", 1]["ctrl_s"] is None and app["b1", 2]["ctrl_s"] == 60
    assert app["b1", 2]["opp_sig_att"] == 40 and app["b1", 1]["has_stats"] and not app["b2", 1]["has_stats"]
    assert app["b6", 1]["sig_att"] is None  # two bouts share event and names: no statistics
    assert [app["b2", 1]["result"], app["b4", 2]["result"], app["b5", 1]["result"]] == ["D", "NC", "L"]
    known = {r["entity_id"]: r for r in data.entities.collect()}
    assert known["unk_newn"]["synthetic"] and not known["a"]["synthetic"] and known["c"]["dob"] is None


def test_strict_dates_and_double_events(spark):
    events, results, *_ = frames(spark)
    with pytest.raises(Exception):
        raw.project_events(events.withColumn("DATE", F.lit("5th of May"))).collect()
    twice = raw.project_events(events).unionByName(raw.project_events(events).withColumn("event_date", F.date_add("event_date", 1)))
    with pytest.raises(Exception, match="two dates"):
        canonical.with_event_date(raw.project_results(results), twice).collect()


def test_rules_raise(spark):
    bad = spark.createDataFrame([("a rule", 3)], "rule string, n_violations long")
    with pytest.raises(ValueError, match="a rule"):
        canonical.require_none(bad)
    canonical.require_none(bad.filter("n_violations > 9"))


def test_tables(spark):
    root = run_dir(spark, "test")
    built = []

    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)

    assert [tables.refresh_if_stale(spark, root, v, build)["rebuilt"] for v in ("1", "1", "2", "2")] == [True, False, True, False]
    assert len(built) == 2
    with pytest.raises(ValueError, match="missing columns"):
        tables.replace_checked(spark.range(1), ["id", "KD"], "x")
    path = run_dir(spark, "csv")
    spark.createDataFrame([('say "hi", x', "--"), ("  y ", "n/a")], "A string, B string").write.option("header", True).option("escape", '"').csv(path)
    assert sorted((r["A"], r["B"]) for r in raw.read_csv(spark, path, ["A", "B"]).collect()) == [('say "hi", x', None), ("y", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_a_plain_loop(spark, seed):
    """A name shared by very many entities and mentions, against the definition."""
    rng = random.Random(seed)
    pool = ["hot"] * 6 + ["ann", "bea", "cid"]
    people = [
        (f"p{i:03d}", rng.choice(pool), rng.choice([None, 115.0, 125.0, 135.0, 155.0]),
         rng.choice([None, day("1960-01-01") + datetime.timedelta(days=rng.randrange(16000))]))
        for i in range(90)
    ] + [("solo", "solo", 155.0, None)]
    asked = [
        (f"b{i}", rng.choice([*pool, "solo", "nobody"]), day("1998-01-01") + datetime.timedelta(days=rng.randrange(8000)),
         rng.choice([None, 120.0, 125.0, 140.0, 170.0]))
        for i in range(500)
    ]
    entities = spark.createDataFrame([(i, n, w, d, n) for i, n, w, d in people], "entity_id string, name string, listed_weight_lbs double, dob date, name_norm string")
    mentions = spark.createDataFrame(asked, "bout_id string, name string, event_date date, weight_lbs double")
    got = {r["bout_id"]: (r["entity_id"], r["status"]) for r in resolve.resolve_names(mentions, entities, {}).collect()}
    for bout, name, date, weight in asked:
        same = [p for p in people if p[1] == name]
        if not same:
            want = (f"unk_{name}", "unmatched_synthetic")
        elif len(same) == 1:
            want = (same[0][0], "exact_unique")
        else:
            left = [p for p in same if p[3] is None or 18 <= (date - p[3]).days / 365.25 <= 45]
            if weight is not None and any(p[2] is not None for p in left):
                best = min(abs(p[2] - weight) for p in left if p[2] is not None)
                left = [p for p in left if p[2] is not None and abs(p[2] - weight) == best]
            want = (left[0][0], "disambiguated") if len(left) == 1 else (f"amb_{name}_{bout}", "ambiguous_bout_scoped")
        assert got[bout] == want


def test_rows_that_break_a_rule_end_the_step(spark):
    """Counted while the table is written; a condition that is NULL counts as broken."""
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "k int, v double")
    with pytest.raises(ValueError, match="negative: 2 rows"):
        written(rows, run_dir(spark, "rules"), {"no key": F.col("k").isNull(), "negative": F.col("v") < 0})
    kept = written(rows.filter("v > 0"), run_dir(spark, "rules"), {"no key": F.col("k").isNull(), "negative": F.col("v") < 0})
    assert kept.collect() == [(1, 2.0)] and written(rows.limit(0), run_dir(spark, "rules"), {"any": F.lit(True)}).isEmpty()


def test_profiles_without_a_rating_are_marked(spark):
    app = appearances_of(spark, calendar_of(3, bouts=20, people=4))
    people, asked = people_of(spark, [f"p{i}" for i in range(4)]), app.select("entity_id", "event_date").distinct()
    rated = asked.filter("entity_id <> 'p1'").selectExpr("*", "1600D AS glicko_rating", "90D AS glicko_rd")
    marked = history.day_profiles(app, people, rated, mark_rated=True)
    want = {(r[0], r[1]): r[0] != "p1" for r in asked.collect()}
    assert {(r["entity_id"], r["event_date"]): r["has_rating"] for r in marked.collect()} == want
    assert not any(r[0] for r in history.day_profiles(app, people, mark_rated=True).select("has_rating").collect())


def test_forecast_rules(spark):
    app = appearances_of(spark, calendar_of(3, bouts=20, people=4))
    last = app.groupBy("entity_id").agg(F.max("event_date").alias("as_of"))
    labels = spark.createDataFrame([("p0", "A"), ("p1", "A"), ("p2", "B")], "entity_id string, display_name string")
    got = {r["rule"]: r["n_violations"] for r in canonical.forecast_quality(app, labels, last).collect()}
    assert got == {"display name used twice": 1, "as-of date not after history": 4}
    canonical.require_none(canonical.forecast_quality(app, labels.filter("entity_id <> 'p1'"), last.withColumn("as_of", F.date_add("as_of", 1))))
