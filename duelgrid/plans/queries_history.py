"""History features, ratings, matchups, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.constants import FINISH_DIFFS, FINISH_FEATURES, MODEL_FEATURES, PROFILE_FEATURES, RATING_FEATURES
from duelgrid.functions import numeric as N
from duelgrid.operators import canonical, history, matchup, models, ratings, resolve, roster, scoring
from duelgrid.plans import adapter, derived
from duelgrid.plans import sqlbase as S
from duelgrid.plans.registry import query, rounded

R6 = S.r6


# ------------------------------------------------------------------------------------ history
@query(f"WITH {S.DAYS} SELECT bout_id, entity_id, event_date, {R6(S.SUMS)} FROM quantities")
def appearance_quantities(spark, sf):
    return rounded(history.appearance_quantities(derived.appearances(spark, sf), keep=("bout_id",)))


@query(f"WITH {S.DAYS} SELECT entity_id, event_date, {R6(S.SUMS)} FROM days")
def entity_days(spark, sf):
    return rounded(history.entity_days(derived.appearances(spark, sf)).drop("resets"))


def _days(spark, sf):
    app = derived.appearances(spark, sf)
    return history.with_streak(history.with_day_runs(app, history.entity_days(app)))


def _totals(spark, sf):
    return history.history_totals(_days(spark, sf))


_CAREER = [f"{c}_career" for c in S.SUMS]
_LAST = [f"{c}_last{k}" for k in history.LAST_K for c in history.LAST_SUMS]


@query(f"WITH {S.TOTALS} SELECT entity_id, event_date, {R6(_CAREER)} FROM totals")
def career_totals(spark, sf):
    return rounded(_totals(spark, sf).select(*history.DAY, *_CAREER))


@query(f"WITH {S.TOTALS} SELECT entity_id, event_date, {R6(_LAST)} FROM totals")
def last_k_totals(spark, sf):
    return rounded(_totals(spark, sf).select(*history.DAY, *_LAST))


@query(f"WITH {S.DAYS} SELECT entity_id, event_date, CAST(event_date - lag(event_date) OVER (PARTITION BY entity_id ORDER BY event_date) AS DOUBLE) AS days_since_last FROM days")
def layoff_days(spark, sf):
    return _totals(spark, sf).selectExpr(*history.DAY, "CAST(datediff(event_date, last_date) AS DOUBLE) AS days_since_last")


@query(f"WITH {S.TOTALS} SELECT entity_id, event_date, CAST(streak AS DOUBLE) AS streak FROM totals")
def streaks(spark, sf):
    return _totals(spark, sf).select(*history.DAY, "streak")


_RATES = ["slpm", "sapm", "sig_diff_pm", "td15", "ctrl_pct", "win_pct", "sig_acc", "sig_def", "td_acc", "td_def", "sub15", "kd15",
          "finish_rate", "ko_win_share", "sub_win_share", "dec_win_share", "fin_loss_rate", "avg_fight_min",
          "td15_last3", "ctrl_pct_last3"]


@query(f"WITH {S.PROFILES} SELECT entity_id, event_date, {R6(_RATES)} FROM profiles")
def shrunk_rates(spark, sf):
    sql = history.rate_features()
    return rounded(_totals(spark, sf).selectExpr(*history.DAY, *[f"{sql[c]} AS {c}" for c in _RATES]))


_STATIC = ["age", "height_in", "reach_in", "southpaw", "switch"]


@query(f"WITH {S.PROFILES} SELECT entity_id, event_date, {R6(_STATIC)}, stance, dob_known, reach_known FROM profiles")
def static_attributes(spark, sf):
    days = derived.appearances(spark, sf).select(*history.DAY).distinct()
    joined = days.join(history.one_per_entity(adapter.entities(spark, sf)), "entity_id", "left")
    sql = history.static_features("event_date")
    return rounded(joined.selectExpr(*history.DAY, *[f"{v} AS {k}" for k, v in sql.items()]))


@query(f"""WITH {S.RATED} SELECT a.bout_id, a.entity_id, {R6(['wins', 'losses', 'draws_nc', *S.RATED_COLUMNS], 'p.')}
FROM appearances a JOIN rated p USING (entity_id, event_date)""")
def prefight_features(spark, sf):
    out = history.prefight_features(derived.appearances(spark, sf), adapter.entities(spark, sf), derived.day_ratings(spark, sf))
    return rounded(out.select("bout_id", "entity_id", "wins", "losses", "draws_nc", *PROFILE_FEATURES))


@query(f"""WITH {S.APPS}, d AS (SELECT DISTINCT entity_id, event_date FROM appearances)
SELECT d.entity_id, d.event_date, count(a.bout_id) AS n_prior, count(*) FILTER (a.result = 'W') AS w_prior
FROM d LEFT JOIN appearances a ON a.entity_id = d.entity_id AND a.event_date < d.event_date GROUP BY d.entity_id, d.event_date""")
def prior_count_theta(spark, sf):
    return history.prior_counts(derived.appearances(spark, sf))


@query(f"WITH {S.APPS} SELECT bout_id, entity_id, opponent_id FROM appearances")
def opponent_lookup(spark, sf):
    return ratings.opponents(derived.appearances(spark, sf).select("bout_id", "entity_id"))


_STATE = S.DAYS + ",\n" + S.STREAKS + """,
state AS (SELECT entity_id, event_date, """ + ", ".join(
    f"sum({c}) OVER (PARTITION BY entity_id ORDER BY event_date ROWS BETWEEN {frame} AND CURRENT ROW) AS {c}_{name}"
    for name, frame in {"career": "UNBOUNDED PRECEDING", "last3": "2 PRECEDING", "last5": "4 PRECEDING"}.items() for c in S.SUMS
) + """, streak_after AS streak FROM days JOIN day_streaks USING (entity_id, event_date))"""


def _as_of_sql(requests: str) -> str:
    zeros = ", ".join(f"coalesce(s.{c}_{n}, 0) AS {c}_{n}" for n in ("career", "last3", "last5") for c in S.SUMS)
    features = ", ".join(f"{v} AS {k}" for k, v in {**S.FEATURES, **S._static("t.as_of")}.items())
    return f"""{_STATE}, {S.ENTITIES}, requests AS ({requests}),
t AS (SELECT r.entity_id, r.as_of, {zeros}, s.event_date AS last_date, coalesce(s.streak, 0) AS streak
  FROM requests r ASOF LEFT JOIN state s ON r.entity_id = s.entity_id AND r.as_of > s.event_date),
as_of_profiles AS (SELECT t.entity_id, t.as_of, {features} FROM t LEFT JOIN entities e ON e.entity_id = t.entity_id)"""


def _rated_as_of_sql(requests: str) -> str:
    return f"""{_as_of_sql(requests)}, {S.GLICKO},
rated_as_of AS (SELECT p.*, coalesce(s.rating, 1500) AS glicko_rating,
  CASE WHEN s.rd IS NULL THEN 350 ELSE least(350, sqrt(s.rd * s.rd + {S.GROWTH} * (p.as_of - s.last_day))) END AS glicko_rd
  FROM as_of_profiles p LEFT JOIN {S.LAST_STATE} s USING (entity_id))"""


_PROFILE_COLS = ["wins", "losses", "draws_nc", *S.PLAIN]
_MONTHLY = """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of FROM lineitem
UNION SELECT DISTINCT 'c' || o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) FROM orders"""


@query(f"WITH {_as_of_sql(_MONTHLY)} SELECT entity_id, as_of, {R6(_PROFILE_COLS)} FROM as_of_profiles")
def profiles_as_of(spark, sf):
    """Every supplier on the first of every month it ships in, and customers: ids without history."""
    known = adapter.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("entity_id"), F.trunc("l_shipdate", "month").alias("as_of")
    )
    unknown = adapter.table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"), F.trunc("o_orderdate", "year").alias("as_of")
    )
    out = history.profiles_as_of(
        derived.appearances(spark, sf), adapter.entities(spark, sf), known.unionByName(unknown)
    )
    return rounded(out.select("entity_id", "as_of", *_PROFILE_COLS))


_NEWEST = "(SELECT max(event_date) + 1 FROM bouts)"
_CURRENT = _rated_as_of_sql(f"SELECT entity_id, {_NEWEST} AS as_of FROM entities")


@query(f"""WITH {_CURRENT} SELECT entity_id, e.name, as_of, e.dob, CASE WHEN p.dob_known THEN round(p.age + 1e-9, 6) END AS age,
  e.height_in, e.reach_in, p.stance, wins, losses, draws_nc, {R6([c for c in S.RATED_COLUMNS if c not in ('age', 'height_in', 'reach_in')], 'p.')}
FROM rated_as_of p JOIN entities e USING (entity_id)""")
def entity_profile(spark, sf):
    """Record, physical data and features of everybody on the day after the newest bout."""
    profile = derived.current_profiles(spark, sf).alias("p")
    listed = adapter.entities(spark, sf).alias("e")
    rest = [c for c in PROFILE_FEATURES if c not in ("age", "height_in", "reach_in")]
    return rounded(
        profile.join(listed, "entity_id").select(
            "entity_id", "e.name", "as_of", "e.dob", F.expr("IF(p.dob_known, p.age, NULL) AS age"), "e.height_in", "e.reach_in",
            "p.stance", "wins", "losses", "draws_nc", *[f"p.{c}" for c in rest],
        )
    )


# ------------------------------------------------------------------------------------ ratings
def _rounded_growth(rd: str, days: str) -> str:
    return f"round(least(350, sqrt({rd} * {rd} + {S.GROWTH} * ({days}))) + 1e-9, 6)"


@query(f"WITH {S.APPS}, {S.GLICKO} SELECT a.bout_id, a.entity_id, {R6(RATING_FEATURES)} FROM appearances a JOIN day_ratings USING (entity_id, event_date)")
def glicko_ratings(spark, sf):
    """Ratings before each bout, with calendar years as rating periods."""
    app = derived.yearly(spark, sf)
    states = ratings.rate_periods(app, "period")
    before = ratings.ratings_before(app.select("entity_id", "event_date", "period"), states, "event_date", "period")
    return rounded(app.select("bout_id", *history.DAY).join(before, history.DAY).select("bout_id", "entity_id", *RATING_FEATURES))


@query(f"""WITH {S.APPS}, {S.GLICKO} SELECT entity_id, round(rating + 1e-9, 6) AS glicko_rating, {_rounded_growth('rd', f'{_NEWEST} - last_day')} AS glicko_rd
FROM {S.LAST_STATE}""")
def ratings_as_of(spark, sf):
    """Everybody's rating on the day after the newest bout. The last years are rated incrementally."""
    app = derived.yearly(spark, sf)
    early = ratings.rate_periods(app.filter("period < '2000-01-01'"), "period")
    states = ratings.rate_periods(app, "period", initial_state=early)
    asked = states.select("entity_id", derived.next_day(spark, sf).alias("as_of"))
    return rounded(ratings.ratings_before(asked, states, "as_of").select("entity_id", *RATING_FEATURES))


_DAILY = f"""WITH RECURSIVE {S.APPS}, scored AS MATERIALIZED (
  SELECT entity_id, opponent_id, CASE result WHEN 'W' THEN 1.0 WHEN 'L' THEN 0.0 ELSE 0.5 END::DOUBLE AS score, event_date,
    dense_rank() OVER (ORDER BY event_date) AS step
  FROM appearances WHERE result IN ('W', 'L', 'D') AND opponent_id IS NOT NULL
), state(entity_id, rating, rd, last_day, step) USING KEY (entity_id) AS (
  SELECT DISTINCT entity_id, 1500.0::DOUBLE, 350.0::DOUBLE, NULL::DATE, 0::BIGINT FROM scored
  UNION
  SELECT entity_id, r + ln(10) / 400 / denom * surprise, greatest(30, sqrt(1 / denom)), day, step FROM (
    SELECT entity_id, any_value(r) AS r, 1 / (any_value(rd) * any_value(rd)) + {S.Q2} * sum(g * g * e * (1 - e)) AS denom, sum(g * (score - e)) AS surprise, day, step
    FROM (SELECT *, 1 / (1 + pow(10, -g * (r - r_opp) / 400)) AS e FROM (SELECT *, 1 / sqrt(1 + 3 * {S.Q2} * rd_opp * rd_opp / (pi() * pi())) AS g FROM (
      SELECT a.entity_id, a.score, a.event_date AS day, a.step, s.rating AS r, o.rating AS r_opp,
        least(350, sqrt(s.rd * s.rd + {S.GROWTH} * coalesce(a.event_date - s.last_day, 0))) AS rd,
        least(350, sqrt(o.rd * o.rd + {S.GROWTH} * coalesce(a.event_date - o.last_day, 0))) AS rd_opp
      FROM scored a JOIN recurring.state s ON s.entity_id = a.entity_id JOIN recurring.state o ON o.entity_id = a.opponent_id
      WHERE a.step = (SELECT max(step) + 1 FROM state))))
    GROUP BY entity_id, day, step)
) SELECT entity_id, round(rating + 1e-9, 6) AS glicko_rating, {_rounded_growth('rd', f'{_NEWEST} - last_day')} AS glicko_rd FROM state"""


def _newest_ratings(spark, sf, states):
    asked = states.select("entity_id", derived.next_day(spark, sf).alias("as_of")).distinct()
    return rounded(ratings.ratings_before(asked, states, "as_of").select("entity_id", *RATING_FEATURES))


@query(_DAILY)
def ratings_by_date(spark, sf):
    """Everybody's rating on the day after the newest bout, with every single date as a rating period."""
    return _newest_ratings(spark, sf, ratings.rate_periods(derived.appearances(spark, sf)))


@query(_DAILY)
def ratings_late_bouts(spark, sf):
    """`ratings_by_date` from a run to which the title bouts of 2000 came late, and which had not seen 2001."""
    app = derived.appearances(spark, sf)
    known = app.where("event_date < DATE '2001-01-01' AND NOT (is_title AND event_date >= DATE '2000-01-01')")
    states = ratings.rate_periods(known)
    return _newest_ratings(spark, sf, ratings.rerated(app, states, known.select("bout_id")))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(least(350, sqrt(pow(l_quantity * 7, 2) + {S.GROWTH} * (l_partkey % 3000))) + 1e-9, 6) AS rd FROM lineitem""")
def rd_growth(spark, sf):
    grown = N.grown_deviation(F.col("l_quantity") * 7, F.col("l_partkey") % 3000)
    return rounded(adapter.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", grown.alias("rd")))


# ----------------------------------------------------------------------------------- matchups
def _profiles(spark, sf):
    return history.day_profiles(derived.appearances(spark, sf), adapter.entities(spark, sf), derived.day_ratings(spark, sf))


def _diff_sql(a: str, b: str) -> str:
    def value(c):
        d = f"{a}.{c} - {b}.{c}"
        return f"CASE WHEN {d} IS NULL THEN 0 ELSE greatest(least({d}, 1500), -1500) END" if c == "days_since_last" else f"coalesce({d}, 0)"

    return ", ".join(f"round({value(c)} + 1e-9, 6) AS {c}_diff" for c in S.RATED_COLUMNS) + f", least({a}.n_fights, {b}.n_fights) AS min_prior_fights"


@query(f"""WITH {S.RATED} SELECT m.bout_id, m.event_date, entity_1_id AS a_id, entity_2_id AS b_id, {_diff_sql('a', 'b')}
FROM bouts m JOIN rated a ON a.entity_id = m.entity_1_id AND a.event_date = m.event_date
JOIN rated b ON b.entity_id = m.entity_2_id AND b.event_date = m.event_date""")
def matchup_features(spark, sf):
    """The flagship: features from the canonical tables, both sides joined into one row per bout."""
    inputs = history.day_inputs(derived.appearances(spark, sf), adapter.entities(spark, sf), derived.day_ratings(spark, sf)).drop("decided")
    pairs = derived.bouts(spark, sf).select(
        "bout_id", "event_date", F.col("entity_1_id").alias("a_id"), F.col("entity_2_id").alias("b_id")
    )
    return rounded(matchup.matchup_features(pairs, inputs, features=PROFILE_FEATURES, derived=history.profile_features()))


_TRAIN = f"""{S.RATED}, oriented AS (
  SELECT *, right(md5(bout_id), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS flip FROM bouts WHERE winner_side IS NOT NULL),
ab AS (SELECT bout_id, event, event_date, weight_class, CASE WHEN flip THEN entity_2_id ELSE entity_1_id END AS a_id,
    CASE WHEN flip THEN entity_1_id ELSE entity_2_id END AS b_id, CASE WHEN flip THEN entity_2_name ELSE entity_1_name END AS a_name,
    CASE WHEN flip THEN entity_1_name ELSE entity_2_name END AS b_name,
    CAST(CASE WHEN flip THEN winner_side = 2 ELSE winner_side = 1 END AS INTEGER) AS label FROM oriented),
train AS (SELECT ab.*, a.n_fights AS a_prior_fights, b.n_fights AS b_prior_fights, {_diff_sql('a', 'b')}
  FROM ab JOIN rated a ON a.entity_id = ab.a_id AND a.event_date = ab.event_date JOIN rated b ON b.entity_id = ab.b_id AND b.event_date = ab.event_date)"""


@query(f"WITH {_TRAIN} SELECT * FROM train")
def training_table(spark, sf):
    profiles = _profiles(spark, sf)
    return rounded(matchup.training_table(derived.bouts(spark, sf), profiles, PROFILE_FEATURES))


_MIRRORED = [c for c in MODEL_FEATURES if c.endswith("_diff")]


@query(f"""WITH {_TRAIN} SELECT bout_id, label, min_prior_fights, {', '.join(_MIRRORED)}, false AS mirrored FROM train
UNION ALL SELECT bout_id, 1 - label, min_prior_fights, {', '.join(f'round(0 - {c}, 6)' for c in _MIRRORED)}, true FROM train""")
def mirror_rows(spark, sf):
    rows = rounded(derived.training_table(spark, sf).select("bout_id", "label", *MODEL_FEATURES))
    return matchup.mirror(rows)


_SPLIT = """CASE WHEN event_date < DATE '1995-07-01' THEN 'history' WHEN event_date < DATE '2000-01-01' THEN 'train'
  WHEN event_date < DATE '2001-01-01' THEN 'validation' ELSE 'test' END"""


@query(f"WITH {S.BOUTS} SELECT bout_id, event_date, {_SPLIT} AS split FROM bouts WHERE winner_side IS NOT NULL")
def chrono_split(spark, sf):
    models.check_periods(adapter.PERIODS)
    return models.with_split(matchup.oriented(derived.bouts(spark, sf)), adapter.PERIODS).select("bout_id", "event_date", "split")


_FINISH_SQL = ", ".join(
    [f"round(w.{c} + 1e-9, 6) AS w_{c}" for c in S.RATED_COLUMNS if f"w_{c}" in FINISH_FEATURES]
    + [f"round(l.{c} + 1e-9, 6) AS l_{c}" for c in S.RATED_COLUMNS if f"l_{c}" in FINISH_FEATURES]
    + [f"round(w.{c} - l.{c} + 1e-9, 6) AS wl_{c}_diff" for c in FINISH_DIFFS]
)


@query(f"""WITH {S.RATED}, wl AS (SELECT *, CASE winner_side WHEN 1 THEN entity_1_id ELSE entity_2_id END AS w_id,
    CASE winner_side WHEN 1 THEN entity_2_id ELSE entity_1_id END AS l_id FROM bouts WHERE winner_side IS NOT NULL AND method IN ('KO/TKO', 'SUB', 'DEC'))
SELECT f.bout_id, f.event_date, f.method, {_FINISH_SQL}, coalesce(weight_lbs, 170) AS weight_lbs, CAST(is_female AS DOUBLE) AS is_female,
  CAST(scheduled_rounds = 5 AS DOUBLE) AS five_rounds, CAST(is_title AS DOUBLE) AS is_title
FROM wl f JOIN rated w ON w.entity_id = w_id AND w.event_date = f.event_date JOIN rated l ON l.entity_id = l_id AND l.event_date = f.event_date
WHERE f.event_date >= DATE '1996-01-01'""")
def method_table(spark, sf):
    profiles = _profiles(spark, sf)
    table = matchup.finish_table(derived.bouts(spark, sf), profiles)
    return rounded(models.between(table, adapter.PERIODS.finish_min_train, None))


_PAIRS = "SELECT DISTINCT entity_1_id AS a_id, entity_2_id AS b_id FROM bouts"


def _pairs(spark, sf):
    return derived.bouts(spark, sf).select(F.col("entity_1_id").alias("a_id"), F.col("entity_2_id").alias("b_id")).distinct()


def _record(p: str) -> str:
    return f"""CAST(CAST({p}.wins AS INTEGER) AS VARCHAR) || '-' || CAST(CAST({p}.losses AS INTEGER) AS VARCHAR)
  || CASE WHEN {p}.draws_nc > 0 THEN '-' || CAST(CAST({p}.draws_nc AS INTEGER) AS VARCHAR) ELSE '' END"""


def _comparison_sql() -> str:
    rows = []
    for position, (category, statistic, name) in enumerate(matchup.COMPARISON, 1):
        if name in ("record", "stance"):
            text = [_record(p) if name == "record" else f"{p}.stance" for p in "ab"]
            number = ["NULL", "NULL"]
        else:
            text = ["NULL", "NULL"]
            number = [{"age": f"CASE WHEN {p}.dob_known THEN {p}.age END", "reach_in": f"CASE WHEN {p}.reach_known THEN {p}.reach_in END"}.get(name, f"{p}.{name}") for p in "ab"]
        rows.append(f"""SELECT m.a_id, m.b_id, a.as_of, {position} AS position, '{category}' AS category, '{statistic}' AS statistic,
  round(CAST({number[0]} AS DOUBLE) + 1e-9, 6) AS a_value, round(CAST({number[1]} AS DOUBLE) + 1e-9, 6) AS b_value,
  CAST({text[0]} AS VARCHAR) AS a_text, CAST({text[1]} AS VARCHAR) AS b_text
FROM pairs m JOIN rated_as_of a ON a.entity_id = m.a_id JOIN rated_as_of b ON b.entity_id = m.b_id""")
    return f"WITH {_CURRENT}, pairs AS ({_PAIRS}) " + " UNION ALL ".join(rows)


@query(_comparison_sql())
def compare_entities(spark, sf):
    """All pairs that have met, compared on the day after the newest bout."""
    pairs = _pairs(spark, sf).withColumn("as_of", derived.next_day(spark, sf))
    return rounded(matchup.compare_entities(pairs, derived.current_profiles(spark, sf)))


# ------------------------------------------------------------------------------------- roster
_NAMED = "replace(weight_class, 'Women''s ', '') IN ('Strawweight', 'Flyweight', 'Bantamweight', 'Featherweight', 'Lightweight', 'Welterweight', 'Middleweight', 'Light Heavyweight', 'Heavyweight')"
_SUMMARY = f"""summary AS (SELECT entity_id, max(event_date) AS last_date, arg_max(weight_class, (event_date, bout_id)) AS last_weight_class,
  count(*) AS n_fights, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses,
  count(*) FILTER (result NOT IN ('W', 'L')) AS draws_nc, bool_or(starts_with(weight_class, 'Women''s ')) AS female,
  arg_max(replace(weight_class, 'Women''s ', ''), (event_date, bout_id)) FILTER ({_NAMED}) AS division,
  coalesce(list_sort(list(DISTINCT replace(weight_class, 'Women''s ', '')) FILTER ({_NAMED})), []) AS divisions FROM appearances GROUP BY entity_id)"""


@query(f"WITH {S.APPS}, {S.ENTITIES}, {_SUMMARY} SELECT s.entity_id, e.name, n_fights, last_date, last_weight_class, wins, losses, draws_nc FROM summary s JOIN entities e USING (entity_id)")
def roster_table(spark, sf):
    out = roster.build_roster(derived.appearances(spark, sf), adapter.entities(spark, sf))
    return out.select("entity_id", "name", "n_fights", "last_date", "last_weight_class", "wins", "losses", "draws_nc")


@query(f"WITH {S.APPS}, ranked AS (SELECT entity_id, weight_class, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, bout_id DESC) AS rn FROM appearances WHERE {_NAMED}) SELECT entity_id, weight_class AS latest_division FROM ranked WHERE rn = 1")
def latest_division(spark, sf):
    return matchup.latest_division(derived.appearances(spark, sf))


@query(f"WITH {S.APPS}, {_SUMMARY} SELECT entity_id, array_to_string(divisions, ',') AS divisions, female, division FROM summary")
def division_sets(spark, sf):
    out = roster.entity_summary(derived.appearances(spark, sf))
    return out.select("entity_id", F.array_join("divisions", ",").alias("divisions"), "female", "division")


@query("SELECT p_partkey, p_name, p_brand, count(*) OVER (PARTITION BY p_name, p_brand) AS n_rows FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_brand) > 1")
def ambiguous_keys(spark, sf):
    return roster.ambiguous_keys(adapter.table(spark, sf, "part"), ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand", "n_rows")


def _named_roster(spark, sf):
    return adapter.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("last_weight_class"), F.expr("date_add(DATE'2000-01-01', p_size * 100)").alias("last_date"),
    )


_LABELS = """parts AS (SELECT 'p' || p_partkey AS entity_id, p_name AS name,
    p_name || ' (' || p_type || ', last ' || year(DATE '2000-01-01' + p_size * 100) || ')' AS detail FROM part),
once AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN detail ELSE name END AS label FROM parts),
labels AS (SELECT entity_id, name, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' [' || entity_id || ']' ELSE label END AS display_name FROM once)"""


@query(f"WITH {_LABELS} SELECT * FROM labels")
def display_names(spark, sf):
    return roster.with_display_names(_named_roster(spark, sf)).select("entity_id", "name", "display_name")


@query(f"""WITH {_LABELS}, asked AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'p' || l_partkey WHEN 'N' THEN upper(p_name)
    WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN p_name ELSE 'nobody ' || l_suppkey END END AS reference FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT -1, 0, display_name FROM labels),
by_id AS (SELECT entity_id AS v, count(*) AS n, min(entity_id) AS id FROM labels GROUP BY 1),
by_label AS (SELECT display_name AS v, count(*) AS n, min(entity_id) AS id FROM labels GROUP BY 1),
by_name AS (SELECT name AS v, count(*) AS n, min(entity_id) AS id FROM labels GROUP BY 1),
by_lower AS (SELECT lower(name) AS v, count(*) AS n, min(entity_id) AS id FROM labels GROUP BY 1)
SELECT l_orderkey, l_linenumber, reference,
  CASE WHEN a.n = 1 THEN a.id WHEN a.n > 1 THEN NULL WHEN b.n = 1 THEN b.id WHEN b.n > 1 THEN NULL WHEN c.n = 1 THEN c.id WHEN c.n > 1 THEN NULL WHEN d.n = 1 THEN d.id END AS entity_id,
  CASE WHEN a.n = 1 THEN 'resolved' WHEN a.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'resolved' WHEN b.n > 1 THEN 'ambiguous' WHEN c.n = 1 THEN 'resolved'
    WHEN c.n > 1 THEN 'ambiguous' WHEN d.n = 1 THEN 'resolved' ELSE 'unknown' END AS status
FROM asked LEFT JOIN by_id a ON a.v = reference LEFT JOIN by_label b ON b.v = reference LEFT JOIN by_name c ON c.v = reference LEFT JOIN by_lower d ON d.v = lower(reference)""")
def resolve_reference(spark, sf):
    """Ids, names, names in capitals, unknown names and display names, each resolved to one id."""
    labelled = roster.with_display_names(_named_roster(spark, sf))
    flag = F.col("l_returnflag")
    lines = adapter.table(spark, sf, "lineitem").join(
        adapter.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
    )
    unknown = F.when(F.col("l_linestatus") == "F", F.col("p_name")).otherwise(F.concat(F.lit("nobody "), F.col("l_suppkey").cast("string")))
    asked = lines.select(
        "l_orderkey", "l_linenumber",
        F.when(flag == "A", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).when(flag == "N", F.upper("p_name")).otherwise(unknown).alias("reference"),
    ).unionByName(labelled.select(F.lit(-1).cast("long").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("display_name").alias("reference")))
    return resolve.resolve_references(asked, labelled)


@query(f"""WITH {S.APPS}, {_SUMMARY} SELECT entity_id, n_fights, division, last_date FROM summary WHERE n_fights >= 2 AND NOT female
  AND {_NEWEST} - last_date <= 730 AND list_has_any(divisions, ['Lightweight', 'Heavyweight'])
UNION ALL SELECT entity_id, n_fights, division, last_date FROM summary WHERE division IN ('Flyweight', 'Strawweight')""")
def roster_filter(spark, sf):
    """Two filters: active men with any past bout in two divisions, and all-time by current division."""
    base = roster.entity_summary(derived.appearances(spark, sf))
    day = derived.next_day(spark, sf)
    one = roster.filter_roster(base, day, 2, False, True, ["Lightweight", "Heavyweight"], True)
    two = roster.filter_roster(base, day, active_only=False, divisions=["Flyweight", "Strawweight"])
    return one.unionByName(two).select("entity_id", "n_fights", "division", "last_date")


_NOW_RD = f"least(350, sqrt(s.rd * s.rd + {S.GROWTH} * ({_NEWEST} - s.last_day)))"


@query(f"""WITH {S.APPS}, {_SUMMARY}, {S.GLICKO} SELECT entity_id, round(coalesce(s.rating, 1500) - 1.96 * coalesce({_NOW_RD}, 350) + 1e-9, 6) AS low,
  round(coalesce(s.rating, 1500) + 1.96 * coalesce({_NOW_RD}, 350) + 1e-9, 6) AS high,
  wins || '-' || losses || CASE WHEN draws_nc > 0 THEN '-' || draws_nc ELSE '' END AS record,
  CASE WHEN division IS NULL THEN 'Catch/Open weight' ELSE CASE WHEN female THEN 'Women''s ' ELSE '' END || division END AS label FROM summary LEFT JOIN {S.LAST_STATE} s USING (entity_id)""")
def rating_interval(spark, sf):
    """95 % range of the rating on the day after the newest bout, record text and division label."""
    summary = roster.entity_summary(derived.appearances(spark, sf))
    asked = summary.select("entity_id", derived.next_day(spark, sf).alias("as_of"))
    now = ratings.ratings_before(asked, derived.rating_states(spark, sf), "as_of").drop("as_of")
    s = summary.join(now, "entity_id")
    low, high = N.rating_range(F.col("glicko_rating"), F.col("glicko_rd"))
    return rounded(s.select(
        "entity_id", low.alias("low"), high.alias("high"),
        matchup.record_text(F.col("wins"), F.col("losses"), F.col("draws_nc")).alias("record"),
        roster.division_label(F.col("female"), F.col("division")).alias("label"),
    ))


@query(f"""WITH {S.APPS}, {S.ENTITIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, bout_id DESC) AS rank FROM appearances)
SELECT r.entity_id, r.rank, r.event_date, r.event, e.name AS opponent, r.result, r.method, r.end_round AS round,
  CAST(CAST(sig_landed AS BIGINT) AS VARCHAR) || ' / ' || CAST(CAST(opp_sig_landed AS BIGINT) AS VARCHAR) AS sig_str, CAST(td_landed AS BIGINT) AS takedowns
FROM ranked r LEFT JOIN entities e ON e.entity_id = r.opponent_id WHERE rank <= 5""")
def recent_bouts(spark, sf):
    return roster.recent_bouts(derived.appearances(spark, sf), adapter.entities(spark, sf))


@query(f"""WITH {S.APPS}, {_SUMMARY}, placed AS (
  SELECT entity_id, coalesce(division, 'any') AS pool, md5(entity_id || ':7') AS draw FROM summary
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY draw, entity_id) - 1 AS place, count(*) OVER (PARTITION BY pool) AS size FROM placed
), alone AS (
  SELECT entity_id, row_number() OVER (ORDER BY draw, entity_id) - 1 AS place, count(*) OVER () AS n FROM ranked WHERE size = 1
), first AS (SELECT entity_id FROM ranked WHERE place = 0 AND size > 1 ORDER BY size DESC, pool LIMIT 1)
SELECT a.pool, a.entity_id AS a_id, b.entity_id AS b_id FROM ranked a JOIN ranked b ON a.pool = b.pool AND a.place % 2 = 0 AND b.place = a.place + 1
UNION ALL SELECT a.pool, a.entity_id, b.entity_id FROM ranked a JOIN ranked b ON a.pool = b.pool
  WHERE a.size > 1 AND a.size % 2 = 1 AND a.place = a.size - 1 AND b.place = 0
UNION ALL SELECT 'rest', a.entity_id, b.entity_id FROM alone a JOIN alone b ON a.place % 2 = 0 AND b.place = a.place + 1
UNION ALL SELECT 'rest', a.entity_id, f.entity_id FROM alone a, first f WHERE a.n % 2 = 1 AND a.place = a.n - 1""")
def random_matchups(spark, sf):
    return roster.random_matchups(roster.entity_summary(derived.appearances(spark, sf)), seed=7)


_LBS = {"Women's Strawweight": 115, "Women's Flyweight": 125, "Lightweight": 155, "Welterweight": 170, "Light Heavyweight": 205, "Heavyweight": 265}
_LBS_SQL = "CASE {} " + " ".join("WHEN '{}' THEN {}".format(k.replace("'", "''"), v) for k, v in _LBS.items()) + " END"


@query(f"""WITH {S.APPS}, pairs AS ({_PAIRS}), ranked AS (SELECT entity_id, weight_class, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, bout_id DESC) AS rn FROM appearances WHERE {_NAMED}),
d AS (SELECT entity_id, weight_class AS wc FROM ranked WHERE rn = 1),
j AS (SELECT a_id, b_id, a.wc AS a_wc, b.wc AS b_wc FROM pairs LEFT JOIN d a ON a.entity_id = a_id LEFT JOIN d b ON b.entity_id = b_id),
c AS (SELECT a_id, b_id, CASE WHEN a_wc IS NULL AND b_wc IS NULL THEN 'Catch Weight' WHEN a_wc IS NULL THEN b_wc WHEN b_wc IS NULL THEN a_wc
  WHEN {_LBS_SQL.format('b_wc')} > {_LBS_SQL.format('a_wc')} THEN b_wc ELSE a_wc END AS weight_class FROM j)
SELECT *, CAST({_LBS_SQL.format('weight_class')} AS DOUBLE) AS weight_lbs, starts_with(weight_class, 'Women') AS is_female FROM c""")
def bout_context(spark, sf):
    return matchup.bout_context(_pairs(spark, sf), matchup.latest_division(derived.appearances(spark, sf)))


def _warning_sql(p: str, name: str) -> str:
    n = f"CAST({p}.n_fights AS INTEGER)"
    return f"""CASE WHEN {p}.n_fights < 3 THEN 'Few bouts on record for ' || {name} || ': ' || {n} || '; rates stay close to the priors' END,
  CASE WHEN NOT ({p}.dob_known AND {p}.reach_known) THEN 'Age or reach unknown for ' || {name} || ': filled with typical values' END"""


@query(f"""WITH {S.PROFILES} SELECT m.bout_id, array_to_string([w FOR w IN [{_warning_sql('a', 'entity_1_name')}, {_warning_sql('b', 'entity_2_name')}] IF w IS NOT NULL], '|') AS warnings
FROM bouts m JOIN profiles a ON a.entity_id = m.entity_1_id AND a.event_date = m.event_date JOIN profiles b ON b.entity_id = m.entity_2_id AND b.event_date = m.event_date""")
def prediction_warnings(spark, sf):
    pairs = derived.bouts(spark, sf).select(
        "bout_id", "event_date", "entity_1_name", "entity_2_name", F.col("entity_1_id").alias("a_id"), F.col("entity_2_id").alias("b_id")
    )
    valid, _ = scoring.split_same_entity(pairs)
    joined = matchup.join_profiles(valid, derived.day_profiles(spark, sf))

    def side(p, name):
        return scoring.prediction_warnings(F.col(f"m.{name}"), F.col(f"{p}.n_fights"), F.col(f"{p}.dob_known"), F.col(f"{p}.reach_known"))

    texts = F.concat(side("a", "entity_1_name"), side("b", "entity_2_name"))
    return joined.select("m.bout_id", F.array_join(texts, "|").alias("warnings"))


@query(f"""WITH {S.APPS}, last AS (SELECT entity_id, max(event_date) AS d FROM appearances GROUP BY 1),
used AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_suppkey AS VARCHAR) IN (entity_1_id, entity_2_id) AS inside FROM lineitem JOIN bouts ON bout_id = CAST(l_orderkey AS VARCHAR)),
years AS (SELECT year(event_date) > min(year(event_date)) OVER (PARTITION BY entity_id) AS rated FROM appearances),
shipped AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1),
spans AS (SELECT split, min(day) AS lo, max(day) AS hi FROM (SELECT bout_id, {_SPLIT} AS split FROM bouts WHERE winner_side IS NOT NULL) b
  JOIN shipped ON bout_id = CAST(l_orderkey AS VARCHAR) GROUP BY 1),
names AS (SELECT left({S.NAME.format('entity_id')}, 5) AS label FROM last)
SELECT 'same entity on both sides' AS rule, count(*) AS n_violations FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND b.l_suppkey = a.l_suppkey
UNION ALL SELECT 'statistics name not in the bout', count(*) FROM used WHERE NOT inside
UNION ALL SELECT 'repeated bout, side and round', count(*) FROM (SELECT 1 FROM used WHERE inside GROUP BY l_orderkey, l_suppkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'appearance without features', count(*) FROM appearances WHERE NOT has_stats
UNION ALL SELECT 'appearance without rating', count(*) FROM years WHERE NOT rated
UNION ALL SELECT 'overlapping periods', count(*) FROM (VALUES ('train', 'validation'), ('validation', 'test')) v(x, y) JOIN spans a ON a.split = x JOIN spans b ON b.split = y WHERE a.hi >= b.lo
UNION ALL SELECT 'display name used twice', count(*) FROM (SELECT 1 FROM names GROUP BY label HAVING count(*) > 1)
UNION ALL SELECT 'as-of date not after history', count(*) FROM last WHERE d >= DATE '2001-01-01'""")
def data_quality(spark, sf):
    """All rules, each on data that break it.

    Neighbouring lines of an order meet, all suppliers of an order count as named in its statistics, profiles exist only
    where statistics do, ratings only from the second year on, periods hold shipping dates, labels are names cut to five
    signs, and the asked date lies inside the history.
    """
    app, b = derived.appearances(spark, sf), derived.bouts(spark, sf)
    lines = adapter.table(spark, sf, "lineitem")
    following = lines.selectExpr("l_orderkey", "l_linenumber - 1 AS l_linenumber", "l_suppkey AS entity_2_id")
    met = lines.join(following, ["l_orderkey", "l_linenumber"]).selectExpr("l_suppkey AS entity_1_id", "entity_2_id")
    named = b.select(F.col("bout_id").cast("long").alias("l_orderkey"), "bout_id", "entity_1_id", "entity_2_id")
    attached = lines.join(named, "l_orderkey").selectExpr(
        "bout_id", "CASE string(l_suppkey) WHEN entity_1_id THEN 1 WHEN entity_2_id THEN 2 ELSE 0 END AS side", "l_linenumber AS round"
    )
    features = app.filter("has_stats").select("bout_id", *history.DAY).join(derived.day_profiles(spark, sf), history.DAY)
    first = derived.rating_states(spark, sf).groupBy("entity_id").agg(F.min("last_day").alias("first_period"))
    rated = derived.yearly(spark, sf).join(first, "entity_id").filter("first_period < period")
    shipped = lines.groupBy(F.col("l_orderkey").cast("string").alias("bout_id")).agg(F.max(F.col("l_shipdate").cast("date")).alias("event_date"))
    split = models.with_split(matchup.oriented(b), adapter.PERIODS).drop("event_date").join(shipped, "bout_id")
    known = adapter.entities(spark, sf)
    people = roster.build_roster(app, known).withColumn("display_name", F.substring("name", 1, 5))
    as_of = known.select("entity_id", F.lit("2001-01-01").cast("date").alias("as_of"))
    return canonical.data_quality(met, attached, app, features, rated, split, people, as_of)
