"""DuckDB building blocks: the contract tables as bouts, written apart from the Spark code."""

from __future__ import annotations

SIDES = """sides AS (
  SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice), 2) AS price, min(l_returnflag) AS flag,
    CAST(count(*) FILTER (l_discount >= 0.08) AS DOUBLE) AS kd,
    CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS sub_att,
    CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS rev,
    CASE WHEN bool_or(l_tax = 0) THEN NULL ELSE round(sum(l_tax) * 1000, 0) END AS ctrl_s,
    sum(l_quantity) AS sig_landed, sum(l_quantity) + 10 * count(*) AS sig_att,
    sum(l_quantity) + count(*) AS tot_landed, 2 * sum(l_quantity) + 10 * count(*) AS tot_att,
    CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS td_landed, CAST(count(*) AS DOUBLE) AS td_att,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS head_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_returnflag = 'A'), 0) AS head_att,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS body_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_returnflag = 'N'), 0) AS body_att,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS leg_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_returnflag = 'R'), 0) AS leg_att,
    coalesce(sum(l_quantity) FILTER (l_discount < 0.04), 0) AS dist_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_discount < 0.04), 0) AS dist_att,
    coalesce(sum(l_quantity) FILTER (l_discount >= 0.04 AND l_discount < 0.07), 0) AS clinch_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_discount >= 0.04 AND l_discount < 0.07), 0) AS clinch_att,
    coalesce(sum(l_quantity) FILTER (l_discount >= 0.07), 0) AS ground_landed,
    coalesce(sum(l_quantity + 5) FILTER (l_discount >= 0.07), 0) AS ground_att
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
ends AS (
  SELECT l_orderkey, min(l_suppkey) AS s1, max(l_suppkey) AS s2 FROM lineitem
  GROUP BY l_orderkey HAVING min(l_suppkey) < max(l_suppkey)),
bout_sides AS (
  SELECT s.*, e.s1, e.s2, CASE WHEN s.l_suppkey = e.s1 THEN 1 ELSE 2 END AS side
  FROM sides s JOIN ends e USING (l_orderkey) WHERE s.l_suppkey IN (e.s1, e.s2))"""

NAME = "'Sup ' || translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"

BOUTS = SIDES + """,
raw_bouts AS (
  SELECT o.o_orderkey AS k, CAST(o.o_orderkey AS VARCHAR) AS bout_id, CAST(o.o_orderdate AS DATE) AS event_date,
    'Card ' || strftime(o.o_orderdate, '%Y-%m-%d') || ' ' || o.o_orderpriority AS event,
    o.o_orderstatus AS status, a.flag AS flag_1, b.flag AS flag_2, a.s1, a.s2,
    CASE WHEN o.o_orderstatus = 'P' THEN NULL WHEN a.price > b.price THEN 1 WHEN a.price < b.price THEN 2 END AS winner_side,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 5 ELSE 3 END AS scheduled_rounds
  FROM orders o JOIN bout_sides a ON a.l_orderkey = o.o_orderkey AND a.side = 1
  JOIN bout_sides b ON b.l_orderkey = o.o_orderkey AND b.side = 2),
bouts AS (
  SELECT bout_id, event, """ + NAME.format("s1") + " || ' vs. ' || " + NAME.format("s2") + """ AS bout, event_date,
    ['Lightweight', 'Welterweight', 'Women''s Flyweight', 'Heavyweight', 'Light Heavyweight', 'Catch Weight',
     'Women''s Strawweight', 'Super Heavyweight'][k % 8 + 1] AS weight_class,
    CAST([155, 170, 125, 265, 205, NULL, 115, NULL][k % 8 + 1] AS DOUBLE) AS weight_lbs,
    k % 8 IN (2, 6) AS is_female, k % 8 IN (1, 6) AS is_title,
    CASE CASE winner_side WHEN 1 THEN flag_1 WHEN 2 THEN flag_2 END
      WHEN 'R' THEN 'KO/TKO' WHEN 'A' THEN 'SUB' WHEN 'N' THEN 'DEC' ELSE 'OTHER' END AS method,
    CAST(1 + k % scheduled_rounds AS INTEGER) AS end_round, scheduled_rounds,
    CAST((k % scheduled_rounds) * 300 + 1 + (k * 37) % 300 AS DOUBLE) AS duration_s, winner_side,
    CASE WHEN status = 'P' THEN 'no_contest' WHEN winner_side IS NOT NULL THEN 'win' ELSE 'draw' END AS result_type,
    CAST(s1 AS VARCHAR) AS entity_1_id, CAST(s2 AS VARCHAR) AS entity_2_id,
    """ + NAME.format("s1") + " AS entity_1_name, " + NAME.format("s2") + """ AS entity_2_name
  FROM raw_bouts)"""

STATS = ["kd", "sub_att", "rev", "ctrl_s", "sig_landed", "sig_att", "tot_landed", "tot_att", "td_landed", "td_att",
         "head_landed", "head_att", "body_landed", "body_att", "leg_landed", "leg_att", "dist_landed", "dist_att",
         "clinch_landed", "clinch_att", "ground_landed", "ground_att"]

APPS = BOUTS + """,
appearances AS (
  SELECT b.bout_id, b.event, b.event_date, b.weight_class, b.weight_lbs, b.is_title, b.method, b.duration_s,
    b.end_round, b.scheduled_rounds, t.side,
    CASE t.side WHEN 1 THEN entity_1_id ELSE entity_2_id END AS entity_id,
    CASE t.side WHEN 1 THEN entity_1_name ELSE entity_2_name END AS entity_name,
    CASE t.side WHEN 1 THEN entity_2_id ELSE entity_1_id END AS opponent_id,
    CASE WHEN winner_side = t.side THEN 'W' WHEN winner_side = 3 - t.side THEN 'L'
      WHEN result_type = 'draw' THEN 'D' ELSE 'NC' END AS result,
    """ + ", ".join(f"o.{c}" for c in STATS) + ", " + ", ".join(f"p.{c} AS opp_{c}" for c in STATS) + """,
    o.sig_att IS NOT NULL AND p.sig_att IS NOT NULL AND b.duration_s IS NOT NULL AS has_stats
  FROM bouts b CROSS JOIN (SELECT unnest([1, 2]) AS side) t
  LEFT JOIN bout_sides o ON CAST(o.l_orderkey AS VARCHAR) = b.bout_id AND o.side = t.side
  LEFT JOIN bout_sides p ON CAST(p.l_orderkey AS VARCHAR) = b.bout_id AND p.side = 3 - t.side)"""

ENTITIES = """entities AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, """ + NAME.format("s_suppkey") + """ AS name,
    CAST(60 + s_suppkey % 20 AS DOUBLE) AS height_in,
    CASE WHEN s_suppkey % 7 <> 0 THEN CAST(60 + s_suppkey % 20 + s_suppkey % 5 AS DOUBLE) END AS reach_in,
    CAST(115 + 10 * (s_suppkey % 16) AS DOUBLE) AS listed_weight_lbs,
    CASE s_suppkey % 4 WHEN 0 THEN 'Orthodox' WHEN 1 THEN 'Southpaw' WHEN 2 THEN 'Switch' END AS stance,
    CASE WHEN s_acctbal >= 0 THEN DATE '1960-01-01' + CAST((s_suppkey * 30) % 5000 AS INTEGER) END AS dob,
    'sup' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS name_norm
  FROM supplier)"""

COUNTS = {
    "n": "1.0", "w": "(result = 'W')", "l": "(result = 'L')", "ko_w": "(result = 'W' AND method = 'KO/TKO')",
    "sub_w": "(result = 'W' AND method = 'SUB')", "dec_w": "(result = 'W' AND method = 'DEC')",
    "fin_l": "(result = 'L' AND method IN ('KO/TKO', 'SUB'))", "minutes": "coalesce(duration_s / 60, 0)",
}
WHEN_STATS = {
    "s_min": "duration_s / 60", "sig_l": "sig_landed", "sig_a": "sig_att", "osig_l": "opp_sig_landed",
    "osig_a": "opp_sig_att", "td_l": "td_landed", "td_a": "td_att", "otd_l": "opp_td_landed", "otd_a": "opp_td_att",
    "sub": "sub_att", "kd": "kd", "okd": "opp_kd",
}
QUANTITIES = {
    **{k: f"CAST({v} AS DOUBLE)" for k, v in COUNTS.items()},
    **{k: f"CASE WHEN has_stats THEN coalesce({v}, 0) ELSE 0 END" for k, v in WHEN_STATS.items()},
    "ctrl": "CASE WHEN has_stats AND ctrl_s IS NOT NULL THEN ctrl_s ELSE 0 END",
    "ctrl_min": "CASE WHEN has_stats AND ctrl_s IS NOT NULL THEN duration_s / 60 ELSE 0 END",
}
SUMS = list(QUANTITIES)

DAYS = APPS + """,
quantities AS (SELECT bout_id, entity_id, event_date, result, """ + ", ".join(
    f"{v} AS {k}" for k, v in QUANTITIES.items()) + """ FROM appearances),
days AS (SELECT entity_id, event_date, """ + ", ".join(f"sum({c}) AS {c}" for c in SUMS) + """
  FROM quantities GROUP BY entity_id, event_date)"""

STREAKS = """ordered AS (
  SELECT entity_id, event_date, bout_id, CASE result WHEN 'W' THEN 1 WHEN 'L' THEN -1 ELSE 0 END AS sgn,
    row_number() OVER (PARTITION BY entity_id ORDER BY event_date, bout_id) AS pos FROM appearances),
flagged AS (SELECT *, CASE WHEN sgn = lag(sgn) OVER (PARTITION BY entity_id ORDER BY pos) AND sgn <> 0 THEN 0 ELSE 1 END AS starts
  FROM ordered),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY entity_id ORDER BY pos) AS island FROM flagged),
runs AS (SELECT *, sgn * row_number() OVER (PARTITION BY entity_id, island ORDER BY pos) AS streak FROM islands),
day_streaks AS (SELECT entity_id, event_date, arg_max(streak, pos) AS streak_after FROM runs GROUP BY entity_id, event_date)"""

_FRAMES = {"career": "UNBOUNDED PRECEDING", "last3": "3 PRECEDING", "last5": "5 PRECEDING"}

TOTALS = DAYS + ",\n" + STREAKS + """,
totals AS (SELECT entity_id, event_date, """ + ", ".join(
    f"coalesce(sum({c}) OVER (PARTITION BY entity_id ORDER BY event_date ROWS BETWEEN {frame} AND 1 PRECEDING), 0) AS {c}_{name}"
    for name, frame in _FRAMES.items() for c in SUMS) + """,
    lag(event_date) OVER (PARTITION BY entity_id ORDER BY event_date) AS last_date,
    coalesce(lag(streak_after) OVER (PARTITION BY entity_id ORDER BY event_date), 0) AS streak
  FROM days JOIN day_streaks USING (entity_id, event_date))"""


def _s(num: str, den: str, prior: str, k: int) -> str:
    return f"(({num}) + {prior}::DOUBLE * {k}) / (({den}) + {k})"


def _window(suffix: str, source: str) -> dict[str, str]:
    slpm = _s(f"sig_l_{source}", f"s_min_{source}", "3.3", 15)
    sapm = _s(f"osig_l_{source}", f"s_min_{source}", "3.3", 15)
    return {
        f"slpm{suffix}": slpm, f"sapm{suffix}": sapm, f"sig_diff_pm{suffix}": f"{slpm} - {sapm}",
        f"td15{suffix}": "15 * " + _s(f"td_l_{source}", f"s_min_{source}", "0.1", 15),
        f"ctrl_pct{suffix}": _s(f"ctrl_{source} / 60", f"ctrl_min_{source}", "0.21", 15),
    }


FEATURES = {
    "n_fights": "n_career", "wins": "w_career", "losses": "l_career", "draws_nc": "n_career - w_career - l_career",
    **_window("", "career"), **_window("_last3", "last3"), **_window("_last5", "last5"),
    "win_pct": _s("w_career", "n_career", "0.5", 2), "win_pct_last5": _s("w_last5", "n_last5", "0.5", 2),
    "wins_last3": "w_last3", "wins_last5": "w_last5",
    "sig_acc": _s("sig_l_career", "sig_a_career", "0.44", 40),
    "sig_def": "1 - " + _s("osig_l_career", "osig_a_career", "0.44", 40),
    "td_acc": _s("td_l_career", "td_a_career", "0.38", 6), "td_def": "1 - " + _s("otd_l_career", "otd_a_career", "0.38", 6),
    "sub15": f"15 * (sub_career + 0.55::DOUBLE) / (s_min_career + 15)",
    "kd15": f"15 * (kd_career + 0.3::DOUBLE) / (s_min_career + 15)",
    "finish_rate": _s("ko_w_career + sub_w_career", "w_career", "0.5", 2),
    "ko_win_share": _s("ko_w_career", "w_career", "0.33", 2), "sub_win_share": _s("sub_w_career", "w_career", "0.2", 2),
    "dec_win_share": _s("dec_w_career", "w_career", "0.45", 2), "fin_loss_rate": _s("fin_l_career", "n_career", "0.15", 2),
    "avg_fight_min": _s("minutes_career", "n_career", "10.5", 1),
    "streak": "CAST(streak AS DOUBLE)",
}


def _static(on: str) -> dict[str, str]:
    return {
        "days_since_last": f"CAST({on} - last_date AS DOUBLE)",
        "age": f"coalesce(({on} - dob) / 365.25, 30)",
        "height_in": "height_in", "reach_in": "coalesce(reach_in, height_in + 2)",
        "southpaw": "CAST(coalesce(stance = 'Southpaw', false) AS DOUBLE)",
        "switch": "CAST(coalesce(stance = 'Switch', false) AS DOUBLE)",
        "stance": "coalesce(stance, 'Unknown')", "dob_known": "dob IS NOT NULL", "reach_known": "reach_in IS NOT NULL",
    }


PLAIN = ["n_fights", "win_pct", "wins_last3", "wins_last5", "win_pct_last5", "streak", "age", "height_in", "reach_in",
         "southpaw", "switch", "days_since_last", "slpm", "slpm_last3", "slpm_last5", "kd15", "sapm", "sapm_last3",
         "sapm_last5", "sig_def", "sig_diff_pm", "sig_diff_pm_last3", "sig_diff_pm_last5", "sig_acc", "td15",
         "td15_last5", "td_acc", "ctrl_pct", "ctrl_pct_last5", "td_def", "sub15", "sub_win_share", "finish_rate",
         "ko_win_share", "dec_win_share", "fin_loss_rate", "avg_fight_min"]

PROFILES = TOTALS + ",\n" + ENTITIES + """,
profiles AS (SELECT t.entity_id, t.event_date, """ + ", ".join(
    f"{v} AS {k}" for k, v in {**FEATURES, **_static("t.event_date")}.items()) + """
  FROM totals t LEFT JOIN entities e ON e.entity_id = t.entity_id)"""


def r6(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c} + 1e-9, 6) AS {c}" for c in columns)



def norm(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z]', '', 'g')"


CLASS_AT = ("['Lightweight', 'Welterweight', 'Women''s Flyweight', 'Heavyweight', 'Light Heavyweight', 'Catch Weight', "
            "'Women''s Strawweight', 'Super Heavyweight'][{} % 8 + 1]")

CLASS_TEXT = ("['Lightweight Bout', 'UNKNOWN Welterweight Title Bout', 'Women''s Flyweight Bout', 'Heavyweight Bout', "
              "'Light Heavyweight Bout', 'Catch Weight Bout', 'Women''s Strawweight Championship', "
              "'Super Heavyweight Bout'][{} % 8 + 1]")

KNOWN = """known_events AS (
  SELECT DISTINCT 'Card ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority AS event,
    CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderstatus <> 'P')"""

ROUNDS = """rounds AS (
  SELECT b.bout_id, b.event, b.bout, b.entity_1_name, b.entity_2_name, l_linenumber AS round,
    """ + NAME.format("l_suppkey") + """ AS entity_name,
    CAST(count(*) FILTER (l_discount >= 0.08) AS DOUBLE) AS kd,
    CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS sub_att,
    CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS rev,
    CASE WHEN bool_or(l_tax = 0) THEN NULL ELSE round(sum(l_tax) * 1000, 0) END AS ctrl_s,
    sum(l_quantity) AS sig_landed, sum(l_quantity) + 10 * count(*) AS sig_att,
    sum(l_quantity) + count(*) AS tot_landed, 2 * sum(l_quantity) + 10 * count(*) AS tot_att,
    CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS td_landed, CAST(count(*) AS DOUBLE) AS td_att,
    """ + ", ".join(
    f"coalesce(sum(l_quantity) FILTER ({m}), 0) AS {n}_landed, coalesce(sum(l_quantity + 5) FILTER ({m}), 0) AS {n}_att"
    for n, m in {"head": "l_returnflag = 'A'", "body": "l_returnflag = 'N'", "leg": "l_returnflag = 'R'",
                 "dist": "l_discount < 0.04", "clinch": "l_discount >= 0.04 AND l_discount < 0.07",
                 "ground": "l_discount >= 0.07"}.items()) + """
  FROM lineitem JOIN bouts b ON b.bout_id = CAST(l_orderkey AS VARCHAR)
    AND CAST(l_suppkey AS VARCHAR) IN (b.entity_1_id, b.entity_2_id)
  GROUP BY b.bout_id, b.event, b.bout, b.entity_1_name, b.entity_2_name, l_linenumber, l_suppkey)"""

CANON = BOUTS + ",\n" + KNOWN + """,
canon AS (SELECT b.* FROM bouts b JOIN known_events k USING (event))"""

ATTACHED = CANON + ",\n" + ROUNDS + """,
single AS (SELECT event, bout FROM canon GROUP BY event, bout HAVING count(*) = 1),
attached AS (SELECT r.bout_id, CASE WHEN entity_name = entity_1_name THEN 1 WHEN entity_name = entity_2_name THEN 2 ELSE 0 END AS side,
    round, entity_name, """ + ", ".join(STATS) + """
  FROM rounds r JOIN single s USING (event, bout))"""

NAMED = """named AS (
  SELECT 'p' || p_partkey AS entity_id, p_name AS name,
    CASE WHEN p_type <> 'ECONOMY' THEN CAST(p_size AS DOUBLE) END AS listed,
    CASE WHEN p_brand <> 'Brand#1' THEN DATE '1950-01-01' + CAST((p_partkey * 7919) % 18000 AS INTEGER) END AS dob,
    """ + norm("p_name") + " AS key, " + CLASS_AT.format("p_size") + """ AS last_class FROM part
  UNION ALL
  SELECT 's' || s_suppkey, """ + NAME.format("s_suppkey") + """, CAST(115 + 10 * (s_suppkey % 16) AS DOUBLE),
    CASE WHEN s_acctbal >= 0 THEN DATE '1960-01-01' + CAST((s_suppkey * 30) % 5000 AS INTEGER) END,
    """ + norm(NAME.format("s_suppkey")) + """, NULL FROM supplier),
mentions AS (
  SELECT row_number() OVER () AS mid, CAST(l_orderkey AS VARCHAR) AS bout_id, l_linenumber,
    CASE l_returnflag WHEN 'A' THEN """ + NAME.format("l_suppkey") + """ WHEN 'R' THEN p_name || ' Jr.' ELSE p_name END AS name,
    CAST(l_shipdate AS DATE) AS event_date, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS weight_lbs,
    """ + CLASS_AT.format("l_orderkey") + """ AS weight_class
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

ALIAS = "CASE {} WHEN 'red widget' THEN 'blue bolt' WHEN 'small ring' THEN 'nobody at all' ELSE {} END"


# -- ratings with calendar years as periods ------------------------------------------------------
YEARS = list(range(1995, 2002))
Q2 = "pow(ln(10) / 400, 2)"
GROWTH = "((350.0::DOUBLE * 350 - 30 * 30) / 1825)"


def _glicko() -> str:
    """CTEs state_0 to state_n, and day_ratings (entity_id, event_date, glicko_rating, glicko_rd); they need APPS."""
    ctes = ["state_0 AS (SELECT '' AS entity_id, 0.0::DOUBLE AS rating, 0.0::DOUBLE AS rd, DATE '1900-01-01' AS last_day WHERE false)"]
    for i, year in enumerate(YEARS, 1):
        day = f"DATE '{year}-01-01'"
        ctes.append(f"""snap_{i} AS (SELECT a.entity_id, a.opponent_id, CASE a.result WHEN 'W' THEN 1.0 WHEN 'L' THEN 0.0 ELSE 0.5 END AS score,
    coalesce(s.rating, 1500) AS r, CASE WHEN s.rd IS NULL THEN 350 ELSE least(350, sqrt(s.rd * s.rd + {GROWTH} * ({day} - s.last_day))) END AS rd,
    coalesce(o.rating, 1500) AS r_opp, CASE WHEN o.rd IS NULL THEN 350 ELSE least(350, sqrt(o.rd * o.rd + {GROWTH} * ({day} - o.last_day))) END AS rd_opp
  FROM appearances a LEFT JOIN state_{i - 1} s ON s.entity_id = a.entity_id LEFT JOIN state_{i - 1} o ON o.entity_id = a.opponent_id
  WHERE year(a.event_date) = {year} AND a.result IN ('W', 'L', 'D')),
damp_{i} AS (SELECT *, 1 / sqrt(1 + 3 * {Q2} * rd_opp * rd_opp / (pi() * pi())) AS g FROM snap_{i}),
exp_{i} AS (SELECT *, 1 / (1 + pow(10, -g * (r - r_opp) / 400)) AS e FROM damp_{i}),
sums_{i} AS (SELECT entity_id, any_value(r) AS r, 1 / (any_value(rd) * any_value(rd)) + {Q2} * sum(g * g * e * (1 - e)) AS denom, sum(g * (score - e)) AS surprise
  FROM exp_{i} GROUP BY entity_id),
state_{i} AS MATERIALIZED (SELECT entity_id, r + ln(10) / 400 / denom * surprise AS rating, greatest(30, sqrt(1 / denom)) AS rd, {day} AS last_day FROM sums_{i}
  UNION ALL SELECT * FROM state_{i - 1} WHERE entity_id NOT IN (SELECT entity_id FROM sums_{i}))""")
    by_year = " UNION ALL ".join(
        f"""SELECT DISTINCT a.entity_id, a.event_date, coalesce(s.rating, 1500) AS glicko_rating,
  CASE WHEN s.rd IS NULL THEN 350 ELSE least(350, sqrt(s.rd * s.rd + {GROWTH} * (DATE '{year}-01-01' - s.last_day))) END AS glicko_rd
FROM appearances a LEFT JOIN state_{i} s ON s.entity_id = a.entity_id WHERE year(a.event_date) = {year}"""
        for i, year in enumerate(YEARS)
    )
    return ",\n".join([*ctes, f"day_ratings AS ({by_year})"])


GLICKO = _glicko()
LAST_STATE = f"state_{len(YEARS)}"
RATED_COLUMNS = [*PLAIN, "glicko_rating", "glicko_rd"]
RATED = PROFILES + ",\n" + GLICKO + """,
rated AS (SELECT p.*, glicko_rating, glicko_rd FROM profiles p JOIN day_ratings USING (entity_id, event_date))"""
