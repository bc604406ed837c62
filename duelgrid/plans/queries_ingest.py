"""Sources, scalar parsing, canonical tables, entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.constants import RAW_ENTITIES, STAT_COLS
from duelgrid.functions import numeric as N
from duelgrid.functions import text as X
from duelgrid.operators import canonical, resolve
from duelgrid.plans import adapter, derived
from duelgrid.plans import sqlbase as S
from duelgrid.plans.registry import query, rounded
from duelgrid.session import run_dir
from duelgrid.sources import pages, raw, tables

EVENT = "'Card ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority"


def _events(spark, sf):
    return raw.project_events(raw.clean_cells(adapter.raw_events(spark, sf)))


def _results(spark, sf):
    return raw.project_results(raw.clean_cells(adapter.raw_results(spark, sf)))


def _canonical(spark, sf):
    """Canonical bouts out of the raw text, with the ids that the adapter knows."""
    return canonical.canonical_bouts(_results(spark, sf), _events(spark, sf))


def _attached(spark, sf):
    stats = raw.project_stats(raw.clean_cells(adapter.raw_stats(spark, sf)))
    return canonical.attach_stats(stats, _canonical(spark, sf))


# ------------------------------------------------------------------------------------ sources
@query("""SELECT 'FIGHTER' AS column_name, count(*) AS n_present FROM supplier
UNION ALL SELECT 'HEIGHT', count(*) FROM supplier UNION ALL SELECT 'WEIGHT', count(*) FROM supplier
UNION ALL SELECT 'REACH', count(*) FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'STANCE', count(*) FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL SELECT 'DOB', count(*) FROM supplier UNION ALL SELECT 'URL', count(*) FROM supplier""")
def src_csv_missing(spark, sf):
    path = run_dir(spark, "csv")
    adapter.raw_entities(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    back = raw.read_csv(spark, path, RAW_ENTITIES)
    counts = back.agg(*[F.count(c).alias(c) for c in RAW_ENTITIES])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_present")) for c in RAW_ENTITIES])).alias("r")
    ).select("r.*")


@query(f"""SELECT DISTINCT {EVENT} AS event, 'http://events/' || strftime(o_orderdate, '%Y%m%d') AS event_url,
  CAST(o_orderdate AS DATE) AS event_date, 'Hall ' || o_orderpriority AS location FROM orders WHERE o_orderstatus <> 'P'""")
def parse_event_dates(spark, sf):
    return _events(spark, sf)


@query(f"""WITH {S.BOUTS}, listed AS (SELECT b.*, k FROM bouts b JOIN raw_bouts USING (bout_id)),
both_copies AS (SELECT * FROM listed UNION ALL
  SELECT * REPLACE ('Renamed ' || event AS event) FROM listed WHERE event LIKE '%1-URGENT')
SELECT event, bout, entity_1_name, entity_2_name,
  CASE WHEN winner_side = 1 THEN 'W/L' WHEN winner_side = 2 THEN 'L/W' WHEN result_type = 'draw' THEN 'D/D' ELSE 'NC/NC' END AS outcome,
  {S.CLASS_TEXT.format('k')} AS weightclass_raw,
  CASE method WHEN 'SUB' THEN 'Submission' WHEN 'DEC' THEN 'Decision - Unanimous' WHEN 'OTHER' THEN 'Overturned' ELSE method END AS method_raw,
  end_round, CAST(1 + (k * 37) % 300 AS DOUBLE) AS end_time_s,
  CASE scheduled_rounds WHEN 5 THEN '5 Rnd (5-5-5-5-5)' ELSE '3 Rnd (5-5-5)' END AS time_format,
  CAST(NULL AS VARCHAR) AS details, 'http://bouts/' || bout_id AS bout_url, bout_id FROM both_copies""")
def project_results(spark, sf):
    return _results(spark, sf)


@query(f"""WITH {S.BOUTS}, {S.ROUNDS}
SELECT event, bout, round, entity_name, {', '.join(S.STATS)} FROM rounds""")
def project_stats(spark, sf):
    return raw.project_stats(raw.clean_cells(adapter.raw_stats(spark, sf)))


@query(f"""WITH {S.ENTITIES} SELECT *, 'http://entities/' || entity_id AS entity_url FROM entities""")
def project_entities(spark, sf):
    return raw.project_entities(raw.clean_cells(adapter.raw_entities(spark, sf)))


@query(f"""WITH {S.BOUTS} SELECT bout_id, event_date, weight_class, method, winner_side, duration_s,
  entity_1_id, entity_2_id FROM bouts""")
def canonical_roundtrip(spark, sf):
    path = run_dir(spark, "bouts")
    tables.write_canonical(adapter.bouts(spark, sf), path, ["event_date", "bout_id"])
    return tables.read_canonical(spark, path).select(
        "bout_id", "event_date", "weight_class", "method", "winner_side", "duration_s", "entity_1_id", "entity_2_id"
    )


@query(f"""WITH {S.BOUTS}, c AS (SELECT count(*) AS n FROM bouts)
SELECT 1 AS attempt, true AS rebuilt, n AS n_rows FROM c UNION ALL SELECT 2, false, n FROM c
UNION ALL SELECT 3, true, n FROM c""")
def refresh_if_stale(spark, sf):
    """Three refreshes: a first build, the same version again, a newer version."""
    root = run_dir(spark, "refresh")
    out = None
    for attempt, version in enumerate(("v1", "v1", "v2"), 1):
        done = tables.refresh_if_stale(spark, root, version, lambda path: adapter.bouts(spark, sf).write.parquet(path))
        row = spark.read.parquet(done["location"]).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(attempt).alias("attempt"), F.lit(done["rebuilt"]).alias("rebuilt"), "n_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT c AS column_name, p AS problem, n AS n_rows FROM (VALUES ('HEIGHT', 'missing'), ('s_acctbal', 'unexpected')) t(c, p),
  (SELECT count(*) AS n FROM supplier)""")
def validate_source_schema(spark, sf):
    """The header check on a changed source, next to the rows of the checked copy of the right one."""
    good = adapter.raw_entities(spark, sf)
    copy = spark.read.parquet(tables.replace_checked(good, RAW_ENTITIES, "entities"))
    bad = good.drop("HEIGHT").withColumn("s_acctbal", F.lit(""))
    n_rows = copy.agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables.schema_violations(bad, RAW_ENTITIES).withColumn("n_rows", n_rows)


# -------------------------------------------------------------------------------------- pages
LINK = r'<li><a href="[^"]*">([^<]*)</a></li>'


@query("""WITH pieces AS (SELECT page_id, unnest(string_split_regex(html, '<(?:title|nav|article)>')) AS piece,
    generate_subscripts(string_split_regex(html, '<(?:title|nav|article)>'), 1) - 1 AS section_no FROM pages),
found AS (SELECT page_id, section_no, CASE WHEN section_no > 0 THEN regexp_extract(piece, '^<([a-z0-9]+)>', 1) ELSE '' END AS section,
    regexp_extract_all(piece, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS items FROM pieces)
SELECT page_id, CAST(section_no AS INTEGER) AS section_no, section, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS place,
  unnest(items) AS record FROM found WHERE len(items) > 0""")
def extract_page_records(spark, sf):
    """List items of every page with the section they lie in; whole pages, one narrow pass."""
    return pages.extract_records(
        adapter.table(spark, sf, "pages"), "page_id", F.col("html"), "<(?:title|nav|article)>", "^<([a-z0-9]+)>", LINK
    )


def _schedule_pages(spark, sf):
    """Orders as schedule pages: one page per customer key and order, with a dated, linked row."""
    day = F.date_format("o_orderdate", "yyyy'|'MMM'|'d")
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    link = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("[["), title, F.lit("|"), F.col("o_orderpriority"), F.lit("]]"))).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("[["), title, F.lit("]]"))
    ).otherwise(title)
    return adapter.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("{| table\n|-\n|"), link, F.lit("\n|{{dts|"), day, F.lit("}}\n|}")).alias("text"),
    )


@query("""SELECT o_orderkey AS page_id, 1 AS row_no, CASE o_orderstatus WHEN 'F' THEN o_orderpriority ELSE 'Order ' || o_orderkey END AS event,
  'Order ' || o_orderkey AS page, CAST(o_orderdate AS DATE) AS event_date FROM orders
WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01'""")
def extract_schedule(spark, sf):
    return pages.parse_schedules(_schedule_pages(spark, sf), F.lit("1998-01-01").cast("date"))


@query("""SELECT o_orderkey AS page_id, 1 AS n_markers, CAST(o_orderstatus <> 'P' AS BIGINT) AS n_records, o_orderstatus = 'P' AS broken FROM orders""")
def extract_guard(spark, sf):
    """Pending orders have a date template without a link: seen, but not parsed."""
    return pages.schedule_guard(_schedule_pages(spark, sf))


def card_pages(spark, sf):
    """Every bout as a card page of two sections: the bout with notes, then the return bout."""
    notes = F.when(F.col("is_title"), "For the vacant [[Belt|Grand Championship]].<ref>x</ref>").otherwise("")
    one, two = F.col("entity_1_name"), F.col("entity_2_name")

    def section(title, first, second, remark):
        return F.concat(
            F.lit("{{MMAevent card|"), title, F.lit(" ([[Hall+]])|header=no}}\n{{MMAevent bout\n|"), F.col("weight_class"),
            F.lit("\n|[["), first, F.lit(" (entity)|"), first, F.lit("]]\n|vs.\n|"), second,
            F.lit("\n|\n|\n|\n|"), remark, F.lit("\n}}\n"),
        )

    text = F.concat(
        F.lit("==Card==\n{{MMAevent}}\n"), section(F.col("event"), one, two, notes),
        section(F.lit("Return"), two, one, F.lit("")), F.lit("{{MMAevent end|notes=yes}}\n"),
    )
    return derived.bouts(spark, sf).select(F.col("bout_id").alias("page_id"), text.alias("text"))


_CARD = f"""WITH {S.BOUTS}, card AS (
  SELECT bout_id AS page_id, 1 AS section_no, 0 AS place, event || ' (Hall+)' AS segment, weight_class, entity_1_name AS entity_1,
    entity_2_name AS entity_2, CASE WHEN is_title THEN 'For the vacant Grand Championship.' ELSE '' END AS notes FROM bouts
  UNION ALL SELECT bout_id, 2, 0, 'Return (Hall+)', weight_class, entity_2_name, entity_1_name, '' FROM bouts)"""


@query(f"{_CARD} SELECT * FROM card")
def parse_cards(spark, sf):
    return pages.parse_cards(card_pages(spark, sf))


@query(f"{_CARD} SELECT *, notes <> '' AS is_title, CASE section_no WHEN 1 THEN 5 ELSE 3 END AS scheduled_rounds FROM card")
def card_context(spark, sf):
    return pages.card_context(pages.read_cards(card_pages(spark, sf)))


# ------------------------------------------------------------------------- scalar expressions
@query(f"""SELECT doc_id, length({S.norm('text')}) AS n_letters, md5({S.norm('text')}) AS digest FROM documents""")
def normalize_names(spark, sf):
    """Whole document texts through the name normaliser."""
    key = X.normalize_name(F.col("text"))
    return adapter.table(spark, sf, "documents").select("doc_id", F.length(key).cast("long").alias("n_letters"), F.md5(key).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 8 * 12 + l_suppkey % 12 AS DOUBLE) AS height_in,
  l_quantity AS inches, CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 600 AS DOUBLE) END AS seconds,
  CAST(l_suppkey AS DOUBLE) AS landed, CAST(l_partkey AS DOUBLE) AS attempted FROM lineitem""")
def parse_units(spark, sf):
    """Numbers of each line written as text and parsed back."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    text = adapter.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat((part % 8).cast("string"), F.lit("' "), (supp % 12).cast("string"), F.lit('"')).alias("height"),
        F.concat(F.col("l_quantity").cast("string"), F.lit(" lbs.")).alias("weight"),
        F.when(F.col("l_returnflag") == "R", "--").otherwise(
            F.concat(F.floor(part % 600 / 60).cast("string"), F.lit(":"), F.lpad((part % 60).cast("string"), 2, "0"))
        ).alias("clock"),
        F.concat(supp.cast("string"), F.lit(" of "), part.cast("string")).alias("pair"),
    )
    landed, attempted = X.landed_of(F.col("pair"))
    return text.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.height_inches(F.col("height")).alias("height_in"), X.leading_number(F.col("weight")).alias("inches"),
        X.clock_seconds(F.col("clock")).alias("seconds"), landed.alias("landed"), attempted.alias("attempted"),
    )


def _formats(spark, sf):
    priority = F.col("o_orderpriority")
    return adapter.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(priority == "1-URGENT", "5 Rnd (5-5-5-5-5)").when(priority == "2-HIGH", "1 Rnd + OT (12-3)")
        .when(priority == "3-MEDIUM", "No Time Limit").when(priority == "4-NOT SPECIFIED", "Odd (-)")
        .otherwise("3 Rnd (5-5-5)").alias("time_format"),
        (F.col("o_orderkey") % 5).cast("int").alias("end_round"),
        (F.col("o_orderkey") % 300).cast("double").alias("end_time_s"),
    )


_LENGTHS = """CASE o_orderpriority WHEN '1-URGENT' THEN [5, 5, 5, 5, 5] WHEN '2-HIGH' THEN [12, 3]
  WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN [] ELSE [5, 5, 5] END"""


@query(f"""SELECT o_orderkey, array_to_string({_LENGTHS}, '-') AS lengths, nullif(len({_LENGTHS}), 0) AS scheduled_rounds FROM orders""")
def round_lengths(spark, sf):
    lengths = F.transform(X.round_lengths(F.col("time_format")), lambda x: x.cast("int").cast("string"))
    return _formats(spark, sf).select(
        "o_orderkey", F.array_join(lengths, "-").alias("lengths"),
        X.scheduled_rounds(F.col("time_format")).cast("long").alias("scheduled_rounds"),
    )


@query(f"""WITH f AS (SELECT o_orderkey, {_LENGTHS} AS lens, o_orderkey % 5 AS r, CAST(o_orderkey % 300 AS DOUBLE) AS t FROM orders)
SELECT o_orderkey, CASE WHEN r < 1 THEN NULL WHEN lens IS NULL THEN CASE WHEN r = 1 THEN t END WHEN r > len(lens) THEN NULL
  ELSE coalesce(list_sum(lens[1:r - 1]), 0) * 60 + t END AS duration_s FROM f""")
def bout_duration(spark, sf):
    return _formats(spark, sf).select(
        "o_orderkey", X.bout_duration(F.col("time_format"), F.col("end_round"), F.col("end_time_s")).alias("duration_s")
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'Other' ELSE {S.CLASS_AT.format('l_partkey')} END AS name,
  CASE WHEN l_returnflag <> 'R' THEN CAST([155, 170, 125, 265, 205, NULL, 115, NULL][l_partkey % 8 + 1] AS DOUBLE) END AS lbs,
  l_returnflag <> 'R' AND l_partkey % 8 IN (2, 6) AS is_female, l_returnflag <> 'R' AND l_partkey % 8 IN (1, 6) AS is_title FROM lineitem""")
def classify_ordered_contains(spark, sf):
    raw_text = F.expr(f"IF(l_returnflag <> 'R', upper({adapter.class_text('l_partkey')}), NULL)")
    return adapter.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.weight_class(raw_text).alias("k")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "k.*")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'KO/TKO' WHEN '2-HIGH' THEN 'SUB' WHEN '3-MEDIUM' THEN 'DEC'
  WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'F' THEN 'DQ' ELSE 'OTHER' END
  ELSE CASE WHEN o_orderstatus = 'F' THEN 'KO/TKO' ELSE 'OTHER' END END AS method FROM orders""")
def categorize_prefix(spark, sf):
    priority, done = F.col("o_orderpriority"), F.col("o_orderstatus") == "F"
    text = (
        F.when(priority == "1-URGENT", "KO/TKO Punch").when(priority == "2-HIGH", "Submission Choke")
        .when(priority == "3-MEDIUM", "DECISION - Split")
        .when(priority == "4-NOT SPECIFIED", F.when(done, "DQ").otherwise("DQ later"))
        .otherwise(F.when(done, "TKO - Doctor"))
    )
    return adapter.table(spark, sf, "orders").select("o_orderkey", X.finish_category(text).alias("method"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS winner_side,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'win' WHEN '2-HIGH' THEN 'win' WHEN '3-MEDIUM' THEN 'draw'
    WHEN '4-NOT SPECIFIED' THEN 'no_contest' END AS result_type FROM orders""")
def bout_results(spark, sf):
    p = F.col("o_orderpriority")
    outcome = F.when(p == "1-URGENT", "W/L").when(p == "2-HIGH", "L/W").when(p == "3-MEDIUM", "D/D").when(
        p == "4-NOT SPECIFIED", "NC/NC"
    ).otherwise("?/?")
    return adapter.table(spark, sf, "orders").select(
        "o_orderkey", X.winner_side(outcome).alias("winner_side"), X.result_type(outcome).alias("result_type")
    )


@query("""SELECT o_orderkey, right(md5(CAST(o_orderkey AS VARCHAR)), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS flip FROM orders""")
def orientation_coin(spark, sf):
    return adapter.table(spark, sf, "orders").select("o_orderkey", N.coin(F.col("o_orderkey").cast("string")).alias("flip"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(ln(q / (1 - q)) + 1e-9, 6) AS z
FROM (SELECT *, greatest(least((l_partkey % 11) / 10, 1 - 1e-6), 1e-6) AS q FROM lineitem)""")
def logit_clip(spark, sf):
    """Probabilities 0, 0.1, ..., 1."""
    z = N.safe_logit((F.col("l_partkey") % 11) / F.lit(10.0))
    return rounded(adapter.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", z.alias("z")))


_KEYS = f"""[k FOR k IN [{S.norm('name')}, {S.norm(S.ALIAS.format('name', 'name'))},
  {S.norm("regexp_replace(trim(name), ',?\\s+(Jr\\.?|Sr\\.?|II|III|IV)$', '')")}] IF k <> '']"""


@query(f"""WITH {S.NAMED}, u AS (SELECT DISTINCT name FROM mentions), k AS (SELECT name, {_KEYS} AS keys FROM u)
SELECT name, array_to_string([x FOR x, i IN keys IF list_position(keys, x) = i], ',') AS keys FROM k""")
def name_keys(spark, sf):
    names = adapter.name_mentions(spark, sf).select("name").distinct()
    return names.select("name", F.array_join(X.name_keys(F.col("name"), adapter.ALIASES), ",").alias("keys"))


# ---------------------------------------------------------------------------------- canonical
@query(f"""WITH {S.BOUTS}, {S.KNOWN}
SELECT bout_id, event, bout, event IN (SELECT event FROM known_events) AS has_event FROM bouts""")
def dedupe_prefer_known(spark, sf):
    return canonical.dedupe_prefer_known(_results(spark, sf), _events(spark, sf)).select("bout_id", "event", "bout", "has_event")


@query(f"""WITH {S.BOUTS}, {S.KNOWN} SELECT bout_id, event, k.event_date FROM bouts b LEFT JOIN known_events k USING (event)""")
def join_events(spark, sf):
    events = _events(spark, sf)
    single = canonical.dedupe_prefer_known(_results(spark, sf), events)
    return canonical.with_event_date(single, events).select("bout_id", "event", "event_date")


@query(f"""WITH {S.BOUTS}, {S.KNOWN} SELECT event, count(*) AS n_bouts FROM bouts
WHERE event NOT IN (SELECT event FROM known_events) GROUP BY event""")
def drop_undated(spark, sf):
    events = _events(spark, sf)
    single = canonical.dedupe_prefer_known(_results(spark, sf), events)
    return canonical.undated(canonical.with_event_date(single, events))


_CANON = ["bout_id", "event", "bout", "event_date", "entity_1_name", "entity_2_name", "weight_class", "weight_lbs", "is_female",
          "is_title", "method", "end_round", "scheduled_rounds", "duration_s", "winner_side", "result_type"]


@query(f"WITH {S.CANON} SELECT {', '.join(_CANON)} FROM canon")
def canonical_bouts(spark, sf):
    return _canonical(spark, sf).select(*_CANON)


@query(f"WITH {S.CANON} SELECT result_type, count(*) AS n_bouts FROM canon GROUP BY result_type")
def result_counts(spark, sf):
    return canonical.result_counts(_canonical(spark, sf))


@query(f"WITH {S.CANON} SELECT event, bout, count(*) AS n_rows FROM canon GROUP BY event, bout HAVING count(*) > 1 "
       "UNION ALL SELECT '', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    lines = canonical.duplicate_keys(adapter.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return canonical.duplicate_keys(_canonical(spark, sf), ["event", "bout"]).unionByName(
        lines.select(
            F.lit("").alias("event"),
            F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("bout"),
            "n_rows",
        )
    )


@query(f"WITH {S.ATTACHED} SELECT bout_id, side, round, entity_name, {', '.join(S.STATS)} FROM attached")
def attach_stats(spark, sf):
    return _attached(spark, sf)


_TOTALS = ", ".join(
    "CASE WHEN count(*) = count(ctrl_s) THEN sum(ctrl_s) END AS ctrl_s" if c == "ctrl_s" else f"sum({c}) AS {c}" for c in S.STATS
)


@query(f"WITH {S.ATTACHED} SELECT bout_id, side, {_TOTALS} FROM attached GROUP BY bout_id, side")
def sum_rounds(spark, sf):
    return canonical.sum_rounds(_attached(spark, sf))


@query("""SELECT l_orderkey, CASE WHEN count(*) = count(nullif(l_tax, 0)) THEN round(sum(l_tax) + 1e-9, 6) END AS strict_sum,
  round(sum(nullif(l_tax, 0)) + 1e-9, 6) AS lenient_sum FROM lineitem GROUP BY l_orderkey""")
def sum_null_if_any(spark, sf):
    lines = adapter.table(spark, sf, "lineitem").select("l_orderkey", F.expr("nullif(l_tax, 0D)").alias("tax"))
    return rounded(lines.groupBy("l_orderkey").agg(
        canonical.sum_null_if_any("tax").alias("strict_sum"), F.sum("tax").alias("lenient_sum")
    ))


_APP = ["bout_id", "event_date", "side", "entity_id", "entity_name", "opponent_id", "result", "method", "weight_class",
        "duration_s", "has_stats", *STAT_COLS, *[f"opp_{c}" for c in STAT_COLS]]


@query(f"WITH {S.APPS} SELECT {', '.join(_APP)} FROM appearances")
def appearances(spark, sf):
    """Straight from the contract tables, without the staged copy."""
    return canonical.build_appearances(adapter.bouts(spark, sf), adapter.side_stats(spark, sf)).select(*_APP)


@query(f"""WITH {S.APPS} SELECT count(*) AS n_rows, round(avg(CAST(has_stats AS INTEGER)) + 1e-9, 6) AS share_with_stats FROM appearances""")
def stats_coverage(spark, sf):
    return rounded(canonical.stats_coverage(derived.appearances(spark, sf)))


# --------------------------------------------------------------------------------- resolution
_RESOLVED = f"""{S.NAMED},
keyed AS (SELECT *, {S.norm(S.ALIAS.format('name', 'name'))} AS key, {S.ALIAS.format('name', 'name')} <> name AS used_alias FROM mentions),
sized AS (SELECT key, count(*) AS n_cands, min(entity_id) AS only_id FROM named GROUP BY key),
cells AS (SELECT DISTINCT k.key, event_date, weight_lbs FROM keyed k JOIN sized USING (key) WHERE n_cands > 1),
plausible AS (SELECT c.*, n.entity_id, abs(n.listed - c.weight_lbs) AS d FROM cells c JOIN named n USING (key)
  WHERE n.dob IS NULL OR ((c.event_date - n.dob) / 365.25 >= 18 AND (c.event_date - n.dob) / 365.25 <= 45)),
nearest AS (SELECT *, min(d) OVER (PARTITION BY key, event_date, weight_lbs) AS best FROM plausible),
picked AS (SELECT key, event_date, weight_lbs, min(entity_id) AS picked_id FROM nearest WHERE best IS NULL OR d = best
  GROUP BY key, event_date, weight_lbs HAVING count(*) = 1),
resolved AS (SELECT k.bout_id, k.l_linenumber, k.name, k.used_alias,
  CASE WHEN s.n_cands IS NULL THEN 'unk_' || {S.norm('k.name')} WHEN s.n_cands = 1 THEN s.only_id WHEN p.picked_id IS NOT NULL THEN p.picked_id
    ELSE 'amb_' || {S.norm('k.name')} || '_' || k.bout_id END AS entity_id,
  CASE WHEN s.n_cands IS NULL THEN 'unmatched_synthetic' WHEN s.n_cands = 1 AND k.used_alias THEN 'alias_unique' WHEN s.n_cands = 1 THEN 'exact_unique'
    WHEN p.picked_id IS NOT NULL THEN 'disambiguated' ELSE 'ambiguous_bout_scoped' END AS status
  FROM keyed k LEFT JOIN sized s USING (key)
  LEFT JOIN picked p ON p.key = k.key AND p.event_date = k.event_date AND p.weight_lbs IS NOT DISTINCT FROM k.weight_lbs)"""


def _resolved(spark, sf):
    return resolve.resolve_names(
        adapter.name_mentions(spark, sf).drop("weight_class"), adapter.named_entities(spark, sf), adapter.ALIASES
    )


@query(f"WITH {_RESOLVED} SELECT bout_id, l_linenumber, name, entity_id, status, used_alias FROM resolved")
def resolve_entities(spark, sf):
    return _resolved(spark, sf).select("bout_id", "l_linenumber", "name", "entity_id", "status", "used_alias")


@query(f"WITH {_RESOLVED} SELECT status, count(*) AS n_mentions FROM resolved GROUP BY status")
def resolution_report(spark, sf):
    return resolve.resolution_report(_resolved(spark, sf))


@query(f"""WITH {_RESOLVED} SELECT entity_id, name, key AS name_norm, false AS synthetic FROM named UNION ALL
SELECT entity_id, min(name), {S.norm('min(name)')}, true FROM resolved WHERE status IN ('unmatched_synthetic', 'ambiguous_bout_scoped') GROUP BY entity_id""")
def synthetic_entities(spark, sf):
    named = adapter.named_entities(spark, sf)
    return resolve.with_synthetic(named, _resolved(spark, sf)).select("entity_id", "name", "name_norm", "synthetic")


@query(f"""WITH {S.NAMED},
u AS (SELECT DISTINCT name, weight_class FROM mentions),
k AS (SELECT *, {_KEYS} AS keys, CAST(['155', '170', '125', '265', '205', NULL, '115', NULL][list_position(
    ['Lightweight', 'Welterweight', 'Women''s Flyweight', 'Heavyweight', 'Light Heavyweight', 'Catch Weight', 'Women''s Strawweight', 'Super Heavyweight'],
    weight_class)] AS DOUBLE) AS target FROM u),
p AS (SELECT name, weight_class, target, unnest(keys) AS key, generate_subscripts(keys, 1) AS pos FROM k),
hits AS (SELECT p.*, n.entity_id, n.listed, n.last_class FROM p JOIN named n USING (key)),
first_key AS (SELECT name, weight_class, min(pos) AS pos FROM hits GROUP BY name, weight_class),
c AS (SELECT h.* FROM hits h JOIN first_key USING (name, weight_class, pos)),
chosen AS (SELECT name, weight_class, count(*) AS n, min(entity_id) AS first_id,
    count(*) FILTER (last_class = weight_class) AS n_class, min(entity_id) FILTER (last_class = weight_class) AS class_id,
    arg_min(entity_id, (abs(listed - target), entity_id)) FILTER (abs(listed - target) IS NOT NULL) AS weight_id
  FROM c GROUP BY name, weight_class)
SELECT m.bout_id, m.l_linenumber, m.name, m.weight_class,
  CASE WHEN n IS NULL THEN 'new_' || {S.norm('m.name')} WHEN n = 1 THEN first_id WHEN n_class = 1 THEN class_id ELSE coalesce(weight_id, first_id) END AS entity_id,
  CASE WHEN n IS NULL THEN 'not in source data' WHEN n = 1 THEN 'matched' WHEN n_class = 1 THEN 'matched (same-name entities: picked by division)'
    WHEN weight_id IS NOT NULL THEN 'matched (same-name entities: picked by weight)' ELSE 'matched (ambiguous name)' END AS how
FROM mentions m LEFT JOIN chosen USING (name, weight_class)""")
def match_mentions(spark, sf):
    named = adapter.named_entities(spark, sf)
    mentions = adapter.name_mentions(spark, sf).select("bout_id", "l_linenumber", "name", "weight_class")
    return resolve.match_mentions(mentions, named.drop("last_weight_class"), named.filter("last_weight_class IS NOT NULL"), adapter.ALIASES)
