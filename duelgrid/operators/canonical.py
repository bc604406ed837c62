"""Raw projections -> canonical bouts, side statistics and appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.constants import STAT_COLS
from duelgrid.functions import text as X


def dedupe_prefer_known(results: DataFrame, events: DataFrame) -> DataFrame:
    """One row per bout id: a copy whose event is known wins, then event and bout text decide.

    A minimum over structs combines map-side, so a bout listed very often shrinks before the
    shuffle.
    """
    known = events.select("event").distinct().withColumn("has_event", F.lit(True))
    flagged = results.join(known, "event", "left").withColumn(
        "has_event", F.coalesce("has_event", F.lit(False))
    )
    order = [(~F.col("has_event")).alias("unknown"), "event", "bout"]
    rest = [c for c in results.columns if c not in ("event", "bout", "bout_id")]
    best = flagged.groupBy("bout_id").agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(
        *[F.col("bout_id") if c == "bout_id" else F.col(f"best.{c}").alias(c) for c in results.columns],
        (~F.col("best.unknown")).alias("has_event"),
    )


def with_event_date(results: DataFrame, events: DataFrame) -> DataFrame:
    """Event date by name. A name listed twice with one date counts once; two dates raise."""
    dates = events.groupBy("event").agg(
        F.min("event_date").alias("event_date"), F.max("event_date").alias("other_date")
    )
    checked = dates.select(
        "event",
        F.when(F.col("event_date") == F.col("other_date"), F.col("event_date"))
        .when(F.col("event_date").isNull(), None)
        .otherwise(
            F.raise_error(F.concat(F.lit("event listed with two dates: "), F.col("event"))).cast("date")
        )
        .alias("event_date"),
    )
    return results.join(checked, "event", "left")


def undated(results: DataFrame) -> DataFrame:
    """The rejected rows of the canonical step, counted by event."""
    return (
        results.filter(F.col("event_date").isNull())
        .groupBy("event")
        .agg(F.count(F.lit(1)).alias("n_bouts"))
    )


def type_bouts(results: DataFrame) -> DataFrame:
    """Dated results with class, finish type, schedule, duration and outcome columns."""
    klass = X.weight_class(F.col("weightclass_raw"))
    return (
        results.filter(F.col("event_date").isNotNull())
        .withColumn("klass", klass)
        .select(
            *[c for c in results.columns if c != "has_event"],
            F.col("klass.name").alias("weight_class"),
            F.col("klass.lbs").alias("weight_lbs"),
            F.col("klass.is_female").alias("is_female"),
            F.col("klass.is_title").alias("is_title"),
            X.finish_category(F.col("method_raw")).alias("method"),
            X.scheduled_rounds(F.col("time_format")).alias("scheduled_rounds"),
            X.bout_duration(F.col("time_format"), F.col("end_round"), F.col("end_time_s")).alias("duration_s"),
            X.winner_side(F.col("outcome")).alias("winner_side"),
            X.result_type(F.col("outcome")).alias("result_type"),
        )
    )


def canonical_bouts(results: DataFrame, events: DataFrame) -> DataFrame:
    return type_bouts(with_event_date(dedupe_prefer_known(results, events), events))


def result_counts(bouts: DataFrame) -> DataFrame:
    return bouts.groupBy("result_type").agg(F.count(F.lit(1)).alias("n_bouts"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def attach_stats(stats: DataFrame, bouts: DataFrame) -> DataFrame:
    """Round statistics with bout id and side (1, 2, or 0 where the name is neither).

    Bouts that share their (event, bout) key with another bout get no statistics.
    """
    only = (
        bouts.groupBy("event", "bout")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.min(c).alias(c) for c in ("bout_id", "entity_1_name", "entity_2_name")],
        )
        .filter("n_rows = 1")
        .drop("n_rows")
    )
    side = (
        F.when(F.col("entity_name") == F.col("entity_1_name"), 1)
        .when(F.col("entity_name") == F.col("entity_2_name"), 2)
        .otherwise(0)
    )
    return stats.join(only, ["event", "bout"]).select(
        "bout_id", side.alias("side"), "round", "entity_name", *STAT_COLS
    )


def sum_null_if_any(column: str):
    """A sum that is unknown as soon as one input is unknown."""
    return F.when(F.count(F.lit(1)) == F.count(column), F.sum(column))


def sum_rounds(attached: DataFrame, columns: list[str] = STAT_COLS) -> DataFrame:
    """Totals per (bout, side); control time is unknown if any round's is."""
    sums = [
        (sum_null_if_any(c) if c == "ctrl_s" else F.sum(c)).alias(c) for c in columns
    ]
    return attached.groupBy("bout_id", "side").agg(*sums)


BOUT_COLS = ["bout_id", "event", "event_date", "weight_class", "weight_lbs", "is_title", "method",
             "duration_s", "end_round", "scheduled_rounds"]


def with_side_stats(bouts: DataFrame, side_stats: DataFrame, stats: list[str] = STAT_COLS) -> DataFrame:
    """Bouts with the statistics of side 1 and side 2 in their row, NULL where there are none."""
    wide = side_stats.groupBy("bout_id").agg(
        *[F.expr(f"max(IF(side = {s}, {c}, NULL)) AS {c}_{s}") for s in (1, 2) for c in stats]
    )
    return bouts.join(wide, "bout_id", "left")


def build_appearances(bouts: DataFrame, side_stats: DataFrame | None = None, stats: list[str] = STAT_COLS) -> DataFrame:
    """Two rows per bout, one per side, with own and `opp_` statistics.

    The sides are folded to one row per bout first, so bouts and statistics meet in a single join
    and the two output rows come from one pass. Bouts that hold the statistics already, as
    `with_side_stats` names them, need no `side_stats`, and no row moves.
    """
    wide = bouts if side_stats is None else with_side_stats(bouts, side_stats, stats)
    both = wide.selectExpr("*", "explode(array(1, 2)) AS side")

    def of(own: str, other: str, name: str) -> str:
        return f"IF(side = 1, {own}, {other}) AS {name}"

    sides = both.selectExpr(
        *BOUT_COLS,
        "side",
        of("entity_1_id", "entity_2_id", "entity_id"),
        of("entity_1_name", "entity_2_name", "entity_name"),
        of("entity_2_id", "entity_1_id", "opponent_id"),
        "CASE WHEN winner_side = side THEN 'W' WHEN winner_side = 3 - side THEN 'L' "
        "WHEN result_type = 'draw' THEN 'D' ELSE 'NC' END AS result",
        *[of(f"{c}_1", f"{c}_2", c) for c in stats],
        *[of(f"{c}_2", f"{c}_1", f"opp_{c}") for c in stats],
    )
    return sides.selectExpr("*", "sig_att IS NOT NULL AND opp_sig_att IS NOT NULL AND duration_s IS NOT NULL AS has_stats")


def stats_coverage(appearances: DataFrame) -> DataFrame:
    return appearances.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("has_stats").cast("int")).alias("share_with_stats"),
    )


def _rule(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("rule"), "n_violations")


def source_quality(bouts: DataFrame, attached_stats: DataFrame) -> DataFrame:
    """The rules that raw tables must keep before they are summed: one row each with the number of violations."""
    return (
        _rule("same entity on both sides", bouts.filter("entity_1_id = entity_2_id"))
        .unionByName(_rule("statistics name not in the bout", attached_stats.filter("side = 0")))
        .unionByName(_rule("repeated bout, side and round", duplicate_keys(attached_stats.filter("side > 0"), ["bout_id", "side", "round"])))
    )


def feature_quality(appearances: DataFrame, features: DataFrame, ratings: DataFrame, split: DataFrame) -> DataFrame:
    """The rules of the feature step: both tables are keyed by (bout_id, entity_id), `split` holds (split, event_date)."""
    key = ["bout_id", "entity_id"]
    ends = split.groupBy("split").agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    order = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).when(F.col("split") == "test", 3)
    bounds = ends.withColumn("pos", order).filter("pos IS NOT NULL")
    later = bounds.select((F.col("pos") - 1).alias("pos"), F.col("lo").alias("next_lo"))
    return (
        _rule("appearance without features", appearances.join(features, key, "left_anti"))
        .unionByName(_rule("appearance without rating", appearances.join(ratings, key, "left_anti")))
        .unionByName(_rule("overlapping periods", bounds.join(later, "pos").filter("hi >= next_lo")))
    )


def forecast_quality(appearances: DataFrame, roster: DataFrame, as_of: DataFrame) -> DataFrame:
    """The rules of a forecast: labels name one entity, and `as_of` (entity_id, as_of) lies behind all history."""
    last_day = appearances.groupBy("entity_id").agg(F.max("event_date").alias("last_day"))
    return _rule("display name used twice", duplicate_keys(roster, ["display_name"])).unionByName(
        _rule("as-of date not after history", as_of.join(last_day, "entity_id").filter("as_of <= last_day"))
    )


def data_quality(
    bouts: DataFrame,
    attached_stats: DataFrame,
    appearances: DataFrame,
    features: DataFrame,
    ratings: DataFrame,
    split: DataFrame,
    roster: DataFrame,
    as_of: DataFrame,
) -> DataFrame:
    """All rules: one row each with the number of violations."""
    return (
        source_quality(bouts, attached_stats)
        .unionByName(feature_quality(appearances, features, ratings, split))
        .unionByName(forecast_quality(appearances, roster, as_of))
    )


def require_none(violations: DataFrame) -> None:
    """Raise if any rule of `data_quality` is violated."""
    broken = violations.filter("n_violations > 0").orderBy("rule").take(1)
    if broken:
        raise ValueError(f"data quality: {broken[0]['rule']}: {broken[0]['n_violations']} rows")
