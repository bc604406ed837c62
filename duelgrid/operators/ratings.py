"""Network rating: one rating period per date, everybody rated from the state before it.

The recurrence runs over periods and across entities, so periods follow each other. Consecutive periods that are small
together are rated in one job, by one task that walks through them; a period too large for that is rated by joins over
the whole cluster. Every job writes only the states it made. They form a log in tiers: a full tier is merged into one
table of the next, so a state is rewritten once per tier, and a job looks up the entities of its own bouts only. What an
entity brought into a bout is its last state before that date, with the deviation grown by the layoff.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.constants import INACTIVITY_DAYS_TO_RESET, INITIAL_RATING, INITIAL_RD, MIN_RD
from duelgrid.functions.numeric import grown_deviation
from duelgrid.session import run_dir, written

Q = math.log(10) / 400
BATCH_ROWS = 100_000  # rows of consecutive periods that one task rates, at most
RD_GROWTH = (INITIAL_RD**2 - MIN_RD**2) / INACTIVITY_DAYS_TO_RESET  # of the squared deviation, per idle day
STATE_SCHEMA = "entity_id string, rating double, rd double, last_day date"


def opponents(appearances: DataFrame) -> DataFrame:
    """Opponent of each row of a two-row bout; rows of other bouts get NULL.

    Two rows fold to their smallest and largest id; whichever is not the row's own is the opponent.
    """
    pairs = (
        appearances.groupBy("bout_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
        .filter("n = 2 AND lo <> hi")
    )
    return appearances.join(pairs, "bout_id", "left").select(
        *appearances.columns,
        F.when(F.col("entity_id") == F.col("lo"), F.col("hi")).when(F.col("entity_id") == F.col("hi"), F.col("lo")).alias("opponent_id"),
    )


def score(result: Column) -> Column:
    return F.when(result == "W", 1.0).when(result == "L", 0.0).when(result == "D", 0.5)


def damping(rd: Column) -> Column:
    """How much an opponent's uncertainty dampens a result."""
    return 1 / F.sqrt(1 + F.lit(3 * Q * Q / math.pi**2) * rd * rd)


def expected_score(rating: Column, opp_rating: Column, opp_damping: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -opp_damping * (rating - opp_rating) / 400))


def _latest(states: DataFrame) -> DataFrame:
    return states.groupBy("entity_id").agg(
        F.max_by("rating", "last_day").alias("rating"),
        F.max_by("rd", "last_day").alias("rd"),
        F.max("last_day").alias("last_day"),
    )


def _snapshot(prefix: str, latest: DataFrame) -> DataFrame:
    return latest.select(
        F.col("entity_id").alias(f"{prefix}_id"),
        F.col("rating").alias(f"{prefix}_rating"),
        F.col("rd").alias(f"{prefix}_rd"),
        F.col("last_day").alias(f"{prefix}_last"),
    )


def _known(column: str, default: float) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def _grown(prefix: str, day: Column) -> Column:
    """Snapshot deviation on a day; an entity without state has the starting deviation."""
    idle = F.datediff(day, F.col(f"{prefix}_last"))
    return F.when(F.col(f"{prefix}_rd").isNull(), INITIAL_RD).otherwise(grown_deviation(F.col(f"{prefix}_rd"), idle))


def period_update(scored: DataFrame, latest: DataFrame, day: Column) -> DataFrame:
    """New state of every entity with a scored bout in one period.

    `scored` holds (own_id, opp_id, score) of the period. The information and surprise sums combine
    map-side, so an entity with very many bouts in a period is no hot spot.
    """
    met = scored.join(_snapshot("opp", latest), "opp_id", "left").join(_snapshot("own", latest), "own_id", "left")
    valued = met.select(
        "own_id",
        "score",
        _known("own_rating", INITIAL_RATING).alias("own_rating"),
        _grown("own", day).alias("own_rd"),
        _known("opp_rating", INITIAL_RATING).alias("opp_rating"),
        damping(_grown("opp", day)).alias("opp_damping"),
    ).withColumn("expected", expected_score(F.col("own_rating"), F.col("opp_rating"), F.col("opp_damping")))
    sums = valued.groupBy("own_id", "own_rating", "own_rd").agg(
        F.sum(F.pow("opp_damping", F.lit(2)) * F.col("expected") * (1 - F.col("expected"))).alias("info"),
        F.sum(F.col("opp_damping") * (F.col("score") - F.col("expected"))).alias("surprise"),
    )
    precision = 1 / (F.col("own_rd") * F.col("own_rd")) + F.lit(Q * Q) * F.col("info")
    return sums.select(
        F.col("own_id").alias("entity_id"),
        (F.col("own_rating") + F.lit(Q) / precision * F.col("surprise")).alias("rating"),
        F.greatest(F.lit(MIN_RD), F.sqrt(1 / precision)).alias("rd"),
        day.alias("last_day"),
    )


class StateLog:
    """States in tiers of written tables; `merge_at` tables of a tier become one of the next."""

    def __init__(self, spark: SparkSession, folder: str, merge_at: int):
        self.spark, self.folder, self.merge_at = spark, folder, merge_at
        self.tiers: list[list[str]] = [[]]
        self.written = 0

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(*paths)

    def add(self, states: DataFrame, tier: int = 0) -> str:
        path = f"{self.folder}/tier={tier}/{self.written}"
        self.written += 1
        states.write.parquet(path)
        self.tiers += [[] for _ in range(tier + 1 - len(self.tiers))]
        self.tiers[tier].append(path)
        if len(self.tiers[tier]) >= self.merge_at:
            full, self.tiers[tier] = self.tiers[tier], []
            self.add(_latest(self._read(full)), tier + 1)
        return path

    def latest(self, ids: DataFrame, few: bool = False) -> DataFrame:
        """The last state of the listed entities; the log is cut down to them before anything is aggregated.

        `few` says that the list is bounded: it goes to the log then, and of the log only states that are asked for move.
        """
        whole = self._read([p for tier in self.tiers for p in tier])
        return _latest(whole.join(F.broadcast(ids) if few else ids, "entity_id", "left_semi"))


def batches_of(sizes: list[tuple[object, int]], most: int) -> list[list[object]]:
    """Consecutive periods, in order, that have at most `most` rows together; a larger period is alone."""
    out: list[list[object]] = []
    held = most + 1
    for period, n in sizes:
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append(period)
        held += n
    return out


def _walk(_: tuple, scored: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """New states of a few periods, one after the other; `states` are those before the first."""
    ids = pd.Index(pd.unique(pd.concat([scored["own_id"], scored["opp_id"]])))
    rating, rd, last = np.full(len(ids), INITIAL_RATING), np.full(len(ids), INITIAL_RD), np.full(len(ids), np.nan)
    known = ids.get_indexer(states["entity_id"])
    rating[known], rd[known] = states["rating"], states["rd"]
    day_of = lambda x: pd.to_datetime(x).to_numpy().astype("datetime64[D]").astype(np.int64)
    last[known] = day_of(states["last_day"])
    own, opp = ids.get_indexer(scored["own_id"]), ids.get_indexer(scored["opp_id"])
    days, points = day_of(scored["period"]), scored["score"].to_numpy(float)
    order = np.argsort(days, kind="stable")
    own, opp, days, points = own[order], opp[order], days[order], points[order]
    out = []
    for at in np.split(np.arange(len(days)), np.flatnonzero(np.diff(days)) + 1):
        today = float(days[at[0]])
        idle = np.where(np.isnan(last), 0.0, today - last)
        grown = np.minimum(INITIAL_RD, np.sqrt(rd**2 + idle * RD_GROWTH))
        damp = 1 / np.sqrt(1 + 3 * Q * Q / math.pi**2 * grown[opp[at]] ** 2)
        expected = 1 / (1 + 10 ** (-damp * (rating[own[at]] - rating[opp[at]]) / 400))
        info = np.bincount(own[at], damp**2 * expected * (1 - expected), len(ids))
        surprise = np.bincount(own[at], damp * (points[at] - expected), len(ids))
        who = np.unique(own[at])
        precision = 1 / grown[who] ** 2 + Q * Q * info[who]
        rating[who] += Q / precision * surprise[who]
        rd[who] = np.maximum(MIN_RD, np.sqrt(1 / precision))
        last[who] = today
        out.append((who, rating[who], rd[who], np.full(len(who), int(today))))
    who, new_rating, new_rd, day = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"entity_id": ids[who], "rating": new_rating, "rd": new_rd, "last_day": pd.to_datetime(day, unit="D").date})


def rate_periods(
    appearances: DataFrame,
    period_col: str = "event_date",
    initial_state: DataFrame | None = None,
    compact_every: int = 16,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """State history (entity_id, rating, rd, last_day): one row per entity and period it was scored in.

    `period_col` is the DATE of the rating period; by default every event date is one. Passing the
    history of an earlier run as `initial_state` rates only the periods after its newest day; `rerated` also takes up
    bouts that came late. The periods and their sizes are listed on the driver, which the calendar bounds. Consecutive
    periods of at most `batch_rows` rows together take one job and one task; a larger one is spread over the cluster.
    """
    spark = appearances.sparkSession
    folder = run_dir(spark, "ratings")
    scored = appearances.select(
        F.col("entity_id").alias("own_id"),
        F.col("opponent_id").alias("opp_id"),
        score(F.col("result")).alias("score"),
        F.col(period_col).alias("period"),
    ).filter("score IS NOT NULL AND opp_id IS NOT NULL AND period IS NOT NULL")
    newest = None if initial_state is None else initial_state.agg(F.max("last_day")).first()[0]
    if newest is None:
        initial_state = None  # an empty state is no state
    else:
        scored = scored.filter(F.col("period") > F.lit(newest))
    scored = written(scored, f"{folder}/scored")
    sizes = [(r["period"], r["count"]) for r in scored.groupBy("period").count().orderBy("period").collect()]
    batches, rows_of = batches_of(sizes, batch_rows), dict(sizes)
    number = {p: i for i, batch in enumerate(batches) for p in batch}
    rows = spark.createDataFrame([(p, i) for p, i in number.items()], "period date, batch int")
    # one folder per batch, so that a job reads the rows of its own periods
    dealt = scored.join(rows, "period")
    dealt.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/dealt")
    log, made = StateLog(spark, f"{folder}/log", compact_every), []
    if initial_state is not None:
        log.add(_latest(initial_state), 1)
    for i, batch in enumerate(batches):
        own = spark.read.schema("own_id string, opp_id string, score double, period date").parquet(f"{folder}/dealt/batch={i}")
        ids = own.select(F.explode(F.array("own_id", "opp_id")).alias("entity_id")).distinct()
        before = log.latest(ids, few=sum(rows_of[p] for p in batch) <= batch_rows)
        if len(batch) == 1:
            states = period_update(own, before, F.lit(batch[0]))
        else:
            key = F.lit(0).alias("key")
            states = own.groupBy(key).cogroup(before.groupBy(key)).applyInPandas(_walk, STATE_SCHEMA)
        made.append(log.add(states))
    history = spark.read.schema(STATE_SCHEMA).parquet(*made) if made else spark.createDataFrame([], STATE_SCHEMA)
    return history if initial_state is None else initial_state.unionByName(history)


def late_bouts(appearances: DataFrame, initial_state: DataFrame, rated: DataFrame, period_col: str = "event_date") -> DataFrame:
    """Rows that resuming from `initial_state` would not rate: dated up to its newest day, and not in `rated` before.

    `rated` lists the bout_ids that the earlier run has used.
    """
    newest = initial_state.agg(F.max("last_day")).first()[0]
    old = appearances.where(F.col(period_col) <= F.lit(newest))
    return old.join(rated.select("bout_id").distinct(), "bout_id", "left_anti")


def rerated(appearances: DataFrame, states: DataFrame, rated: DataFrame, period_col: str = "event_date", **options) -> DataFrame:
    """The history that a full run over all appearances gives, from an earlier run's `states` and the bouts it `rated`.

    States before the earliest period with a late scored bout stay; periods from there on are rated anew. Without late
    bouts only the periods after the newest day are rated.
    """
    late = late_bouts(appearances, states, rated, period_col)
    usable = late.where(score(F.col("result")).isNotNull() & F.col("opponent_id").isNotNull())
    first = usable.agg(F.min(period_col)).first()[0]
    kept = states if first is None else states.where(F.col("last_day") < F.lit(first))
    return rate_periods(appearances, period_col, kept, **options)


def ratings_before(requests: DataFrame, history: DataFrame, date_col: str = "event_date", period_col: str | None = None) -> DataFrame:
    """Rating with which each requested (entity_id, date) is entered.

    Requests are made distinct and meet the history in one window per entity, both bounded by the
    calendar. `period_col` names the period date of a request where it differs from the date.
    """
    period = period_col or date_col
    asked = requests.select("entity_id", date_col, F.col(period).alias("at")).distinct()
    stacked = history.select(
        "entity_id",
        F.lit(None).cast("date").alias(date_col),
        F.col("last_day").alias("at"),
        F.lit(1).alias("is_state"),
        "rating",
        "rd",
        F.col("last_day").alias("own_last"),
    ).unionByName(asked.withColumn("is_state", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("entity_id").orderBy("at", "is_state").rowsBetween(Window.unboundedPreceding, -1)
    last = stacked.select(
        "entity_id",
        date_col,
        "at",
        "is_state",
        *[F.last(c, ignorenulls=True).over(before).alias(f"own_{c}") for c in ("rating", "rd")],
        F.last("own_last", ignorenulls=True).over(before).alias("own_last"),
    ).filter("is_state = 0")
    return last.select(
        "entity_id",
        date_col,
        _known("own_rating", INITIAL_RATING).alias("glicko_rating"),
        _grown("own", F.col("at")).alias("glicko_rd"),
    )
