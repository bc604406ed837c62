"""Finish types and rounds: rates, splits and the joint outcome of a matchup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.constants import FINISH_TYPES

RATE_FLOOR = 1e-3


def finish_rates(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of each finish type as columns, overall or per group; absent types count 0."""
    keys = by or []
    counts = [
        F.sum((F.col("method") == m).cast("double")).alias(f"n_{i}") for i, m in enumerate(FINISH_TYPES)
    ]
    total = " + ".join(f"n_{i}" for i in range(len(FINISH_TYPES)))
    shares = ", ".join(f"try_divide(n_{i}, {total})" for i in range(len(FINISH_TYPES)))
    return rows.groupBy(*keys).agg(*counts).selectExpr(*keys, f"array({shares}) AS rates")


def class_rates_fallback(rows: DataFrame, train: DataFrame, by: list[str]) -> DataFrame:
    """Training rates of each row's group, overall rates where the group is new.

    Rates are floored and normalised again, so that no outcome has probability 0. There are as many
    rate rows as groups, and one overall row, which travels as a scalar subquery.
    """
    groups = finish_rates(train, by)
    overall = finish_rates(train).select("rates").scalar()
    joined = rows.join(groups, by, "left").withColumn("raw_rates", F.coalesce("rates", overall)).drop("rates")
    floored = F.transform("raw_rates", lambda x: F.greatest(x, F.lit(RATE_FLOOR)))
    total = F.aggregate("floored", F.lit(0.0), lambda acc, x: acc + x)
    return (
        joined.withColumn("floored", floored)
        .withColumn("rates", F.transform("floored", lambda x: x / total))
        .drop("floored", "raw_rates")
    )


def finished(bouts: DataFrame, start: str, end: str | None, kinds: list[str]) -> DataFrame:
    keep = F.col("winner_side").isNotNull() & F.col("method").isin(kinds) & (F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        keep &= F.col("event_date") < F.lit(end).cast("date")
    return bouts.filter(keep)


def _smoothed(cells: DataFrame, slots: DataFrame, cell: str) -> DataFrame:
    """Add-one smoothed shares of `cell` per schedule length; every slot gets a row."""
    counts = cells.groupBy("scheduled_rounds", cell).agg(F.count(F.lit(1)).alias("n"))
    full = slots.join(counts, ["scheduled_rounds", cell], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    totals = full.groupBy("scheduled_rounds").agg(F.sum("n").alias("total"))
    return full.join(totals, "scheduled_rounds").select(
        "scheduled_rounds", cell, (F.col("n") / F.col("total")).alias("share")
    )


def _slots(bouts: DataFrame, lengths: tuple[int, ...], extra: int, cell: str) -> DataFrame:
    rows = [(k, r) for k in lengths for r in range(1, k + extra + 1)]
    return bouts.sparkSession.createDataFrame(rows, f"scheduled_rounds int, {cell} int")


def round_split(bouts: DataFrame, start: str, end: str | None, lengths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """P(finish in round r | an early finish), per schedule length, add-one smoothed."""
    early = finished(bouts, start, end, FINISH_TYPES[:2]).filter(F.col("scheduled_rounds").isin(list(lengths)) & F.col("end_round").isNotNull())
    clipped = F.greatest(F.least(F.col("end_round"), F.col("scheduled_rounds")), F.lit(1)).cast("int")
    cells = early.select(F.col("scheduled_rounds").cast("int").alias("scheduled_rounds"), clipped.alias("round"))
    return _smoothed(cells, _slots(bouts, lengths, 0, "round"), "round")


def round_outcome(method: Column, end_round: Column, scheduled: Column) -> Column:
    """1..k for the round of an early finish, k+1 for a decision; NULL if an early finish has no round."""
    inside = F.when(end_round.isNotNull(), F.greatest(F.least(end_round, scheduled), F.lit(1)))
    return F.when(method == "DEC", scheduled + 1).otherwise(inside).cast("int")


def round_outcome_rates(bouts: DataFrame, start: str, end: str | None, lengths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Smoothed rates of {round 1..k, decision} per schedule length."""
    pool = finished(bouts, start, end, FINISH_TYPES).filter(F.col("scheduled_rounds").isin(list(lengths)))
    slot = round_outcome(F.col("method"), F.col("end_round"), F.col("scheduled_rounds"))
    cells = pool.select(F.col("scheduled_rounds").cast("int").alias("scheduled_rounds"), slot.alias("outcome"))
    return _smoothed(cells, _slots(bouts, lengths, 1, "outcome"), "outcome")


def split_arrays(split: DataFrame) -> DataFrame:
    """One row per schedule length with its shares in round order (at most a handful each)."""
    ordered = F.array_sort(F.collect_list(F.struct("round", "share")))
    return split.groupBy("scheduled_rounds").agg(F.transform(ordered, lambda x: x["share"]).alias("shares"))


# ------------------------------------------------------------------------------ joint outcome
def six_way(p_a: Column, given_a: Column, given_b: Column) -> Column:
    """struct(a, b, overall): P(side wins by each finish type), arrays in finish-type order."""
    a = F.transform(given_a, lambda x: x * p_a)
    b = F.transform(given_b, lambda x: x * (F.lit(1.0) - p_a))
    return F.struct(a.alias("a"), b.alias("b"), F.zip_with(a, b, lambda x, y: x + y).alias("overall"))


def most_likely(joint: Column) -> Column:
    """struct(winner, method, prob) of the largest cell; on a tie A before B, then type order."""
    cells = [
        F.struct(
            joint[side][i].alias("prob"),
            F.lit(-(3 * s + i)).alias("priority"),
            F.lit(side.upper()).alias("winner"),
            F.lit(m).alias("method"),
        )
        for s, side in enumerate(("a", "b"))
        for i, m in enumerate(FINISH_TYPES)
    ]
    best = F.array_max(F.array(*cells))
    return F.struct(best["winner"].alias("winner"), best["method"].alias("method"), best["prob"].alias("prob"))


def round_odds(rows: DataFrame, split: DataFrame) -> DataFrame:
    """P(distance) and P(ends in round r) of rows with p_decision and scheduled_rounds.

    A schedule length without a split keeps NULL odds.
    """
    shares = split_arrays(split)
    joined = rows.join(shares, "scheduled_rounds", "left")
    return joined.select(
        *rows.columns,
        F.when(F.col("shares").isNotNull(), F.col("p_decision")).alias("distance"),
        F.transform("shares", lambda s: s * (F.lit(1.0) - F.col("p_decision"))).alias("by_round"),
    )
