"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelgrid.constants import (
    DAYS_PER_YEAR,
    INACTIVITY_DAYS_TO_RESET,
    INITIAL_RD,
    LAYOFF_CLIP_DAYS,
    MIN_RD,
    RECALIBRATE_AFTER_DAYS,
    RETRAIN_AFTER_DAYS,
)


def shrunk(num: Column, den: Column, prior: float, weight: float) -> Column:
    """A rate pulled towards `prior` by `weight` units of the denominator."""
    return (num + prior * weight) / (den + weight)


def clipped_or_zero(x: Column, limit: float = LAYOFF_CLIP_DAYS) -> Column:
    """Clip to +-limit; missing becomes 0 (least and greatest would skip the NULL)."""
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def clip_probability(p: Column, eps: float = 1e-6) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps)))


def safe_logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.log(q / (1 - q))


def age_years(on: Column, dob: Column) -> Column:
    return F.datediff(on, dob) / F.lit(DAYS_PER_YEAR)


def coin(text_id: Column) -> Column:
    """A repeatable coin: parity of the MD5 digest, which its last hex digit decides."""
    return F.right(F.md5(text_id), F.lit(1)).isin("1", "3", "5", "7", "9", "b", "d", "f")


def grown_deviation(rd: Column, idle_days: Column) -> Column:
    """Rating deviation after a layoff; a full reset takes `INACTIVITY_DAYS_TO_RESET` days."""
    per_day = (INITIAL_RD**2 - MIN_RD**2) / INACTIVITY_DAYS_TO_RESET
    return F.least(
        F.lit(INITIAL_RD),
        F.sqrt(rd * rd + F.lit(per_day) * F.greatest(idle_days, F.lit(0))),
    )


def symmetric_probability(p_ab: Column, p_ba: Column) -> Column:
    """Mean of both orientations, so that the two sides sum to one."""
    return F.lit(0.5) * (p_ab + F.lit(1.0) - p_ba)


def model_age_status(age_days: Column) -> Column:
    return (
        F.when(age_days >= RETRAIN_AFTER_DAYS, "retrain")
        .when(age_days >= RECALIBRATE_AFTER_DAYS, "recalibrate")
        .otherwise("ok")
    )


def rating_range(rating: Column, rd: Column) -> tuple[Column, Column]:
    """95 % range of a rating."""
    return rating - F.lit(1.96) * rd, rating + F.lit(1.96) * rd
