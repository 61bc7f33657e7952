"""Scores as column expressions; all times are seconds since 1970 and `now` is a parameter."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults.
COSINE_LOW, COSINE_HIGH = 0.20, 0.75
DECAY_RATE, DECAY_FLOOR, DECAY_CEILING = 0.005, 0.3, 0.5
BOOST, BOOST_DECAY = 0.02, 0.002
LEAST_HOURS, REFERENCE_HOURS = 24.0, 168.0
RESOLVED, RECENT, RECENT_MINUTES = 0.3, 0.7, 5
PENALTY_RATE, PENALTY_FLOOR = 0.01, 0.5
RRF_K = 60
RRF_SCALE = 3 / 61


def dot(a: Column, b: list[float] | Column) -> Column:
    """Dot product in double precision; inside whole-stage code."""
    other = F.array(*[F.lit(float(x)) for x in b]) if isinstance(b, list) else b
    return F.aggregate(F.zip_with(a, other, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / length)


def adaptive_least(pool: Column) -> Column:
    """Least score that a pool of so many rows asks for."""
    return F.when(pool <= 0, 0.5).otherwise(F.round(0.5 - 0.3 * F.least(F.lit(1.0), F.ln(pool + 1) / log(500)), 4))


def boundary_penalty(seconds: Column, boundary: Column) -> Column:
    """Factor for what was said before the latest session ended."""
    hours = (boundary - seconds) / 3600
    return F.when(hours > 0, F.greatest(F.lit(PENALTY_FLOOR), F.exp(-PENALTY_RATE * hours))).otherwise(1.0)


def age_hours(seconds: Column, now: float, newest_age: Column, span: Column) -> Column:
    """Hours since a row's time; rows without one get the middle of the pool's span."""
    width = F.greatest(F.lit(LEAST_HOURS), F.coalesce(span, F.lit(0.0)))
    return F.coalesce(F.greatest(F.lit(0.0), (now - seconds) / 3600), newest_age + F.coalesce(span, F.lit(0.0)) / 2, width / 2)


def confidence(cosine: Column, age: Column, span: Column, recalls: Column, since_recall: Column, resolved: Column, deep: bool = False) -> Column:
    """Confidence between 0 and 1, rounded to four places. since_recall: hours since the last recall, null if never."""
    boost = F.ln(1 + F.coalesce(recalls, F.lit(0))) * BOOST / (1 + BOOST_DECAY * F.coalesce(since_recall, F.lit(0.0)))
    floor = F.least(F.lit(DECAY_CEILING), DECAY_FLOOR + boost)
    rate = F.when(span > 0, DECAY_RATE / F.greatest(F.lit(1.0), F.greatest(F.lit(LEAST_HOURS), span) / REFERENCE_HOURS)).otherwise(DECAY_RATE)
    decay = F.lit(1.0) if deep else F.greatest(floor, 1 / (1 + age * rate))
    done = F.lit(1.0) if deep else F.when(resolved, RESOLVED).otherwise(1.0)
    recent = F.lit(1.0) if deep else F.when(since_recall * 60 < RECENT_MINUTES, RECENT).otherwise(1.0)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - COSINE_LOW) / (COSINE_HIGH - COSINE_LOW)))
    return F.round(F.coalesce(F.sqrt(base * decay), F.sqrt(decay)) * done * recent, 4)
