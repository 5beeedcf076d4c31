"""Scalar parsing and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a suffix multiplies a number by; a per cent sign leaves it as it is.
MULTIPLIERS = {"": 1.0, "K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12, "%": 1.0}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def human_number(raw: Column) -> Column:
    """'3.8%', '150K' or '1,950B' as a double; null for anything else, also for a plus sign."""
    text = F.upper(F.regexp_replace(strip(raw), ",", ""))
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    body = F.when(F.startswith(text, F.lit("-")), F.substring(text, 2, 1_000_000)).otherwise(text)
    digits = F.regexp_extract(body, r"^([0-9]+(\.[0-9]+)?)", 1)
    suffix = strip(F.substring(body, F.length(digits) + 1, F.length(body)))
    times = F.lit(None).cast("double")
    for name, by in MULTIPLIERS.items():
        times = F.when(suffix == name, by).otherwise(times)
    return F.when(digits != "", sign * digits.try_cast("double") * times)


def first_keyword(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """The name of the first (name, pattern) that the lower-cased text matches, in list order; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(keywords):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def title_key(title: Column) -> Column:
    """SHA-1 of the lower-cased title without white space at its ends."""
    return F.sha1(F.lower(strip(title)).cast("binary"))


def slug(text: Column, longest: int = 60) -> Column:
    """Lower-case letters and digits joined by underscores, for file names; ``query`` if there are none."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(joined == "", "query").otherwise(F.substring(joined, 1, longest))


def vote_score(positive: Column, negative: Column) -> Column:
    """(p - n) / (p + n); null without votes."""
    return F.try_divide(positive - negative, positive + negative)


def clamp(score: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """The score within bounds; null stays null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), score)))


def next_business_day(day: Column) -> Column:
    """One business day later: from Friday 3 days on, from Saturday 2, else 1."""
    weekday = F.dayofweek(day)  # Sunday is 1
    return F.date_add(day, F.when(weekday == 6, 3).when(weekday == 7, 2).otherwise(1))


def business_days_later(day: Column, days: int) -> Column:
    """``days`` business days later; the day itself for 0."""
    for _ in range(days):
        day = next_business_day(day)
    return day


def any_case(fields: Column, *names: str) -> Column:
    """The value of the first of ``names`` that is a key of the map, whatever the keys' case."""
    lower = F.transform_keys(fields, lambda k, _: F.lower(k))
    return F.coalesce(*[F.try_element_at(lower, F.lit(n.lower())) for n in names])


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by its series around 0 (90 terms); 0 or 1 beyond 7 deviations."""
    terms = F.aggregate(F.sequence(F.lit(90), F.lit(1)), F.lit(1.0), lambda a, k: 1 + z * z / (2 * k + 1) * a)
    return F.when(z > 7, 1.0).when(z < -7, 0.0).otherwise(0.5 + F.exp(-z * z / 2) * 0.3989422804014327 * z * terms)


def entropy(probabilities: Column) -> Column:
    """-sum p ln p of an array, with 0 ln 0 = 0."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def first_argmax(values: Column) -> Column:
    """Index (from 0) of the first greatest value of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
