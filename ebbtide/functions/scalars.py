"""Column expressions shared by all sources. Missing and infinite values are NULL throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import specs

EPSILON = 1e-6


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * F.lit(100.0)


def epsilon_ratio(numerator: Column, denominator: Column) -> Column:
    """Division stabilised by a small constant in the denominator."""
    return numerator / (denominator + F.lit(EPSILON))


def log_difference(current: Column, previous: Column) -> Column:
    """log(1+x) difference of the non-negative parts; NULL if either side is NULL."""

    def part(c: Column) -> Column:
        return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))

    return part(current) - part(previous)


def finite_or_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nullify_non_finite(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every floating column."""
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[finite_or_null(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def median_rating(df: DataFrame, col: str) -> Column:
    """Median of ratings from 1 to 5: whole ones from their counts, which need no list of the values."""
    if not isinstance(df.schema[col].dataType, T.IntegralType):
        return F.median(col)
    n = F.count(col)
    up_to = [F.count_if(F.col(col) <= k) for k in range(1, 5)]

    def at(rank: Column) -> Column:
        return sum((rank >= c).cast("double") for c in up_to) + 1

    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def period_start(ts: Column, grain: str = "month") -> Column:
    """First day of the month or (Monday-based) week, independent of the session time zone."""
    return F.trunc(F.to_date(ts), grain)


def period_text(period: Column, grain: str = "month") -> Column:
    return F.date_format(period, "yyyy-MM" if grain == "month" else "yyyy-MM-dd")


def parse_month(text: Column) -> Column:
    """``yyyy-MM`` text to the first day of that month; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM")).cast("date")


def timestamp_from_unix(seconds: Column) -> Column:
    """Unix seconds as a zone-free timestamp."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def unix_from_timestamp(ts: Column) -> Column:
    """Zone-free timestamp as whole unix seconds."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def naive_timestamp(text: Column) -> Column:
    """Text with a trailing zone name to a zone-free UTC timestamp; NULL when malformed."""
    bare = F.regexp_replace(F.trim(text), r"\s*(UTC|Z|\+00:?00)$", "")
    return F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def age_months(period: Column, first_seen: Column) -> Column:
    """Whole days from first sighting to the period start over 30, to one digit.

    Days are floored, so the first period of a product is usually negative.
    """
    day = F.to_date(first_seen)
    partial = (first_seen > day.cast("timestamp_ntz")).cast("int")
    return F.round((F.datediff(period, day) - partial) / F.lit(30.0), 1)


def lifecycle_stage(age: Column, bounds: Sequence[float] = (3, 12, 24)) -> Column:
    first, second, third = bounds
    return (
        F.when(age < first, "introduction")
        .when(age < second, "growth")
        .when(age < third, "maturity")
        .otherwise("decline")
    )


def rating_sentiment(score: Column) -> Column:
    """Rating 1..5 to -1..1; any other score is NULL."""
    out = F.lit(None).cast("double")
    for rating, value in specs.RATING_SENTIMENT.items():
        out = F.when(score == rating, F.lit(value)).otherwise(out)
    return out


def event_weight(event_type: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for name, weight in specs.EVENT_WEIGHTS.items():
        out = F.when(event_type == name, F.lit(weight).cast("bigint")).otherwise(out)
    return out


def hash_bucket(key: Column, buckets: int = 1_000_000) -> Column:
    """Deterministic bucket in [0, buckets) from the md5 of the key's text."""
    digits = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % F.lit(buckets).cast("bigint")


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp that keeps NULL (greatest and least skip NULL on their own)."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))
