"""Counts, ratios and rounding that give the same digits on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round a double half up, staying in double arithmetic."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def exact_sum(value: Column) -> Column:
    """Sum doubles as decimals: the result does not depend on the task order."""
    return F.sum(value.cast("decimal(18,6)")).cast("double")


def rounded_avg(value: Column, digits: int) -> Column:
    """Average over non-NULL values; NULL when there are none."""
    return ratio(exact_sum(value), F.count(value), digits)


def ratio(total: Column, n: Column, digits: int) -> Column:
    """Rounded quotient; NULL when ``n`` is 0."""
    return half_up(total / F.nullif(n, F.lit(0)), digits)


def percentage(part: Column, total: Column, digits: int) -> Column:
    """Share of ``total`` in percent; NULL when the total is 0."""
    return half_up(
        part.cast("double") / F.nullif(total, F.lit(0)).cast("double") * F.lit(100.0), digits
    )


def whole_number(text: Column) -> Column:
    """Payload number as BIGINT; fractions are cut, anything else is NULL."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def first_nonzero(*counts: Column) -> Column:
    """First count that is neither NULL nor 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("bigint")) for c in counts],
                      F.lit(0).cast("bigint"))


def engagement(likes: Column, shares: Column, replies: Column) -> Column:
    return likes + shares + replies


def reach_estimate(likes: Column, shares: Column, replies: Column, views: Column) -> Column:
    """Views when there are any, else ten times the engagement."""
    return F.when(views > 0, views).otherwise(
        engagement(likes, shares, replies) * F.lit(10).cast("bigint")
    )
