"""Column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as a number: plain or scientific decimals and infinities.  The JVM
# parser alone would also take a trailing type letter, as in "12d".
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"

DAY_FIRST = ("d/M/yyyy",)


def parse_day(text: Column, formats: Sequence[str] = DAY_FIRST) -> Column:
    """First format that fits, else null.  Impossible days are null."""
    parsed = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*parsed)


def parse_number(text: Column) -> Column:
    """Drop thousands commas and outer blanks; anything that is no number is null."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def zero_to_null(value: Column) -> Column:
    """A zero day means no service; most statistics leave it out."""
    return F.when(value != 0, value)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide((new - old) * F.lit(100.0), old)


def whole_number(value: Column) -> Column:
    """Round to an integer.

    The inner round removes the noise of the summation order, which otherwise moves
    exact halves between runs.
    """
    return F.round(F.round(value, 4)).cast("bigint")


def weekday_number(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def year_week(day: Column, iso_year: bool = False) -> Column:
    """``YYYY-Www``.  The default joins the *calendar* year with the ISO week, so the
    last days of December can share a label with January of the same year; with
    ``iso_year`` the week-numbering year is used instead."""
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year else F.year(day)
    return F.concat(year.cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the complete pairs; null for a constant side.

    The built-in ``corr`` divides by the deviations and raises under ANSI mode when one
    of them is zero.
    """
    a_in_pair = F.when(b.isNotNull(), a)
    b_in_pair = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a, b),
                        F.stddev_samp(a_in_pair) * F.stddev_samp(b_in_pair))


def month_wave(day: Column) -> tuple[Column, Column]:
    """Position of the month on the yearly circle."""
    angle = F.lit(2 * 3.141592653589793) * F.month(day) / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)
