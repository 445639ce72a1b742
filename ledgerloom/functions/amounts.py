"""Scalar expressions on money, dates and text that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.sources.schemas import MONEY


def debit_less_credit() -> Column:
    """Null when either side is null, so that sums leave the line out."""
    return F.col("debit") - F.col("credit")


def money(amount: Column) -> Column:
    return amount.cast(MONEY)


def or_zero(amount: Column) -> Column:
    """Money with zero for "no lines"."""
    return money(F.coalesce(amount, F.lit(0)))


def within(date: Column, date_start=None, date_end=None) -> Column:
    """Both ends included and optional; with any end given, undated lines are out."""
    inside = F.lit(True)
    if date_start is not None:
        inside = inside & (date >= day(date_start))
    if date_end is not None:
        inside = inside & (date <= day(date_end))
    return inside


def day(value) -> Column:
    """A date given as text, as a date or as a column."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def day_or_today(value) -> Column:
    return F.current_date() if value is None else day(value)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Substring search; ``%`` and ``_`` in the needle are ordinary characters."""
    return F.lower(text).contains(needle.lower())


def balance_color(balance: Column) -> Column:
    return F.when(balance < 0, "red").otherwise("black")
