"""Row filters shared by the reports. All are plain Column predicates, so Catalyst
pushes them to the scan where the format allows it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def scoped(df: DataFrame, company: int | None = 1, active: bool | None = None) -> DataFrame:
    """Rows of one company and one soft-delete state; ``None`` leaves either open."""
    if company is not None:
        df = df.filter(F.col("company") == company)
    if active is not None:
        df = df.filter(F.col("active") if active else ~F.col("active"))
    return df


def contains_pattern(column: str, term: str | None) -> Column | None:
    """Case-insensitive match anywhere; ``%`` and ``_`` in the term stay wildcards."""
    return F.col(column).ilike(f"%{term}%") if term else None


def in_range(column: str, date_from=None, date_to=None) -> Column | None:
    """Inclusive date range; a blank bound is open."""
    bounds = []
    if date_from:
        bounds.append(F.col(column) >= F.lit(_day(date_from)))
    if date_to:
        bounds.append(F.col(column) <= F.lit(_day(date_to)))
    return _all(bounds)


def history_predicate(
    date_column: str,
    party_column: str,
    part_column: str,
    *,
    party: str | None = None,
    part: str | None = None,
    date_from=None,
    date_to=None,
) -> Column:
    """The AND of the filled-in history filters; true when all are blank."""
    parts = [
        contains_pattern(party_column, party),
        contains_pattern(part_column, part),
        in_range(date_column, date_from, date_to),
    ]
    return _all([p for p in parts if p is not None], F.lit(True))


def search(df: DataFrame, term: str | None, columns: list[str]) -> DataFrame:
    """Rows in which any of ``columns`` holds ``term`` literally, ignoring case."""
    if not term:
        return df
    hits = [_lowered(c).contains(term.lower()) for c in columns]
    return df.filter(reduce(Column.__or__, hits))


def facet_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows whose facet column holds ``value`` as a substring, ignoring case."""
    return df.filter(_lowered(column).contains(value.lower())) if value else df


def status_filter(df: DataFrame, active: bool | None) -> DataFrame:
    if active is None:
        return df
    return df.filter(F.col("active") if active else ~F.col("active"))


def date_filter(df: DataFrame, column: str, from_=None, to=None, exact=None) -> DataFrame:
    """List-page date filter: a lower bound drops undated rows, an upper bound keeps
    them, an exact day drops them."""
    if exact:
        df = df.filter(F.col(column) == F.lit(_day(exact)))
    if from_:
        df = df.filter(F.col(column) >= F.lit(_day(from_)))
    if to:
        df = df.filter(F.col(column).isNull() | (F.col(column) <= F.lit(_day(to))))
    return df


def stock_level_filter(df: DataFrame, level: str | None, column: str = "current_stock") -> DataFrame:
    """``low`` (0 < x < 10), ``zero`` (x <= 0) or ``available`` (x > 0) on the whole
    units of the stock level, cut toward zero."""
    whole = F.coalesce(F.col(column).cast("bigint"), F.lit(0))
    rules = {
        "low": (whole > 0) & (whole < 10),
        "zero": whole <= 0,
        "available": whole > 0,
    }
    return df.filter(rules[level]) if level else df


def _lowered(column: str) -> Column:
    return F.lower(F.col(column).cast("string"))


def _day(value) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _all(conditions: list[Column], default: Column | None = None) -> Column | None:
    return reduce(Column.__and__, conditions) if conditions else default
