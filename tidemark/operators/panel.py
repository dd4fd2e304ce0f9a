"""Panels of entities over sessions, and windows aligned to the calendar.

Offsets count sessions of the whole market, so that an entity without a row there has no value. A range frame over
the session number says just that; no grid of all sessions and entities is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Sessions are numbered in one place; there are so many at most.
MAX_SESSIONS = 1_000_000


def supplier_panel(lineitem: DataFrame) -> DataFrame:
    """entity, session_date, price, volume and tradable by supplier and ship date."""
    return lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("session_date")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 9).alias("price"), F.sum("l_quantity").alias("volume"), F.bool_and(F.col("l_returnflag") != "R").alias("tradable")
    )


def numbered(panel: DataFrame, date: str = "session_date", to: str = "t", dates: DataFrame | None = None) -> DataFrame:
    """panel with the number of each row's session, from 0. The dates are few: one small table, which is broadcast.

    dates, if given, has the panel's dates at less cost than the panel itself, such as one column of what it is made of.
    """
    dates = (panel if dates is None else dates).select(date).distinct()
    if (n := dates.count()) > MAX_SESSIONS:
        raise ValueError(f"{n} sessions")
    calendar = dates.withColumn(to, (F.row_number().over(Window.orderBy(date)) - 1).cast("int"))
    return panel.join(F.broadcast(calendar), date)


def _by_entity() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("t")


def at_offset(value: str, sessions: int) -> Column:
    """The entity's value so many sessions later (or, negative, earlier), null if it has no row there."""
    return F.max(value).over(_by_entity().rangeBetween(sessions, sessions))


def momentum(sessions: int, value: str = "price") -> Column:
    before = at_offset(value, -sessions)
    return F.when(before > 0, F.col(value) / before - 1)


def forward_label(sessions: int, value: str = "price") -> Column:
    return F.when(F.col(value) > 0, at_offset(value, sessions) / F.col(value) - 1)


def _z(value: str, w: WindowSpec, least: int) -> Column:
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    var = q / n - (s / n) * (s / n)
    return F.when((n >= least) & (var > 0), (F.col(value) - s / n) / F.sqrt(var))


def expanding_zscore(value: str, least: int = 20) -> Column:
    """(x - mean) / sd over all sessions so far, this one included, with at least so many values."""
    return _z(value, _by_entity().rowsBetween(Window.unboundedPreceding, 0), least)


def full_sample_zscore(value: str, least: int = 20) -> Column:
    """The same over the whole sample: a deliberate look into the future."""
    return _z(value, Window.partitionBy("entity"), least)


def trailing_volatility(value: str, sessions: int = 60, least: int = 20) -> Column:
    """Population sd over the last sessions of the calendar, from the time that there are so many."""
    w = _by_entity().rangeBetween(-(sessions - 1), 0)
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    var = q / n - (s / n) * (s / n)
    return F.when((F.col("t") >= sessions) & (n >= least) & (var > 0), F.sqrt(var))


def full_sample_volatility(value: str, least: int = 20) -> Column:
    """Population sd over all of the entity's values: a deliberate look into the future."""
    w = Window.partitionBy("entity")
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    var = q / n - (s / n) * (s / n)
    return F.when((n >= least) & (var > 0), F.sqrt(var))
