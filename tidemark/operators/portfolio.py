"""Ranks, quantile books, turnover and books that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: a session with fewer names makes no book where books are of the best and worst of many.
LEAST_NAMES = 10


def ranked(signals: DataFrame, signal: str = "signal", by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Rows with a signal, with their place (from 1, best first, ties by entity) and the number of names of the session. Several strategies are ranked at once if by names them too."""
    w = Window.partitionBy(*by).orderBy(F.desc(signal), F.asc("entity"))
    return signals.where(F.col(signal).isNotNull() & ~F.isnan(signal)).withColumns({"place": F.row_number().over(w), "names": F.count("*").over(Window.partitionBy(*by))})


def books(rows: DataFrame, quantile: float, long_short: bool = True) -> DataFrame:
    """The selected rows of ranked(), with weight: +-0.5 / size of the bucket, or 1 / size of the only one."""
    k = F.greatest(F.lit(1), F.floor(F.col("names") * F.lit(quantile)).cast("int"))
    if not long_short:
        k = F.least(k, F.col("names"))
        return rows.withColumn("weight", 1.0 / k).where(F.col("place") <= k)
    k = F.least(k, F.floor(F.col("names") / 2).cast("int"))
    side = F.when(F.col("place") <= k, 1).when(F.col("place") > F.col("names") - k, -1)
    return rows.withColumn("side", side).where("side is not null").withColumn("weight", F.col("side") * 0.5 / k)


def trades(weights: DataFrame, cadence: int, by: tuple[str, ...] = ()) -> DataFrame:
    """entity, t, change: the difference of each book (t, entity, weight) from the one cadence sessions before; names that left are sold. by names the strategies, if there are several."""
    keys = [*by, "entity", "t"]
    now = weights.select(*keys, F.col("weight").alias("new"))
    before = weights.select(*by, "entity", (F.col("t") + cadence).alias("t"), F.col("weight").alias("old"))
    both = now.join(before, keys, "full")
    return both.select(*keys, (F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("change")).where("change <> 0")


#: Weights are rounded to so many places where they are added up, so that a book that replaces its like trades nothing.
PLACES = 12


def netted(rows: DataFrame, weights: DataFrame, horizon: int, cadence: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (entity, t, tradable) with the book held after each session's trades (`position`) and the trade itself (`change`, null where there is none).

    A book (t, entity, weight) is wished for horizon sessions and has 1 / ceil(horizon / cadence) of the capital; what all
    books wish is netted by entity before it is traded, so that a new book is traded against the one that retires. An
    entity is traded in its own tradable rows only: what can't be traded is carried to its next one, and nothing is
    liquidated when the rows end. Books enter and leave as events of one window by entity; no session of a
    book's life is spelled out. by names the strategies, if rows and weights have several.
    """
    keys, slots = [*by, "entity"], -(-horizon // cadence)
    enter = weights.select(*keys, "t", (F.col("weight") / slots).alias("book_step"))
    leave = weights.select(*keys, (F.col("t") + horizon).alias("t"), (-F.col("weight") / slots).alias("book_step"))
    both = rows.withColumn("is_row", F.lit(True)).unionByName(enter.unionByName(leave), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t")
    wish = F.round(F.coalesce(F.sum("book_step").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), PLACES)
    own = both.withColumn("wish", F.when(F.col("tradable"), wish)).where("is_row")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    held = own.withColumn("position", F.coalesce(F.last("wish", ignorenulls=True).over(so_far), F.lit(0.0)))
    change = F.round(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)), PLACES)
    return held.withColumn("change", change).withColumn("change", F.when(F.col("change") != 0, F.col("change"))).drop("is_row", "book_step", "wish")


#: When a trade begins to earn: with the session after it, or (a look-ahead on purpose) with its own.
NEXT_BAR, SAME_BAR = "next-bar", "same-bar"


def book_days(held: DataFrame, per_change: float, execution: str = NEXT_BAR, price: str = "price") -> DataFrame:
    """t, gross, turnover, cost, net and n_trades of each session of netted(), from the first book to the last session that can earn.

    The book held after a session's trades earns from this session's close to the next one's, or from the close before
    to this one's; a price that is missing or not above 0 on either side earns nothing.
    """
    w = Window.partitionBy("entity").orderBy("t")
    other = F.max(price).over(w.rangeBetween(1, 1) if execution == NEXT_BAR else w.rangeBetween(-1, -1))
    now, then = (F.col(price), other) if execution == NEXT_BAR else (other, F.col(price))
    r = F.round(F.when((now > 0) & then.isNotNull(), then / now - 1), 9)
    days = held.withColumn("r", r).groupBy("t").agg(
        F.round(F.sum(F.col("position") * F.coalesce("r", F.lit(0.0))), 9).alias("gross"), F.round(F.coalesce(F.sum(F.abs("change")), F.lit(0.0)), 9).alias("turnover"), F.count("change").alias("n_trades"), F.bool_or(F.col("position") != 0).alias("any_held"),
    )
    # a row for each session
    ends = days.agg(F.min(F.when(F.col("any_held") | (F.col("n_trades") > 0), F.col("t"))).alias("first_book"), F.max("t").alias("last_session"))
    inside = (F.col("t") >= F.col("first_book")) & ((F.col("t") < F.col("last_session")) | F.lit(execution != NEXT_BAR))
    cost = F.round(F.col("turnover") * per_change, 12)
    return days.join(F.broadcast(ends), inside).select("t", "gross", "turnover", cost.alias("cost"), F.round(F.col("gross") - cost, 9).alias("net"), "n_trades")


#: Fixed value: a position's size is this over its volatility, before books are scaled to a gross exposure of 1.
TARGET_VOLATILITY = 0.02


def sized_by_volatility(rows: DataFrame, volatility: str, target: float = TARGET_VOLATILITY) -> DataFrame:
    """Rows (t, side, volatility) with weight: sizes in inverse proportion to volatility, gross 1 by session. No volatility above 0, no position."""
    size = F.lit(target) / F.col(volatility)
    sized = rows.where(F.col(volatility) > 0).withColumn("weight", F.col("side") * size)
    return sized.withColumn("weight", F.col("weight") / F.sum(F.abs("weight")).over(Window.partitionBy("t")))
