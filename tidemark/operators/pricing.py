"""Prices books fold by fold, with positions that can't be traded carried along.

What a book may buy depends on what is still held, but only through one number: the part of a side's budget that is
left at each step. Which names a step wishes, how long each of them stays if it can't be traded, and what share of a
budget those that stay take, come from one pass over all steps. The parts that are left then follow from the ones
before by a small recurrence for each fold and side, and scale the wishes. So the number of jobs doesn't grow with
the steps, and what is written doesn't either. Sessions and folds are few; entities may be many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


#: What names a trade.
TRADE = ("fold", "t", "entity")
#: A cost model: from trades (TRADE, previous, target, change, price and the market columns asked for) to one `charge` for each TRADE.
CostModel = Callable[[DataFrame], DataFrame]


class PricingError(ValueError):
    """A position or trade that can't be priced, or carried positions beyond their side's budget."""


def _broken(text: str) -> Column:
    return F.raise_error(F.lit(f"PRICING: {text}"))


def by_trade(charge: Callable[[Column], Column]) -> CostModel:
    """The cost model of a charge that depends on the trade's change alone, such as finance.linear_cost."""
    return lambda trades: trades.select(*TRADE, charge(F.col("change")).alias("charge"))


def spread_and_impact(spread: str, impact_bps: float) -> CostModel:
    """Half the spread (a market column in basis points, not below 0) and a fixed impact on what is traded."""
    bps = F.when(F.col(spread) >= 0, F.col(spread)).otherwise(_broken(f"{spread} is not a number from 0").cast("double"))
    return lambda trades: trades.select(*TRADE, (F.abs("change") * (bps / 2 + impact_bps) / 1e4).alias("charge"))


#: Rows of folds and sessions that are broadcast, at most.
MAX_SESSIONS = 1_000_000


def _placed(rows: DataFrame) -> DataFrame:
    """rows (fold, step, entity, score, ...) with names and place in each step, from 1: best scores first, ties by entity. Ranges of the order are ranked by themselves and their sizes added up, so that a step of any size is spread over tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order, step = [F.desc("score"), F.asc("entity")], ["fold", "step"]
    ranged = written(rows.repartitionByRange(n, F.asc("fold"), F.asc("step"), *order).withColumn("part", F.spark_partition_id()), "pricing-ranks")
    sizes = ranged.groupBy(*step, "part").agg(F.count("*").alias("n_part"))
    all_, before = Window.partitionBy(*step), Window.partitionBy(*step).orderBy("part")
    # a row for each step and range
    starts = sizes.select(*step, "part", F.sum("n_part").over(all_).alias("names"), (F.sum("n_part").over(before) - F.col("n_part")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy(*step, "part").orderBy(*order))
    return ranged.join(F.broadcast(starts), [*step, "part"]).withColumn("place", place).drop("part", "start")


def _wishes(rows: DataFrame, hold: int, lag: int, quantile: float, long_short: bool) -> DataFrame:
    """fold, step, entity, side, base and until: what each step wishes among what can be traded then, as if nothing else were held, and the next step at which it can be traded (null if there is none)."""
    offset = F.col("offset")
    may = rows.where((offset >= lag) & ((offset - lag) % hold == 0) & F.col("tradable")).select("fold", F.expr(f"cast((offset - {lag}) div {hold} as int)").alias("step"), "entity")
    may = may.withColumn("until", F.lead("step").over(Window.partitionBy("fold", "entity").orderBy("step")))
    sized = "size" in rows.columns
    signal = rows.where((offset % hold == 0) & F.col("score").isNotNull() & ~F.isnan("score")).select("fold", F.expr(f"cast(offset div {hold} as int)").alias("step"), "entity", "score", *(["size"] if sized else []))
    placed = _placed(signal.join(may, ["fold", "step", "entity"]))
    k = F.least(F.greatest(F.lit(1), F.floor(F.col("names") * quantile)), F.floor(F.col("names") / 2) if long_short else F.col("names"))
    side = F.when(F.col("place") <= k, 1).when(F.lit(long_short) & (F.col("place") > F.col("names") - k), -1)
    chosen = placed.withColumns({"side": side, "k": k}).where("side is not null")
    budget = F.when(F.col("side") == 1, 0.5 if long_short else 1.0).otherwise(0.5)
    if not sized:
        return chosen.select("fold", "step", "entity", "side", (F.col("side") * budget / F.col("k")).alias("base"), "until")
    size = F.when((F.col("size") > 0) & (F.col("size") < float("inf")), F.col("size")).otherwise(_broken("a size is not a number above 0").cast("double"))
    chosen = chosen.withColumn("size", size)
    totals = chosen.groupBy("fold", "step", "side").agg(F.sum("size").alias("total"))  # two rows for each step
    return chosen.join(F.broadcast(totals), ["fold", "step", "side"]).select("fold", "step", "entity", "side", (F.col("side") * budget * F.col("size") / F.col("total")).alias("base"), "until")


def _left(wishes: DataFrame, last: DataFrame, long_short: bool) -> DataFrame:
    """fold, side, step and left: the part of a side's budget that positions carried through the step leave; only of folds and sides that carry anything.

    left(s) = 1 - the sum of share(r, u) * left(r) over what was bought at r < s and can't be traded before u > s, in shares of the side's budget.
    """
    budget = 0.5 if long_short else 1.0
    beyond = F.coalesce("until", F.col("last_step") + 1)
    kept = wishes.join(F.broadcast(last), "fold").select("fold", "side", "step", beyond.alias("until"), "last_step", (F.abs("base") / budget).alias("share")).where("until > step + 1")
    # for a fold, at most a row for each two steps; exact sums, which doubles wouldn't have in any order
    edges = kept.groupBy("fold", "side", "step", "until", "last_step").agg(F.sum(F.col("share").cast("decimal(38,30)")).cast("double").alias("share"))
    lists = edges.groupBy("fold", "side", "last_step").agg(F.sort_array(F.collect_list(F.struct("step", "until", "share"))).alias("edges"))

    def step(done: Column, s: Column) -> Column:
        open_ = F.filter("edges", lambda e: (e["step"] < s) & (e["until"] > s))
        used = F.aggregate(open_, F.lit(0.0), lambda x, e: x + e["share"] * F.element_at(done, e["step"] + 1))
        checked = F.when(used > 1 + 1e-9, _broken("carried positions exceed their side's budget").cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - used))
        return F.concat(done, F.array(checked))

    parts = F.aggregate(F.sequence(F.lit(0), F.col("last_step")), F.array().cast("array<double>"), step)
    return lists.select("fold", "side", F.posexplode(parts).alias("step", "left"))


def _priced(rows: DataFrame, hold: int, lag: int, quantile: float, long_short: bool, market: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions (fold, t, offset, step), rows with their offset, and positions (fold, entity, step, until, target): bought at a step, held until another (null: to the end)."""
    if lag < 1 or hold < 1:
        raise PricingError("a signal is traded a session later at the earliest")
    sized = "size" in rows.columns
    rows = written(rows.select("fold", "t", F.col("entity").cast("bigint").alias("entity"), "price", "tradable", "score", *(["size"] if sized else []), *market), "pricing-rows")
    sessions = rows.select("fold", "t").distinct().withColumn("offset", F.row_number().over(Window.partitionBy("fold").orderBy("t")) - 1)
    sessions = written(sessions.withColumn("step", F.expr(f"case when offset >= {lag} then cast((offset - {lag}) div {hold} as int) end")), "pricing-sessions")
    if (n := sessions.count()) > MAX_SESSIONS:
        raise PricingError(f"{n} sessions of folds")
    rows = rows.join(F.broadcast(sessions.select("fold", "t", "offset")), ["fold", "t"])
    last = sessions.groupBy("fold").agg(F.max("step").alias("last_step")).where("last_step is not null")
    wishes = written(_wishes(rows, hold, lag, quantile, long_short), "pricing-wishes")
    left = F.broadcast(_left(wishes, last, long_short))  # no more rows than two for each session
    target = F.col("base") * F.coalesce("left", F.lit(1.0))
    return sessions, rows, written(wishes.join(left, ["fold", "side", "step"], "left").select("fold", "entity", "step", "until", target.alias("target")), "pricing-positions")


def _gross(sessions: DataFrame, rows: DataFrame, positions: DataFrame) -> DataFrame:
    last = sessions.groupBy("fold").agg(F.max("step").alias("last_step"))
    steps = F.explode(F.sequence(F.col("step"), F.coalesce(F.col("until") - 1, F.col("last_step"))))
    each = positions.join(F.broadcast(last), "fold").select("fold", "entity", "target", steps.alias("step"))
    held = each.join(F.broadcast(sessions), ["fold", "step"]).select("fold", "t", "offset", "entity", "target")
    now = rows.select("fold", "offset", "entity", "price", F.lit(True).alias("is_now"))
    past = rows.select("fold", (F.col("offset") + 1).alias("offset"), "entity", F.col("price").alias("past"), F.lit(True).alias("is_past"))
    priced = held.join(now, ["fold", "offset", "entity"], "left").join(past, ["fold", "offset", "entity"], "left")
    lost = F.count_if(F.col("is_now").isNull() | F.col("is_past").isNull())
    sums = priced.groupBy("fold", "t").agg(F.count("*").cast("int").alias("held"), F.sum(F.col("target") * (F.col("price") / F.col("past") - 1)).alias("gross"), lost.alias("lost"))
    gross = F.when(F.col("lost") > 0, F.raise_error(F.format_string("fold %d, session %d: no close for a held position", "fold", "t"))).otherwise(F.col("gross"))
    return sessions.select("fold", "t").join(sums, ["fold", "t"], "left").select("fold", "t", F.coalesce("held", F.lit(0)).alias("held"), F.when(F.col("held").isNull(), 0.0).otherwise(gross).alias("gross"))


def _trades(sessions: DataFrame, positions: DataFrame) -> DataFrame:
    """What is bought at a step against what ends there."""
    first = sessions.where("step is not null").groupBy("fold", "step").agg(F.min("t").alias("t"))
    bought = positions.select("fold", "entity", "step", "target")
    ended = positions.where("until is not null").select("fold", "entity", F.col("until").alias("step"), F.col("target").alias("previous"))
    before, after = (F.coalesce(c, F.lit(0.0)) for c in ("previous", "target"))
    trades = bought.join(ended, ["fold", "entity", "step"], "full").where(before != after).join(F.broadcast(first), ["fold", "step"])
    return trades.select(*TRADE, before.alias("previous"), after.alias("target"), (after - before).alias("change"))


def fold_returns(rows: DataFrame, hold: int, lag: int, quantile: float, long_short: bool = True) -> DataFrame:
    """Gross return and number of positions of every session; rows (fold, t, entity, price, tradable, score) are one each per fold, session and entity.

    A fold starts flat, trades lag sessions after every hold-th signal, earns from the close before the
    execution session on, and isn't liquidated. A missing close of a held position is an error. A column `size`
    (above 0) divides each side's budget in proportion; without it, a side's positions are equal.
    """
    return _gross(*_priced(rows, hold, lag, quantile, long_short))


def fold_trades(rows: DataFrame, hold: int, lag: int, quantile: float, long_short: bool = True) -> DataFrame:
    """The trades of the same walk."""
    sessions, _, positions = _priced(rows, hold, lag, quantile, long_short)
    return _trades(sessions, positions)


def charged(trades: DataFrame, cost: CostModel) -> DataFrame:
    """The trades with their charge. A trade without a charge or with more than one, a charge without its trade, and one that is no number from 0 are errors when read."""
    charge = F.col("charge")
    charges = cost(trades).groupBy(*TRADE).agg(F.count("*").alias("charges"), F.max("charge").cast("double").alias("charge"))
    ok = (charge >= 0) & (charge < float("inf"))
    checked = F.when(F.col("is_trade").isNull(), _broken("a charge without a trade").cast("double")).when(F.coalesce("charges", F.lit(0)) != 1, _broken("a trade needs one charge").cast("double"))
    checked = checked.when(F.coalesce(ok, F.lit(False)), charge).otherwise(_broken("a charge is not a number from 0").cast("double"))
    return trades.withColumn("is_trade", F.lit(True)).join(charges, list(TRADE), "full").withColumn("charge", checked).drop("charges", "is_trade")


def net_returns(rows: DataFrame, hold: int, lag: int, quantile: float, cost: CostModel, long_short: bool = True, market: tuple[str, ...] = ()) -> DataFrame:
    """fold_returns() with turnover, cost and net return of every session; costs fall on the session that trades.

    The cost model is given each trade's price at its execution session, and the columns of the rows that market names.
    A price that isn't above 0 is an error for every row, traded or not.
    """
    price = F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.col("price")).otherwise(_broken("a price is not a number above 0").cast("double"))
    sessions, rows, positions = _priced(rows.withColumn("price", price), hold, lag, quantile, long_short, market)
    found = _trades(sessions, positions).join(rows.select(*TRADE, "price", *market, F.lit(True).alias("is_market")), list(TRADE), "left")
    at_market = F.when(F.col("is_market").isNull(), _broken("a trade has no market row").cast("boolean")).otherwise(True)
    traded = written(found.where(at_market).drop("is_market"), "pricing-trades")
    costs = charged(traded, cost).groupBy("fold", "t").agg(F.sum(F.abs("change")).alias("turnover"), F.sum("charge").alias("cost"))
    # every session has one return and at most one cost; a cost without its session is an error
    days = _gross(sessions, rows, positions).join(costs, ["fold", "t"], "full")
    one = F.when(F.col("held").isNull(), _broken("a cost has no session").cast("boolean")).otherwise(True)
    return days.where(one).fillna(0.0, ["turnover", "cost"]).withColumn("net", F.col("gross") - F.col("cost"))
