"""The queries on the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import finance
from .operators import gates, guard, joins, null, panel, portfolio, pricing, regression, views
from .plans.declaration import Declaration, read_plan
from .plans.folds import fitted_folds
from .session import written

AS_OF = "1998-06-30 00:00:00"
EVENTS_AS_OF = "2024-01-15 00:00:00"
ORDERS = Declaration("orders", "o_custkey", "event_time", "available_time", "tradable")
EVENTS = Declaration("events", "user_id", "ts")
LOOKBACKS, CADENCE, HORIZON, QUANTILE, BPS = (3, 5, 10, 20), 5, 10, 0.2, 10.0
#: Sessions to train on, out of sample, and between the two; as many folds as the calendar has room for.
TRAIN, OOS, PURGE, EMBARGO = 500, 250, 10, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Order lines: known when ordered and shipped. Of both dates, the scans leave out those after until; the guard stays on top."""
    orders, lines = (_table(spark, sf_dir, name) for name in ("orders", "lineitem"))
    if until:
        early = lambda c: F.col(c).isNull() | (F.col(c) <= F.lit(until).cast("timestamp_ntz"))
        orders, lines = orders.where(early("o_orderdate")), lines.where(early("l_shipdate"))
    orders = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("event_time"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", (F.col("l_returnflag") != "R").alias("tradable"))
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return rows.select("o_orderkey", "l_linenumber", "o_custkey", "event_time", F.greatest("event_time", "l_shipdate").alias("available_time"), "tradable", F.col("l_extendedprice").alias("value"))


_FACTS = """facts AS (SELECT o_orderkey, l_linenumber, o_custkey, o_orderdate AS event_time, greatest(o_orderdate, l_shipdate) AS available_time,
  l_returnflag <> 'R' AS tradable, l_extendedprice AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return panel.numbered(panel.supplier_panel(lines), dates=lines.select(F.col("l_shipdate").alias("session_date"))).drop("session_date")


_PANEL = """raw AS (SELECT l_suppkey AS entity, l_shipdate AS d, round(avg(l_extendedprice / l_quantity), 9) AS price, sum(l_quantity) AS volume, bool_and(l_returnflag <> 'R') AS tradable
  FROM lineitem GROUP BY 1, 2),
calendar AS (SELECT d, (row_number() OVER (ORDER BY d) - 1)::INT AS t FROM (SELECT DISTINCT d FROM raw)),
panel AS (SELECT entity, t, price, volume, tradable FROM raw JOIN calendar USING (d))"""


def _signals(spark: SparkSession, sf_dir: str, lookback: int = 20, rows: DataFrame | None = None) -> DataFrame:
    """Momentum of the rows that are tradable, at the sessions on which books are made. Here and below, rows is the panel if it is at hand already."""
    rows = (rows or _panel(spark, sf_dir)).withColumn("signal", F.round(panel.momentum(lookback), 9))
    return rows.where((F.col("t") % CADENCE == 0) & F.col("tradable"))


def _signal_sql(lookback: int = 20) -> str:
    return f"""{_PANEL},
back AS (SELECT *, max(price) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN {lookback} PRECEDING AND {lookback} PRECEDING) AS p0 FROM panel),
signals AS (SELECT entity, t, price, volume, round(CASE WHEN p0 > 0 THEN price / p0 - 1 END, 9) AS signal FROM back WHERE tradable AND t % {CADENCE} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY signal DESC, entity) AS place, count(*) OVER (PARTITION BY t) AS names FROM signals WHERE signal IS NOT NULL),
sized AS (SELECT *, least(greatest(1, floor(names * {QUANTILE})::INT), names // 2) AS k FROM ranked),
weights AS (SELECT entity, t, CASE WHEN place <= k THEN 0.5 / k ELSE -0.5 / k END::DOUBLE AS weight FROM sized WHERE place <= k OR place > names - k)"""


def _weights(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return portfolio.books(portfolio.ranked(_signals(spark, sf_dir, rows=rows)), QUANTILE).select("entity", "t", "weight")


def _offset_sql(k: int) -> str:
    frame = f"{-k} PRECEDING AND {-k} PRECEDING" if k < 0 else f"{k} FOLLOWING AND {k} FOLLOWING"
    return f"max(price) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN {frame})"


_SLOTS = -(-HORIZON // CADENCE)
#: The book held: what all books that are alive wish, in the tradable rows; in between it is carried.
_BOOK = f"""{_signal_sql()},
wished AS (SELECT p.entity, p.t, round(coalesce(sum(w.weight / {_SLOTS}), 0), 12) AS wish FROM panel p LEFT JOIN weights w ON w.entity = p.entity AND w.t BETWEEN p.t - {HORIZON - 1} AND p.t WHERE p.tradable GROUP BY p.entity, p.t),
moved AS (SELECT entity, t, wish, round(wish - coalesce(lag(wish) OVER (PARTITION BY entity ORDER BY t), 0), 12) AS change FROM wished),
trades AS (SELECT entity, t, price, volume, change FROM moved JOIN panel USING (entity, t) WHERE change <> 0),
earned AS (SELECT p.entity, p.t, coalesce(last_value(wish IGNORE NULLS) OVER (PARTITION BY p.entity ORDER BY p.t), 0) AS position,
  round(CASE WHEN price > 0 THEN max(price) OVER (PARTITION BY p.entity ORDER BY p.t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / price - 1 END, 9) AS r,
  round(price / nullif(max(price) OVER (PARTITION BY p.entity ORDER BY p.t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1, 9) AS r_same
  FROM panel p LEFT JOIN moved m ON p.entity = m.entity AND p.t = m.t),
span AS (SELECT (SELECT min(t) FROM weights) AS first_book, (SELECT max(t) FROM panel) AS last_session),
costs AS (SELECT t, round(sum(abs(change)), 9) AS turnover, count(*) AS n_trades FROM trades GROUP BY t),
daily AS (SELECT t, round(sum(position * coalesce(r, 0)), 9) AS gross FROM earned, span WHERE t >= first_book AND t < last_session GROUP BY t)"""


def _held(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The panel with the book held and its trades, written once: returns, costs and gates all read it."""
    rows = rows or written(_panel(spark, sf_dir), "book-panel")
    return written(portfolio.netted(rows, _weights(spark, sf_dir, rows), HORIZON, CADENCE), "book-held")


def _trades(held: DataFrame) -> DataFrame:
    return held.where("change is not null").select("entity", "t", "price", "volume", "change")


def _daily(held: DataFrame) -> DataFrame:
    return portfolio.book_days(held, BPS / 1e4)


@query(f"WITH {_FACTS} SELECT o_orderkey, l_linenumber, o_custkey, available_time, value FROM facts WHERE available_time <= TIMESTAMP '{AS_OF}'")
def point_view_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read_plan(ORDERS, AS_OF.replace(" ", "T") + "Z", ["o_orderkey", "l_linenumber", "o_custkey", "available_time", "value"])
    return guard.guarded(_facts(spark, sf_dir, AS_OF), plan)


@query(f"SELECT event_id, user_id, ts, value FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}'")
def event_time_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read_plan(EVENTS, EVENTS_AS_OF.replace(" ", "T") + "Z", ["event_id", "user_id", "ts", "value"])
    return guard.guarded(_table(spark, sf_dir, "events"), plan)


@query(f"SELECT user_id, arg_max(value, (ts, event_id)) AS latest, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}' AND event_type <> 'error' GROUP BY user_id")
def latest_value_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    rows = rows.where(guard.as_of(rows, "ts", EVENTS_AS_OF) & (F.col("event_type") != "error"))
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("n"))


@query(f"""WITH {_FACTS} SELECT count(*) AS input_rows, count(*) FILTER (available_time <= TIMESTAMP '{AS_OF}') AS output_rows,
  count(*) FILTER (available_time > TIMESTAMP '{AS_OF}' OR available_time IS NULL) AS dropped_rows, count(*) FILTER (available_time IS NULL) AS invalid_rows FROM facts""")
def guard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.audit(_facts(spark, sf_dir), "available_time", AS_OF)


@query(f"""WITH c AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'soon' WHEN o_orderkey % 83 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' END AS clock,
  CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) ELSE o_orderdate - INTERVAL 2 HOUR END END AS moment FROM orders)
SELECT count(*) AS input_rows, count(*) FILTER (moment <= TIMESTAMP '{AS_OF}') AS output_rows, count(*) FILTER (moment > TIMESTAMP '{AS_OF}' OR moment IS NULL) AS dropped_rows, count(*) FILTER (moment IS NULL) AS invalid_rows FROM c""")
def guard_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks as text: dates, instants with a zone, and three kinds that are no instants."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    clock = F.when(key % 97 == 0, None).when(key % 89 == 0, "soon").when(key % 83 == 0, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    clock = clock.when(key % 2 == 0, F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return guard.audit(_table(spark, sf_dir, "orders").select(clock.alias("clock")), "clock", AS_OF)


@query(f"WITH {_FACTS} SELECT o_custkey, event_time, available_time, tradable, value FROM facts WHERE available_time <= TIMESTAMP '{AS_OF}'")
def panel_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read_plan(ORDERS, AS_OF.replace(" ", "T") + "Z", ["o_custkey", "event_time", "available_time", "tradable", "value"])
    return guard.guarded(_facts(spark, sf_dir, AS_OF), plan)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _panel(spark, sf_dir)
    primary = rows.select("entity", "t", F.col("t").alias("available"), "tradable")
    members = rows.where("entity % 7 <> 0").select("entity", "t", (F.col("t") + F.when(F.col("entity") % 5 == 0, 1).otherwise(0)).alias("member_available"), (F.col("entity") % 3 != 0).alias("member"))
    return primary, members


_SIDES = f"""{_PANEL}, m AS (SELECT entity, t, t + CASE WHEN entity % 5 = 0 THEN 1 ELSE 0 END AS member_available, entity % 3 <> 0 AS member FROM panel WHERE entity % 7 <> 0)"""


@query(f"""WITH {_SIDES} SELECT entity, p.t, greatest(p.t, member_available) AS available, tradable AND member AS eligible FROM panel p JOIN m USING (entity, t)""")
def composite_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, members = _sides(spark, sf_dir)
    return joins.composite(primary.where("entity % 7 <> 0"), members, ["entity", "t"]).select("entity", "t", "available", "eligible")


@query(f"""WITH {_SIDES}, u AS (SELECT entity, t FROM m UNION ALL SELECT entity, t FROM m WHERE entity % 11 = 0 UNION ALL SELECT entity, t + 100000 FROM m WHERE entity % 13 = 0),
keys AS (SELECT entity, t, count(*) AS n FROM u GROUP BY ALL)
SELECT (SELECT count(*) FROM panel)::BIGINT AS primary_rows, (SELECT count(*) FROM u)::BIGINT AS membership_rows, (SELECT count(*) FROM panel SEMI JOIN keys USING (entity, t))::BIGINT AS matched_rows,
  (SELECT coalesce(sum(n), 0) FROM keys ANTI JOIN panel USING (entity, t))::BIGINT AS unused_rows, (SELECT count(*) FROM keys WHERE n > 1)::BIGINT AS repeated_keys""")
def composite_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership with repeated keys, and with keys that no primary row has."""
    primary, members = _sides(spark, sf_dir)
    keys = members.select("entity", "t")
    unused = keys.where("entity % 13 = 0").withColumn("t", F.col("t") + 100000)
    return joins.coverage(primary, keys.unionByName(keys.where("entity % 11 = 0")).unionByName(unused), ["entity", "t"])


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n_output FROM events GROUP BY ALL),
s AS (SELECT user_id, event_type, count(*) AS n_supplied FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT user_id, event_type, n_output, coalesce(n_supplied, 0) AS n_supplied FROM o LEFT JOIN s USING (user_id, event_type) WHERE n_output > coalesce(n_supplied, 0)""")
def multiset_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return joins.excess(rows, rows.where("event_id % 3 <> 0"), ["user_id", "event_type"])


_REVISIONS = f"""{_FACTS}, rev AS (SELECT o_custkey, event_time, available_time, round(sum(value), 2) AS value FROM facts GROUP BY ALL)"""


@query(f"""WITH {_REVISIONS} SELECT o_custkey, event_time, available_time, arg_max(value, (event_time, available_time))
  OVER (PARTITION BY o_custkey ORDER BY available_time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM rev""")
def asof_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = _facts(spark, sf_dir).groupBy("o_custkey", "event_time", "available_time").agg(F.round(F.sum("value"), 2).alias("value"))
    return joins.revision_as_of(rev, "o_custkey", "event_time", "available_time", "value").drop("value")


@query(f"WITH {_PANEL} SELECT entity, t, round(price / nullif({_offset_sql(-1)}, 0) - 1, 9) AS r FROM panel")
def lag_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("entity", "t", F.round(panel.momentum(1), 9).alias("r"))


@query(f"WITH {_PANEL} SELECT entity, t, {', '.join(f'round(price / nullif({_offset_sql(-k)}, 0) - 1, 9) AS m{k}' for k in LOOKBACKS)} FROM panel")
def momentum_lookbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("entity", "t", *(F.round(panel.momentum(k), 9).alias(f"m{k}") for k in LOOKBACKS))


@query(f"WITH {_PANEL} SELECT entity, t, round({_offset_sql(5)} / price - 1, 9) AS label FROM panel")
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("entity", "t", F.round(panel.forward_label(5), 9).alias("label"))


def _z_sql(over: str) -> str:
    n, s, q = (f"{x} OVER ({over})" for x in ("count(v)", "sum(v)", "sum(v * v)"))
    return f"round(CASE WHEN {n} >= 20 AND {q} / {n} - ({s} / {n}) * ({s} / {n}) > 0 THEN (v - {s} / {n}) / sqrt({q} / {n} - ({s} / {n}) * ({s} / {n})) END, 4) + 0.0"


_LOGS = f"{_PANEL}, v AS (SELECT entity, t, price / 1000 AS v FROM panel)"


@query(f"WITH {_LOGS} SELECT entity, t, {_z_sql('PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING')} AS z FROM v")
def expanding_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).withColumn("v", F.col("price") / 1000)
    return rows.select("entity", "t", (F.round(panel.expanding_zscore("v"), 4) + 0.0).alias("z"))


@query(f"WITH {_LOGS} SELECT entity, t, {_z_sql('PARTITION BY entity')} AS z FROM v")
def full_sample_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).withColumn("v", F.col("price") / 1000)
    return rows.select("entity", "t", (F.round(panel.full_sample_zscore("v"), 4) + 0.0).alias("z"))


@query(f"""WITH {_LOGS}, w AS (SELECT entity, t, count(v) OVER f AS n, sum(v) OVER f AS s, sum(v * v) OVER f AS q FROM v
  WINDOW f AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT entity, t, round(CASE WHEN t >= 60 AND n >= 20 AND q / n - (s / n) * (s / n) > 0 THEN sqrt(q / n - (s / n) * (s / n)) END, 6) AS vol FROM w""")
def trailing_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).withColumn("v", F.col("price") / 1000)
    return rows.select("entity", "t", F.round(panel.trailing_volatility("v"), 6).alias("vol"))


@query(f"WITH {_signal_sql()} SELECT entity, t, signal, place, names FROM ranked")
def cross_section_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(_signals(spark, sf_dir)).select("entity", "t", "signal", "place", "names")


@query(f"WITH {_signal_sql()} SELECT entity, t, round(weight, 9) AS weight FROM weights")
def longshort_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_BOOK} SELECT t, count(*) AS n, round(sum(abs(change)), 9) AS turnover FROM trades GROUP BY t")
def rebalance_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(_held(spark, sf_dir)).groupBy("t").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("change")), 9).alias("turnover"))


@query(f"""WITH {_BOOK} SELECT entity, t, round(abs(change) * {BPS} / 1e4, 9) AS linear, round(abs(change) * (3 + 0.27) / 1e4 + greatest(change, 0) * 10 / 1e4, 9) AS equity,
  round(abs(change) * (4 + 2) / 1e4, 9) AS futures FROM trades""")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("change")
    return _trades(_held(spark, sf_dir)).select("entity", "t", F.round(finance.linear_cost(c, BPS), 9).alias("linear"), F.round(finance.equity_cost(c, 3, 0.27, 10), 9).alias("equity"), F.round(finance.futures_cost(c, 4, 2), 9).alias("futures"))


@query(f"WITH {_BOOK} SELECT t, round(gross, 7) AS gross FROM daily")
def overlapping_books_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(_held(spark, sf_dir)).select("t", F.round("gross", 7).alias("gross"))


def _costs_sql(execution: str, r: str, until: str) -> str:
    return f"""SELECT '{execution}' AS execution, t, round(round(gross, 9), 7) AS gross, round(coalesce(turnover, 0), 7) AS turnover, round(round(gross, 9) - round(coalesce(turnover, 0) * {BPS} / 1e4, 12), 7) AS net, coalesce(n_trades, 0) AS n_trades
  FROM (SELECT t, sum(position * coalesce({r}, 0)) AS gross FROM earned, span WHERE t >= first_book AND t {until} last_session GROUP BY t) LEFT JOIN costs USING (t)"""


@query(f"WITH {_BOOK} {_costs_sql('next-bar', 'r', '<')} UNION ALL {_costs_sql('same-bar', 'r_same', '<=')}")
def overlapping_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover and returns net of costs of the book held, for both kinds of execution: the second one shows what it is worth to earn before one trades."""
    held = _held(spark, sf_dir)
    both = (portfolio.book_days(held, BPS / 1e4, execution).withColumn("execution", F.lit(execution)) for execution in (portfolio.NEXT_BAR, portfolio.SAME_BAR))
    return reduce(DataFrame.unionByName, both).select("execution", "t", *(F.round(c, 7).alias(c) for c in ("gross", "turnover", "net")), "n_trades")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few rows: one for each OOS sessions of the calendar."""
    return fitted_folds(_table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_shipdate").cast("int").alias("n")), TRAIN, OOS, PURGE, EMBARGO, HORIZON)


_FOLDS = f"""folds AS (SELECT k::INT AS fold, 0 AS train_start, ({TRAIN} + k * {OOS} - 1)::INT AS train_end, ({TRAIN + PURGE + EMBARGO} + k * {OOS})::INT AS oos_start, ({TRAIN + PURGE + EMBARGO} + (k + 1) * {OOS} - 1)::INT AS oos_end
  FROM (SELECT unnest(range(n // {OOS} + 1)) AS k, n FROM (SELECT count(DISTINCT l_shipdate) AS n FROM lineitem)) WHERE {TRAIN + PURGE + EMBARGO} + (k + 1) * {OOS} <= n)"""


@query(f"WITH {_FOLDS} SELECT * FROM folds")
def fold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir)


@query(f"""WITH {_PANEL}, {_FOLDS} SELECT fold, count(*) FILTER (t BETWEEN train_start AND train_end) AS train_rows, count(*) FILTER (t BETWEEN oos_start AND oos_end) AS oos_rows,
  count(*) FILTER (t > train_end AND t < oos_start) AS gap_rows FROM folds JOIN panel ON t BETWEEN train_start AND oos_end GROUP BY fold""")
def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _folds(spark, sf_dir), _panel(spark, sf_dir).groupBy("t").agg(F.count("*").alias("n"))
    both = rows.join(F.broadcast(table), F.col("t").between(F.col("train_start"), F.col("oos_end")))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return both.groupBy("fold").agg(n(F.col("t").between(F.col("train_start"), F.col("train_end"))).alias("train_rows"), n(F.col("t").between(F.col("oos_start"), F.col("oos_end"))).alias("oos_rows"), n((F.col("t") > F.col("train_end")) & (F.col("t") < F.col("oos_start"))).alias("gap_rows"))


@query(f"""WITH {_PANEL}, {_FOLDS}, d AS (SELECT fold, train_start AS hist_start, unnest(range(oos_start, oos_end + 1, {HORIZON})) AS decision FROM folds)
SELECT fold, decision::INT AS decision, count(*) AS source_rows, count(*) FILTER (t BETWEEN hist_start AND decision) AS history_rows, count(*) FILTER (t < hist_start OR t > decision) AS outside_rows, count(*) FILTER (t BETWEEN hist_start AND decision AND NOT tradable) AS masked_rows,
  count(*) FILTER (t BETWEEN hist_start AND decision AND tradable) AS output_rows, count(*) FILTER (tradable AND t = decision) AS decision_rows FROM d, panel GROUP BY fold, decision""")
def verification_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _folds(spark, sf_dir).select("fold", F.col("train_start").alias("hist_start"), F.explode(F.sequence("oos_start", "oos_end", F.lit(HORIZON))).alias("decision"))
    return views.audit(_panel(spark, sf_dir), decisions)


_METRICS = "round(coalesce(avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(252), 0), 6) AS sharpe, round(avg(gross) * 252, 6) AS annual_return, round(coalesce(stddev_samp(gross), 0) * sqrt(252), 6) AS annual_vol"


def _metrics() -> list:
    return [F.round(finance.sharpe("gross"), 6).alias("sharpe"), F.round(F.avg("gross") * 252, 6).alias("annual_return"), F.round(finance.sample_sd("gross") * F.sqrt(F.lit(252.0)), 6).alias("annual_vol")]


def _by_fold(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    return _daily(held or _held(spark, sf_dir)).join(F.broadcast(_folds(spark, sf_dir)), F.col("t").between(F.col("oos_start"), F.col("oos_end")))


@query(f"WITH {_BOOK}, {_FOLDS} SELECT fold, count(*) AS n, {_METRICS} FROM daily JOIN folds ON t BETWEEN oos_start AND oos_end GROUP BY fold")
def return_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), *_metrics())


@query(f"""WITH {_BOOK}, {_FOLDS}, e AS (SELECT fold, t, product(1 + gross) OVER (PARTITION BY fold ORDER BY t) AS equity FROM daily JOIN folds ON t BETWEEN oos_start AND oos_end),
p AS (SELECT fold, equity / greatest(1, max(equity) OVER (PARTITION BY fold ORDER BY t)) - 1 AS dd FROM e) SELECT fold, round(least(0, min(dd)), 6) AS max_drawdown FROM p GROUP BY fold""")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("fold").orderBy("t")
    equity = _by_fold(spark, sf_dir).withColumn("equity", F.product(1 + F.col("gross")).over(w))
    return equity.withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1).groupBy("fold").agg(F.round(F.least(F.lit(0.0), F.min("dd")), 6).alias("max_drawdown"))


@query(f"""WITH {_BOOK}, {_FOLDS}, f AS (SELECT fold, sum(gross) AS r FROM daily JOIN folds ON t BETWEEN oos_start AND oos_end GROUP BY fold)
SELECT count(*) AS n_folds, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(coalesce(max(abs(r)) / nullif(sum(abs(r)), 0), 1), 6) AS largest_share FROM f""")
def fold_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _by_fold(spark, sf_dir).groupBy("fold").agg(F.sum("gross").alias("r"))
    total = F.sum(F.abs("r"))
    return sums.agg(F.count("*").alias("n_folds"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 6).alias("positive"), F.round(F.when(total > 0, F.max(F.abs("r")) / total).otherwise(1.0), 6).alias("largest_share"))


@query(f"""WITH {_BOOK} SELECT t, round(max(abs(change) * 1e6 / (price * volume)), 6) AS participation, count(*) FILTER (volume IS NULL OR volume <= 0) AS unknown FROM trades GROUP BY t""")
def capacity_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades are where the name has a market: a name is traded in its own rows only."""
    rows = _trades(_held(spark, sf_dir))
    return rows.groupBy("t").agg(F.round(F.max(F.abs("change") * 1e6 / (F.col("price") * F.col("volume"))), 6).alias("participation"), F.count_if(F.col("volume").isNull() | (F.col("volume") <= 0)).alias("unknown"))


@query(f"""WITH {_BOOK}, x AS (SELECT gross AS r FROM daily), s AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM x),
k AS (SELECT n, m / sd AS sr, sum(pow((r - m) / sd, 3)) / n AS g3, sum(pow((r - m) / sd, 4)) / n AS g4 FROM x, s GROUP BY n, m, sd)
SELECT n, round(sr, 6) AS sharpe, round(g3, 5) AS skew, round(g4, 4) AS kurt, round(sr * sqrt(n - 1.0) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr), 5) AS z FROM k""")
def deflated_sharpe_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(written(_daily(_held(spark, sf_dir)), "daily-returns"))


def _moments(rows: DataFrame) -> DataFrame:
    s = rows.agg(F.count("*").alias("n"), F.avg("gross").alias("m"), F.stddev_samp("gross").alias("sd"))
    z = (F.col("gross") - F.col("m")) / F.col("sd")
    k = rows.join(F.broadcast(s)).groupBy("n", "m", "sd").agg((F.sum(F.pow(z, 3)) / F.first("n")).alias("g3"), (F.sum(F.pow(z, 4)) / F.first("n")).alias("g4")).withColumn("sr", F.col("m") / F.col("sd"))
    deflated = F.col("sr") * F.sqrt(F.col("n") - 1.0) / F.sqrt(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr"))
    return k.select("n", F.round("sr", 6).alias("sharpe"), F.round("g3", 5).alias("skew"), F.round("g4", 4).alias("kurt"), F.round(deflated, 5).alias("z"))


@query(f"""WITH {_PANEL}, x AS (SELECT {_offset_sql(-5)} AS p5, {_offset_sql(-20)} AS p20, {_offset_sql(5)} AS ahead, price FROM panel),
f AS (SELECT round(price / p5 - 1, 6) AS a, round(price / p20 - 1, 6) AS b, round(ahead / price - 1, 6) AS y FROM x WHERE p5 > 0 AND p20 > 0 AND ahead IS NOT NULL)
SELECT count(*) AS n, round(sum(a), 3) AS a, round(sum(b), 3) AS b, round(sum(y), 3) AS y, round(sum(a * a), 3) AS aa, round(sum(a * b), 3) AS ab, round(sum(b * b), 3) AS bb, round(sum(a * y), 3) AS ay, round(sum(b * y), 3) AS by FROM f""")
def ridge_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).select(F.round(panel.momentum(5), 6).alias("a"), F.round(panel.momentum(20), 6).alias("b"), F.round(panel.forward_label(5), 6).alias("y")).dropna()
    pairs = ("a", "b", "y", "aa", "ab", "bb", "ay", "by")
    return rows.agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(p[0]) * F.col(p[1]) if len(p) == 2 else F.col(p)), 3).alias(p) for p in pairs))


@query("""SELECT o_custkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'assumed' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'reconstructed' ELSE 'observed' END AS basis, o_orderkey FROM orders""")
def basis_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    basis = F.when(F.col("o_orderdate") < at("1996-01-01"), "assumed").when(F.col("o_orderdate") < at("1998-01-01"), "reconstructed").otherwise("observed")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", basis.alias("basis"), "o_orderkey")


_PARTS = range(1, 61, 15)


@query(f"""SELECT count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {i}, 15))::BIGINT)::HUGEINT::VARCHAR AS part_{i}" for i in _PARTS)}
FROM (SELECT sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'))) AS h FROM orders)""")
def row_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a table's rows whatever their order: parts of each row's hash are added up, so that no list of hashes meets in one place."""
    cells = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = _table(spark, sf_dir, "orders").select(F.sha2(cells, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"part_{i}") for i in _PARTS]
    return rows.agg(F.count("*").alias("n"), *parts)


def _series(daily: DataFrame) -> DataFrame:
    """Sessions are few: numbered in one place."""
    return daily.select((F.row_number().over(Window.orderBy("t")) - 1).alias("i"), F.col("gross").alias("r"))


REPLICATIONS, BLOCK, SEED = 64, 10, 42


@query(f"""WITH {_BOOK}, s AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, gross AS r FROM daily), n AS (SELECT count(*) AS n, avg(r) AS m, avg(r) / stddev_samp(r) AS sr FROM s),
k AS (SELECT n, unnest(range({REPLICATIONS} * n)) AS id FROM n),
a AS (SELECT *, id // n AS replication, id % n AS place, ({SEED} + ((id // n) * CAST(ceil(n / {BLOCK}.0) AS BIGINT) + (id % n) // {BLOCK} + 1) * {null.GOLDEN}) % 4294967296 AS x FROM k),
b AS (SELECT * REPLACE (((xor(x, x >> 15)::HUGEINT * (x | 1)) % 4294967296)::BIGINT AS x) FROM a),
c AS (SELECT * REPLACE (xor(x, ((x + (xor(x, x >> 7)::HUGEINT * (x | 61)) % 4294967296) % 4294967296)::BIGINT) AS x) FROM b),
d AS (SELECT replication, (floor(xor(x, x >> 14) / 4294967296.0 * n)::BIGINT + place % {BLOCK}) % n AS i FROM c),
e AS (SELECT replication, avg(r - m) / stddev_samp(r - m) AS sharpe FROM d JOIN s USING (i), n GROUP BY replication)
SELECT count(*) AS replications, count(*) FILTER (sharpe >= sr) AS exceedances, round((count(*) FILTER (sharpe >= sr) + 1) / (count(*) + 1), 6) AS p_value FROM e, n GROUP BY sr""")
def bootstrap_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = written(_series(_daily(_held(spark, sf_dir))), "bootstrap-series")
    observed = series.agg((F.avg("r") / F.stddev_samp("r")).alias("sr")).first()["sr"]
    drawn = null.block_bootstrap(spark, series, REPLICATIONS, BLOCK, SEED).groupBy("replication").agg((F.avg("value") / F.stddev_samp("value")).alias("sharpe"))
    return null.p_value(drawn, "sharpe", observed).withColumn("p_value", F.round("p_value", 6))


@query(f"""WITH {_BOOK}
SELECT count(*) AS n, round(avg(gross - 2 * coalesce(turnover, 0) * {BPS} / 1e4) / stddev_samp(gross - 2 * coalesce(turnover, 0) * {BPS} / 1e4) * sqrt(252), 5) AS sharpe FROM daily LEFT JOIN costs USING (t)""")
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Sharpe ratio of the book held at twice its costs."""
    net = _daily(_held(spark, sf_dir)).withColumn("net", F.col("gross") - 2 * F.col("cost"))
    return net.agg(F.count("*").alias("n"), F.round(finance.sharpe("net"), 5).alias("sharpe"))


@query(f"""WITH {_PANEL}, {_FOLDS}, x AS (SELECT t, {', '.join(f"round(price / nullif({_offset_sql(-k)}, 0) - 1, 6) AS m{k}" for k in LOOKBACKS)}, round({_offset_sql(1)} / price - 1, 6) AS y FROM panel),
s AS ({' UNION ALL '.join(f"SELECT fold, {k} AS lookback, round(sum(m{k} * y) / sqrt(sum(m{k} * m{k}) * sum(y * y)), 6) AS score FROM x JOIN folds ON t BETWEEN train_start AND train_end WHERE m{k} IS NOT NULL AND y IS NOT NULL GROUP BY fold" for k in LOOKBACKS)}),
o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, lookback) AS place FROM s) SELECT fold, lookback, score FROM o WHERE place = 1""")
def lookback_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookback whose momentum goes best with the next return in each fold's training; the first of equals."""
    x = _panel(spark, sf_dir).select("t", F.round(panel.forward_label(1), 6).alias("y"), *(F.round(panel.momentum(k), 6).alias(str(k)) for k in LOOKBACKS))
    tall = x.unpivot(["t", "y"], [str(k) for k in LOOKBACKS], "lookback", "m").where("m is not null and y is not null")
    m, y = F.col("m"), F.col("y")
    sums = tall.groupBy("lookback", "t").agg(F.sum(m * y).alias("my"), F.sum(m * m).alias("mm"), F.sum(y * y).alias("yy"))
    rows = sums.join(F.broadcast(_folds(spark, sf_dir)), F.col("t").between(F.col("train_start"), F.col("train_end")))
    scores = rows.groupBy("fold", F.col("lookback").cast("int").alias("lookback")).agg(F.round(F.try_divide(F.sum("my"), F.sqrt(F.sum("mm") * F.sum("yy"))), 6).alias("score"))
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last("score"), "lookback"))).where("place = 1").drop("place")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, t, entity, price, tradable, score by supplier and month. A month without a sale carries the price; it, and a month whose last line came back, isn't tradable."""
    lines = _table(spark, sf_dir, "lineitem")
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")
    seen = lines.groupBy(F.col("l_suppkey").alias("entity"), t).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("seen"), (F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")) != "R").alias("open"))
    last = seen.agg(F.max("t")).first()[0]
    if last is None:
        last = 0
    grid = seen.groupBy("entity").agg(F.min("t").alias("first")).select("entity", F.explode(F.sequence("first", F.lit(last))).alias("t"))
    w = Window.partitionBy("entity").orderBy("t")
    rows = grid.join(seen, ["entity", "t"], "left").withColumn("price", F.last("seen", ignorenulls=True).over(w))
    rows = rows.select(F.floor((F.lit(last) - F.col("t")) / 24).cast("int").alias("fold"), "t", "entity", "price", (F.col("seen").isNotNull() & F.col("open")).alias("tradable"), (F.col("price") / F.lag("price", 3).over(w) - 1).alias("score"))
    return rows


#: A walk from step to step: what can't be traded stays, and what else is wished shares what is left of its side's budget.
_MONTHS = f"""seen AS (SELECT l_suppkey AS entity, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS t, avg(l_extendedprice / l_quantity) AS seen, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) <> 'R' AS open FROM lineitem GROUP BY 1, 2),
last_ AS (SELECT max(t) AS last FROM seen), grid AS (SELECT entity, unnest(range(min(t), (SELECT last FROM last_) + 1))::INT AS t FROM seen GROUP BY entity),
filled AS (SELECT entity, t, last_value(seen IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t) AS price, seen IS NOT NULL AND open AS tradable FROM grid LEFT JOIN seen USING (entity, t)),
market AS (SELECT ((last - t) // 24)::INT AS fold, t, entity, price, tradable, price / lag(price, 3) OVER (PARTITION BY entity ORDER BY t) - 1 AS score FROM filled, last_),
sessions AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY t) - 1 AS o FROM (SELECT DISTINCT fold, t FROM market)),
m AS (SELECT * FROM market JOIN sessions USING (fold, t)),
may AS (SELECT fold, (o - 1) // 3 AS step, entity FROM m WHERE o >= 1 AND (o - 1) % 3 = 0 AND tradable),
signals AS (SELECT fold, o // 3 AS step, entity, score FROM m WHERE o % 3 = 0 AND score IS NOT NULL AND NOT isnan(score)),
placed AS (SELECT fold, step, entity, row_number() OVER (PARTITION BY fold, step ORDER BY score DESC, entity) AS place, count(*) OVER (PARTITION BY fold, step) AS names FROM signals JOIN may USING (fold, step, entity)),
cut AS (SELECT *, least(greatest(1, floor(names * {QUANTILE})::INT), names // 2) AS k FROM placed),
wish AS (SELECT fold, step, entity, CASE WHEN place <= k THEN 0.5 / k ELSE -0.5 / k END::DOUBLE AS base FROM cut WHERE place <= k OR place > names - k),
walk AS (SELECT -1 AS step, fold, NULL::BIGINT AS entity, NULL::DOUBLE AS target FROM (SELECT DISTINCT fold FROM m)
  UNION ALL (WITH carried AS (SELECT w.step + 1 AS step, w.fold, w.entity, w.target FROM walk w WHERE w.entity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM may WHERE may.fold = w.fold AND may.step = w.step + 1 AND may.entity = w.entity)),
    used AS (SELECT fold, sum(greatest(target, 0)) AS l, sum(greatest(-target, 0)) AS s FROM carried GROUP BY fold),
    here AS (SELECT step + 1 AS step, fold FROM walk w WHERE entity IS NULL AND EXISTS (SELECT 1 FROM sessions x WHERE x.fold = w.fold AND x.o = 1 + 3 * (w.step + 1)))
    SELECT carried.* FROM carried SEMI JOIN here USING (step, fold)
    UNION ALL SELECT step, fold, entity, base * CASE WHEN base > 0 THEN (0.5 - coalesce(l, 0)) / 0.5 ELSE (0.5 - coalesce(s, 0)) / 0.5 END FROM wish JOIN here USING (step, fold) LEFT JOIN used USING (fold)
    UNION ALL SELECT step, fold, NULL, NULL FROM here)),
kept AS (SELECT fold, o, t, w.entity, target FROM walk w JOIN sessions USING (fold) WHERE o >= 1 AND (o - 1) // 3 = w.step AND w.entity IS NOT NULL),
paid AS (SELECT k.fold, k.t, count(*)::INT AS held, sum(target * (now.price / before.price - 1)) AS gross FROM kept k JOIN m now ON now.fold = k.fold AND now.o = k.o AND now.entity = k.entity
  JOIN m before ON before.fold = k.fold AND before.o = k.o - 1 AND before.entity = k.entity GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_MONTHS} SELECT fold, t, coalesce(held, 0) AS held, round(coalesce(gross, 0), 8) AS gross FROM sessions LEFT JOIN paid USING (fold, t)")
def fold_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross returns of long-short books with positions carried through months without a sale."""
    return pricing.fold_returns(_months(spark, sf_dir), 3, 1, QUANTILE).withColumn("gross", F.round("gross", 8))


_TRIALS = len(LOOKBACKS)
_LUCK = (1 - finance.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / _TRIALS) + finance.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (_TRIALS * math.e))
_ERF = "({1} + k * ({2} + k * ({3} + k * ({4} + k * {5}))))".format(*finance.ERF)


@query(f"""WITH x AS ({SQL['deflated_sharpe_inputs']}), v AS (SELECT n, sharpe, sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1)) AS sd FROM x),
y AS (SELECT n, sharpe, (sharpe - sd * {_LUCK}) / sd / sqrt(2.0) AS y FROM v), k AS (SELECT *, 1 / (1 + {finance.ERF[0]} * abs(y)) AS k FROM y)
SELECT n, sharpe, round((1 + sign(y) * (1 - k * {_ERF} * exp(-y * y))) / 2, 6) AS probability FROM k""")
def deflated_sharpe_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deflated(deflated_sharpe_inputs(spark, sf_dir))


def _deflated(x: DataFrame) -> DataFrame:
    v = finance.sharpe_variance(F.col("sharpe"), F.col("skew"), F.col("kurt"), F.col("n"))
    return x.select("n", "sharpe", F.round(finance.deflated_sharpe(F.col("sharpe"), v, F.lit(_TRIALS)), 6).alias("probability"))


@query(f"""WITH {_signal_sql()}, w AS (SELECT entity, t, count(v) OVER f AS n, sum(v) OVER f AS s, sum(v * v) OVER f AS q FROM (SELECT entity, t, price / 1000 AS v FROM panel)
  WINDOW f AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
vols AS (SELECT entity, t, round(CASE WHEN t >= 60 AND n >= 20 AND q / n - (s / n) * (s / n) > 0 THEN sqrt(q / n - (s / n) * (s / n)) END, 6) AS vol FROM w),
sizes AS (SELECT entity, t, sign(weight) * {portfolio.TARGET_VOLATILITY} / vol AS size FROM weights JOIN vols USING (entity, t) WHERE vol > 0)
SELECT entity, t, round(size / sum(abs(size)) OVER (PARTITION BY t), 7) AS weight FROM sizes""")
def volatility_sized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    vols = _panel(spark, sf_dir).withColumn("v", F.col("price") / 1000).select("entity", "t", F.round(panel.trailing_volatility("v"), 6).alias("vol"))
    rows = _weights(spark, sf_dir).select("entity", "t", F.signum("weight").alias("side")).join(vols, ["entity", "t"])
    return portfolio.sized_by_volatility(rows, "vol").select("entity", "t", F.round("weight", 7).alias("weight"))


CAPITAL, MOST_PARTICIPATION = 1e4, 0.05


def _gates(held: DataFrame, returns: DataFrame) -> DataFrame:
    """Capacity and costs of the book held, and stability of its returns by fold."""
    return gates.report(gates.capacity(_trades(held), CAPITAL, MOST_PARTICIPATION), gates.cost_stress(returns), gates.stability(returns.select("fold", F.col("gross").alias("r"))))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    return _gates(held, written(_by_fold(spark, sf_dir, held), "gates-returns"))


_GATES = f"""{_BOOK}, {_FOLDS},
shares AS (SELECT CASE WHEN price > 0 AND volume > 0 THEN abs(change) * {CAPITAL} / (price * volume) END AS share FROM trades),
oos AS (SELECT fold, t, gross FROM daily JOIN folds ON t BETWEEN oos_start AND oos_end),
stressed AS (SELECT count(*) AS n, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS s FROM (SELECT gross - {gates.COST_MULTIPLE} * round(coalesce(turnover, 0) * {BPS} / 1e4, 12) AS r FROM oos LEFT JOIN costs USING (t))),
sums AS (SELECT sum(gross) AS r FROM oos GROUP BY fold),
stable AS (SELECT count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS share, coalesce(max(abs(r)) / nullif(sum(abs(r)), 0), 1) AS one FROM sums),
gates AS (SELECT 'capacity' AS gate, CASE WHEN count(*) = 0 THEN 'unavailable' WHEN count(*) = count(share) AND max(share) <= {MOST_PARTICIPATION} THEN 'passed' ELSE 'failed' END AS status, max(share) AS observed FROM shares
  UNION ALL SELECT 'cost', CASE WHEN n < {gates.LEAST_RETURNS} THEN 'unavailable' WHEN s > 0 THEN 'passed' ELSE 'failed' END, s FROM stressed
  UNION ALL SELECT 'stability', CASE WHEN n < {gates.LEAST_FOLDS} THEN 'unavailable' WHEN share >= 2.0 / 3 AND one <= {gates.MOST_OF_ONE_FOLD} THEN 'passed' ELSE 'failed' END, share FROM stable)"""


@query(f"WITH {_GATES} SELECT gate, status, round(observed, 6) AS observed FROM gates")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("gate", "status", F.round("observed", 6).alias("observed"))


@query(f"WITH {_GATES} SELECT CASE WHEN bool_or(status = 'failed' OR status = 'unavailable' AND gate <> 'stability') THEN 'rejected' WHEN bool_or(status = 'unavailable') THEN 'degraded' ELSE 'accepted' END AS verdict FROM gates")
def report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.verdict(_report(spark, sf_dir), ("capacity", "cost"))


#: A fold's gain is known once it has so many sessions with trades.
LEAST_TRADED = 100


@query(f"""WITH {_GATES}, x AS (SELECT fold, t, gross, round(coalesce(turnover, 0) * {BPS} / 1e4, 12) AS cost, coalesce(n_trades, 0) AS n_trades FROM oos LEFT JOIN costs USING (t)),
f AS (SELECT fold, count(*) AS n, count(*) FILTER (n_trades > 0) AS traded, sum(gross) AS gain, coalesce(avg(gross - {gates.COST_MULTIPLE} * cost) / nullif(stddev_samp(gross - {gates.COST_MULTIPLE} * cost), 0), 0) AS s FROM x GROUP BY fold),
g AS (SELECT fold, CASE WHEN n < {gates.LEAST_RETURNS} THEN 'unavailable' WHEN s > 0 THEN 'passed' ELSE 'failed' END AS cost, CASE WHEN traded < {LEAST_TRADED} THEN 'unavailable' WHEN gain > 0 THEN 'passed' ELSE 'failed' END AS gain FROM f)
SELECT fold, CASE WHEN cost <> 'passed' OR gain = 'failed' THEN 'rejected' WHEN gain = 'unavailable' THEN 'degraded' ELSE 'accepted' END AS verdict FROM g""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each fold from two gates of its own: what it earns after doubled costs (required), and what it gains where it traded enough to tell."""
    days = _by_fold(spark, sf_dir)
    stressed = days.withColumn("stressed", F.col("gross") - gates.COST_MULTIPLE * F.col("cost"))
    folds = stressed.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("n_trades") > 0).alias("traded"), F.sum("gross").alias("gain"), finance.sharpe("stressed").alias("s"))
    cost = F.when(F.col("n") < gates.LEAST_RETURNS, gates.UNAVAILABLE).when(F.col("s") > 0, gates.PASSED).otherwise(gates.FAILED)
    gain = F.when(F.col("traded") < LEAST_TRADED, gates.UNAVAILABLE).when(F.col("gain") > 0, gates.PASSED).otherwise(gates.FAILED)
    rows = folds.select("fold", F.explode(F.array(F.struct(F.lit("cost").alias("gate"), cost.alias("status")), F.struct(F.lit("gain").alias("gate"), gain.alias("status")))).alias("g")).select("fold", "g.*")
    return gates.verdict(rows, ("cost",), ("fold",))


@query(f"""WITH {_PANEL}, x AS (SELECT {_offset_sql(-20)} AS p20, {_offset_sql(5)} AS ahead, price FROM panel),
f AS (SELECT round(price / p20 - 1, 6) AS b, round(ahead / price - 1, 6) AS y FROM x WHERE p20 > 0 AND ahead IS NOT NULL),
s AS (SELECT count(*) AS n, sum(b) AS b, sum(y) AS y, sum(b * b) + 1 AS bb, sum(b * y) AS c FROM f)
SELECT round((y - b * (n * c - b * y) / (n * bb - b * b)) / n, 6) AS intercept, round((n * c - b * y) / (n * bb - b * b), 6) AS slope FROM s""")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).select(F.round(panel.momentum(20), 6).alias("b"), F.round(panel.forward_label(5), 6).alias("y"))
    intercept, slope = regression.ridge_fit(rows, ["b"], "y", 1.0)
    return spark.range(1).select(F.round(F.lit(intercept), 6).alias("intercept"), F.round(F.lit(slope), 6).alias("slope"))
