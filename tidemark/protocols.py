"""Queries on verification views, lineage, packaged factors and whole protocols, each with SQL for the same rows; they join the catalogue's."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as c
from .catalog import SQL, query
from .functions import dates, finance, text
from .operators import gates, joins, lineage, null, panel, portfolio, views
from .plans.declaration import Declaration
from .plans.folds import block_folds
from .session import written

_DECISIONS = f"""{c._FOLDS}, asked AS (SELECT fold, 'train' AS role, train_end AS decision, train_start AS hist_start FROM folds
  UNION ALL SELECT fold, 'out-of-sample', oos_start, train_start FROM folds)"""
_SEEN = f"""{c._PANEL}, {_DECISIONS}, seen AS (SELECT fold, role, decision, entity, t, price FROM asked JOIN panel ON t BETWEEN hist_start AND decision WHERE tradable)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's end of training and its first decision out of sample."""
    folds = c._folds(spark, sf_dir)
    first = folds.select("fold", F.lit(views.OUT_OF_SAMPLE).alias("role"), F.col("oos_start").alias("decision"))
    train = folds.select("fold", F.lit(views.TRAIN).alias("role"), F.col("train_end").alias("decision"))
    return views.admissible(train.unionByName(first), folds)


@query(f"WITH {_SEEN} SELECT * FROM seen")
def verification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be seen at each decision."""
    return views.view(c._panel(spark, sf_dir), _asked(spark, sf_dir)).select(*views.VIEW, "entity", "t", "price")


@query(f"WITH {_SEEN} SELECT fold, role, decision, entity, t FROM seen WHERE price > 10 AND (role = 'train' OR t = decision)")
def admitted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output on the rows with a price above 10: training's counts whole, out of sample only what is said at the decision."""
    rows, asked = written(c._panel(spark, sf_dir).select("entity", "t", "price", "tradable"), "views-panel"), _asked(spark, sf_dir)
    output = views.view(rows, asked).where("price > 10").select(*views.VIEW, "entity", "t")
    return views.admitted_by_range(output, rows, asked).select(*views.VIEW, "entity", "t")


_FACTOR = f"""{c._PANEL}, open AS (SELECT * FROM panel WHERE tradable AND price > 0),
lags AS (SELECT entity, t, {', '.join(f'round(price / lag(price, {k}) OVER (PARTITION BY entity ORDER BY t) - 1, 6) AS r{k}' for k in c.LOOKBACKS)} FROM open)"""


def _z_sql(x: str, over: str) -> str:
    n, s, q = (f"{a} OVER ({over})" for a in (f"count({x})", f"sum({x})", f"sum({x} * {x})"))
    return f"round(CASE WHEN {n} >= 20 AND {q} / {n} - ({s} / {n}) * ({s} / {n}) > 0 THEN ({x} - {s} / {n}) / sqrt({q} / {n} - ({s} / {n}) * ({s} / {n})) END, 4) + 0.0"


_SO_FAR, _ALWAYS = "PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING", "PARTITION BY entity"


@query(f"""WITH {_FACTOR}, z AS (SELECT entity, t, {', '.join(f"{_z_sql(f'r{k}', _SO_FAR)} AS momentum_{k}" for k in c.LOOKBACKS)} FROM lags)
SELECT * FROM z WHERE t % {c.CADENCE} = 0""")
def packaged_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum over so many of the entity's own tradable rows (not sessions), scored against its own past; rows at decisions only.

    Every decision's history starts with the panel, so that one pass serves all decisions.
    """
    rows, w = c._panel(spark, sf_dir).where("tradable and price > 0"), Window.partitionBy("entity").orderBy("t")
    raw = rows.select("entity", "t", *(F.round(F.col("price") / F.lag("price", k).over(w) - 1, 6).alias(f"r{k}") for k in c.LOOKBACKS))
    return raw.select("entity", "t", *((F.round(panel.expanding_zscore(f"r{k}"), 4) + 0.0).alias(f"momentum_{k}") for k in c.LOOKBACKS)).where(F.col("t") % c.CADENCE == 0)


_MOMENTA = f"{c._PANEL}, v AS (SELECT entity, t, round(price / nullif({c._offset_sql(-20)}, 0) - 1, 6) AS v, round(price / nullif({c._offset_sql(-1)}, 0) - 1, 6) AS r FROM panel)"


def _momenta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c._panel(spark, sf_dir).select("entity", "t", F.round(panel.momentum(20), 6).alias("v"), F.round(panel.momentum(1), 6).alias("r"))


@query(f"WITH {_MOMENTA} SELECT entity, t, {_z_sql('v', _SO_FAR)} AS so_far, {_z_sql('v', _ALWAYS)} AS full_sample FROM v")
def momentum_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum against the entity's past, and against its whole sample (a deliberate look into the future)."""
    z = lambda x: F.round(x, 4) + 0.0
    return _momenta(spark, sf_dir).select("entity", "t", z(panel.expanding_zscore("v")).alias("so_far"), z(panel.full_sample_zscore("v")).alias("full_sample"))


@query(f"""WITH {_MOMENTA}, w AS (SELECT entity, t, count(r) OVER f AS n, sum(r) OVER f AS s, sum(r * r) OVER f AS q FROM v WINDOW f AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT entity, t, round(CASE WHEN t >= 60 AND n >= 20 AND q / n - (s / n) * (s / n) > 0 THEN sqrt(q / n - (s / n) * (s / n)) END, 6) AS vol FROM w""")
def return_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _momenta(spark, sf_dir).select("entity", "t", F.round(panel.trailing_volatility("r"), 6).alias("vol"))


@query(f"""WITH {c._REVISIONS}, asks AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS asked FROM orders),
both_ AS (SELECT o_custkey, available_time AS asked, event_time, available_time, value, FALSE AS ask FROM rev UNION ALL SELECT o_custkey, asked, NULL, NULL, NULL, TRUE FROM asks),
known AS (SELECT *, arg_max(value, (event_time, available_time)) FILTER (NOT ask) OVER (PARTITION BY o_custkey ORDER BY asked RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM both_)
SELECT o_custkey, asked, in_force FROM known WHERE ask""")
def revision_at_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in force on the first day of each month in which a customer orders."""
    rev = c._facts(spark, sf_dir).groupBy("o_custkey", "event_time", "available_time").agg(F.round(F.sum("value"), 2).alias("value"))
    asks = c._table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("asked")).distinct()
    return joins.revision_at(asks, rev, "o_custkey", "asked", "event_time", "available_time", "value")


_AT = [datetime(y, 1, 1, tzinfo=UTC) for y in (1993, 1996, 1998)]
CLAIMED = Declaration("orders", "o_custkey", "event_time", "available_time", segments=((_AT[0], _AT[1], "assumed"), (_AT[1], _AT[2], "reconstructed"), (_AT[2], None, "observed")))
FIRST_OBSERVED = datetime(1998, 2, 1, tzinfo=UTC)


@query(f"""WITH {c._FACTS}, b AS (SELECT o_orderkey, l_linenumber, available_time, CASE WHEN event_time < TIMESTAMP '1993-01-01' THEN NULL WHEN event_time < TIMESTAMP '1996-01-01' THEN 'assumed'
  WHEN event_time < TIMESTAMP '1998-01-01' THEN 'reconstructed' ELSE 'observed' END AS basis FROM facts)
SELECT * FROM (SELECT o_orderkey, l_linenumber, basis, CASE WHEN basis IS NULL THEN 'INVALID_SEGMENTS' WHEN basis = 'observed' AND available_time IS NULL THEN 'INVALID_VALUE'
  WHEN basis = 'observed' AND available_time < TIMESTAMP '1998-02-01' THEN 'OBSERVED_BEFORE_LINEAGE' END AS fault FROM b) WHERE fault IS NOT NULL""")
def lineage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.faults(c._facts(spark, sf_dir), CLAIMED, FIRST_OBSERVED).select("o_orderkey", "l_linenumber", "basis", "fault")


_CANDIDATES = f"""{c._PANEL}, moves AS (SELECT entity, t, tradable, {', '.join(f'round(price / nullif({c._offset_sql(-k)}, 0) - 1, 9) AS m{k}' for k in c.LOOKBACKS)}, round({c._offset_sql(1)} / price - 1, 9) AS ahead FROM panel),
tall AS ({' UNION ALL '.join(f'SELECT {k} AS lookback, entity, t, m{k} AS signal FROM moves WHERE tradable AND t % {c.HORIZON} = 0 AND m{k} IS NOT NULL' for k in c.LOOKBACKS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY lookback, t ORDER BY signal DESC, entity) AS place, count(*) OVER (PARTITION BY lookback, t) AS names FROM tall),
cut AS (SELECT *, least(greatest(1, floor(names * {c.QUANTILE})::INT), names // 2) AS k FROM placed),
book AS (SELECT lookback, entity, t, CASE WHEN place <= k THEN 0.5 / k ELSE -0.5 / k END::DOUBLE AS weight FROM cut WHERE place <= k OR place > names - k),
swaps AS (SELECT lookback, t, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM book a FULL JOIN (SELECT lookback, entity, t + {c.HORIZON} AS t, weight FROM book) b USING (lookback, entity, t) GROUP BY lookback, t),
held AS (SELECT lookback, entity, t + i AS t, weight FROM book, range({c.HORIZON}) r(i)),
grown AS (SELECT lookback, t, sum(weight * coalesce(ahead, 0)) AS gross FROM held LEFT JOIN moves USING (entity, t) GROUP BY lookback, t),
days AS (SELECT lookback, t, round(gross, 9) AS gross, round(coalesce(turnover, 0), 9) AS turnover, round(round(gross, 9) - round(coalesce(turnover, 0), 9) * {c.BPS} / 1e4, 9) AS net FROM grown LEFT JOIN swaps USING (lookback, t) WHERE t < (SELECT max(t) FROM panel))"""


def _candidate_days(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """lookback, t, gross, turnover, net: a book that is held to its horizon for each candidate, all candidates at once; costs fall on the first day of holding."""
    momenta = (F.round(panel.momentum(k), 9).alias(str(k)) for k in c.LOOKBACKS)
    rows = written((rows or c._panel(spark, sf_dir)).select("entity", "t", "tradable", F.round(panel.forward_label(1), 9).alias("ahead"), *momenta), "protocol-panel")
    at = rows.where((F.col("t") % c.HORIZON == 0) & F.col("tradable"))
    tall = at.unpivot(["entity", "t"], [str(k) for k in c.LOOKBACKS], "lookback", "signal").withColumn("lookback", F.col("lookback").cast("int"))
    book = portfolio.books(portfolio.ranked(tall, by=("lookback", "t")), c.QUANTILE).select("lookback", "entity", "t", "weight")
    swaps = portfolio.trades(book, c.HORIZON, ("lookback",)).groupBy("lookback", "t").agg(F.sum(F.abs("change")).alias("turnover"))
    held = book.withColumn("t", F.explode(F.sequence(F.col("t"), F.col("t") + c.HORIZON - 1)))
    grown = held.join(rows.select("entity", "t", "ahead"), ["entity", "t"], "left").groupBy("lookback", "t").agg(F.round(F.sum(F.col("weight") * F.coalesce("ahead", F.lit(0.0))), 9).alias("gross"))
    days = grown.join(swaps, ["lookback", "t"], "left").withColumn("turnover", F.round(F.coalesce("turnover", F.lit(0.0)), 9))
    # a book earns up to the last session, and isn't sold after it
    days = days.join(F.broadcast(rows.agg(F.max("t").alias("last_session"))), F.col("t") < F.col("last_session")).drop("last_session")
    return days.withColumn("net", F.round(F.col("gross") - finance.linear_cost(F.col("turnover"), c.BPS), 9))


@query(f"WITH {_CANDIDATES} SELECT lookback, t, round(gross, 7) AS gross, round(turnover, 7) AS turnover, round(net, 7) AS net FROM days")
def candidate_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_days(spark, sf_dir).select("lookback", "t", *(F.round(x, 7).alias(x) for x in ("gross", "turnover", "net")))


_NET_SHARPE = "round(coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0), 5)"
_CHOICE = f"""{_CANDIDATES}, {c._FOLDS}, scores AS (SELECT fold, lookback, {_NET_SHARPE} AS sharpe FROM days JOIN folds ON t BETWEEN train_start AND train_end GROUP BY ALL),
choice AS (SELECT fold, lookback, sharpe FROM scores QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sharpe DESC, lookback) = 1),
oos AS (SELECT fold, lookback, t, turnover, net FROM days JOIN folds ON t BETWEEN oos_start AND oos_end),
chosen AS (SELECT oos.* FROM oos SEMI JOIN choice USING (fold, lookback))"""


def _choice(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each fold's candidate with the best Sharpe in training (the first of equals), and the days out of sample, of all candidates and of the one chosen."""
    days, folds = written(_candidate_days(spark, sf_dir, rows), "protocol-days"), F.broadcast(c._folds(spark, sf_dir))
    scores = days.join(folds, F.col("t").between(F.col("train_start"), F.col("train_end"))).groupBy("fold", "lookback").agg(F.round(finance.sharpe("net"), 5).alias("sharpe"))
    choice = scores.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("sharpe"), "lookback"))).where("place = 1").drop("place")
    oos = days.join(folds, F.col("t").between(F.col("oos_start"), F.col("oos_end"))).select("fold", "lookback", "t", "turnover", "net")
    return choice, oos, oos.join(choice.select("fold", "lookback"), ["fold", "lookback"], "left_semi")


@query(f"WITH {_CHOICE} SELECT fold, lookback, sharpe FROM choice")
def insample_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(spark, sf_dir)[0]


@query(f"""WITH {_CHOICE}, f AS (SELECT fold, {_NET_SHARPE} AS sharpe FROM chosen GROUP BY fold)
SELECT count(*) AS n, {_NET_SHARPE} AS sharpe, round(avg(net) * 252, 6) AS annual_return, round(sum(turnover) / count(*) * 252, 5) AS annual_turnover, (SELECT max(sharpe) FROM f) AS best_fold FROM chosen""")
def protocol_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds' days stitched together: metrics net of costs, turnover by year, and the best fold's Sharpe."""
    chosen = _choice(spark, sf_dir)[2]
    best = chosen.groupBy("fold").agg(F.round(finance.sharpe("net"), 5).alias("s")).agg(F.max("s").alias("best_fold"))
    whole = chosen.agg(F.count("*").alias("n"), F.round(finance.sharpe("net"), 5).alias("sharpe"), F.round(F.avg("net") * 252, 6).alias("annual_return"), F.round(F.sum("turnover") / F.count("*") * 252, 5).alias("annual_turnover"))
    return whole.crossJoin(best)  # one row each


@query(f"""WITH {_CHOICE}, v AS (SELECT fold, {_NET_SHARPE} AS verified FROM chosen GROUP BY fold)
SELECT fold, lookback, sharpe AS explored, verified, round(sharpe - verified, 4) + 0.0 AS evaporated FROM choice JOIN v USING (fold)""")
def evaporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the Sharpe ratio found in training is gone out of sample."""
    choice, _, chosen = _choice(spark, sf_dir)
    verified = chosen.groupBy("fold").agg(F.round(finance.sharpe("net"), 5).alias("verified"))
    return choice.join(verified, "fold").select("fold", "lookback", F.col("sharpe").alias("explored"), "verified", (F.round(F.col("sharpe") - F.col("verified"), 4) + 0.0).alias("evaporated"))


CUTOFF, OWN = "1997-12-31", 20


@query(f"""WITH {c._GATES}, boot AS ({SQL['bootstrap_pvalue']}), luck AS ({SQL['deflated_sharpe_probability']}), late AS (SELECT count(*) AS n, count(*) FILTER (d > TIMESTAMP '{CUTOFF}') AS after FROM oos JOIN calendar USING (t)),
near AS (WITH {_CHOICE} SELECT lookback, {_NET_SHARPE} AS sharpe FROM oos GROUP BY lookback), others AS (SELECT count(*) AS n, avg((sharpe > 0)::INT) AS share FROM near WHERE lookback <> {OWN}), picked AS (WITH {_CHOICE} SELECT count(DISTINCT lookback) AS n FROM choice), tried AS (SELECT (SELECT count(*) FROM near) + (SELECT n FROM picked) AS n)
SELECT gate, status, round(observed, 5) AS observed FROM gates
UNION ALL SELECT 'contamination', CASE WHEN n = 0 THEN 'unavailable' WHEN after >= {gates.LEAST_RETURNS} THEN 'passed' ELSE 'failed' END, after FROM late
UNION ALL SELECT 'null', CASE WHEN p_value <= {gates.ALPHA} THEN 'passed' ELSE 'failed' END, round(p_value, 5) FROM boot
UNION ALL SELECT 'parameter', CASE WHEN n < {gates.LEAST_NEIGHBOURS} THEN 'unavailable' WHEN share >= {gates.POSITIVE_NEIGHBOURS} THEN 'passed' ELSE 'failed' END, round(share, 5) FROM others
UNION ALL SELECT 'trials', CASE WHEN greatest(n, {len(c.LOOKBACKS)}) <= {len(c.LOOKBACKS)} THEN 'passed' ELSE 'failed' END, greatest(n, {len(c.LOOKBACKS)}) FROM tried
UNION ALL SELECT 'deflated_sharpe', CASE WHEN n < {gates.LEAST_RETURNS} THEN 'unavailable' WHEN probability >= {gates.PROBABILITY['standard']} THEN 'passed' ELSE 'failed' END, round(probability, 5) FROM luck""")
def eight_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates on the overlapping momentum book; its neighbours are the other lookbacks' books, held to their horizon, out of sample and net of costs.

    On record are those that were tried out of sample, and besides, as experiments of the family, those that some fold's training chose.
    """
    days = c._table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("decision_time")).distinct()
    calendar = days.withColumn("t", (F.row_number().over(Window.orderBy("decision_time")) - 1).cast("int"))  # sessions are few
    rows = written(c._panel(spark, sf_dir), "gates-panel")
    held = c._held(spark, sf_dir, rows)
    daily = written(c._daily(held), "gates-days")
    returns = daily.join(F.broadcast(c._folds(spark, sf_dir)), F.col("t").between(F.col("oos_start"), F.col("oos_end")))
    choice, tried, _ = _choice(spark, sf_dir, rows)
    near = written(tried.groupBy(F.col("lookback").alias("lock")).agg(F.round(finance.sharpe("net"), 5).alias("sharpe")), "gates-neighbours")
    series = c._series(daily)
    observed = series.agg((F.avg("r") / F.stddev_samp("r")).alias("sr")).first()["sr"]
    drawn = null.block_bootstrap(spark, series, c.REPLICATIONS, c.BLOCK, c.SEED).groupBy("replication").agg((F.avg("value") / F.stddev_samp("value")).alias("value"))
    ids = near.select(F.col("lock").alias("id"))
    found = gates.report(
        c._gates(held, returns), gates.contamination(returns.join(calendar, "t"), CUTOFF), gates.chance(drawn, observed), gates.neighbours(near, str(OWN)),
        gates.trials(gates.trial_count(len(c.LOOKBACKS), ids, choice.select(F.col("lookback").alias("id"))), len(c.LOOKBACKS)), gates.deflated(c._deflated(c._moments(daily))),
    )
    return found.select("gate", "status", F.round("observed", 5).alias("observed"))


def _sql_text(text: str) -> str:
    return text.replace("'", "''")


@query(f"""SELECT doc_id, {', '.join(f"coalesce(regexp_matches(text, '{_sql_text(p)}', 'i'), FALSE) AS {code.lower()}" for code, p in text.ADVISORIES.items())} FROM documents""")
def advisory_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c._table(spark, sf_dir, "documents").select("doc_id", *(text.advisory(F.col("text"), code).alias(code.lower()) for code in text.ADVISORIES))


@query("""WITH s AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'PT' || (event_id % 90) || 'M' WHEN 1 THEN 'P' || (event_id % 3) || 'D' WHEN 2 THEN 'PT' WHEN 3 THEN 'P1DT' WHEN 4 THEN ' PT1.5H ' WHEN 5 THEN 'P1H' WHEN 6 THEN 'P2Y3M1W' END AS span FROM events)
SELECT event_id, coalesce(regexp_matches(trim(span), '^P(\\d+(\\.\\d+)?Y)?(\\d+(\\.\\d+)?M)?(\\d+(\\.\\d+)?W)?(\\d+(\\.\\d+)?D)?(T(\\d+(\\.\\d+)?H)?(\\d+(\\.\\d+)?M)?(\\d+(\\.\\d+)?S)?)?$') AND trim(span) NOT LIKE '%T' AND regexp_matches(span, '[1-9]'), FALSE) AS valid FROM s""")
def duration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), F.lit
    span = F.when(i % 8 == 0, F.concat(s("PT"), i % 90, s("M"))).when(i % 8 == 1, F.concat(s("P"), i % 3, s("D")))
    for k, form in ((2, "PT"), (3, "P1DT"), (4, " PT1.5H "), (5, "P1H"), (6, "P2Y3M1W")):
        span = span.when(i % 8 == k, form)
    return c._table(spark, sf_dir, "events").select("event_id", text.positive_duration(span).alias("valid"))


@query("""SELECT d, (row_number() OVER (ORDER BY d) - 1)::INT AS t FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS d FROM orders) WHERE isodow(d) < 6""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mondays to Fridays from the first order to the last, numbered; days are few."""
    ends = c._table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("d")).where(F.weekday("d") < 5)
    return days.select("d", (F.row_number().over(Window.orderBy("d")) - 1).cast("int").alias("t"))


@query("""WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE - INTERVAL 90 DAY, max(o_orderdate)::DATE + INTERVAL 90 DAY, INTERVAL 1 DAY))::DATE AS d FROM orders) WHERE isodow(d) < 6),
asked AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderkey % 41 - 20)::INT AS n FROM orders),
based AS (SELECT o_orderkey, n, CASE WHEN n >= 0 THEN d - greatest(0, isodow(d) - 5)::INT ELSE d + CASE WHEN isodow(d) > 5 THEN 8 - isodow(d) ELSE 0 END::INT END AS d FROM asked)
SELECT o_orderkey, n, b.d AS due FROM based JOIN days a USING (d) JOIN days b ON b.i = a.i + n""")
def business_day_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days due so many business days after or before an order."""
    n = (F.col("o_orderkey") % 41 - 20).cast("int")
    return c._table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), dates.add_business_days(F.col("o_orderdate").cast("date"), n).alias("due"))


BLOCKS, WARM_UP, GAP = 4, 30, 10


@query(f"""WITH n AS (SELECT count(DISTINCT l_shipdate) AS n FROM lineitem), b AS (SELECT n, (n - {WARM_UP}) // {BLOCKS + 1} AS block, unnest(range({BLOCKS})) AS fold FROM n)
SELECT fold::INT AS fold, {WARM_UP} AS train_start, (n - ({BLOCKS} - fold) * block - {GAP} - 1)::INT AS train_end, (n - ({BLOCKS} - fold) * block)::INT AS oos_start, (n - ({BLOCKS} - fold - 1) * block - 1)::INT AS oos_end FROM b WHERE block > 0""")
def block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by equal blocks at the end of the calendar."""
    return block_folds(c._table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_shipdate").alias("n")), BLOCKS, WARM_UP, GAP)


VOL_SESSIONS, VOL_LEAST = 250, 20
_ROW_SD = "CASE WHEN {n} >= %d AND {q} / {n} - ({s} / {n}) * ({s} / {n}) > 0 THEN sqrt({q} / {n} - ({s} / {n}) * ({s} / {n})) END" % VOL_LEAST


@query(f"""WITH {c._signal_sql()}, r AS (SELECT entity, t, round(price / nullif(lag(price) OVER (PARTITION BY entity ORDER BY t), 0) - 1, 6) AS r FROM panel),
sums AS (SELECT entity, t, count(r) OVER f AS n, sum(r) OVER f AS s, sum(r * r) OVER f AS q, count(r) OVER e AS n_all, sum(r) OVER e AS s_all, sum(r * r) OVER e AS q_all FROM r
  WINDOW f AS (PARTITION BY entity ORDER BY t RANGE BETWEEN {VOL_SESSIONS - 1} PRECEDING AND CURRENT ROW), e AS (PARTITION BY entity)),
vols AS (SELECT entity, t, round(CASE WHEN t >= {VOL_SESSIONS} THEN {_ROW_SD.format(n='n', s='s', q='q')} END, 6) AS of_past, round({_ROW_SD.format(n='n_all', s='s_all', q='q_all')}, 6) AS full_sample FROM sums),
by_vol AS (SELECT entity, t, CASE WHEN of_past > 0 THEN sign(weight) * {portfolio.TARGET_VOLATILITY} / of_past END AS a, CASE WHEN full_sample > 0 THEN sign(weight) * {portfolio.TARGET_VOLATILITY} / full_sample END AS b FROM weights JOIN vols USING (entity, t))
SELECT entity, t, round(a / sum(abs(a)) OVER (PARTITION BY t), 7) AS of_past, round(b / sum(abs(b)) OVER (PARTITION BY t), 7) AS full_sample FROM by_vol WHERE a IS NOT NULL OR b IS NOT NULL""")
def return_sized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books sized by the volatility of each name's own returns: of the last sessions, and of the whole sample (a deliberate look into the future)."""
    rows = written(c._panel(spark, sf_dir), "sizes-panel")
    w = Window.partitionBy("entity").orderBy("t")
    r = rows.withColumn("r", F.round(F.when(F.lag("price").over(w) != 0, F.col("price") / F.lag("price").over(w) - 1), 6))
    vols = r.select("entity", "t", F.round(panel.trailing_volatility("r", VOL_SESSIONS, VOL_LEAST), 6).alias("of_past"), F.round(panel.full_sample_volatility("r", VOL_LEAST), 6).alias("full_sample"))
    book = c._weights(spark, sf_dir, rows).select("entity", "t", F.signum("weight").alias("side")).join(vols, ["entity", "t"])
    forms = (portfolio.sized_by_volatility(book, form).select("entity", "t", F.round("weight", 7).alias(form)) for form in ("of_past", "full_sample"))
    return next(forms).join(next(forms), ["entity", "t"], "full")


LAST = 20


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, event_type, place, n FROM p WHERE place <= {LAST}""")
def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last so many entries, and how many there are."""
    w = Window.partitionBy("user_id")
    last = c._table(spark, sf_dir, "events").withColumns({"place": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))), "n": F.count("*").over(w)})
    return last.where(F.col("place") <= LAST).select("user_id", "event_id", "event_type", "place", "n")


@query("SELECT p_partkey, (('0x' || substr(sha256(p_name), 1, 8))::BIGINT % 97)::BIGINT AS seed FROM part")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c._table(spark, sf_dir, "part").select("p_partkey", text.seed(F.col("p_name"), 97).alias("seed"))


@query(f"""WITH {c._signal_sql()} SELECT t, count(*) FILTER (weight > 0) AS longs, count(*) FILTER (weight < 0) AS shorts, count(*) - count(DISTINCT entity) AS overlap, round(sum(weight), 9) + 0.0 AS net FROM weights GROUP BY t""")
def book_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long and short names of each book: none is both."""
    by_name = c._weights(spark, sf_dir).groupBy("t", "entity").agg(F.count_if(F.col("weight") > 0).alias("l"), F.count_if(F.col("weight") < 0).alias("s"), F.sum("weight").alias("w"))
    return by_name.groupBy("t").agg(F.sum("l").alias("longs"), F.sum("s").alias("shorts"), F.sum(F.col("l") + F.col("s") - 1).alias("overlap"), (F.round(F.sum("w"), 9) + 0.0).alias("net"))
