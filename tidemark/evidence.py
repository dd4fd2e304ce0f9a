"""Queries on what evidence is worth: clocks of composites, bad rows and where they are, connectors, canonical JSON; each with SQL for the same rows. They join the catalogue's."""

from __future__ import annotations

from collections import deque
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as c
from . import protocols  # noqa: F401  (whose SQL a query here shares)
from .catalog import query
from .functions.canonical import canonical
from .operators import factor, guard, joins, panel, portfolio, regression
from .plans.declaration import Declaration, read_plan
from .sources.registry import Registry

_SHIPPED = """p AS (SELECT o_orderkey AS k, o_orderdate AS ts, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate END AS available, CASE WHEN o_orderkey % 103 <> 0 THEN o_orderstatus <> 'P' END AS tradable FROM orders),
m AS (SELECT o_orderkey AS k, o_orderdate AS ts, CASE WHEN o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 5 HOUR ELSE o_orderdate - INTERVAL 2 HOUR END END AS known,
  CASE WHEN o_orderkey % 79 <> 0 THEN o_orderkey % 3 <> 0 END AS member FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, o_orderdate, o_orderdate, TRUE FROM orders WHERE o_orderkey % 73 = 0 UNION ALL SELECT -o_orderkey, o_orderdate, o_orderdate, TRUE FROM orders WHERE o_orderkey % 71 = 0)"""


def _clocked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders whose availability is a time, and membership of them whose availability is a text with a zone, missing, or no instant; with repeats, gaps and rows that no order has."""
    orders, k, d = c._table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    primary = orders.select(k.alias("k"), d.alias("ts"), F.when(k % 101 != 0, d).alias("available"), F.when(k % 103 != 0, F.col("o_orderstatus") != "P").alias("tradable"))
    # 23:00 of the day before in the west is 5:00 in UTC
    west = F.concat(F.date_format(d.cast("date") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd"), F.lit("T23:00:00-06:00"))
    east = F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    text = F.when(k % 89 == 0, None).when(k % 83 == 0, "soon").when(k % 2 == 0, west).otherwise(east)
    members = orders.where("o_orderkey % 7 <> 0").select(k.alias("k"), d.alias("ts"), text.alias("member_available"), F.when(k % 79 != 0, k % 3 != 0).alias("member"))
    more = [orders.where(k % n == 0).select((k * sign).alias("k"), d.alias("ts"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("member_available"), F.lit(True).alias("member")) for n, sign in ((73, 1), (71, -1))]
    return primary, members.unionByName(more[0]).unionByName(more[1])


@query(f"""WITH {_SHIPPED}, one AS (SELECT k, ts, count(*) AS n, max(known) AS known, bool_and(member) AS member FROM m GROUP BY k, ts),
j AS (SELECT p.k, p.available, known, tradable, member, n, CASE WHEN n IS NULL OR n > 1 THEN 'unmatched' WHEN p.available IS NULL OR known IS NULL THEN 'clock' WHEN member IS NULL OR tradable IS NULL THEN 'mask'
  WHEN NOT tradable THEN 'untradable' WHEN NOT member THEN 'stranger' ELSE 'eligible' END AS kind FROM p LEFT JOIN one ON p.k = one.k AND p.ts = one.ts)
SELECT count(*) AS primary_rows, (SELECT count(*) FROM m) AS membership_rows, count(*) FILTER (kind IN ('untradable', 'stranger', 'eligible')) AS matched_rows, count(*) FILTER (kind = 'eligible') AS eligible_rows,
  count(*) FILTER (kind = 'untradable') AS dropped_by_mask, count(*) FILTER (kind = 'stranger') AS dropped_by_membership, count(*) FILTER (kind = 'unmatched') AS unmatched_rows, 0::BIGINT AS repeated_rows, count(*) FILTER (kind = 'clock') AS clock_faults,
  count(*) FILTER (kind = 'mask') AS mask_faults, (SELECT count(*) FROM m ANTI JOIN p USING (k, ts)) AS unused_rows, count(*) FILTER (kind = 'eligible' AND known > available) AS later_membership FROM j""")
def composite_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each row of a composite with null, text and unreadable clocks ends."""
    return joins.composite_audit(*_clocked(spark, sf_dir), ["k", "ts"])


@query(f"""WITH {_SHIPPED}, one AS (SELECT k, ts, count(*) AS n, max(known) AS known, bool_and(member) AS member FROM m GROUP BY k, ts)
SELECT p.k, greatest(p.available, known) AS available, tradable AND member AS eligible FROM p JOIN one ON p.k = one.k AND p.ts = one.ts WHERE n = 1 AND p.available IS NOT NULL AND known IS NOT NULL AND tradable IS NOT NULL AND member IS NOT NULL AND p.k % 73 <> 0""")
def composite_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of the rows without a fault: the later of two instants, one of them a text with a zone."""
    primary, members = _clocked(spark, sf_dir)
    faulty = lambda n: F.col("k") % n == 0
    bad = faulty(7) | faulty(73) | faulty(79) | faulty(83) | faulty(89) | faulty(101) | faulty(103)
    return joins.composite(primary.where(~bad), members.where(~bad), ["k", "ts"]).select("k", "available", "eligible")


_TEXT_CLOCK = "CASE WHEN event_id % 977 = 976 THEN NULL WHEN event_id % 1201 = 1200 THEN 'later' WHEN event_id % 1301 = 1300 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"


@query(f"""WITH n AS (SELECT row_number() OVER () - 1 AS i, {_TEXT_CLOCK} AS clock FROM events)
SELECT 'events.parquet' AS file, count(*) AS n_bad, min(i) AS row, arg_min(coalesce(clock, '-'), i) AS clock FROM n WHERE clock IS NULL OR clock NOT LIKE '____-__-__T__:__:__Z' HAVING count(*) > 0""")
def first_bad_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first clock is that is no instant, by file."""
    i, form = F.col("event_id"), F.lit
    clock = F.when(i % 977 == 976, None).when(i % 1201 == 1200, form("later")).when(i % 1301 == 1300, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    found = guard.first_bad_clock(c._table(spark, sf_dir, "events").withColumn("clock", clock), "clock")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "n_bad", "row", F.coalesce("clock", F.lit("-")).alias("clock"))


_ODD_NUMBER = "CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN value * 1e-9 WHEN 2 THEN (1 + value) * 1e21 WHEN 3 THEN -value WHEN 4 THEN 5e-324 WHEN 5 THEN floor(value) ELSE -0.0 END::DOUBLE"
_JS_NUMBER = r"CASE WHEN x = 0 THEN '0' ELSE regexp_replace(regexp_replace(x::VARCHAR, '\.0$', ''), 'e([+-])0(\d)$', 'e\1\2') END"


@query(f"""WITH e AS (SELECT *, {_ODD_NUMBER} AS x, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN event_type || chr(1) || chr(10) || '\\"é' ELSE event_type END AS label FROM events)
SELECT event_id, '{{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","big":' || CASE WHEN event_id % 3 = 0 THEN '"bigint:' || (9007199254740992 + event_id) || '"' ELSE (9007199254740991 - event_id)::VARCHAR END || ',"label":' || coalesce(to_json(label)::VARCHAR, 'null')
  || ',"props":' || coalesce(to_json(props)::VARCHAR, 'null') || ',"raw":"base64:' || to_base64(encode(event_type)) || '","tags":{{"a":[' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 'true' END || ',false],"b":[]}},"x":' || {_JS_NUMBER} || '}}' AS canonical FROM e""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical JSON: quotes, control characters, numbers very large and small, whole numbers beyond a double's, binary data, maps and lists."""
    i, v = F.col("event_id"), F.col("value")
    x = F.when(i % 7 == 0, v).when(i % 7 == 1, v * 1e-9).when(i % 7 == 2, (1 + v) * 1e21).when(i % 7 == 3, -v).when(i % 7 == 4, F.lit(5e-324)).when(i % 7 == 5, F.floor(v).cast("double")).otherwise(F.lit(-0.0))
    label = F.when(i % 5 == 0, None).when(i % 5 == 1, F.concat("event_type", F.lit('\x01\n\\"é'))).otherwise(F.col("event_type"))
    big = F.when(i % 3 == 0, 9007199254740992 + i).otherwise(9007199254740991 - i)
    tags = F.create_map(F.lit("b"), F.array().cast("array<boolean>"), F.lit("a"), F.array(F.when(i % 2 == 1, True), F.lit(False)))
    row = F.struct(F.col("props"), F.col("ts").alias("at"), x.alias("x"), label.alias("label"), big.alias("big"), F.encode("event_type", "UTF-8").alias("raw"), tags.alias("tags"))
    rows = c._table(spark, sf_dir, "events").select("event_id", row.alias("row"))
    return rows.select("event_id", canonical(F.col("row"), rows.schema["row"].dataType).alias("canonical"))


#: Every so many sessions a supplier's membership may change; it is a member where its number says so.
SPAN = 250
_SPANS = f"""spans AS (SELECT entity, i * {SPAN} AS since, CASE WHEN (i + 1) * {SPAN} <= last THEN (i + 1) * {SPAN} END AS until FROM (SELECT entity, max(t) AS last FROM panel GROUP BY entity), range(20) r(i) WHERE i * {SPAN} <= last AND (entity + i) % 3 <> 0)"""


@query(f"""WITH {c._PANEL}, {_SPANS}, last_ AS (SELECT max(t) AS t FROM panel),
revised AS (SELECT l_suppkey AS entity, date_trunc('month', o_orderdate) AS period, t AS effective, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN calendar ON d = l_shipdate GROUP BY ALL),
merged AS (SELECT entity, t, price, tradable, NULL AS version, TRUE AS is_row FROM panel UNION ALL SELECT entity, effective, NULL, NULL, {{'period': period, 'effective': effective, 'value': value}}, FALSE FROM revised),
forced AS (SELECT entity, t, price, tradable, is_row, max(version) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM merged)
SELECT f.entity, f.t, price, tradable, EXISTS (SELECT 1 FROM spans s WHERE s.entity = f.entity AND f.t >= since AND (until IS NULL OR f.t < until)) AS member,
  f.entity IN (SELECT entity FROM panel, last_ WHERE panel.t > last_.t - 60) AS survivor, v.period AS period, v.value AS fundamental, v.effective AS known_at FROM forced f WHERE is_row""")
def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with membership at the time, who is left in the end, and the revenue of the latest month known by then, as revised last."""
    rows = c._panel(spark, sf_dir).select("entity", "t", "price", "tradable")
    last = rows.groupBy("entity").agg(F.max("t").alias("last"))
    spans = last.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).where(f"i * {SPAN} <= last and (entity + i) % 3 <> 0")
    members = spans.select("entity", (F.col("i") * SPAN).alias("since"), F.when((F.col("i") + 1) * SPAN <= F.col("last"), (F.col("i") + 1) * SPAN).alias("until"))
    lines, orders = c._table(spark, sf_dir, "lineitem"), c._table(spark, sf_dir, "orders")
    facts = panel.numbered(lines.select("l_orderkey", F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("session_date"), "l_extendedprice"), to="effective")
    dated = facts.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("entity", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("period"), "effective")
    return joins.full_panel(rows, members, joins.survivors(rows, 60), dated.agg(F.round(F.sum("l_extendedprice"), 2).alias("value")))


FEATURES, RIDGE = {"a": 3, "b": 10}, 1.0
_FEATURES = f"""{c._PANEL}, {c._FOLDS}, moves AS (SELECT entity, t, tradable, {', '.join(f"round(price / nullif(lag(price, {k}) OVER e, 0) - 1, 6) AS {n}" for n, k in FEATURES.items())}, round(lead(price) OVER e / nullif(price, 0) - 1, 6) AS y, lead(t) OVER e AS known
  FROM panel WINDOW e AS (PARTITION BY entity ORDER BY t))"""
#: Three equations by Cramer's rule.
_MODELS = f"""{_FEATURES}, s AS (SELECT fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) + {RIDGE} AS aa, sum(a * b) AS ab, sum(b * b) + {RIDGE} AS bb, sum(a * y) AS ay, sum(b * y) AS byy
  FROM moves JOIN folds ON known BETWEEN train_start AND train_end WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL AND t % {c.CADENCE} = 0 GROUP BY fold),
det AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s),
models AS (SELECT fold, n, round((y * (aa * bb - ab * ab) - a * (ay * bb - ab * byy) + b * (ay * ab - aa * byy)) / det, 6) AS intercept,
  round((n * (ay * bb - ab * byy) - y * (a * bb - ab * b) + b * (a * byy - ay * b)) / det, 6) AS slope_a, round((n * (aa * byy - ay * ab) - a * (a * byy - ay * b) + y * (a * ab - aa * b)) / det, 6) AS slope_b FROM det)"""


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The momenta of all rows over the entity's own rows, the folds, and each fold's model of the return up to the next row. A row counts in training from the session on which its label is known, so that no label reaches past the range."""
    w, price = Window.partitionBy("entity").orderBy("t"), F.col("price")
    moved = lambda now, before: F.round(F.when(before != 0, now / before - 1), 6)
    rows = c._panel(spark, sf_dir).select("entity", "t", "tradable", *(moved(price, F.lag("price", k).over(w)).alias(n) for n, k in FEATURES.items()), moved(F.lead("price").over(w), price).alias("y"), F.lead("t").over(w).alias("known"))
    rows, folds = c.written(rows, "models-rows"), c.written(c._folds(spark, sf_dir), "models-folds")
    training = rows.where(F.col("t") % c.CADENCE == 0).select(F.col("known").alias("t"), *FEATURES, "y")
    models = regression.fold_models(training, folds, list(FEATURES), "y", RIDGE)
    return rows, folds, models.withColumn("coefficients", F.transform("coefficients", lambda x: F.round(x, 6)))


@query(f"WITH {_MODELS} SELECT fold, n, intercept, slope_a, slope_b FROM models")
def fold_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regressions on two momenta, one for each fold's training range, from one pass."""
    models = _models(spark, sf_dir)[2]
    return models.select("fold", "n", *(F.element_at("coefficients", i + 1).alias(n) for i, n in enumerate(("intercept", "slope_a", "slope_b"))))


@query(f"""WITH {_MODELS}, scored AS (SELECT fold, entity, t, round(intercept + a * slope_a + b * slope_b, 9) AS score FROM moves JOIN folds ON t BETWEEN oos_start AND oos_end JOIN models USING (fold) WHERE tradable AND t % {c.CADENCE} = 0 AND a IS NOT NULL AND b IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY fold, t ORDER BY score DESC, entity) AS place, count(*) OVER (PARTITION BY fold, t) AS names FROM scored),
cut AS (SELECT *, least(greatest(1, floor(names * {c.QUANTILE})::INT), names // 2) AS k FROM placed WHERE names >= 10)
SELECT fold, entity, t, score, round(CASE WHEN place <= k THEN 0.5 / k ELSE -0.5 / k END::DOUBLE, 9) AS weight FROM cut WHERE place <= k OR place > names - k""")
def model_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books out of sample by the score of each fold's own model, where there are ten names at least."""
    rows, folds, models = _models(spark, sf_dir)
    at = rows.where(F.col("tradable") & (F.col("t") % c.CADENCE == 0))
    scored = regression.fold_scores(at, folds, models, list(FEATURES)).withColumn("score", F.round("score", 9))
    ranked = portfolio.ranked(scored, "score", ("fold", "t")).where(F.col("names") >= portfolio.LEAST_NAMES)
    return portfolio.books(ranked, c.QUANTILE).select("fold", "entity", "t", "score", F.round("weight", 9).alias("weight"))


@query(f"SELECT event_id, user_id, ts, value FROM events WHERE ts <= TIMESTAMP '{c.EVENTS_AS_OF}'")
def connector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point view through a connector that reads Parquet files in parts and takes over columns and time; the guard stays on top."""
    declared = Declaration("events", "user_id", "ts", kind="parts", locator=f"{sf_dir}/events.parquet")
    return Registry().read(spark, read_plan(declared, c.EVENTS_AS_OF.replace(" ", "T") + "Z", ["event_id", "user_id", "ts", "value"]))


def _rounded(x: float, places: str) -> float:
    """Half up by the number's decimal digits, as Spark's round."""
    return float(Decimal(repr(x)).quantize(Decimal(places), ROUND_HALF_UP)) + 0.0


class Momentum(factor.Factor):
    """Momentum over so many of the entity's own rows, against its own past: what has been seen so far is two sums for each lookback."""

    columns = {f"momentum_{k}": "double" for k in c.LOOKBACKS}
    least = 20

    def start(self) -> None:
        self.prices = deque(maxlen=max(c.LOOKBACKS) + 1)
        self.sums = {k: [0, 0.0, 0.0] for k in c.LOOKBACKS}

    def step(self, row):
        self.prices.append(row["price"])
        out = []
        for k in c.LOOKBACKS:
            z = None
            if len(self.prices) > k:
                r = _rounded(row["price"] / self.prices[-1 - k] - 1, "0.000001")
                n, s, q = (a + b for a, b in zip(self.sums[k], (1, r, r * r), strict=True))
                self.sums[k] = [n, s, q]
                var = q / n - (s / n) * (s / n)
                if n >= self.least and var > 0:
                    z = _rounded((r - s / n) / var**0.5, "0.0001")
            out.append(z)
        if row["t"] % c.CADENCE == 0:
            yield row["t"], *out


@query(c.SQL["packaged_factor"])
def own_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaged factor as code of a user: state along time by entity, rows at decisions only, let in by what it was given."""
    given = c.written(c._panel(spark, sf_dir).where("tradable and price > 0").select("entity", "t", "price"), "factor-rows")
    return factor.admitted(c.written(factor.compute(given, Momentum()), "factor-made"), given, ["entity", "t"])
