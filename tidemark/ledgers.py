"""Queries on priced folds net of costs, universes, records of experiments and identities, each with SQL for the same rows; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog as c
from .catalog import query
from .functions import text
from .operators import joins, ledger, pricing, views

HOLD, IMPACT = 3, 2.0


@query(f"""WITH seen AS (SELECT l_suppkey AS entity, year(l_shipdate) * 12 + month(l_shipdate) AS t, round(avg(l_extendedprice / l_quantity), 9) AS seen FROM lineitem GROUP BY ALL),
grid AS (SELECT entity, unnest(range(min(t), (SELECT max(t) FROM seen) + 1)) AS t FROM seen GROUP BY entity),
priced AS (SELECT entity, t, last_value(seen IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t) AS price FROM grid LEFT JOIN seen USING (entity, t)),
scored AS (SELECT *, ((SELECT max(t) FROM seen) - t) // 24 AS fold, round(price / lag(price, 3) OVER (PARTITION BY entity ORDER BY t) - 1, 9) AS score FROM priced),
m AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY t) - 1 AS o FROM scored),
last AS (SELECT fold, max(o) AS final FROM m GROUP BY fold),
r AS (SELECT fold, o // {HOLD} AS step, entity, price, row_number() OVER (PARTITION BY fold, o ORDER BY score DESC, entity) AS place, count(*) OVER (PARTITION BY fold, o) AS names FROM m JOIN last USING (fold) WHERE score IS NOT NULL AND o % {HOLD} = 0 AND o < final),
k AS (SELECT *, least(greatest(1, floor(names * {c.QUANTILE})::INT), names // 2) AS k FROM r),
s AS (SELECT *, CASE WHEN place <= k THEN 1 ELSE -1 END AS side FROM k WHERE place <= k OR place > names - k),
book AS (SELECT fold, step, entity, side * 0.5::DOUBLE * price / sum(price) OVER (PARTITION BY fold, step, side) AS w FROM s),
change AS (SELECT fold, step, entity, coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM book a FULL JOIN (SELECT fold, step + 1 AS step, entity, w FROM book) b USING (fold, step, entity)),
cost AS (SELECT fold, step * {HOLD} + 1 AS o, sum(abs(d)) AS turnover, sum(abs(d) * (entity % 7 / 2.0 + {IMPACT}) / 1e4) AS cost FROM change GROUP BY ALL),
held AS (SELECT m.fold, m.o, count(*) AS held, sum(w * (m.price / p.price - 1)) AS gross FROM m JOIN book ON m.fold = book.fold AND m.entity = book.entity AND m.o >= 1 AND (m.o - 1) // {HOLD} = step JOIN m p ON p.fold = m.fold AND p.entity = m.entity AND p.o = m.o - 1 GROUP BY ALL)
SELECT fold::INT AS fold, t::INT AS t, coalesce(held, 0)::INT AS held, round(coalesce(gross, 0), 8) AS gross, round(coalesce(turnover, 0), 8) AS turnover, round(coalesce(cost, 0), 8) AS cost, round(coalesce(gross, 0) - coalesce(cost, 0), 8) AS net
FROM (SELECT DISTINCT fold, t, o FROM m) LEFT JOIN held USING (fold, o) LEFT JOIN cost USING (fold, o)""")
def net_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-short books sized by price, net of half the spread and impact; every month can be traded, so that SQL has no positions to carry."""
    lines = c._table(spark, sf_dir, "lineitem")
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")
    seen = lines.groupBy(F.col("l_suppkey").alias("entity"), t).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 9).alias("seen"))
    last = lines.agg(F.max(t)).first()[0] or 0
    grid = seen.groupBy("entity").agg(F.min("t").alias("first")).select("entity", F.explode(F.sequence("first", F.lit(last))).alias("t"))
    w = Window.partitionBy("entity").orderBy("t")
    rows = grid.join(seen, ["entity", "t"], "left").withColumn("price", F.last("seen", ignorenulls=True).over(w))
    score = F.round(F.col("price") / F.lag("price", 3).over(w) - 1, 9)
    rows = rows.select(F.floor((F.lit(last) - F.col("t")) / 24).cast("int").alias("fold"), "t", "entity", "price", F.lit(True).alias("tradable"), score.alias("score"), F.col("price").alias("size"), (F.col("entity") % 7).cast("double").alias("spread"))
    days = pricing.net_returns(rows, HOLD, 1, c.QUANTILE, pricing.spread_and_impact("spread", IMPACT), market=("spread",))
    return days.select("fold", "t", "held", *(F.round(x, 8).alias(x) for x in ("gross", "turnover", "cost", "net")))


SURVIVES = 60


@query(f"""WITH {c._PANEL}, left_ AS (SELECT entity FROM panel GROUP BY entity HAVING max(t) > (SELECT max(t) FROM panel) - {SURVIVES}),
u AS (SELECT t, price IS NOT NULL AND entity % 3 <> 0 AND t >= entity % 50 * 10 AS member, entity IN (SELECT entity FROM left_) AS survivor FROM panel)
SELECT t, count(*) AS names, count(*) FILTER (member) AS members, count(*) FILTER (survivor) AS survivors, count(*) FILTER (member AND NOT survivor) AS members_lost FROM u GROUP BY t""")
def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by session: those who are members then, and those of whom it is known today that they last (a look ahead)."""
    rows = c._panel(spark, sf_dir)
    members = rows.groupBy("entity").agg(F.max("t").alias("last")).where("entity % 3 <> 0").select("entity", (F.col("entity") % 50 * 10).alias("since"), F.lit(None).cast("int").alias("until"))
    found = joins.in_universe(rows.where("price is not null"), members, joins.survivors(rows, SURVIVES))
    return found.groupBy("t").agg(F.count("*").alias("names"), F.count_if("member").alias("members"), F.count_if("survivor").alias("survivors"), F.count_if(F.col("member") & ~F.col("survivor")).alias("members_lost"))


_STATES = ("click", "error", "purchase", "signup", "view")
_DIGEST = ", ".join(f"sum(('0x' || substr(sha256(id::VARCHAR), {1 + 15 * i}, 15))::BIGINT)::HUGEINT::VARCHAR AS part_{i}" for i in range(4))


@query(f"SELECT event_type, count(*) AS members, {_DIGEST} FROM (SELECT DISTINCT event_type, user_id AS id FROM events WHERE user_id IS NOT NULL) GROUP BY event_type")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.families(c._table(spark, sf_dir, "events"), "event_type", "user_id")


@query(f"""SELECT user_id, count(*) AS entries, {', '.join(f"count(*) FILTER (event_type = '{s}') AS {s}" for s in _STATES)}, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(c._table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], _STATES)


@query(f"SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND user_id <> 1 ORDER BY ts DESC, event_id DESC LIMIT {ledger.MOST_PRIORS}")
def compatible_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last few entries of the candidate's kind with another lock."""
    found = ledger.priors(c._table(spark, sf_dir, "events"), {"event_type": "click", "user_id": 1}, "user_id", ["ts", "event_id"])
    return found.select("event_id", "user_id", "value")


@query("""SELECT round(coalesce(avg(1.0 - toxic), 0), 9) AS safety, coalesce(bool_and(toxic = 0), FALSE) AS safety_perfect, round(coalesce(avg(quality), 0), 9) AS competence FROM labels""")
def suite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = c._table(spark, sf_dir, "labels")
    found = ledger.suite_scores(labels.select((1.0 - F.col("toxic")).alias("weight")), labels.select((F.col("quality") == 1).alias("passed")))
    return found.select(F.round("safety", 9).alias("safety"), "safety_perfect", F.round("competence", 9).alias("competence"))


@query(f"""WITH {c._FOLDS}, wanted AS (SELECT fold, 'train' AS role, train_end AS decision FROM folds UNION ALL SELECT fold, 'out-of-sample', unnest(range(oos_start, oos_end + 1, {c.HORIZON}))::INT FROM folds),
first AS (SELECT fold, role, decision + CASE WHEN decision % 11 = 0 THEN 1 ELSE 0 END AS decision, 's' || decision % 2 AS source, CASE WHEN decision % 17 = 0 THEN 'none' ELSE fold || role || decision END AS evidence FROM wanted WHERE decision % 7 <> 0),
done AS (SELECT * FROM first UNION ALL SELECT fold, role, decision, source, evidence || '-' FROM first WHERE decision % 13 = 0 UNION ALL SELECT fold, role, decision, 's9', evidence || '+' FROM first WHERE decision % 29 = 0 AND decision % 13 <> 0),
g AS (SELECT fold, role, decision, count(*) AS n, max(evidence) AS evidence FROM done GROUP BY ALL), j AS (SELECT *, w.decision IS NOT NULL AS asked FROM g FULL JOIN (SELECT *, TRUE AS w FROM wanted) w USING (fold, role, decision)),
mixed AS (SELECT decision FROM done GROUP BY decision HAVING count(DISTINCT source) > 1), shared AS (SELECT evidence FROM done GROUP BY evidence HAVING count(*) > 1),
f AS (SELECT fold, role, decision, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN decision IN (SELECT decision FROM mixed) THEN 'sources' WHEN evidence IN (SELECT evidence FROM shared) THEN 'evidence' END AS fault FROM j)
SELECT * FROM f WHERE fault IS NOT NULL""".replace(", w.decision IS NOT NULL AS asked", ""))
def protocol_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of the folds' decisions with faults of every kind."""
    wanted = views.decisions(c._folds(spark, sf_dir), c.HORIZON).select(*views.VIEW)
    d = F.col("decision")
    evidence = F.when(d % 17 == 0, "none").otherwise(F.concat("fold", "role", "decision"))
    first = wanted.where(d % 7 != 0).select("fold", "role", (d + F.when(d % 11 == 0, 1).otherwise(0)).alias("decision"), F.concat(F.lit("s"), d % 2).alias("source"), evidence.alias("evidence"))
    twice = first.where(d % 13 == 0).withColumn("evidence", F.concat("evidence", F.lit("-")))
    other = first.where((d % 29 == 0) & (d % 13 != 0)).withColumns({"source": F.lit("s9"), "evidence": F.concat("evidence", F.lit("+"))})
    return ledger.topology(first.unionByName(twice).unionByName(other), wanted)


@query("""SELECT p_partkey, 'number:' || p_partkey AS number_identity, 'string:"' || p_name || '"' AS text_identity, base64(encode(p_name)) AS name_base64,
sha256('part' || chr(0) || '{"key":' || p_partkey || ',"name":"' || p_name || '"}') AS digest FROM part""")
def tagged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that keep a number and the same digits as text apart, and a digest that is bound to its domain."""
    key, name = F.col("p_partkey"), F.col("p_name")
    digest = text.domain_hash("part", text.canonical_json(name=name, key=key))
    return c._table(spark, sf_dir, "part").select("p_partkey", text.identity(key, "number").alias("number_identity"), text.identity(name, "string").alias("text_identity"), F.base64(F.encode(name, "UTF-8")).alias("name_base64"), digest.alias("digest"))
