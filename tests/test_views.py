from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import joins, lineage, views
from tidemark.plans.declaration import Declaration, PlanError

FOLDS = "fold int, train_start int, train_end int, oos_start int, oos_end int"
ASKED = "fold int, role string, decision int"


def folds(spark):
    return spark.createDataFrame([(0, 0, 3, 6, 9)], FOLDS)


def test_decisions_and_their_roles(spark):
    made = views.decisions(folds(spark), 2)
    assert sorted(map(tuple, made.collect())) == [(0, "out-of-sample", 6, 0), (0, "out-of-sample", 8, 0), (0, "train", 3, 0)]
    assert views.admissible(made.drop("hist_start"), folds(spark)).count() == 3
    for bad in [(0, "train", 2), (0, "out-of-sample", 10), (0, "out-of-sample", 3), (1, "train", 3), (0, "test", 3), (0, None, 3), (0, "train", None)]:
        with pytest.raises(Exception, match="C2"):
            views.admissible(spark.createDataFrame([bad], ASKED), folds(spark)).collect()


def test_view_and_output(spark):
    rows = spark.createDataFrame([(e, t, t % 2 == 0) for e in ("a", "b") for t in range(10)], "entity string, t int, tradable boolean")
    asked = views.admissible(spark.createDataFrame([(0, "train", 3), (0, "out-of-sample", 8)], ASKED), folds(spark))
    seen = views.view(rows, asked)
    assert sorted((r.role, r.entity, r.t) for r in seen.collect()) == [("out-of-sample", e, t) for e in "ab" for t in (0, 2, 4, 6, 8)] + [("train", e, t) for e in "ab" for t in (0, 2)]
    output = seen.drop("tradable")
    assert sorted((r.role, r.entity, r.t) for r in views.admitted(output, seen).collect()) == [("out-of-sample", "a", 8), ("out-of-sample", "b", 8), ("train", "a", 0), ("train", "a", 2), ("train", "b", 0), ("train", "b", 2)]
    row = lambda t: spark.createDataFrame([(0, "out-of-sample", 8, "a", t)], "fold int, role string, decision int, entity string, t int")
    with pytest.raises(Exception, match="C1"):
        views.admitted(row(9), seen).collect()
    with pytest.raises(Exception, match="C4"):  # the mask took it out
        views.admitted(row(7), seen).collect()
    with pytest.raises(Exception, match="C4"):  # once in the view, twice in the output
        views.admitted(row(8).unionByName(row(8)), seen).collect()
    with pytest.raises(Exception, match="C4"):
        views.view(rows.withColumn("tradable", F.lit(None).cast("boolean")), asked).collect()
    assert views.view(rows.limit(0), asked).count() == 0


def test_output_by_ranges_is_as_by_views(spark):
    rows = spark.createDataFrame([(e, t, t % 3 > 0) for e in ("a", "b") for t in range(10)] + [("a", 1, True), ("a", 8, True)], "entity string, t int, tradable boolean")
    asked = views.admissible(spark.createDataFrame([(0, "train", 5), (0, "out-of-sample", 8), (1, "out-of-sample", 8)], ASKED), spark.createDataFrame([(0, 0, 5, 6, 9), (1, 4, 6, 8, 9)], FOLDS))
    seen = views.view(rows, asked)
    output = seen.drop("tradable")
    whole = sorted(map(tuple, views.admitted_by_range(output, rows, asked).select(*views.VIEW, "entity", "t").collect()))
    assert whole == sorted(map(tuple, views.admitted(output, seen).select(*views.VIEW, "entity", "t").collect())) and len(whole) == 15
    row = lambda *r: spark.createDataFrame([r], "fold int, role string, decision int, entity string, t int")
    for code, more in {
        "C1": row(0, "out-of-sample", 8, "a", 9),
        "C2": row(2, "out-of-sample", 8, "a", 8),
        # masked; before the history of this fold; more often than the rows have it; a name that isn't there; no name
        "C4": [row(0, "out-of-sample", 8, "a", 6), row(1, "out-of-sample", 8, "a", 2), output.unionByName(output.where("entity = 'b' and t = 8")), row(0, "train", 5, "c", 1), row(0, "train", 5, None, 1)],
    }.items():
        for bad in more if isinstance(more, list) else [more]:
            with pytest.raises(Exception, match=code):
                views.admitted_by_range(bad, rows, asked).collect()
    with pytest.raises(Exception, match="C4"):
        views.admitted_by_range(output, rows.withColumn("tradable", F.lit(None).cast("boolean")), asked).collect()
    assert views.admitted_by_range(output.limit(0), rows, asked).count() == 0


def test_lineage(spark):
    at = lambda y: datetime(y, 1, 1, tzinfo=UTC)
    d = Declaration("x", "e", "ts", "known", segments=((at(2000), at(2010), "assumed"), (at(2010), None, "observed")))
    rows = [("1999-12-31", "2000-01-01"), ("2000-01-01", "2000-01-02"), ("2010-01-01", "2010-01-02"), ("2012-01-01", None), ("2012-01-01", "2012-01-01"), (None, "2012-01-01")]
    df = spark.createDataFrame(rows, "ts string, known string").select(F.col("ts").cast("timestamp_ntz"), F.col("known").cast("timestamp_ntz"))
    found = lineage.faults(df, d, at(2011))
    assert sorted((str(r.ts)[:4], r.fault) for r in found.collect()) == [("1999", "INVALID_SEGMENTS"), ("2010", "OBSERVED_BEFORE_LINEAGE"), ("2012", "INVALID_VALUE"), ("None", "INVALID_SEGMENTS")]
    for bad in (((at(2000), at(2001), "assumed"), (at(2002), None, "observed")), ((at(2000), None, "assumed"), (at(2002), None, "observed")), ((at(2000), None, "guessed"),)):
        with pytest.raises(PlanError):
            lineage.check_segments(Declaration("x", "e", "ts", segments=bad))


def test_revision_at_dates_ignores_late_ones_of_older_periods(spark):
    rev = spark.createDataFrame([("a", 1, 2, 10.0), ("a", 2, 4, 20.0), ("a", 1, 5, 11.0), ("a", 2, 7, 21.0)], "e string, period int, known int, v double")
    asks = spark.createDataFrame([(e, t) for e in ("a", "b") for t in (1, 2, 3, 4, 6, 7)], "e string, at int")
    got = {(r.e, r.at): r.in_force for r in joins.revision_at(asks, rev, "e", "at", "period", "known", "v").collect()}
    assert got == {("a", 1): None, ("a", 2): 10.0, ("a", 3): 10.0, ("a", 4): 20.0, ("a", 6): 20.0, ("a", 7): 21.0} | {("b", t): None for t in (1, 2, 3, 4, 6, 7)}


def test_texts(spark):
    hits = {"FULL_SAMPLE": ["Full-Sample mean", "x.fit_transform (y)"], "FUTURE_FUNCTION": ["df.shift(-1)", "close[i + 1]"], "SURVIVORSHIP": ["the current  members"]}
    df = spark.createDataFrame([(code, s) for code, texts in hits.items() for s in texts] + [(None, "shift(1) of the past"), (None, ""), (None, None), ("FULL_SAMPLE", "x" * 70_000 + " whole sample")], "code string, s string")
    for r in df.select("code", *(text.advisory(F.col("s"), k).alias(k) for k in hits)).collect():
        assert [k for k in hits if r[k]] == ([r.code] if r.code else [])
    spans = {"PT15M": True, "P2D": True, "P1Y2M3W4DT5H6M7.5S": True, "PT0S": False, "P": False, "PT": False, "P1DT": False, "P1H": False, "PT1D": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in spans], "s string").select("s", text.positive_duration(F.col("s")).alias("ok"))
    assert {r.s: r.ok for r in df.collect()} == spans
    names = {"netSharpe": True, "sharpe_ratio": True, " Sharpe ": True, "sharpened": False, "sharpe2": False}
    df = spark.createDataFrame([(k,) for k in names], "s string").select("s", F.array_contains(text.metric_tokens(F.col("s")), "sharpe").alias("ok"))
    assert {r.s: r.ok for r in df.collect()} == names
