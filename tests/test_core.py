import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.operators import guard, joins, panel, portfolio
from tidemark.plans.declaration import Declaration, PlanError, read_plan
from tidemark.plans.folds import check_fits, fitted_folds, folds
from tidemark.sources import files
from tidemark.streaming.guard import guarded_stream


def test_as_of_keeps_the_boundary(spark):
    df = spark.sql("SELECT * FROM VALUES ('PAST', TIMESTAMP_NTZ '2026-08-11', 1.5D), ('BOUNDARY', TIMESTAMP_NTZ '2026-08-12', 2.5D), ('FUTURE', TIMESTAMP_NTZ '2026-08-13', 999D) AS t(ticker, available_time, value)")
    plan = read_plan(Declaration("t", "ticker", "available_time", "available_time"), "2026-08-12", ["ticker"])
    assert {r[0] for r in guard.guarded(df, plan).collect()} == {"PAST", "BOUNDARY"}
    with pytest.raises(PlanError, match="C1"):
        read_plan(plan.declaration, None)
    with pytest.raises(PlanError, match="C1"):
        guard.guarded(df.drop("available_time"), plan)


def test_no_mask_is_a_mask_error(spark):
    df = spark.range(1).select(F.lit("a").alias("e"), F.lit(dt.datetime(2026, 1, 1)).alias("t"))
    with pytest.raises(PlanError, match="C4"):
        guard.guarded(df, read_plan(Declaration("t", "e", "t", None, "tradable"), "2026-08-12"))


def test_late_revision_of_an_older_period_does_not_win(spark):
    rev = spark.createDataFrame([("A", 1, 1, 10.0), ("A", 2, 2, 20.0), ("A", 1, 3, 11.0)], "e string, period int, effective int, v double")
    assert [r["in_force"] for r in joins.revision_as_of(rev, "e", "period", "effective", "v").orderBy("effective").collect()] == [10.0, 20.0, 20.0]


def test_offsets_are_of_the_calendar(spark):
    p = spark.createDataFrame([(1, t, float(t)) for t in (1, 2, 4, 5)], "entity int, t int, price double")
    got = {r["t"]: r["b"] for r in p.select("t", panel.at_offset("price", -1).alias("b")).collect()}
    assert got == {1: None, 2: 1.0, 4: None, 5: 4.0}


def test_admission_counts_repeats(spark):
    a, b = (spark.createDataFrame([(k,) for k in x], "k string") for x in ("xxy", "xyz"))
    assert [tuple(r) for r in joins.excess(a, b, ["k"]).collect()] == [("x", 2, 1)]


def test_books_and_trades(spark):
    rows = spark.createDataFrame([(e, 0, float(-e)) for e in range(10)], "entity int, t int, signal double")
    w = portfolio.books(portfolio.ranked(rows), 0.2)
    assert {r["entity"]: r["weight"] for r in w.collect()} == {0: 0.25, 1: 0.25, 8: -0.25, 9: -0.25}
    t = portfolio.trades(w.select("entity", "t", "weight"), 5)
    assert sorted((r["t"], r["change"]) for r in t.collect()) == [(0, -0.25), (0, -0.25), (0, 0.25), (0, 0.25), (5, -0.25), (5, -0.25), (5, 0.25), (5, 0.25)]


def test_costs(spark):
    c = F.col("c")
    rows = spark.createDataFrame([(0.5,), (-0.5,)], "c double").select(finance.linear_cost(c, 10.0), finance.futures_cost(c, 4, 2), finance.normal_cdf(F.lit(0.0))).collect()
    assert [round(r[0], 8) for r in rows] == [0.0005, 0.0005]
    assert [round(r[1], 8) for r in rows] == [0.0003, 0.0003]
    assert abs(rows[0][2] - 0.5) < 1e-6


def test_folds_keep_their_gaps():
    f = folds(2, 10, 5, 3, 1, 3)
    assert [(x.train_start, x.train_end, x.oos_start, x.oos_end) for x in f] == [(0, 9, 14, 18), (0, 14, 19, 23)]
    for bad in ((2, 1), (3, 0)):
        with pytest.raises(PlanError, match="C2"):
            folds(2, 10, 5, bad[0], bad[1], 3)


def test_locator_and_manifest(spark, tmp_path):
    assert files.locator("data/**/*.csv") == ["data", "**", "*.csv"]
    for bad in ("/a", "a/../b", "a/{b}", "a**", "a\\b"):
        with pytest.raises(ValueError):
            files.locator(bad)
    (tmp_path / "a.csv").write_text("k,v\nx,1\n")
    assert [tuple(r)[:2] for r in files.manifest(spark, str(tmp_path)).collect()] == [("a.csv", 8)]
    assert files.read(spark, "csv", [str(tmp_path / "a.csv")]).collect()[0]["v"] == 1


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo", "UTC"])
@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMP_NTZ", "TEXT"])
def test_guard_compares_instants_in_any_session(spark, zone, kind):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # instants of 11:59, 12:00 and 20:00 in UTC
        values = {"TIMESTAMP": "TIMESTAMP '2026-08-12 {} UTC'", "TIMESTAMP_NTZ": "TIMESTAMP_NTZ '2026-08-12 {}'", "TEXT": "'2026-08-12T{}Z'"}[kind]
        df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {values.format(x)})" for i, x in enumerate(("11:59:00", "12:00:00", "20:00:00"))) + " AS t(e, known)")
        plan = read_plan(Declaration("t", "e", "known", "known"), "2026-08-12T12:00:00Z")
        seen = Observation()
        assert sorted(r["e"] for r in guard.guarded(df, plan, seen).collect()) == [0, 1]
        assert seen.get == {"input_rows": 3, "output_rows": 2, "dropped_rows": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("clock", ["CAST(NULL AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP)", "'soon'", "'2026-08-12T12:00:00'", "CAST(NULL AS STRING)"])
def test_null_or_unreadable_clock_breaks_c1(spark, tmp_path, clock):
    spark.sql(f"SELECT 1 AS e, {clock} AS known").write.parquet(str(tmp_path / "t"))
    df, plan = spark.read.parquet(str(tmp_path / "t")), read_plan(Declaration("t", "e", "known", "known"), "2026-08-12")
    with pytest.raises(Exception, match="C1"):
        guard.guarded(df, plan).collect()
    assert tuple(guard.audit(df, "known", "2026-08-12 00:00:00").first()) == (1, 0, 1, 1)


def test_a_truth_value_is_no_clock(spark):
    with pytest.raises(PlanError, match="C1"):
        guard.guarded(spark.range(1).withColumn("known", F.lit(True)), read_plan(Declaration("t", "id", "known", "known"), "2026-08-12"))


def test_guarded_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2026-08-11 00:00:00 UTC'), (2, TIMESTAMP '2026-08-13 00:00:00 UTC') AS t(e, known)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e int, known timestamp").parquet(str(tmp_path / "in"))
    counts = guarded_stream(stream, "known", "2026-08-12 00:00:00").groupBy(F.window("known", "1 day")).agg(F.sum("e").alias("s"))
    run = counts.writeStream.format("memory").queryName("guarded").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["s"] for r in spark.table("guarded").collect()] == [1]


def test_composite_fails_closed(spark):
    primary = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "k string, available int, tradable boolean")
    member = lambda rows: spark.createDataFrame(rows, "k string, member_available int, member boolean")
    got = joins.composite(primary, member([("a", 3, True), ("b", 1, False), ("c", 1, None)]), ["k"]).collect()
    assert sorted((r["k"], r["available"], r["eligible"]) for r in got) == [("a", 3, True), ("b", 2, False)]
    for bad in ([("a", 1, True)], [("a", 1, True), ("b", 1, True), ("b", 2, True)], [("a", 1, True), ("b", 1, None)]):
        with pytest.raises(Exception, match="C4"):
            joins.composite(primary, member(bad), ["k"]).collect()


def test_folds_fit_the_schedule(spark):
    for sessions in (0, 18, 19, 23, 24, 100):
        got = [tuple(r) for r in fitted_folds(spark.range(1).select(F.lit(sessions).alias("n")), 10, 5, 3, 1, 3).orderBy("fold").collect()]
        room = max(0, (sessions - 14) // 5)
        assert got == [(f.fold, f.train_start, f.train_end, f.oos_start, f.oos_end) for f in folds(room, 10, 5, 3, 1, 3)]
        if room:
            check_fits(folds(room, 10, 5, 3, 1, 3), sessions)
            for bad in (room + 1, room - 1):
                with pytest.raises(PlanError, match="C2"):
                    check_fits(folds(bad, 10, 5, 3, 1, 3), sessions)
