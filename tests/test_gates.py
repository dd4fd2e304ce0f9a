import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, portfolio, regression
from tidemark.plans.declaration import Declaration, PlanError
from tidemark.sources import registry


def _status(df):
    return {r["gate"]: (r["status"], r["observed"]) for r in df.collect()}


def test_capacity_fails_without_a_volume(spark):
    rows = [(0.5, 10.0, 1000.0), (-0.25, 10.0, 1000.0)]
    good = spark.createDataFrame(rows, "change double, price double, volume double")
    bad = spark.createDataFrame([*rows, (0.1, 10.0, 0.0)], good.schema)
    assert _status(gates.capacity(good, 1000.0, 0.05)) == {"capacity": ("passed", 0.05)}
    assert _status(gates.capacity(good, 1000.0, 0.04))["capacity"][0] == "failed"
    assert _status(gates.capacity(bad, 1000.0, 0.05))["capacity"][0] == "failed"
    assert _status(gates.capacity(good.limit(0), 1000.0, 0.05))["capacity"][0] == "unavailable"


def test_costs_contamination_and_chance(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + dt.timedelta(i), 0.002 if i % 2 else -0.001, 0.0001) for i in range(40)], "decision_time timestamp_ntz, gross double, cost double")
    assert _status(gates.cost_stress(rows))["cost"][0] == "passed"
    assert _status(gates.cost_stress(rows, 10.0))["cost"][0] == "failed"
    assert _status(gates.cost_stress(rows.limit(29)))["cost"][0] == "unavailable"
    assert _status(gates.contamination(rows, "2024-01-10 00:00:00"))["contamination"] == ("passed", 30.0)
    assert _status(gates.contamination(rows, "2024-01-11 00:00:00"))["contamination"] == ("failed", 29.0)
    null = spark.range(99).select(F.col("id").cast("double").alias("value"))
    assert _status(gates.chance(null, 95.0))["null"] == ("passed", 0.05)
    assert _status(gates.chance(null, 94.0))["null"][0] == "failed"


def test_neighbours_trials_and_stability(spark):
    near = spark.createDataFrame([("own", -9.0), ("a", 1.0), ("a", -1.0), ("b", 1.0), ("c", 2.0)], "lock string, sharpe double")
    status, share = _status(gates.neighbours(near, "own"))["parameter"]
    assert status == "passed" and share == pytest.approx(2 / 3)
    assert _status(gates.neighbours(near.where("lock in ('own', 'b')"), "own"))["parameter"][0] == "unavailable"
    ids = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    counted = gates.trial_count(3, ids, ids)
    assert counted.first()["trials"] == 4
    assert _status(gates.trials(counted, 3))["trials"][0] == "failed"
    folds = spark.createDataFrame([(0, 0.1), (1, 0.1), (2, -0.05)], "fold int, r double")
    assert _status(gates.stability(folds))["stability"][0] == "passed"
    assert _status(gates.stability(folds.where("fold < 2")))["stability"][0] == "unavailable"
    assert _status(gates.stability(folds.withColumn("r", F.when(F.col("fold") == 0, 0.9).otherwise(0.1))))["stability"][0] == "failed"


@pytest.mark.parametrize(("rows", "says"), [(["passed", "passed"], "accepted"), (["passed", "failed"], "rejected"), (["unavailable", "passed"], "rejected"), (["passed", "unavailable"], "degraded"), ([], "rejected")])
def test_verdict(spark, rows, says):
    df = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(rows)], "gate string, status string")
    assert gates.verdict(df, ("g0",)).first()["verdict"] == says


def test_ridge_is_as_by_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 0.5 + x @ [2.0, -1.0] + rng.normal(size=200) / 10
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0)], "a double, b double, y double")
    design = np.c_[np.ones(200), x]
    want = np.linalg.solve(design.T @ design + np.diag([0, 0.3, 0.3]), design.T @ y)
    got = regression.ridge_fit(rows, ["a", "b"], "y", 0.3)
    assert np.allclose(got, want)
    fitted = [r[0] for r in rows.select(regression.linear_score(["a", "b"], got).alias("s")).collect()]
    assert fitted[200:] == [None, None] and np.allclose(fitted[:200], design @ want)
    assert regression.ridge_fit(rows.select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), "y"), ["a", "b"], "y", 0.0) == [0.0] * 3
    assert regression.ridge_fit(rows.limit(0), ["a", "b"], "y") == [0.0] * 3


def test_sizes_by_volatility_add_up(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0.01), (0, 2, 1, 0.02), (0, 3, -1, 0.02), (0, 4, -1, None), (0, 5, -1, 0.0)], "t int, entity int, side int, vol double")
    got = {r["entity"]: r["weight"] for r in portfolio.sized_by_volatility(rows, "vol").collect()}
    assert got == pytest.approx({1: 0.5, 2: 0.25, 3: -0.25})


def test_connectors_and_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,t,v\nx,2024-01-01 00:00:00,1\ny,2024-01-03 00:00:00,\n")
    d, r = Declaration("d", "k", "t", kind="csv", locator=str(tmp_path / "in")), registry.Registry()
    assert [x["k"] for x in registry.point(r, spark, d, "2024-01-02", ["k", "v"]).collect()] == ["x"]
    assert registry.panel(r, spark, d, "2024-01-02", ["v"]).columns == ["k", "t", "v"]
    with pytest.raises(PlanError, match="CONFIG"):
        r.register("csv", lambda spark, d: None)
    with pytest.raises(PlanError, match="CONFIG"):
        registry.point(r, spark, Declaration("d", "k", "t", kind="other"), "2024-01-02")
    with pytest.raises(PlanError, match="SOURCE_CHANGED"), registry.unchanged(spark, str(tmp_path / "in")):
        (tmp_path / "in/b.csv").write_text("k,t,v\n")
    assert registry.redacted("at db://me:pw@host/x with password=abc") == "at db://***@host/x with password=***"


def test_snapshots_are_named_by_content(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), (None, 2), ("", 2)], "k string, v int")
    store = str(tmp_path / "store")
    digest = registry.save_snapshot(a, store)
    assert registry.save_snapshot(a.orderBy(F.desc("v")).select("v", "k"), store) == digest
    assert registry.rows_digest(a.unionByName(a.limit(1))) != digest != registry.rows_digest(a.fillna("", ["k"]))
    assert registry.load_snapshot(spark, store, digest).count() == 3
    a.limit(1).write.mode("overwrite").parquet(f"{store}/{digest}")
    with pytest.raises(PlanError, match="SNAPSHOT_CORRUPT"):
        registry.load_snapshot(spark, store, digest)
