import json
import os
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import canonical
from tidemark.operators import factor, guard, joins, portfolio, regression, views
from tidemark.plans.declaration import Declaration, PlanError, read_plan
from tidemark.sources import connectors, files, registry

# Numbers as JSON writes them.
NUMBERS = {
    0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789012345680000.0: "123456789012345680000", 5e-324: "5e-324", 1e-7: "1e-7", 1e-6: "0.000001", 0.1: "0.1", 1e23: "1e+23", 2e-323: "2e-323",
    1.7976931348623157e308: "1.7976931348623157e+308", 2.2250738585072014e-308: "2.2250738585072014e-308", 5.684341886080802e-14: "5.684341886080802e-14", 97.12 * 1e21: "9.712e+22", 1 / 3: "0.3333333333333333", 9007199254740993.0: "9007199254740992", 123e-20: "1.23e-18",
}


def test_numbers_are_canonical(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    got = {r["x"]: r["j"] for r in df.select("x", canonical(F.col("x"), T.DoubleType()).alias("j")).collect()}
    assert got == NUMBERS
    rng = np.random.default_rng(1)
    some = [float(x) for x in np.r_[rng.normal(size=200), rng.normal(size=100) * 1e10, 10.0 ** rng.uniform(-300, 300, 300)]]
    for r in spark.createDataFrame([(x,) for x in some], "x double").select("x", canonical(F.col("x"), T.DoubleType()).alias("j")).collect():
        assert float(r["j"]) == r["x"] and len(r["j"].replace("-", "").replace(".", "").split("e")[0].strip("0")) == len(repr(r["x"]).replace("-", "").replace(".", "").split("e")[0].strip("0"))
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(bad,)], "x double").select(canonical(F.col("x"), T.DoubleType())).collect()


def test_any_schema_has_a_canonical_form(spark):
    schema = T.StructType.fromDDL("z string, a struct<`b c`:int, A:boolean>, m map<string, array<bigint>>, d date, t timestamp_ntz, i timestamp, bin binary, dec decimal(5,2), f float, e struct<>")
    odd = "".join(map(chr, range(32))) + '"\\/é😀 '
    row = (odd, (1, None), {"b": [2**53, 1, None], "a": []}, datetime(2024, 2, 3).date(), datetime(2024, 2, 3, 4, 5, 6, 789000), datetime(2024, 2, 3, 4, 5, 6, tzinfo=UTC), b"\x00\xff" * 60, None, 0.5, ())
    df = spark.createDataFrame([(row,), (None,)], T.StructType([T.StructField("x", schema)]))
    first, second = [r[0] for r in df.select(canonical(F.col("x"), schema)).collect()]
    back = json.loads(first)
    assert list(back) == sorted(back) and back["z"] == odd and back["a"] == {"A": None, "b c": 1} and back["m"] == {"a": [], "b": ["bigint:9007199254740992", 1, None]}
    assert (back["d"], back["t"], back["i"], back["f"], back["dec"], back["e"]) == ("2024-02-03T00:00:00.000Z", "2024-02-03T04:05:06.789Z", "2024-02-03T04:05:06.000Z", 0.5, None, {})
    assert back["bin"].startswith("base64:AP8A") and "\n" not in back["bin"] and second == "null"
    # the same text as a library's, but for the case of keys that it keeps
    assert first == json.dumps(back, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    with pytest.raises(PlanError, match="CANONICAL"):
        canonical(F.lit(None), T.MapType(T.IntegerType(), T.StringType()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_composite_compares_instants(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        a = spark.sql("SELECT 'a' AS k, TIMESTAMP_NTZ '2024-01-02 01:00:00' AS available, true AS tradable")
        b = spark.createDataFrame([("a", "2024-01-01T23:00:00-05:00", True)], "k string, member_available string, member boolean")
        got = joins.composite(a, b, ["k"]).select(F.col("available").cast("string").alias("at"), "eligible").first()
        assert tuple(got) == ("2024-01-02 04:00:00", True)
        # the west's late evening is the later instant, though its text sorts first
        other = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-11-03 06:30:00Z' AS available, true AS tradable")
        assert joins.composite(other, b, ["k"]).select(F.col("available").cast("string")).first()[0] == "2024-11-03 06:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_composite_is_an_error_on_null_clocks_and_repeats(spark):
    rows = lambda x: spark.createDataFrame(x, "k string, available timestamp_ntz, tradable boolean")
    members = lambda x: spark.createDataFrame(x, "k string, member_available string, member boolean")
    at, text = datetime(2024, 1, 1), "2024-01-01"
    good, bad = [("a", at, True)], [("a", text, True)]
    for primary, membership, code in (([("a", None, True)], bad, "C1"), (good, [("a", None, True)], "C1"), (good, [("a", "noon", True)], "C1"), (good, [("a", "2024-01-01 05:00:00", True)], "C1"), (good * 2, bad, "C4"), (good, bad * 2, "C4"), (good, [], "C4"), ([("a", at, None)], bad, "C4")):
        for column in ("available", "eligible"):
            with pytest.raises(Exception, match=code):
                joins.composite(rows(primary), members(membership), ["k"]).select(column).collect()
    with pytest.raises(PlanError, match="C1"):
        joins.composite(rows(good), spark.createDataFrame([("a", 3, True)], "k string, member_available int, member boolean"), ["k"])
    counted = joins.composite_audit(rows([*good, *good, ("b", None, True), ("c", at, False), ("d", at, True), ("e", at, True)]), members([(k, text, k != "d") for k in "abcdf"]), ["k"]).first().asDict()
    assert counted == {"primary_rows": 6, "membership_rows": 5, "matched_rows": 2, "eligible_rows": 0, "dropped_by_mask": 1, "dropped_by_membership": 1, "unmatched_rows": 1, "repeated_rows": 2, "clock_faults": 1, "mask_faults": 0, "unused_rows": 1, "later_membership": 0}


def test_composite_source_releases_nothing_early(spark, tmp_path):
    (tmp_path / "p.csv").write_text("k,t,known,ok\na,2024-01-01T00:00:00Z,2024-01-02T01:00:00Z,true\n")
    (tmp_path / "m.csv").write_text("k,t,known,member\na,2024-01-01T00:00:00Z,2024-01-01T23:00:00-05:00,true\n")
    r = registry.Registry()
    text = lambda d: spark.read.csv(d.locator, header=True, schema="k string, t string, known string, ok boolean" if "p.csv" in d.locator else "k string, t string, known string, member boolean")
    r.register("text", lambda spark, d: text(d))
    a, b = (Declaration(n, "k", "t", "known", mask, kind="text", locator=str(tmp_path / f"{n}.csv")) for n, mask in (("p", "ok"), ("m", None)))
    r.register("both", registry.composite_connector(r, a, b, "member", ["k", "t"]))
    both = Declaration("both", "k", "t", "available", "eligible", kind="both")
    assert registry.point(r, spark, both, "2024-01-02T03:59:00Z").count() == 0
    assert registry.point(r, spark, both, "2024-01-02T04:00:00Z").count() == 1


def test_view_audit_balances(spark):
    rows = spark.createDataFrame([(t, t % 3 != 0) for t in range(10) for _ in range(2)], "t int, tradable boolean")
    asked = spark.createDataFrame([(0, 2, 5), (1, 8, 20), (2, 30, 40)], "fold int, hist_start int, decision int")
    got = {r["fold"]: tuple(r)[2:] for r in views.audit(rows, asked).collect()}
    assert got == {0: (20, 8, 12, 2, 6, 2), 1: (20, 4, 16, 2, 2, 0), 2: (20, 0, 20, 0, 0, 0)}
    assert views.audit(rows.limit(0), asked).where("source_rows <> 0 or output_rows <> 0").count() == 0


def _loop_book(prices, tradable, books, horizon, cadence):
    """Positions and trades by a walk over sessions: {(entity, t): (position, change)}."""
    slots, out, held = -(-horizon // cadence), {}, {}
    for t in range(len(next(iter(prices.values())))):
        for e in prices:
            if prices[e][t] is None:
                continue
            before = held.get(e, 0.0)
            if tradable[e][t]:
                held[e] = sum(w.get(e, 0.0) / slots for s, w in books.items() if s <= t < s + horizon)
            out[e, t] = (round(held.get(e, 0.0), 9), round(held.get(e, 0.0) - before, 9))
    return out


def test_netted_books_are_as_by_a_walk(spark):
    rng = np.random.default_rng(4)
    n, names = 40, range(6)
    prices = {e: [float(p) if rng.random() > 0.2 else None for p in 10 + rng.random(n)] for e in names}
    tradable = {e: [bool(rng.random() > 0.3) for _ in range(n)] for e in names}
    books = {t: {int(e): float(w) for e, w in zip(rng.permutation(6)[:4], (0.25, 0.25, -0.25, -0.25), strict=True)} for t in range(0, n, 5)}
    rows = spark.createDataFrame([(e, t, prices[e][t], tradable[e][t]) for e in names for t in range(n) if prices[e][t] is not None], "entity int, t int, price double, tradable boolean")
    weights = spark.createDataFrame([(e, t, w) for t, b in books.items() for e, w in b.items()], "entity int, t int, weight double")
    held = portfolio.netted(rows, weights, 10, 5)
    want = _loop_book(prices, tradable, books, 10, 5)
    assert {(r["entity"], r["t"]): (round(r["position"], 9), round(r["change"] or 0.0, 9)) for r in held.collect()} == want
    for execution, step in ((portfolio.NEXT_BAR, 1), (portfolio.SAME_BAR, -1)):
        days = {r["t"]: r for r in portfolio.book_days(held, 0.001, execution).collect()}
        assert sorted(days) == list(range(min(t for (_, t), (p, _) in want.items() if p), n - (step == 1)))
        for t, day in days.items():
            earned = lambda e, t=t, step=step: (prices[e][t + step] / prices[e][t] - 1 if step == 1 else prices[e][t] / prices[e][t - 1] - 1) if 0 <= t + step < n and prices[e][t] and prices[e][t + step] else 0.0
            turnover = sum(abs(want[e, t][1]) for e in names if (e, t) in want)
            assert day["gross"] == pytest.approx(sum(want[e, t][0] * earned(e) for e in names if (e, t) in want), abs=1e-8)
            assert day["turnover"] == pytest.approx(turnover, abs=1e-8) and day["net"] == pytest.approx(day["gross"] - turnover * 0.001, abs=1e-8)


def test_a_replacement_is_netted(spark):
    rows = spark.createDataFrame([(e, t, 10.0, True) for e in (1, 2) for t in range(12)], "entity int, t int, price double, tradable boolean")
    weights = spark.createDataFrame([(e, t, w) for t in (0, 5, 10) for e, w in ((1, 0.5), (2, -0.5))], "entity int, t int, weight double")
    held = portfolio.netted(rows, weights, 5, 5)
    # the same book again trades nothing, and the last one isn't sold
    assert sorted((r["t"], r["change"]) for r in held.where("change is not null").collect()) == [(0, -0.5), (0, 0.5)]


def test_first_bad_clock_says_where(spark, tmp_path):
    spark.createDataFrame([(i, None if i in (7, 9) else "2024-01-01") for i in range(10)], "i int, t string").coalesce(1).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    got = guard.first_bad_clock(df, "t").first()
    assert (got["n_bad"], got["row"], got["clock"]) == (2, 7, None) and got["file"].endswith(".parquet")
    with pytest.raises(Exception, match=r"C1.*row 7 of .*parquet"):
        guard.guarded(df, read_plan(Declaration("d", "i", "t"), "2025-01-01"), locate=True).collect()
    with pytest.raises(PlanError, match="CONFIG"):
        guard.first_bad_clock(spark.range(3), "id")
    clock = lambda kind, *v: spark.createDataFrame([(x,) for x in v], f"t {kind}")
    for kind, values in (("bigint", (1704067200000, 1704067200001)), ("double", (1704067200000.0, 1704067200001.0))):
        plan = read_plan(Declaration("d", "t", "t"), "2024-01-01T00:00:00Z")
        assert guard.guarded(clock(kind, *values), plan).count() == 1
        with pytest.raises(Exception, match="C1"):
            guard.guarded(clock(kind, None, *values), plan).count()
    with pytest.raises(Exception, match="C1"):
        guard.guarded(clock("double", float("nan")), plan).count()


def test_models_are_as_by_numpy(spark):
    rng = np.random.default_rng(8)
    x, t = rng.normal(size=(300, 3)), rng.integers(0, 60, 300)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    rows = spark.createDataFrame([(int(s), *map(float, a), float(b)) for s, a, b in zip(t, x, y, strict=True)] + [(3, None, 1.0, 1.0, 1.0), (3, 1.0, float("nan"), 1.0, 1.0)], "t int, a double, b double, c double, y double")
    folds = spark.createDataFrame([(0, 0, 19, 25, 29), (1, 10, 39, 45, 49), (2, 70, 80, 90, 91)], "fold int, train_start int, train_end int, oos_start int, oos_end int")
    models = regression.fold_models(rows, folds, ["a", "b", "c"], "y", 0.5)
    got = {r["fold"]: r for r in models.collect()}
    for fold, (low, high) in enumerate(((0, 19), (10, 39))):
        inside = (t >= low) & (t <= high)
        design = np.c_[np.ones(inside.sum()), x[inside]]
        assert got[fold]["n"] == inside.sum() and np.allclose(got[fold]["coefficients"], np.linalg.solve(design.T @ design + np.diag([0, 0.5, 0.5, 0.5]), design.T @ y[inside]))
    assert (got[2]["n"], got[2]["coefficients"]) == (0, [0.0] * 4)
    scored = regression.fold_scores(rows, folds, models, ["a", "b", "c"]).where("fold = 0").collect()
    assert {r["t"] for r in scored} <= set(range(25, 30)) and all(r["score"] == pytest.approx(got[0]["coefficients"] @ np.r_[1, r["a"], r["b"], r["c"]]) for r in scored)


def test_solution_swaps_rows_and_knows_singular_systems(spark):
    systems = [[[0.0, 2.0, 4.0], [1.0, 1.0, 3.0]], [[1.0, 1.0, 2.0], [2.0, 2.0, 4.0]], [[1e-20, 0.0, 1.0], [0.0, 1.0, 1.0]]]
    df = spark.createDataFrame([(m,) for m in systems], "m array<array<double>>")
    assert [r[0] for r in df.select(regression.solution(F.col("m"), 2)).collect()] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_full_panel_takes_the_latest_period_known(spark):
    panel = spark.createDataFrame([(e, t, 1.0) for e in ("a", "b") for t in range(8)], "entity string, t int, price double")
    members = spark.createDataFrame([("a", 1, 3), ("a", 5, None), ("c", 0, None)], "entity string, since int, until int")
    revisions = spark.createDataFrame([("a", 1, 2, 10.0), ("a", 2, 4, 20.0), ("a", 1, 5, 11.0), ("a", 2, 6, 21.0), ("a", 3, None, 9.0)], "entity string, period int, effective int, value double")
    got = {(r["entity"], r["t"]): (r["member"], r["survivor"], r["period"], r["fundamental"], r["known_at"]) for r in joins.full_panel(panel, members, spark.createDataFrame([("b",)], "entity string"), revisions).collect()}
    want = [None, None, (1, 10.0, 2), (1, 10.0, 2), (2, 20.0, 4), (2, 20.0, 4), (2, 21.0, 6), (2, 21.0, 6)]
    assert got == {("a", t): (t in (1, 2, 5, 6, 7), False, *(want[t] or (None,) * 3)) for t in range(8)} | {("b", t): (False, True, None, None, None) for t in range(8)}


@pytest.fixture
def sums():
    """A class that goes to the workers as it is, as one of a user's script does."""

    class Sum(factor.Factor):
        columns = {"total": "double"}
        odd = None

        def start(self):
            self.total = 0.0

        def step(self, row):
            self.total += row["v"]
            yield row["t"] + (1 if self.odd == "future" else 0), self.total
            if self.odd == "twice":
                yield row["t"], self.total

        def end(self):
            if self.odd == "other":
                yield -1, 0.0

    return Sum


def test_factors_of_a_user(spark, sums):
    rows = spark.createDataFrame([(e, t, float(t)) for e in ("a", "b") for t in (3, 1, 2)], "entity string, t int, v double").repartition(3)
    made = factor.compute(rows, sums())
    assert sorted(map(tuple, factor.admitted(made, rows, ["entity", "t"]).collect())) == [(e, t, s) for e in ("a", "b") for t, s in ((1, 1.0), (2, 3.0), (3, 6.0))]
    assert factor.compute(rows.limit(0), sums()).count() == 0
    for odd, code in (("future", "C1"), ("twice", "C4"), ("other", "C4")):
        bad = sums()
        bad.odd = odd
        with pytest.raises(Exception, match=code):
            factor.admitted(factor.compute(rows, bad), rows, ["entity", "t"]).collect()
    with pytest.raises(PlanError, match="CONFIG"):
        bad.columns = {"T": "double"}
        factor.compute(rows, bad)


def test_a_factor_in_views(spark, sums):
    folds = spark.createDataFrame([(0, 0, 3, 6, 9)], "fold int, train_start int, train_end int, oos_start int, oos_end int")
    rows = spark.createDataFrame([(e, t, float(t), True) for e in ("a", "b") for t in range(10)], "entity string, t int, v double, tradable boolean")
    seen = views.view(rows, views.admissible(spark.createDataFrame([(0, "train", 3), (0, "out-of-sample", 8)], "fold int, role string, decision int"), folds))
    made = factor.compute(seen, sums(), (*views.VIEW, "entity"))
    got = sorted((r["role"], r["entity"], r["t"], r["total"]) for r in views.admitted(made, seen).collect())
    assert got == [("out-of-sample", e, 8, 36.0) for e in "ab"] + [("train", e, t, t * (t + 1) / 2) for e in "ab" for t in range(4)]


class Liar(connectors.Connector):
    """Gives everything, and says what it likes."""

    name, capabilities = "liar", connectors.Capabilities(projection=True, as_of=True)

    def __init__(self, taken):
        self.taken = taken

    def accepts(self, declaration):
        return declaration.name != "foreign"

    def read(self, spark, request):
        return spark.read.parquet(*request.paths), self.taken


def test_connectors_take_over_and_are_not_trusted(spark, tmp_path):
    at = lambda day: datetime(2024, 1, day)
    rows = spark.createDataFrame([(i, at(1 + i % 20), float(i)) for i in range(200)], "k int, t timestamp_ntz, v double")
    rows.repartitionByRange(5, "t").write.parquet(str(tmp_path / "d"))
    r = registry.Registry()
    plan = lambda kind, columns=("k", "v"), name="d": read_plan(Declaration(name, "k", "t", kind=kind, locator=str(tmp_path / "d")), "2024-01-06T00:00:00Z", list(columns))
    got, taken = r.reported(spark, plan("parts"))
    assert taken == connectors.Taken(True, True) and sorted(map(tuple, got.collect())) == sorted((i, float(i)) for i in range(200) if i % 20 < 6) and got.columns == ["k", "v"]
    reader = connectors._PartsReader({"paths": json.dumps([files.uri(f) for f in spark.read.parquet(str(tmp_path / "d")).inputFiles()]), "columns": '["k"]', "clock": "t", "as_of": "2024-01-06T00:00:00+00:00"})
    assert len(reader.paths) == 5 and len(reader.partitions()) < 5
    r.register("liar", Liar(connectors.Taken(False, True)))
    assert sorted(map(tuple, r.read(spark, plan("liar")).collect())) == sorted(map(tuple, got.collect()))
    r.register("worse", Liar(connectors.Taken(True, True)))
    with pytest.raises(PlanError, match="gave others"):
        r.read(spark, plan("worse", ["k"]))
    with pytest.raises(PlanError, match="doesn't read"):
        r.read(spark, plan("liar", name="foreign"))
    with pytest.raises(PlanError, match="which it can't"):
        connectors.checked(connectors.FilesOf("parquet"), (got, connectors.Taken(True)), connectors.Request(plan("parquet"), ()))
    # a row without a clock reaches the guard
    rows.unionByName(spark.createDataFrame([(999, None, 0.0)], rows.schema)).coalesce(1).write.parquet(str(tmp_path / "n"))
    with pytest.raises(Exception, match="C1"):
        r.read(spark, read_plan(Declaration("n", "k", "t", kind="parts", locator=str(tmp_path / "n")), "2023-01-01")).collect()


def test_manifest_of_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = os.urandom(5000)
    (tmp_path / "in/a.bin").write_bytes(data)
    (tmp_path / "in/empty").write_bytes(b"")
    seen = lambda size=1000: {r["name"]: (r["bytes"], r["tree"]) for r in files.manifest(spark, str(tmp_path / "in"), size).collect()}
    first = seen()
    assert first == seen() and {k: v[0] for k, v in first.items()} == {"a.bin": 5000, "empty": 0} and first["a.bin"] != seen(999)["a.bin"]
    for at in (0, 999, 1000, 4999):
        (tmp_path / "in/a.bin").write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        assert seen()["a.bin"] != first["a.bin"]
    # ranges in another order are another file
    (tmp_path / "in/a.bin").write_bytes(data[1000:2000] + data[:1000] + data[2000:])
    assert seen()["a.bin"] != first["a.bin"]


def test_zone_map_leaves_files_out(spark, tmp_path):
    at = lambda day: datetime(2024, 1, 1 + day)
    rows = spark.createDataFrame([(i, at(i % 28)) for i in range(280)], "k int, t timestamp_ntz")
    store, d = str(tmp_path / "store"), Declaration("d", "k", "t")
    digest = registry.save_snapshot(rows, store, "t")
    known = registry.snapshot_as_of(spark, store, digest, d, "2024-01-04")
    assert sorted(r["k"] for r in known.collect()) == sorted(i for i in range(280) if i % 28 < 4)
    assert 0 < len(known.inputFiles()) < len(registry.load_snapshot(spark, store, digest).inputFiles())
    assert registry.snapshot_as_of(spark, store, digest, d, "2023-01-01").count() == 0
    with_null = registry.save_snapshot(rows.unionByName(spark.createDataFrame([(999, None)], rows.schema)), store, "t")
    with pytest.raises(Exception, match="C1"):
        registry.snapshot_as_of(spark, store, with_null, d, "2023-01-01").collect()
    for read in (lambda: registry.load_snapshot(spark, store, "0" * 64), lambda: registry.snapshot_as_of(spark, store, registry.save_snapshot(rows.limit(3), store), d, "2024-01-04")):
        with pytest.raises(PlanError, match="READ_SET_UNAVAILABLE"):
            read()


def _walked(rows, hold, lag, quantile, long_short):
    """Positions of each fold by a walk over its sessions, one at a time: {(fold, t): {entity: weight}}."""
    out, budgets = {}, (0.5, 0.5) if long_short else (1.0, 0.0)
    for fold in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == fold]
        times, held = sorted({r[1] for r in own}), {}
        for o, t in enumerate(times):
            if o >= lag and (o - lag) % hold == 0:
                may = {r[2] for r in own if r[1] == t and r[4]}
                names = sorted((-r[5], r[2]) for r in own if r[1] == times[o - lag] and r[5] is not None and r[2] in may)
                carried = {e: w for e, w in held.items() if e not in may}
                k = max(1, int(len(names) * quantile))
                k = min(k, len(names) // 2) if long_short else min(k, len(names))
                left = [max(0.0, b - sum(max(0.0, w * s) for w in carried.values())) for b, s in zip(budgets, (1, -1))]
                held = dict(carried) | {e: left[0] / k for _, e in names[:k]} | ({e: -left[1] / k for _, e in names[len(names) - k :]} if long_short and k else {})
            out[fold, t] = dict(held)
    return out


@pytest.mark.parametrize("long_short", [True, False])
def test_carried_positions_are_as_by_a_walk(spark, long_short):
    from tidemark.operators import pricing

    rng = np.random.default_rng(6)
    rows = [(f, t, e, float(10 + rng.random()), bool(rng.random() > 0.5), float(rng.integers(0, 5)) if rng.random() > 0.1 else None) for f in (0, 1) for t in range(f, 23) for e in range(9)]
    df = spark.createDataFrame(rows, "fold int, t int, entity bigint, price double, tradable boolean, score double")
    want, price = _walked(rows, 2, 1, 0.3, long_short), {r[:3]: r[3] for r in rows}
    for r in pricing.fold_returns(df, 2, 1, 0.3, long_short).collect():
        book = want[r["fold"], r["t"]]
        assert r["held"] == len(book)
        assert r["gross"] == pytest.approx(sum(w * (price[r["fold"], r["t"], e] / price[r["fold"], r["t"] - 1, e] - 1) for e, w in book.items()), abs=1e-9)
    trades = {(r["fold"], r["t"], r["entity"]): r["change"] for r in pricing.fold_trades(df, 2, 1, 0.3, long_short).collect()}
    for (fold, t), book in want.items():
        before = want.get((fold, t - 1), {})
        for e in range(9):
            assert trades.get((fold, t, e), 0.0) == pytest.approx(book.get(e, 0.0) - before.get(e, 0.0), abs=1e-9)


def test_jobs_do_not_grow_with_the_steps(spark):
    from tidemark.operators import pricing

    def jobs(sessions):
        df = spark.range(sessions * 4).select(F.lit(0).alias("fold"), F.expr("cast(id div 4 as int) AS t"), (F.col("id") % 4).alias("entity"), F.lit(1.0).alias("price"), (F.col("id") % 5 > 0).alias("tradable"), (F.col("id") % 7).cast("double").alias("score"))
        context = spark.sparkContext
        context.setJobGroup(f"steps-{sessions}", "")
        pricing.fold_returns(df, 1, 1, 0.25).collect()
        return len(context.statusTracker().getJobIdsForGroup(f"steps-{sessions}"))

    assert jobs(40) <= jobs(8) + 2


def test_business_days_by_counting(spark):
    from datetime import date, timedelta

    from tidemark.functions.dates import add_business_days

    def count(day, n):
        step = 1 if n > 0 else -1
        while n == 0 and day.weekday() > 4:
            day -= timedelta(1)
        for _ in range(abs(n)):
            day += timedelta(step)
            while day.weekday() > 4:
                day += timedelta(step)
        return day

    rows = [(date(2024, 1, 1) + timedelta(i), n) for i in range(14) for n in range(-12, 13)]
    got = spark.createDataFrame(rows, "d date, n int").select("d", "n", add_business_days(F.col("d"), F.col("n")).alias("due")).collect()
    assert all(r["due"] == count(r["d"], r["n"]) for r in got)


def test_block_folds(spark):
    from tidemark.plans.folds import block_folds

    made = lambda n: [tuple(r) for r in block_folds(spark.createDataFrame([(n,)], "n int"), 4, 30, 10).orderBy("fold").collect()]
    assert made(131) == [(0, 30, 40, 51, 70), (1, 30, 60, 71, 90), (2, 30, 80, 91, 110), (3, 30, 100, 111, 130)]
    assert made(31) == made(0) == []
    with pytest.raises(PlanError, match="C2"):
        block_folds(spark.range(1), 0, 30, 10)


def test_written_tables_can_be_cleared(spark, tmp_path):
    from tidemark import session

    kept = session.written(spark.range(3), "test-table")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    session.clear_written(spark)
    assert not os.path.exists(path)
