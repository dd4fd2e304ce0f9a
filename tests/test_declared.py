import json

import pytest

from tidemark.__main__ import main
from tidemark.plans.declaration import Declaration, PlanError
from tidemark.plans.declared import declaration, load
from tidemark.sources import registry

GOOD = """dataset: prices
version: "1"
entity_key: k
event_time: t
available_time: a
availability_basis:
  - until: 2024-01-02
    basis: reconstructed
    source: vendor
  - from: 2024-01-02
    basis: observed
guarantees: {point_in_time: true, tradability_mask: ok}
payload_schema: {v: float64}
source: {type: csv, locator: data/*.csv}
"""


def test_declaration_from_yaml(spark, tmp_path):
    file = tmp_path / "d.yaml"
    file.write_text(GOOD)
    d = load(str(file))
    assert (d.name, d.clock, d.mask, d.kind, d.locator, d.payload) == ("prices", "a", "ok", "csv", "data/*.csv", ("v",))
    assert [(str(u)[:10] if u else None, b) for _, u, b in d.segments] == [("2024-01-02", "reconstructed"), (None, "observed")]
    for old, new, message in (
        ("version: ", "dataset: x\nversion: ", "twice"), ("version: ", "other: 1\nversion: ", "unknown key other"), ('version: "1"\n', "", "no version"), ('"1"', "1", "version must be"),
        ("source: vendor", "rationale: x", "source of a reconstructed"), ("from: 2024-01-02", "from: 2024-01-03", "gap"), ("available_time: a", "available_time: null", "goes with"), ("dataset: prices", "dataset: a b", "dataset"),
        ("dataset: prices", "dataset: [", "no readable"), ("dataset: prices", "dataset: !!python/name:os.system", "no readable"),
    ):
        file.write_text(GOOD.replace(old, new, 1))
        with pytest.raises(PlanError, match=message):
            load(str(file))
    with pytest.raises(PlanError, match="no readable"):
        load(str(tmp_path / "none.yaml"))
    for old, new, message in (
        ("dataset: prices", "dataset: ..", "dataset"), ("point_in_time: true", 'point_in_time: "false"', "true or false"), ("point_in_time: true", "vintage: 7", "true or false"), ("point_in_time: true", "survivorship_free: maybe", "survivorship_free"),
        ("point_in_time: true", "point_in_time: on", "neither true nor false"), ("tradability_mask: ok", "tradability_mask: 3", "must be a text"), ("basis: observed", "basis: observed\n    source: x", "can't carry source"), ("source: vendor", "source: vendor\n    lag: P2D", "can't carry lag"),
        ("source: {type", "provenance: {certified: true}\nsource: {type", "lineage_ref"), ("source: {type", "provenance: {lineage_ref: 'sha256:ab'}\nsource: {type", "SHA-256"), ("{v: float64}", "{v: 3}", "payload_schema"),
    ):
        file.write_text(GOOD.replace(old, new, 1))
        with pytest.raises(PlanError, match=message):
            load(str(file))
    file.write_text(GOOD)
    assert load(str(file)).digest == d.digest != load(str(file)).__class__(d.name, d.entity, d.event_time).digest
    whole = {"dataset": "x", "version": "1", "entity_key": "k", "event_time": "t", "available_time": "a", "source": {"type": "csv", "locator": "x"}}
    assert declaration(whole | {"availability_basis": {"basis": "assumed", "lag": "P2D", "rationale": "r"}}).degradations == ("NO_TRADABILITY_MASK", "AVAILABILITY_ASSUMED")
    for basis in ("assumed", {"basis": "assumed", "lag": "P0D", "rationale": "r"}, [], {"basis": "guessed"}):
        with pytest.raises(PlanError, match="CONFIG"):
            declaration(whole | {"availability_basis": basis})


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_text("k,t,a,ok,v\nx,2024-01-01,2024-01-01,true,1.5\nx,2024-01-02,2024-01-05,true,2.5\n")
    (tmp_path / "d.yaml").write_text(GOOD)
    base = ["--declaration", str(tmp_path / "d.yaml"), "--root", str(tmp_path), "--as-of", "2024-01-03T00:00:00Z"]
    assert main(["panel", *base, "--columns", "v"], spark) == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [list(r) for r in shown] == [["k", "t", "a", "ok", "v"]] and shown[0]["v"] == 1.5
    assert main(["point", *base, "--output", "snapshot", "--to", str(tmp_path / "store")], spark) == 0
    assert registry.load_snapshot(spark, str(tmp_path / "store"), capsys.readouterr().out.strip()).count() == 1
    assert main(["point", *base[:-1], "2024-01-03T00:00:00"], spark) == 1 and "no zone" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["point", *base, "--to", "x"], spark)


def test_composite_is_a_source_like_others(spark):
    prices = spark.createDataFrame([("x", 1, "2024-01-01", True), ("y", 1, "2024-01-01", True)], "k string, t int, a string, ok boolean")
    members = spark.createDataFrame([("x", 1, "2024-01-02", True), ("y", 1, "2024-01-09", True)], "k string, t int, known string, member boolean")
    a, b = Declaration("p", "k", "t", "a", "ok", kind="prices"), Declaration("m", "k", "t", "known", kind="members")
    r = registry.Registry()
    r.register("prices", lambda *_: prices)
    r.register("members", lambda *_: members)
    r.register("both", registry.composite_connector(r, a, b, "member", ["k", "t"]))
    both = Declaration("c", "k", "t", "available", "eligible", kind="both")
    assert [tuple(x) for x in registry.point(r, spark, both, "2024-01-03", ["k"]).collect()] == [("x", True)]
    with pytest.raises(PlanError, match="CONFIG"):
        registry.composite_connector(r, Declaration("p", "k", "t"), b, "member", ["k", "t"])
