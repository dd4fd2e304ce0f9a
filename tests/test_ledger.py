import hashlib
import json

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import joins, ledger


def test_numbers_are_written_in_their_canonical_form(spark):
    forms = {0.0: "0", -0.0: "0", 1.0: "1", -2.5: "-2.5", 0.1: "0.1", 100.0: "100", 12345678.9: "12345678.9", 1e20: "1" + "0" * 20, 1e21: "1e+21", 1.25e25: "1.25e+25", 1e-6: "0.000001", 1e-7: "1e-7", -1.5e-10: "-1.5e-10", 0.00123: "0.00123", 123456789012345680.0: "123456789012345680"}
    got = spark.createDataFrame([(float(x),) for x in forms], "x double").select("x", text.canonical_number(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in got} == forms


def test_json_hash_and_identity(spark):
    row = spark.createDataFrame([(1, 'a"b\n\u00e9'), (2, None)], "k int, s string")
    found = row.orderBy("k").select(text.canonical_json(s=F.col("s"), k=F.col("k")), text.domain_hash("d", text.canonical_json(s=F.col("s"), k=F.col("k"))), text.identity(F.col("s"), "string"), text.identity(F.col("k"), "number")).collect()
    want = json.dumps({"k": 1, "s": 'a"b\n\u00e9'}, separators=(",", ":"), ensure_ascii=False)
    assert found[0][0] == want and found[1][0] == '{"k":2,"s":null}'
    assert found[0][1] == hashlib.sha256(b"d\0" + want.encode()).hexdigest()
    assert found[0][2] == "string:" + json.dumps('a"b\n\u00e9', ensure_ascii=False) and found[0][3] == "number:1"


def test_universe_by_spans(spark):
    panel = spark.createDataFrame([(1, t) for t in range(6)] + [(2, 0)], "entity int, t int")
    spans = spark.createDataFrame([(1, 1, 3), (1, 5, None), (1, 2, 3), (3, 0, None)], "entity int, since int, until int")
    got = joins.in_universe(panel, spans, joins.survivors(panel, 2)).collect()
    assert sorted((r["entity"], r["t"]) for r in got if r["member"]) == [(1, 1), (1, 2), (1, 5)] and len(got) == 7
    assert {r["entity"] for r in got if r["survivor"]} == {1}


def test_empty_ledgers(spark):
    none = spark.createDataFrame([], "weight double, passed boolean")
    assert tuple(ledger.suite_scores(none, none).first()) == (0.0, False, 0.0)
    rows = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 2, 3), ("b", "y", 3, 4)], "kind string, lock string, at int, id int")
    assert [r["lock"] for r in ledger.priors(rows, {"kind": "a", "lock": "x"}, "lock", ["at"]).collect()] == ["y"]
    assert {r["kind"]: r["members"] for r in ledger.families(rows, "kind", "id").collect()} == {"a": 1, "b": 1}


def test_topology_of_a_whole_protocol_has_no_fault(spark):
    wanted = spark.createDataFrame([(0, "train", 9), (0, "out-of-sample", 12), (1, "train", 12)], "fold int, role string, decision int")
    done = wanted.withColumns({"source": F.col("decision").cast("string"), "evidence": F.concat("fold", "role", "decision")})
    assert ledger.topology(done, wanted).count() == 0
    assert sorted(r["fault"] for r in ledger.topology(done.withColumn("source", F.col("role")), wanted).collect()) == ["sources", "sources"]
