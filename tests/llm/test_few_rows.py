"""Joins with tables of few rows, and of more, give the same."""

import numpy as np
import pytest

from tidemark.llm import common, minmax_dedup
from tidemark.llm import components as stars


def test_few_links_are_not_counted_by_node(spark, monkeypatch):
    links = spark.createDataFrame([(i // 2, i) for i in range(1, 30)] + [(70, 71), (71, 72)], "u bigint, v bigint")
    want = {i: 0 for i in range(30)} | {70: 70, 71: 70, 72: 70}
    counts = []
    monkeypatch.setattr(stars, "frequent", lambda *a: counts.append(1) or common.frequent(*a))
    assert {r["node"]: r["label"] for r in stars.components(links).collect()} == want
    assert not counts
    monkeypatch.setattr(stars, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "SLICE", 1)
    assert {r["node"]: r["label"] for r in stars.components(links).collect()} == want
    assert counts


@pytest.mark.parametrize("few", [0, 250_000])
def test_near_duplicates_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(common, "SLICE", 4)
    monkeypatch.setattr(minmax_dedup, "SLICE", 4)
    monkeypatch.setattr(minmax_dedup, "BROADCAST_ROWS", few)
    for module in (minmax_dedup, stars):
        monkeypatch.setattr(module, "FEW_ROWS", few)
    rng = np.random.default_rng(3)
    base = [[f"b{i}w{rng.integers(900)}" for _ in range(60)] for i in range(4)]
    rows = [(i, " ".join([*base[i % 4][: 30 + i % 2], *(["edit"] * (i % 3)), *base[i % 4][30 + i % 2 :]])) for i in range(40)] + [(None, "no id here at all"), (99, "no id here at all"), (None, "alone without id")]
    sets = [set(minmax_dedup.shingles(t, 3).tolist()) for _, t in rows]
    alike = [[100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if alike[i][j]) for i in range(len(rows))]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if least[i] == c and rows[i][0] is not None), default=None) for c in least}
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(((i, ids[c]) for (i, _), c in zip(rows, least, strict=True)), key=repr)
