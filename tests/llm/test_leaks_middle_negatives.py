import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, hard_negatives, winnowing
from tidemark.llm.words import ALPHANUMERIC, BLOCK, NOT_SPACE, hashed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(docs, items, window=10):
    owners, out = defaultdict(set), []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[j : j + n])].add(i)
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in range(1, window + 1):
            for j in range(len(w) - n + 1):
                if (found := owners.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    ids |= found
        ids = {str(x) for x in ids if x is not None}
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0))
    return out


@pytest.fixture(scope="module")
def leaky():
    """Documents and items with nulls, empty texts, repeats, short items, passages that many share, and words of many blocks."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["alpha", "beta", "Gamma", "delta", "ÉTÉ", "x1"])
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    shared = text(30)
    items = [(i, f"{text(4)} {shared} {text(5)}" if i % 3 else text(14)) for i in range(20)]
    items += [(20, "beta beta"), (21, "x1"), (22, None), (23, " !? "), (None, "delta delta delta"), (24, items[1][1]), (1, items[1][1]), (100, "alpha beta gamma delta alpha beta gamma delta alpha")]
    docs = [(i, f"{text(int(rng.integers(0, 40)))} {items[i % 20][1][int(rng.integers(0, 60)):]} {text(3)}" if i % 2 else text(int(rng.integers(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "quite another text without any of these"), (203, shared), (203, shared), (204, "y" * (2 * BLOCK + 5) + " " + shared + "é" * BLOCK), (205, "BETA-beta")]
    return docs, items


def test_leaks_are_as_by_brute_force(spark, leaky, monkeypatch):
    docs, items = leaky
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(repr, leaks(docs, items)))
    assert rows_of(winnowing.contamination(d, b)) == want
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("tidemark.llm.common.SLICE", 3)
    assert rows_of(winnowing.contamination(d, b)) == want
    assert rows_of(winnowing.contamination(d, b, 4)) == sorted(map(repr, leaks(docs, items, 4)))


def test_a_full_bitmap_lets_all_through(spark, leaky, monkeypatch):
    docs, items = leaky
    d, b = spark.createDataFrame(docs[:40], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(winnowing, "LEAST_BITS", 6)
    monkeypatch.setattr(winnowing, "MOST_BITS", 6)
    assert rows_of(winnowing.contamination(d, b)) == sorted(map(repr, leaks(docs[:40], items)))


def test_leak_spans_and_clean_documents(spark, leaky):
    docs, items = leaky
    d = spark.createDataFrame([(i, t, "kept", 7) for i, t in docs], "doc_id bigint, text string, key string, leak_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    hit = {r[0]: r[2] for r in leaks(docs, items) if r[0] is not None and r[0] != 203}
    got = {r["doc_id"]: r["n"] for r in winnowing.hit_spans(d, b).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert all(got.get(i, 0) == n for i, n in hit.items())
    clean = winnowing.drop_contaminated(d, b)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, n in hit.items() if n == 0)


@pytest.mark.parametrize("docs,items", [(0, 3), (3, 0), (0, 0)])
def test_no_documents_or_no_items(spark, docs, items):
    d = spark.createDataFrame([(i, f"some text {i}") for i in range(docs)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, "other words") for i in range(items)], "item_id bigint, text string")
    got = winnowing.contamination(d, b).collect()
    assert len(got) == docs and all((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (3, 0, 0, sha(""), False) for r in got)


@pytest.mark.parametrize("window", range(1, 11))
def test_every_shared_window_has_a_shared_fingerprint(window):
    rng = np.random.default_rng(window)
    shared = rng.integers(0, 1 << 60, window).astype(np.uint64)
    for _ in range(20):
        sides = [np.r_[rng.integers(0, 5, int(rng.integers(0, 9))), shared, rng.integers(0, 5, int(rng.integers(0, 9)))].astype(np.uint64) for _ in range(2)]
        prints = [set(winnowing.winnow(x, np.zeros(len(x), int), window)[2].tolist()) for x in sides]
        assert prints[0] & prints[1]


def test_words_of_blocks_are_as_whole(monkeypatch):
    texts = ["", "One two", "a" * 50 + " b", "  ", "é" * 30, "c\x0bd\x1fe", "tail " * 9]
    want = hashed(texts, NOT_SPACE)
    assert np.bincount(want[1], minlength=7).tolist() == [0, 2, 2, 0, 1, 2, 9]
    assert np.bincount(hashed(texts, ALPHANUMERIC)[1], minlength=7).tolist() == [0, 2, 2, 0, 1, 3, 9]
    assert hashed(["ONE"], NOT_SPACE)[0] == hashed(["x one"], NOT_SPACE)[0][1:]
    from tidemark.llm import words as module

    monkeypatch.setattr(module, "BLOCK", 7)
    module._powers.cache_clear()
    got = hashed(texts, NOT_SPACE)
    module._powers.cache_clear()
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def middles(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in draws[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if draws[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(u), "spm" if draws[3] % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text)


def test_middles_are_as_by_hand(spark):
    odd = ["", None, " ", "\t\n", " a  b ", "😀 😀\n\x0b é\x1fx\x85y z", "x <P> y", "<<P<<P", "a <", "M> b S> c <", "w " * 200_000, "x" * 2_000_000]
    rows = [(i, odd[i % len(odd)]) for i in range(90)] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    got = fill_in_middle.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert rows_of(got) == sorted(map(repr, (middles(*r) for r in rows)))
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_middle_keeps_columns_and_grammars_lose_nothing(spark):
    text = "One two.  Three!\n\n 😀 four\n"
    docs = spark.createDataFrame([(i, text, "kept", i) for i in range(40)], "doc_id bigint, text string, fim_units string, N int")
    got = fill_in_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "fim_units", *fill_in_middle.NEW] and got.where(fill_in_middle.restored() != F.col("text")).count() == 0
    names = ("WORDS", "WORDS_THEN_SPACE", "LINES", "SENTENCES", "CHARACTERS")
    row = docs.select(*(fill_in_middle.units("text", getattr(fill_in_middle, n)).alias(n) for n in names)).first()
    assert all("".join(row[n]) == text for n in names)
    assert row["LINES"] == ["One two.  Three!\n", "\n", " 😀 four\n"] and row["SENTENCES"] == ["One two.", "  Three!", "\n\n 😀 four\n"]
    assert row["CHARACTERS"] == list(text) and row["WORDS"] == ["One", " two.", "  Three!", "\n\n 😀", " four", "\n"]


def negatives(rows):
    some = [(i, g, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, v in {(i, g, v.tobytes()): (i, g, v) for i, g, v in some if i % 50 == 0}.values():
        scores = sorted((-int(v[: min(len(v), len(w))] @ w[: min(len(v), len(w))]), j, h) for j, h, w in some)
        for p, j, _ in [x for x in scores if x[2] == g and x[1] != i][:5]:
            near = [x for x in scores if x[2] != g and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_are_as_by_full_search(spark, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(0, 4)), (centre[i % 4] + rng.normal(size=6) * 0.4).round(1).tolist()) for i in range(400)]
    same = rows[7][2]
    rows += [(1000 + i, i % 3, same) for i in range(300)] + [(2000, 1, []), (2050, 2, []), (2100, 1, same[:2]), (2150, 1, same + [1.0])]
    rows += [(None, 1, same), (3000, None, same), (3050, 1, None), (3100, 1, [None, *same[1:]]), (3150, 1, [float("nan"), *same[1:]]), (3200, 1, [float("-inf"), *same[1:]])]
    rows += [rows[50], rows[51], rows[51]]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == negatives(rows)


def test_negatives_of_few_rows(spark):
    every = F.col("vec_id") % 50 == 0
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), every).count() == 0
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 2, [1.5, 9.0]), (3, 2, [3.0, 0.0]), (4, 2, [1e30, 0.0])]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), every).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 131072, 98304)]


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)) * 100
    centroids = x[:9]
    at = hard_negatives._nearest(x, centroids)
    radii = np.array([np.sqrt(((x[at == i] - centroids[i]) ** 2).sum(1)).max() for i in range(9)])
    below, above = hard_negatives.Bounds(centroids, radii)(x)
    scores = x @ x.T
    assert all((scores[:, at == i] <= above[:, [i]]).all() and (scores[:, at == i] >= below[:, [i]]).all() for i in range(9))
    scores = np.array([[5.0, 5, 9, 5, 1], [1, 1, 1, 1, 1]])
    row, score, ids = hard_negatives._best(scores, scores < 9, np.arange(1, 6), 2)
    assert sorted(zip(row.tolist(), score.tolist(), ids.tolist())) == [(0, 5, 1), (0, 5, 2), (1, 1, 1), (1, 1, 2)]
