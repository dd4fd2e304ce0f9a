import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, lang_id, minmax_dedup, mixing, order_minhash, prefix_counts, pseudo_likelihood, quality, queries, sstable, vocab, warc, word_bpe
from tidemark.llm.common import fresh_folder
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix bright potions near old stone towers".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int, part string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, odd white space, and columns named like ours."""
    long = " ".join(WORDS * 400)
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, " \n\t ", "en", "b"), (5, "été  à la\tplage!! <|endoftext|>", "fr", "b"), (None, "no id here", "en", "c"), (None, None, None, None), (6, long[:-4] + "end", "en", "c"), (7, "???", "en", "a"), (8, "x" * 5000, "en", "a")]
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, "k", 1, "p") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "op1": lang_id.identify, "op2": lambda d: sstable.read_shards(sstable.write_shards(d)), "op3": minmax_dedup.near_duplicates, "op3 drop": minmax_dedup.drop_near_duplicates, "op4": order_minhash.fingerprints, "op5": quality.assess, "op5 keep": quality.keep_good,
    "op6": pseudo_likelihood.pseudo_likelihoods, "op7": lambda d: prefix_counts.count_tokens(d.select("doc_id", "text"), prefixes=True), "op9": mixing.mix, "op9 documents": mixing.mixed_documents, "op10": lambda d: word_bpe.encode(d.select("doc_id", "text"), outputs=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if " " not in n])
def test_odd_rows_all_come_back(odd, name):
    assert sorted(map(repr, [r["doc_id"] for r in OPERATORS[name](odd).collect()])) == sorted(map(repr, [r["doc_id"] for r in odd.collect()]))


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    got = {r["doc_id"]: r for r in lang_id.identify(odd).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 7))


def test_language_vectors_are_as_by_hand():
    text = "ab a"
    v = {c: lang_id.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(int) for c in " ab"}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    doc, kind, count, rows = lang_id.trigram_counts([text])
    assert (lang_id.bundle(doc, kind, count, rows, 1)[0] == want).all()


def test_language_is_as_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()

    def vector(text):
        points = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        points = " ".join(["", *points.split(), ""])
        out = np.zeros(lang_id.DIMENSIONS)
        for tri, n in Counter(zip(points, points[1:], points[2:])).items():
            if set(tri) != {" "}:
                x, y, z = (lang_id.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint32))[0].astype(float) for c in tri)
                out += n * np.roll(x, 2) * np.roll(y, 1) * z
        return out

    texts = [r["text"] or "" for r in rows][:60]
    small = spark.createDataFrame([(r["doc_id"], t, r["lang"]) for r, t in zip(rows, texts)], "doc_id bigint, text string, lang string")
    vectors = {r["doc_id"]: vector(t) for r, t in zip(rows, texts)}
    learn = {}
    for r, t in zip(rows, texts):
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            learn[r["lang"]] = learn.get(r["lang"], 0) + vectors[r["doc_id"]]
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    for r in lang_id.identify(small).collect():
        cosines = {k: float(unit(vectors[r["doc_id"]]) @ unit(p)) for k, p in sorted(learn.items())}
        best = max(cosines, key=cosines.get)
        if vectors[r["doc_id"]].any():
            assert r["lang_pred"] == best and r["score"] == pytest.approx(max(0, cosines[best]), abs=1e-6)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_equal_cosines_go_to_the_first_language():
    same = np.arange(1, lang_id.DIMENSIONS + 1, dtype=float)
    assert lang_id.predict_texts(["some text"], {"aa": same, "bb": same})[0] == ["aa"]


def test_shards_round_trip_and_look_up(spark, odd):
    docs = odd.where("doc_id is not null")
    manifest = sstable.write_shards(docs)
    library = vocab.library(sstable.TOKENIZER)
    start = 0
    rows = sstable.read_shards(manifest).orderBy("start").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, sstable.END]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shards = [sstable.Shard(m["path"]) for m in manifest.collect()]
    found = [x for x in (s.get(5) for s in shards) if x is not None]
    assert found[0].tolist()[:-1] == library.encode(texts[5], add_special_tokens=False).ids
    assert all(s.get(12345) is None for s in shards)


def _components_by_hand(rows, k, threshold):
    """(set size, component) of each doc_id, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_near_duplicates_are_as_by_brute_force(spark, k, threshold):
    rng = np.random.default_rng(k)
    base = [list(rng.choice(WORDS, 120)) for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > e else f"w{rng.integers(1000)}" for w in base[i % 6])) for i, e in enumerate(rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05], 150))]
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "two one"), (505, rows[0][1].upper())]
    want = _components_by_hand(rows, k, threshold)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minmax_dedup.near_duplicates(docs, k, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert sorted(r["doc_id"] for r in minmax_dedup.drop_near_duplicates(docs, k, threshold).collect()) == sorted({c for _, c in want.values()})


def test_large_buckets_of_alike_but_unlinked_texts(spark, monkeypatch):
    """Texts of one core and three of six passages each: nearly alike, but linked with their own edits only."""
    monkeypatch.setattr(common, "SLICE", 8)
    monkeypatch.setattr(minmax_dedup, "SLICE", 8)
    called, rarest = [], minmax_dedup._rarest
    monkeypatch.setattr(minmax_dedup, "_rarest", lambda *a: called.append(1) or rarest(*a))
    rng = np.random.default_rng(8)
    words = lambda name, n: [f"{name}{j}" for j in range(n)]
    core = words("core", 100)
    passages = [[words(f"p{slot}x{i}y", 13) for i in range(6)] for slot in range(3)]
    picks = rng.permutation(216)[:80]
    rows = [(i, core[:50] + passages[0][p % 6] + core[50:] + passages[1][p // 6 % 6] + passages[2][p // 36]) for i, p in enumerate(picks)]
    for i, w in rows[:80:4]:  # edits of every fourth
        at = int(rng.integers(len(w)))
        rows.append((1000 + i, [*w[:at], "edit", *w[at + 1 :]]))
    rows = [(i, " ".join(w)) for i, w in rows]
    want = _components_by_hand(rows, 3, 85)
    assert len({c for _, c in want.values()}) == 80
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert called
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_sets_that_are_alike_share_one_of_their_rarest_shingles(spark):
    rng = np.random.default_rng(4)
    core = rng.choice(500, (12, 40))
    sets = [set(rng.choice(core[i % 12], rng.integers(33, 40), replace=False).tolist()) | set(rng.integers(500, 5000, rng.integers(0, 6)).tolist()) for i in range(200)]
    count = Counter(t for x in sets for t in x)
    rows = [(str(i).encode(), len(x), sum(count[t] > 1 for t in x), t) for i, x in enumerate(sets) for t in x if count[t] > 1]
    tokens = spark.createDataFrame(rows, "node binary, n bigint, most bigint, token int")
    shared = spark.createDataFrame([(t, c) for t, c in count.items() if c > 1], "key int, size bigint")
    found = {}
    for r in minmax_dedup._rarest(tokens, shared, 80, common.Scratch(spark)).collect():
        found.setdefault(int(bytes(r["node"])), set()).add(r["token"])
    alike = [(i, j) for i in range(200) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(alike) > 20 and all(found[i] & found[j] for i, j in alike)
    assert sum(map(len, found.values())) < len(rows) / 2


def test_repeated_rows_leave_one(odd):
    left = minmax_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_components_of_a_chain(spark):
    links = spark.range(0, 40).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")).union(spark.createDataFrame([(100, 101)], "u bigint, v bigint"))
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_fingerprints_are_as_by_hand(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    rows.sort(reverse=True)
    want = {}
    for n, (i, t) in enumerate(rows):
        follow = rows[(n + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        prints = [order_minhash.fingerprint(x) for x in (t, changed, follow)]
        want[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[0].tobytes().hex(), prints[1].tobytes().hex(), float((prints[0] == prints[1]).mean()), float((prints[0] == prints[2]).mean()))
    got = order_minhash.fingerprints(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_sketches_are_as_by_a_slow_loop():
    rng = np.random.default_rng(1)
    for text in ["abcabcabcabc", "ab", "aaaaaaaaaa", "".join(rng.choice(list("abc "), 300))]:
        hashes, ids = order_minhash.kmers(text)
        k = min(order_minhash.K, len(text))
        grams = [text[i : i + k] for i in range(len(text) - k + 1)]
        assert len(hashes) == len(grams) and all((hashes[i] == hashes[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(0, i, 7))
        numbered = [(g, grams[:i].count(g)) for i, g in enumerate(grams)]
        assert len(set(ids.tolist())) == len(set(numbered))
        found = order_minhash.fingerprint(text)
        for sketch in range(0, order_minhash.SKETCHES, 5):
            own = [(int(x) ^ int(order_minhash._MASK[sketch])) * int(order_minhash._ODD[sketch]) & 0xFFFFFFFF for x in ids]
            places = sorted(sorted(range(len(own)), key=lambda i: (own[i], i))[: order_minhash.L])
            out = np.array([len(places)], np.uint64)
            with np.errstate(over="ignore"):
                for i in places:
                    out = order_minhash.mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i])
            assert found[sketch] == int(out[0]) >> 32


def test_fingerprint_feels_order():
    a, b = " ".join(WORDS * 20), " ".join([*WORDS[9:] * 20, *WORDS[:9] * 20])
    assert order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(a)) == 1
    assert order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)) < 0.6


def test_long_texts_are_numbered_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdé ☃"), 30_000)) + "abcabc" * 3000
    whole = order_minhash.kmers(text)
    for run in (1 << 10, 7001, len(text) - 6):
        monkeypatch.setattr(order_minhash, "RUN", run)
        assert all((x == y).all() for x, y in zip(order_minhash.kmers(text), whole, strict=True))
    monkeypatch.undo()
    long = text * 430
    tracemalloc.start()
    assert len(long) > 20_000_000 and order_minhash.fingerprint(long).any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 << 20


def test_quality_measures_are_as_by_hand(spark):
    for text in ["", "a b c", "a b c a b c x", "one two\none two\n\n three# |\none two", " ".join(WORDS * 5)]:
        words = text.split()
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert quality.measure(text)[:5] == (len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered))
        flags = (sum(len(w.encode()) for w in words), sum(c.isalpha() for c in text), sum(not any(c.isalpha() for c in w) for w in words), sum(any(c.isalpha() for c in w) and any(c in quality.SYMBOLS for c in w) for w in words), sum(w[-1] in ".!?" for w in words))
        assert quality.measure(text)[10:15] == flags
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = quality.assess(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95


def test_quality_votes_where_fences_are():
    lines = np.array([[100, 140]] * len(quality.RULES))
    level = np.repeat(np.array([[-1], [100 - 121], [100 - 120], [100 - 60], [100], [140 + 60], [140 + 61], [140 + 121]]), len(quality.RULES), axis=1)
    level[1] = np.maximum(level[1], 0)
    sides = list(quality.SIDES.values())
    got = quality.votes(level, lines).T
    assert all((v[0], v[4]) == (quality.ABSTAIN, quality.GOOD) for v in got)
    for v, side in zip(got, sides, strict=True):
        assert (v[7] == quality.BAD) == (side != "low") and (v[6] == quality.ABSTAIN) == (side != "low") and v[5] == v[3] == quality.GOOD
    close = quality.votes(np.array([[0] * len(sides), [61] * len(sides)]), np.zeros((len(sides), 2), int))
    assert (close[0] == quality.GOOD).all() and [v == quality.BAD for v in close[1]] == [side != "low" for side in sides]
    assert (quality.quartiles({}) == 0).all() and quality.quartiles({(0, 5): 1, (0, 7): 2, (0, 9): 1, (0, -1): 50})[0].tolist() == [5, 7]


def test_quality_is_more_than_all_rules_passed(spark):
    """Documents that one rule alone finds bad stay unless the corpus bears the rule out; labels measure only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = quality.read_corpus(docs)
    measured = quality._measures(docs, corpus, "doc_id").where("not base_failed").collect()
    model = quality.fit(docs)
    v = quality.votes(np.array([r["levels"] for r in measured]), model.lines)
    p = np.array([model.posterior[k] for k in quality.pattern(v).tolist()])
    strict = (v != quality.BAD).all(axis=1)
    assert ((p >= 0.5) & ~strict).sum() >= 10
    labels = {r["doc_id"]: bool(r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [(labels[r["doc_id"]], a >= 0.5, b) for r, a, b in zip(measured, p, strict, strict=True) if r["doc_id"] in labels]
    assert np.mean([a == k for k, a, _ in known]) >= np.mean([b == k for k, _, b in known])


def test_em_is_as_by_a_slow_version_and_knows_a_noisy_rule():
    rng = np.random.default_rng(5)
    good = rng.random(5000) < 0.9
    # how often each rule is right on bad and on good documents; the last one is noisy
    right = [(0.6, 0.97), (0.5, 0.98), (0.7, 0.99), (0.4, 0.99), (0.5, 0.97), (0.2, 0.8)]
    v = np.stack([np.where(rng.random(5000) < 0.2, quality.ABSTAIN, np.where(good, rng.random(5000) < g, rng.random(5000) >= b)) for b, g in right], axis=1).astype(int)
    model = quality.estimate(Counter(quality.pattern(v).tolist()), len(right))
    assert np.abs(model.right.T - right).max() < 0.08 and abs(model.good - 0.9) < 0.02
    p = np.array([model.posterior[k] for k in quality.pattern(v).tolist()])
    alone = (v[:, :5] != quality.BAD).all(axis=1) & (v[:, 5] == quality.BAD)
    assert alone.sum() > 300 and (p[alone] >= 0.5).all() and ((p >= 0.5) == good).mean() > 0.95
    few, r, share = v[:300].tolist(), [[quality.START_RIGHT[c]] * 6 for c in (0, 1)], quality.START_GOOD
    for _ in range(3):
        post = []
        for row in few:
            odds = [1 - share, share]
            for k, x in enumerate(row):
                if x != quality.ABSTAIN:
                    odds = [odds[c] * (r[c][k] if x == c else 1 - r[c][k]) for c in (0, 1)]
            post.append(odds[1] / sum(odds))
        weights = [[1 - x for x in post], post]
        r = [[(sum(w for w, row in zip(weights[c], few) if row[k] == c) + quality.PSEUDO * quality.START_RIGHT[c]) / (sum(w for w, row in zip(weights[c], few) if row[k] != quality.ABSTAIN) + quality.PSEUDO) for k in range(6)] for c in (0, 1)]
        share = (sum(post) + quality.PSEUDO * quality.START_GOOD) / (len(few) + quality.PSEUDO)
    found = quality.estimate(Counter(quality.pattern(v[:300]).tolist()), 6, rounds=3)
    assert np.allclose(found.right, r) and found.good == pytest.approx(share)
    assert quality.estimate({}).posterior == {}


def test_pseudo_likelihood_prefers_what_it_knows(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(WORDS * 5)) for i in range(60)] + [(100 + i, " ".join(rng.permutation(WORDS * 5))) for i in range(5)] + [(200, None)]
    got = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihoods(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0]["mean_loglik"] > max(got[100 + i]["mean_loglik"] for i in range(5))
    assert (got[200]["n_words"], got[200]["pseudo_loglik"], got[200]["mean_loglik"]) == (0, 0.0, None)


def test_pseudo_likelihood_scores_each_word_by_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "GROUPS", 5)
    rows = [(i, f"{' '.join(WORDS)} word{i % 40}ing other{i}ing") for i in range(300)] + [(1000, "rare7ing " * 7), (1001, "rare1ing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    run = lambda df: {r["doc_id"]: tuple(r) for r in pseudo_likelihood.pseudo_likelihoods(df).collect()}
    all_listed = run(docs)
    assert run(docs.repartition(7)) == all_listed
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 26)
    few_listed = run(docs)
    assert few_listed.keys() == all_listed.keys()
    assert all(few_listed[k][1] == v[1] and np.allclose(few_listed[k][2:], v[2:], atol=0.011) for k, v in all_listed.items())
    counted = pseudo_likelihood.count_words(docs)
    lexicon = pseudo_likelihood.fit_lexicon(counted)
    network = pseudo_likelihood.Network.start(lexicon.groups)
    pair = spark.createDataFrame([(1, "rare7ing"), (2, "rare1ing"), (3, "unseening")], "doc_id int, text string")
    got = {r["doc_id"]: r["mean_loglik"] for r in pseudo_likelihood.score(pair, counted, lexicon, network).collect()}
    assert got[1] - got[2] == pytest.approx(np.log(7), abs=2e-4) and got[3] == got[2]


def test_pseudo_likelihood_model_grows_with_the_corpus():
    assert [pseudo_likelihood.n_groups_for(n) for n in (0, 1000, 10**7, 10**10)] == [24, 24, 25, 100]
    assert pseudo_likelihood.Network.start(24).bias.size == 16 and pseudo_likelihood.Network.start(48).bias.size == 32


def _slow_log_probabilities(net, leaves, doc):
    size, out = net.group.shape[0], []
    for i, leaf in enumerate(leaves):
        own = [j for j in range(len(leaves)) if doc[j] == doc[i]]
        h = net.bias[:, 0].astype(float).copy()
        for p, j in enumerate((i - 1, i + 1)):
            h += net.place[p][:, leaves[j] if j in own else size * size]
        others = [j for j in own if j != i and abs(j - i) <= pseudo_likelihood.BAG]
        if others:
            h += np.mean([net.place[2][:, leaves[j]] for j in others], axis=0)
        h = np.tanh(h)
        total = 0
        for matrix, bias, at in ((net.group, net.group_bias, leaf // size), (net.leaf[leaf // size], net.leaf_bias[leaf // size], leaf % size)):
            logits = matrix @ h + bias[:, 0]
            total += logits[at] - np.log(np.exp(logits).sum())
        out.append(total)
    return np.array(out)


def test_network_is_as_by_a_slow_loop():
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network.start(3, seed=2)
    net = net.filled(rng.normal(0, 0.5, net.flat().size))
    leaves, doc = rng.integers(0, 9, 40), np.repeat([0, 1, 2, 3], [20, 1, 2, 17])
    assert np.allclose(net.log_probabilities(leaves, doc), _slow_log_probabilities(net, leaves, doc), atol=1e-4)
    # probabilities of all leaves at one place add up to 1
    every = [_slow_log_probabilities(net, np.r_[leaves[:5], x, leaves[6:]], doc)[5] for x in range(9)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    # AdaGrad's first step is the rate times the gradient's sign, so that the sums of squares show the gradient
    learner = pseudo_likelihood.Learner(net.filled(net.flat()))
    learner.train(leaves, doc)
    sums = np.concatenate([x.ravel() for x in (learner.place, learner.bias, learner.group[0], learner.group[1], np.stack([x for x, _ in learner.leaf]), np.stack([x for _, x in learner.leaf]))])
    sign = np.sign(net.flat() - learner.network.flat())
    for k in rng.choice(np.flatnonzero(sums > 1e-6), 40, replace=False):
        moved = []
        for d in (1e-3, -1e-3):
            flat = net.flat().astype(float)
            flat[k] += d
            moved.append(-_slow_log_probabilities(net.filled(flat), leaves, doc).mean())
        assert sign[k] * np.sqrt(sums[k] - pseudo_likelihood.SMALL) == pytest.approx((moved[0] - moved[1]) / 2e-3, abs=2e-3)


ODD_TEXTS = ["", "a", "it's they're ", "a  b\n\n c\t\td", "日本 語!! 'll 12 3", "  x \x1cy", "<|endoftext|>x<|endof", "ΑΣ İ é ﬁ aaaaaaa", "naïve\r\n  café'v"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_counts_at_every_prefix_are_the_librarys(text):
    library = vocab.library(prefix_counts.TOKENIZER)
    n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    found = prefix_counts.PrefixTable(text)
    assert [found.at(i) for i in range(len(text) + 1)] == [n(text[:i]) for i in range(len(text) + 1)]
    assert n(text[: found.fitting(3)]) <= 3
    assert np.frombuffer(vocab.UnitEncoder(prefix_counts.TOKENIZER).encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_bpe_is_the_librarys(spark):
    library = vocab.library(word_bpe.TOKENIZER)
    texts = [*ODD_TEXTS, *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect())]
    rows = word_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), outputs=True).collect()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bundles(spark):
    big = "é" * 80
    rows = [(5, "http://x/\r\ny", big), (3, None, big), (9, "u", "small"), (2, "u", "small"), (7, "u", None), (3, None, big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_bundles(pages)
    got = sorted((tuple(r) for r in warc.read_bundles(manifest).collect()), key=repr)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(5, 160, digest(big), "revisit", 3), (3, 160, digest(big), "response", None), (9, 5, digest("small"), "response", None), (2, 5, digest("small"), "response", None), (7, 0, digest(""), "response", None), (3, 160, digest(big), "response", None), (None, 160, digest(big), "revisit", 3)]
    assert got == sorted(want, key=repr)
    found = [x for x in (warc.Bundle(m["path"]).get(9) for m in manifest.collect()) if x]
    headers, block = found[0]
    assert warc.payload(block) == b"small" and block.startswith(b"HTTP/1.1 200 OK\r\n") and headers["Content-Type"] == "application/http;msgtype=response"
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["WARC-Record-ID"])
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_bundles_with_a_frequent_payload_and_look_up(spark):
    """One payload in half of the rows, pairs of equal ones, short ones and single ones; every record is found by its identifier."""
    text = lambda i: "x" * 200 if i % 2 else f"pair {i // 8} " * 30 if i % 8 < 4 else f"s{i}" if i % 3 else f"single {i} " * 20
    pages = spark.createDataFrame([(7 * i - 900, "u", text(i)) for i in range(4000)], "page_id bigint, url string, html string").repartition(5)
    manifest = warc.write_bundles(pages)
    first: dict[str, int] = {}
    for i in range(4000):
        first.setdefault(text(i), 7 * i - 900)
    want = {}
    for i in range(4000):
        page, t = 7 * i - 900, text(i)
        revisit = len(t) >= 100 and first[t] != page
        want[page] = ("revisit" if revisit else "response", first[t] if revisit else None)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_bundles(manifest).collect()} == want
    bundles = [warc.Bundle(m["path"]) for m in manifest.collect()]
    for i in range(0, 4000, 37):
        page, t = 7 * i - 900, text(i)
        found = [x for x in (b.get(page) for b in bundles) if x]
        assert len(found) == 1 and found[0][0]["X-Page-ID"] == str(page)
        assert warc.payload(found[0][1]).decode() == ("" if want[page][0] == "revisit" else t)
    assert not any(b.get(p) for b in bundles for p in (-901, 1, 10**12, None))


def test_mix_meets_its_targets(spark, odd):
    assert mixing.targets([10, 10, 0, 1000], [5, 2, 1, 5]) == [30.0, 30.0, 0.0, 960.0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    # whole documents: as many copies as taken says, to the nearest
    copies = Counter(r["doc_id"] for r in out.collect())
    assert copies == {r["doc_id"]: n for r in rows if r["size"] and (n := r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"]))}
    assert out.exceptAll(docs.crossJoin(docs.sparkSession.range(3)).drop("id")).count() == 0


def test_mix_comes_in_the_order_of_its_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    place = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16)
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(rows) == len(texts)
    names = sorted({r["source"] for r in texts.values()}, key=lambda x: (x is None, (x or "").encode()))
    want = {}
    for k, name in enumerate(names):
        before, slope = 0, (-0.5, 0.5, 0.0)[k % 3]
        for i in sorted((i for i, r in texts.items() if r["source"] == name), key=lambda i: (place(i), i)):
            if rows[i]["taken"] > 0:
                # halve until the integral of the weight over training so far is what stands before the document
                low, high = 0.0, 1.0
                for _ in range(60):
                    t = (low + high) / 2
                    low, high = (t, high) if rows[i]["target"] * ((1 - slope) * t + slope * t * t) < before else (low, t)
                want[i] = low
            before += rows[i]["size"]
    assert {i for i, r in rows.items() if r["position"] is not None} == want.keys()
    assert all(abs(rows[i]["position"] - x) < 1e-8 for i, x in want.items())
    ids = [r["doc_id"] for r in queries.op9_source_mix(spark, SF).collect()]
    assert sorted(ids) == sorted(texts)
    assert ids[: len(want)] == sorted(want, key=lambda i: (rows[i]["position"], place(i), i))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, got = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, got.fetchall()))


def test_pipeline_stages_keep_their_promises(spark, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).columns == odd.columns
    rows = corpus_pipeline.run(spark, SF)
    assert 0 < rows.count() and {"doc_id", "ids"} <= set(rows.columns)


def test_shared_folder_is_the_sessions(spark):
    assert fresh_folder(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:")


@pytest.mark.parametrize(("own", "other", "common"), [(0, 0, 300), (5, 7, 300), (400, 90, 20), (5000, 5000, 5000), (1, 1, 0)])
def test_parity_bitmaps_never_tell_sets_further_apart_than_they_are(own, other, common):
    draws = np.random.default_rng(own + common).integers(0, 2**64, own + other + common, dtype=np.uint64)
    a, b = np.unique(draws[: own + common]), np.unique(draws[own:])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["node", "own"])
    maps = minmax_dedup._parities(batch)
    apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in (maps.column(c).to_pylist() for c in minmax_dedup.PARITY))
    assert apart <= own + other and (apart > 0) == (own + other > 0)


@pytest.mark.parametrize("frequent", [10**9, 1])
def test_revisits_are_the_same_when_payloads_are_dealt_to_slices(spark, monkeypatch, frequent):
    """By slices (more than 3 rows of a payload) and, with FREQUENT so large that all are broadcast, without."""
    monkeypatch.setattr(common, "SLICE", 3)
    monkeypatch.setattr(warc, "FREQUENT", frequent)
    body = lambda i: f"<p>{i}</p>" * 30
    rows = [(i, f"u{i}", body("hot" if i % 3 else i % 10)) for i in range(1, 101)] + [(None, "x", body("hot")), (200, "y", "short"), (201, "z", "short"), (202, "n", None)]
    firsts = {}
    for i, _, h in rows:
        if i is not None and len(h or "") >= 100:
            firsts[h] = min(firsts.get(h, i), i)
    want = sorted(((i, firsts[h] if h in firsts and firsts[h] != i else None) for i, _, h in rows), key=repr)
    found = warc.read_bundles(warc.write_bundles(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4))).collect()
    assert sorted(((r["page_id"], r["refers_to"]) for r in found), key=repr) == want


CLASHES = ("target", "source_size", "taken", "n_tokens", "ids", "kept", "posterior", "dedup_node", "lang_pred", "score", "n_words", "lm_sum", "total", "row", "word", "mix_row", "mix_size", "mix_copy", "mix_position", "size", "node", "gone_id", "slice", "key")


@pytest.mark.parametrize("name", ["keep_good", "drop_near_duplicates", "mixed_documents", "language", "encode", "count", "score", "judge"])
def test_columns_may_have_the_operators_names(odd, name):
    docs = odd.select("doc_id", "text", "lang", "source", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    filters = {"keep_good": quality.keep_good, "drop_near_duplicates": minmax_dedup.drop_near_duplicates, "mixed_documents": mixing.mixed_documents}
    if name in filters:
        found, new = filters[name](docs), ()
    elif name == "score":
        counted = pseudo_likelihood.count_words(docs)
        lexicon = pseudo_likelihood.fit_lexicon(counted)
        found, new = pseudo_likelihood.score(docs, counted, lexicon, pseudo_likelihood.Network.start(lexicon.groups)), pseudo_likelihood.NEW
    else:
        run, new = {"language": (lambda d: lang_id.predict(d, lang_id.fit(d)), ("lang_pred", "score")), "encode": (lambda d: word_bpe.encode(d, outputs=True), ("n_tokens", "ids", "decoded")), "count": (prefix_counts.count_tokens, ("n_tokens",)), "judge": (lambda d: quality.judge(d, quality.fit(d)), quality.NEW)}[name]
        found = run(docs)
    rows = found.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in new)
    assert not any(r[c] == f"own {c}" for r in rows for c in CLASHES if c in new)
    if name in filters:
        assert found.columns == docs.columns
    else:
        assert len(rows) == odd.count()


@pytest.mark.parametrize("name", ["keep_good", "drop_near_duplicates", "mixed_documents", "language", "encode", "count"])
def test_names_of_any_kind_and_nested_fields(odd, name):
    docs = odd.select("doc_id", "text", "lang", "source", F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d")).alias("st ruct"), F.lit("own").alias("back`tick"), F.lit(2).alias("do.t"))
    run = {
        "keep_good": quality.keep_good, "drop_near_duplicates": minmax_dedup.drop_near_duplicates, "mixed_documents": mixing.mixed_documents, "language": lambda d: lang_id.predict(d, lang_id.fit(d)),
        "encode": word_bpe.encode, "count": prefix_counts.count_tokens,
    }[name]
    found = run(docs)
    rows = found.collect()
    assert found.columns[: len(docs.columns)] == docs.columns and (rows or name == "keep_good")  # the base rules reject all of them
    assert all(r["back`tick"] == "own" and r["do.t"] == 2 and tuple(r["st ruct"]) == (1, "x") for r in rows)


def test_text_of_20_megabytes():
    text = " ".join(f"word{i}" for i in range(1_800_000)) + "x" * 1_000_000
    assert len(text) > 20_000_000
    assert quality.measure(text)[0] == 1_800_000
    own = minmax_dedup.shingles(text, 5)
    assert len(own) == 1_800_000 - 4 and len(minmax_dedup.band_keys(own, 5)) == 20
    bpe = word_bpe.word_bpe(word_bpe.public_tokenizers.path(word_bpe.TOKENIZER))
    bpe.encode([text])
    assert bpe.held > word_bpe.TABLE_CHARS
    assert bpe.decode_joined(bpe.encode(["a b"])[0]) == "a</w> b</w>" and bpe.held < 10
