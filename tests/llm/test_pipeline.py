"""The pipeline against slow versions of all its stages, one after the other."""

import hashlib
import math
import zlib
from collections import Counter
from functools import cache

import numpy as np

import corpus_pipeline
from tidemark.llm import lang_id, quality, vocab, word_bpe
from tidemark.llm.words import NOT_SPACE, hashed

SF = "/root/testdata/sf0.001"


def slow_levels(docs, passed):
    """The level of each rule for each document of passed, (document, measures), by the counts of all docs."""
    bucket = lambda w: int(hashed([w], NOT_SPACE)[0][0]) >> 48
    words, pairs, first = Counter(), Counter(), Counter()
    for d in docs:
        raw = (d["text"] or "").encode()
        words.update(bucket(w.decode()) for w in raw.lower().split())
        pairs.update(zip(raw, raw[1:]))
        first.update(raw[:-1])
    total, out = sum(words.values()), []
    for d, m in passed:
        raw, by = d["text"].encode(), dict(zip(quality.MEASURES, m, strict=True))
        n, letters = by["n_words"], by["n_letters"] + by["n_loud"]
        entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
        cost = sum(round(-100 * math.log2((pairs[p] + 1) / (first[p[0]] + 256))) for p in zip(raw, raw[1:])) / (len(raw) - 1)
        rare = sum(words[bucket(w.decode())] * quality.BUCKETS < total for w in raw.lower().split())
        found = [
            1000 * by["n_letter_bytes"] / by["n_bytes"], 1000 * by["n_function"] / n, 1000 * rare / n, 100 * by["word_chars"] / n, 1000 * by["n_ended"] / n, 100 * by["n_kinds"] / n**0.8,
            1000 * max(by["n_repeat_words"] / n, by["n_dup_lines"] / by["n_lines"]), 1000 * (by["n_upper"] + by["n_loud"]) / letters if letters else -1, 100 * entropy, cost, 100 * math.log2(1 + n / by["n_lines"]),
        ]
        out.append([min(math.floor(x), quality.LEVELS - 1) for x in found])
    return out


def slow_votes(docs, passed):
    levels, out = slow_levels(docs, passed), [[] for _ in passed]
    for r, side in enumerate(quality.SIDES.values()):
        own = sorted(x[r] for x in levels if x[r] != quality.NONE)
        q1, q3 = (own[math.ceil(k * len(own) / 4) - 1] for k in (1, 3)) if own else (0, 0)
        for x, row in zip(levels, out, strict=True):
            far = max(0, *([q1 - x[r]] if side != "high" else []), *([x[r] - q3] if side != "low" else [])) / max(q3 - q1, 20)
            row.append(quality.ABSTAIN if x[r] == quality.NONE else quality.GOOD if far <= 1.5 else quality.BAD if far > 3 else quality.ABSTAIN)
    return out


def good_by_slow_em(docs):
    """Documents that pass the base rules and whose posterior, by EM over one document after the other, is 0.5 or more."""
    measured = [(d, quality.measure(d["text"] or "")) for d in docs]
    passed = [(d, m) for d, m in measured if m[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    votes = slow_votes(docs, passed)
    right, share, post, n = [[x] * len(quality.RULES) for x in quality.START_RIGHT], quality.START_GOOD, [], len(quality.RULES)
    for _ in range(quality.ROUNDS):
        before, post = post, []
        for row in votes:
            odds = np.log([1 - share, share])
            for k, x in enumerate(row):
                if x != quality.ABSTAIN:
                    odds = odds + np.log([right[c][k] if x == c else 1 - right[c][k] for c in (0, 1)])
            post.append(float(1 / (1 + np.exp(np.clip(odds[0] - odds[1], -700, 700)))))
        if before and max(abs(a - b) for a, b in zip(before, post, strict=True)) < quality.SETTLED:
            break
        weights = [[1 - x for x in post], post]
        for c in (0, 1):
            for k in range(n):
                agree = sum(w for w, row in zip(weights[c], votes, strict=True) if row[k] == c)
                other = sum(w for w, row in zip(weights[c], votes, strict=True) if row[k] == 1 - c)
                right[c][k] = (agree + quality.PSEUDO * quality.START_RIGHT[c]) / (agree + other + quality.PSEUDO)
        share = (sum(post) + quality.PSEUDO * quality.START_GOOD) / (len(votes) + quality.PSEUDO)
    return [d for (d, _), p in zip(passed, post, strict=True) if p >= 0.5]


@cache
def letter(c):
    return lang_id.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint32))[0].astype(float)


def hypervector(text):
    points = " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""])
    out = np.zeros(lang_id.DIMENSIONS)
    for (x, y, z), n in Counter(zip(points, points[1:], points[2:], strict=False)).items():
        if {x, y, z} != {" "}:
            out += n * np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z)
    return out


def in_a_known_language(docs):
    vectors = [hypervector(d["text"]) for d in docs]
    sums = {}
    for d, v in zip(docs, vectors, strict=True):
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5:
            sums[d["lang"]] = sums.get(d["lang"], 0) + v
    cosine = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    return [d for d, v in zip(docs, vectors, strict=True) if v.any() and max((cosine(v, p) for p in sums.values()), default=0) >= corpus_pipeline.MIN_LANGUAGE_SCORE]


def one_of_each_group(docs):
    sets = {}
    for d in docs:
        w = d["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[d["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    return [d for d in docs if label[d["doc_id"]] == d["doc_id"]]


def copies_of_the_mix(docs):
    """How often each document is in the mix, to the nearest whole copy."""
    size = {d["doc_id"]: len(d["text"].split()) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), sum(total.values())
    while True:
        want = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if want[s] > 3 * total[s]}
        target |= {s: 3 * total[s] for s in full} if full else want
        if not full:
            break
        rest, open_ = rest - sum(3 * total[s] for s in full), open_ - full
        if not open_:
            break
    out = Counter()
    for s in sources:
        own = sorted((d["doc_id"] for d in docs if d["source"] == s), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16), i))
        whole, more = divmod(target[s], total[s])
        left = round(more)
        for i in own:
            part = max(0, min(size[i], left))
            left -= part
            out[i] = int(whole) + (part > 0 and 2 * part >= size[i])
    return out


def test_pipeline_is_as_slow_stages_in_a_row(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = one_of_each_group(in_a_known_language(good_by_slow_em(docs)))
    assert 0 < len(kept) < len(docs)
    library, copies, want = vocab.library(word_bpe.TOKENIZER), copies_of_the_mix(kept), Counter()
    for d in kept:
        if n := copies[d["doc_id"]]:
            want[d["doc_id"], tuple(library.encode(d["text"], add_special_tokens=False).ids)] += n
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_quality_is_as_by_slow_rules_and_em(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [r.asDict() for r in table.collect()]
    good = {d["doc_id"] for d in good_by_slow_em(docs)}
    assert {r["doc_id"] for r in quality.assess(table).where("kept").collect()} == good
    assert {r["doc_id"] for r in quality.keep_good(table).collect()} == good
