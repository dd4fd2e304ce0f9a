"""Quality rules by weak supervision.

Each rule looks at one kind of evidence about a text and votes good (1) or bad (0), or abstains (2). Where a rule's lines
are is taken from the corpus: it votes good up to the inner fence beyond the quartiles of all documents that pass the
base rules (1.5 times their distance) and bad beyond the outer one (3 times). Kinds of evidence that show the same fault are
one rule (all about letters and symbols; repeats and repeated lines; capitals and exclamations). Two rules compare
a text with the whole corpus: how rare its words are in it, and how usual the pairs of its bytes are.

Which rules to trust is not fixed: expectation-maximisation over all documents' votes estimates how often each rule is
right on good and on bad documents, and a document is kept if the posterior probability that it is good is at
least 0.5. So no rule decides alone unless the others bear it out; labels are not used.

Work: one pass over the texts counts words (by bucket of a hash) and pairs of bytes, 2 * 65,536 numbers however many
documents; a second one measures the texts. What follows reads measures only: a histogram of each rule's levels (4,096 at
most), and the number of documents by pattern of votes (3**rules patterns at most). The driver gets these
tables of bounded size, and the fit covers all documents. Quartiles are exact on the levels, so that reruns agree.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, ddl, free, map_batches, quoted, session_defaults, texts, tick, with_columns, without, written
from .words import NOT_SPACE, hashed

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BAD, GOOD, ABSTAIN = 0, 1, 2
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_loud", "n_kinds",
    "n_bytes", "n_letter_bytes", "n_wordless", "n_glued", "n_ended", "n_function",
)
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    (
        "the of and to in is that it for on with as was be by at this from are or an not but they which you "
        "de la le les et des un une dans qui que pour pas sur au aux par ne ce est il du se plus son avec sont "
        "der die das und den von zu mit ist des dem nicht ein eine auf im auch sich als aus bei nach wird sind "
        "el en los las del con por para una lo su al como es y o si ya"
    ).encode().split()
)
#: Rules, and on which side of the usual they vote bad.
SIDES = {
    "characters": "low", "function_words": "low", "rare_words": "high", "word_length": "both", "sentences": "both", "variety": "both",
    "repetition": "high", "shouting": "high", "entropy": "both", "byte_pairs": "high", "lines": "low",
}
RULES = tuple(SIDES)
#: Fences in distances between the quartiles: good up to the first, bad beyond the second, abstention between.
GOOD_FENCE, BAD_FENCE = 1.5, 3.0
#: Levels of a rule: whole numbers below LEVELS; NONE where a text has nothing to measure. Quartiles closer than
#: LEAST_SPREAD (2 percent of a share, 0.2 of a letter or bit) count as that far apart.
LEVELS, NONE, LEAST_SPREAD = 4096, -1, 20
#: Buckets of words by hash. A word is rare if its bucket has less than an equal share of all words of the corpus.
BUCKETS = 1 << 16
#: Bytes of a text that are looked at in one go.
BLOCK = 1 << 20
#: EM starts with these: how often a rule's vote is right on bad documents (most have few faults, so that most rules
#: find them good) and on good ones, and the share of good documents. By these, one bad vote doesn't make a
#: document bad, and two do; what the rules' votes are worth from then on is up to the corpus.
START_RIGHT, START_GOOD = (0.25, 0.98), 0.8
#: The start counts for so many votes or documents in each round's estimates.
PSEUDO = 4.0
ROUNDS, SETTLED = 500, 1e-9

_WHITE = WHITESPACE.encode()
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_SYMBOL = np.array([chr(b) in SYMBOLS for b in range(256)])
#: Bits by byte: 1 for a letter (of ASCII, or any byte of another script), 2 for a symbol, 4 for what ends a sentence.
_FLAGS = (_LETTER + 2 * _SYMBOL + 4 * np.isin(np.arange(256), list(b".!?"))).astype(np.uint8)
_INSIDE = ~np.isin(np.arange(256), list(_WHITE))


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text; all are 0 for an empty one.

    Words are runs of characters other than the six of ASCII white space. n_lines: lines with a word.
    n_loud: exclamation marks. n_kinds: different words. n_bytes, n_letter_bytes: in words, and letters of them.
    n_wordless: words without a letter; n_glued: with a letter and a symbol; n_ended: that end a sentence;
    n_function: that are a function word.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = np.zeros(len(words), bool)
        at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        for k in range(3):
            covered[k : len(words) - 2 + k] |= at
        repeated = int(covered.sum())
    upper, lower = _cases(text, raw)
    return (
        len(words), len(text) - sum(map(text.count, WHITESPACE)), sum(map(raw.count, map(str.encode, SYMBOLS))), len(lines) - len(set(lines)), repeated,
        len(lines), upper, upper + lower, raw.count(b"!"), len(set(words)), *_words(raw), sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())),
    )


def _words(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_bytes to n_ended of MEASURES, from each byte's flags and those of each word."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.take(_INSIDE, data, out=inside[1:-1])
    flags = np.take(_FLAGS, data)
    starts, last = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
    if not len(starts):
        return 0, 0, 0, 0, 0
    own = np.bincount(np.bitwise_or.reduceat(flags, starts) & 3, minlength=4)
    return int(np.count_nonzero(inside)), int(np.count_nonzero(flags & 1)), int(own[0] + own[2]), int(own[3]), int(np.count_nonzero(flags[last] & 4))


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def _cases(text: str, raw: bytes) -> tuple[int, int]:
    """Upper- and lower-case letters among A-Z and a-z; scripts without them leave the rule to abstain."""
    return len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))


@dataclass(frozen=True)
class Corpus:
    """What the whole corpus says: which buckets' words are rare, and what each pair of bytes (first * 256 + second) costs in hundredths of a bit."""

    rare: np.ndarray
    cost: np.ndarray

    @staticmethod
    def of(words: np.ndarray, pairs: np.ndarray) -> Corpus:
        """From the number of words by bucket and of pairs of bytes. A pair costs what it tells after its first byte, each count taken as one more."""
        more = pairs.reshape(256, 256).astype(np.float64) + 1
        cost = np.rint(-100 * np.log2(more / more.sum(axis=1, keepdims=True))).astype(np.int64)
        return Corpus(words * BUCKETS < words.sum(), cost.ravel())


def _pairs(raw: bytes):
    """The pairs of neighbouring bytes, by blocks."""
    data = np.frombuffer(raw, np.uint8)
    for a in range(0, len(data) - 1, BLOCK):
        block = data[a : a + BLOCK + 1].astype(np.uint16)
        yield block[:-1] << np.uint16(8) | block[1:]


def levels(batch: list[str], m: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Each rule's level (texts x rules) for texts and their MEASURES."""
    by = {name: m[:, i].astype(np.float64) for i, name in enumerate(MEASURES)}
    hashes, owner = hashed(batch, NOT_SPACE)
    rare = np.bincount(owner, weights=corpus.rare[(hashes >> np.uint64(48)).astype(np.int64)], minlength=len(batch))
    entropy, cost = np.zeros(len(batch)), np.zeros(len(batch))
    for i, text in enumerate(batch):
        raw = text.encode("utf-8", "surrogatepass")
        n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n = n[n > 0]
        entropy[i] = np.log2(len(raw)) - (n * np.log2(n)).sum() / len(raw) if raw else 0
        cost[i] = sum(int(corpus.cost[p].sum()) for p in _pairs(raw)) / max(len(raw) - 1, 1)
    words, some = by["n_words"], by["n_words"] > 0
    n = np.maximum(words, 1)
    letters = by["n_letters"] + by["n_loud"]
    found = {
        "characters": (1000 * by["n_letter_bytes"] / np.maximum(by["n_bytes"], 1), some), "function_words": (1000 * by["n_function"] / n, some),
        "rare_words": (1000 * rare / n, some), "word_length": (100 * by["word_chars"] / n, some), "sentences": (1000 * by["n_ended"] / n, some),
        "variety": (100 * by["n_kinds"] / n**0.8, some), "repetition": (1000 * np.maximum(by["n_repeat_words"] / n, by["n_dup_lines"] / np.maximum(by["n_lines"], 1)), some),
        "shouting": (1000 * (by["n_upper"] + by["n_loud"]) / np.maximum(letters, 1), letters > 0), "entropy": (100 * entropy, some),
        "byte_pairs": (cost, some), "lines": (100 * np.log2(1 + words / np.maximum(by["n_lines"], 1)), some),
    }
    return np.stack([np.where(ok, np.clip(np.floor(x), 0, LEVELS - 1), NONE) for x, ok in (found[r] for r in RULES)], axis=1).astype(np.int64)


def quartiles(counts: dict[tuple[int, int], int]) -> np.ndarray:
    """(rules x 2): the smallest level of each rule that a quarter of its documents don't exceed, and that three quarters don't; from counts by (rule, level). 0 without documents."""
    out = np.zeros((len(RULES), 2), np.int64)
    for r in range(len(RULES)):
        n = np.zeros(LEVELS, np.int64)
        for (rule, level), c in counts.items():
            if rule == r and level != NONE:
                n[level] += c
        if n.any():
            out[r] = [np.searchsorted(4 * np.cumsum(n), k * n.sum()) for k in (1, 3)]
    return out


def votes(level: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The rules' votes (rows x rules) on rows of levels, by the quartiles."""
    q1, q3 = lines[:, 0], lines[:, 1]
    low, high = (np.array([side != other for side in SIDES.values()]) for other in ("high", "low"))
    beyond = np.maximum(np.where(low, q1 - level, 0), np.where(high, level - q3, 0)) / np.maximum(q3 - q1, LEAST_SPREAD)
    said = np.where(beyond <= GOOD_FENCE, GOOD, np.where(beyond > BAD_FENCE, BAD, ABSTAIN))
    return np.where(level == NONE, ABSTAIN, said).astype(np.int64)


def base_failed(m: np.ndarray) -> np.ndarray:
    n, repeated = m[:, MEASURES.index("n_words")], m[:, MEASURES.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def pattern(v: np.ndarray) -> np.ndarray:
    """Rows of votes as one number each."""
    return v @ (3 ** np.arange(v.shape[1]))


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3


@dataclass(frozen=True)
class Model:
    """right[c, r]: how often a vote of rule r is right on documents of class c (0 bad, 1 good); good: their share; posterior: of good, by pattern of votes. lines and corpus, by which rules vote, are None if only votes are known."""

    right: np.ndarray
    good: float
    posterior: dict[int, float]
    lines: np.ndarray | None = None
    corpus: Corpus | None = None


def posteriors(v: np.ndarray, right: np.ndarray, good: float) -> np.ndarray:
    """The probability of good for rows of votes. A rule that abstains says nothing."""
    for_good = np.where(v == GOOD, np.log(right[GOOD]), np.where(v == BAD, np.log(1 - right[GOOD]), 0)).sum(axis=1) + np.log(good)
    for_bad = np.where(v == BAD, np.log(right[BAD]), np.where(v == GOOD, np.log(1 - right[BAD]), 0)).sum(axis=1) + np.log(1 - good)
    return 1 / (1 + np.exp(np.clip(for_bad - for_good, -700, 700)))


def estimate(patterns: dict[int, int], n_rules: int = len(RULES), rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation from the counts of all patterns of votes.

    Each round takes the posteriors by the accuracies so far, and then each rule's accuracies by those posteriors.
    A rule has two, one for each class, so that one which votes bad on many documents that all others find good
    turns out to be noisy, and its vote alone rejects nothing. The start counts for PSEUDO votes in every
    estimate, which keeps the classes from swapping and accuracies from 0 and 1, and no more: on a large corpus
    it has no weight. Rounds end when no posterior moves. No patterns: the start, and no posteriors.
    """
    keys = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[int(k)] for k in keys], np.float64)
    v = votes_of(keys, n_rules)
    right, good = np.repeat(np.array(START_RIGHT)[:, None], n_rules, axis=1), START_GOOD
    post = posteriors(v, right, good)
    for _ in range(rounds if len(keys) else 0):
        for c, w in ((BAD, (1 - post) * n), (GOOD, post * n)):
            agree, other = (w @ (v == x) for x in (c, 1 - c))
            right[c] = (agree + PSEUDO * START_RIGHT[c]) / (agree + other + PSEUDO)
        good = float((post @ n + PSEUDO * START_GOOD) / (n.sum() + PSEUDO))
        before, post = post, posteriors(v, right, good)
        if np.abs(post - before).max() < SETTLED:
            break
    return Model(right, good, {int(k): float(g) for k, g in zip(keys, post, strict=True)})


def _measured(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([measure(x) for x in texts(batch)], np.int64).reshape(-1, len(MEASURES))


def read_corpus(docs: DataFrame) -> Corpus:
    """Words by bucket and pairs of bytes of all documents. A task sends 2 * 65,536 counts at most, and so many come to the driver."""
    session_defaults(docs.sparkSession)

    def count(batches):
        n = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            found = texts(batch)
            hashes, _ = hashed(found, NOT_SPACE)
            n[:BUCKETS] += np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            for text in found:
                for p in _pairs(text.encode("utf-8", "surrogatepass")):
                    # a short text has few pairs: no table of all is made for it
                    if len(p) < BUCKETS // 8:
                        np.add.at(n, BUCKETS + p.astype(np.int64), 1)
                    else:
                        n[BUCKETS:] += np.bincount(p, minlength=BUCKETS)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(2 * BUCKETS, np.int64)
    n[[r["at"] for r in rows]] = [r["n"] for r in rows]
    return Corpus.of(n[:BUCKETS], n[BUCKETS:])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measures(docs: DataFrame, corpus: Corpus, *own: str) -> DataFrame:
    """BASE, base_failed and the rules' levels of each document, and the columns own of docs."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _measured(batch)
        found = {x: pa.array(m[:, MEASURES.index(x)]) for x in BASE} | {"base_failed": pa.array(base_failed(m))}
        level = pa.array(list(levels(texts(batch), m, corpus)), pa.list_(pa.int64()))
        return with_columns(batch.select(list(own)), **found, levels=level)

    slim = docs.select(*own)
    return map_batches(docs.select(*own, "text"), step, ddl(slim, ", ".join(f"{x} bigint" for x in BASE) + ", base_failed boolean, levels array<bigint>"))


def _fit(measured: DataFrame, corpus: Corpus) -> Model:
    """The model of all documents of measured (a written table) that pass the base rules."""
    passed = measured.where("not base_failed").select("levels")
    counts = passed.select(F.posexplode("levels").alias("rule", "level")).groupBy("rule", "level").agg(F.count("*").alias("n")).collect()
    lines = quartiles({(r["rule"], r["level"]): r["n"] for r in counts})

    def patterns(batches):
        total: Counter[int] = Counter()
        for batch in batches:
            total.update(pattern(votes(_levels(batch), lines)).tolist())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["pattern", "n"])

    rows = passed.mapInArrow(patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = estimate({r["pattern"]: r["n"] for r in rows})
    return replace(found, lines=lines, corpus=corpus)


def _levels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("levels").flatten().to_numpy().reshape(-1, len(RULES))


def fit(docs: DataFrame) -> Model:
    """The model of all documents that pass the base rules."""
    scratch, corpus = Scratch(docs.sparkSession), read_corpus(docs)
    model = _fit(scratch.written(_measures(docs, corpus), "quality-measures"), corpus)
    scratch.clear()
    return model


def _posterior(level: np.ndarray, failed: np.ndarray, model: Model) -> np.ndarray:
    """The probability of good of documents with these levels; 0 if the base rules reject them."""
    own = pattern(votes(level, model.lines))
    # documents that the model wasn't fitted on may have a pattern of their own
    new = np.array(sorted(set(own.tolist()) - model.posterior.keys()), np.int64)
    model.posterior.update(zip(new.tolist(), posteriors(votes_of(new, len(RULES)), model.right, model.good).tolist(), strict=True))
    return np.array([model.posterior[k] for k in own.tolist()]) * ~failed


NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def judge(docs: DataFrame, model: Model, **names: str) -> DataFrame:
    """docs with some of NEW after its own columns, each under the name given for it (or all, under their own).

    base_failed says that the base rules reject the document; posterior is 0 then; kept: posterior of 0.5 or more,
    and not base_failed. Null and empty texts have no words and fail. Repeated rows get equal results. Columns of
    docs that have one of the new names are replaced.
    """
    names = names or {x: x for x in NEW}
    kinds = dict.fromkeys(NEW, "bigint") | {"base_failed": "boolean", "posterior": "double", "kept": "boolean"}
    docs = without(docs, *names.values())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _measured(batch)
        failed = base_failed(m)
        p = _posterior(levels(texts(batch), m, model.corpus), failed, model)
        found = {name: m[:, i] for i, name in enumerate(MEASURES)} | {"base_failed": failed, "posterior": p, "kept": (p >= 0.5) & ~failed}
        return with_columns(batch, **{to: pa.array(found[x]) for x, to in names.items()})

    return map_batches(docs, step, ddl(docs, ", ".join(f"{tick(to)} {kinds[x]}" for x, to in names.items())))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, posterior and kept of every document. Texts are measured once; votes are of the written measures."""
    corpus = read_corpus(docs)
    measured = written(_measures(docs, corpus, "doc_id"), "quality-measures")
    model = _fit(measured, corpus)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        failed = np.array(batch.column("base_failed").to_pylist(), bool)
        p = _posterior(_levels(batch), failed, model)
        return with_columns(batch.drop_columns(["levels"]), posterior=pa.array(p), kept=pa.array((p >= 0.5) & ~failed))

    return map_batches(measured, step, ddl(measured.drop("levels"), "posterior double, kept boolean"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that assess() keeps, with their own columns, whatever their names."""
    (kept,) = free(docs, "kept")
    return judge(docs, fit(docs), kept=kept).where(tick(kept)).select(*quoted(docs))
