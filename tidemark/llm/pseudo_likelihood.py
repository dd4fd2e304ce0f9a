"""Scores of documents by masked pseudo-likelihood.

Each word is hidden in turn and predicted from the words on both its sides; a document's score is the sum of the
log-probabilities. Every word belongs to a leaf: the most frequent words have one each, the others share leaves by
their endings. The probability of a word has three factors: a network, trained in numpy, gives those of the leaf's
group and of the leaf within its group (a hierarchical softmax), and the corpus counts that of the word within its
leaf. The network sees the SIDE nearest words on either side, each by a table of its own, and the mean of a further
table over all BAG words on either side.

The counts are over all words of all documents, and every word is scored by its own count: those of the most
frequent words go to the tasks with the model, those of all others stay in a written table that the documents'
words are joined to. How many leaves and hidden units there are comes from the number of different words.

The network is trained on all words as well. Documents are dealt to shards of about SHARD_WORDS words by a hash of
doc_id and words, and ordered by it; so what a shard learns doesn't depend on partitions. The first shard alone
makes the start; from there each shard walks its own words by gradient descent (AdaGrad), and the shards' results are
averaged with their words as weights. Averages are taken of whole numbers, so that their order doesn't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, free, map_batches, quoted, session_defaults, with_columns, without, written

SIDE, BAG = 1, 8
#: Groups of leaves and hidden units at least, and words that are listed for each task at most.
GROUPS, HIDDEN, VOCABULARY = 24, 16, 50_000
#: Words of a step, of a shard, and of a task that walks shards, about.
STEP, SHARD_WORDS, TASK_WORDS = 4096, 1_000_000, 64_000_000
RATE, SMALL = 0.1, 1e-7
#: Fixed-point scale of weights that are averaged.
SCALE = 1 << 20


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def split(text: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The same words of all texts in a row, made by Arrow, and where each text's begin (with the end of the last). Null is empty."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, ""))))
    words, sizes = cut.flatten(), pc.list_value_length(cut).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)  # a text without words has one of no bytes
    if not pc.all(there).as_py():
        ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[np.cumsum(sizes)]
        return words.filter(there).cast(pa.binary()), np.concatenate([[0], ends])
    return words.cast(pa.binary()), np.concatenate([[0], np.cumsum(sizes)])


def n_groups_for(kinds: int) -> int:
    """Groups for a corpus of so many different words; there are as many leaves in each. Half of all leaves are frequent words."""
    return max(GROUPS, round(kinds**0.2))


def n_hidden_for(groups: int) -> int:
    return HIDDEN * groups // GROUPS


def shared_leaf(word: bytes, n_own: int, n_leaves: int) -> int:
    """The leaf of a word that has none of its own: by its last three bytes."""
    return n_own + zlib.crc32(word[-3:]) % (n_leaves - n_own)


@dataclass
class Lexicon:
    """Leaves and log-probabilities within the leaf of the listed words; for all others the logarithm of their leaf's total, with a minus, which that of their count is added to."""

    known: dict[bytes, tuple[int, float]]
    other: np.ndarray
    n_own: int
    groups: int

    @property
    def n_leaves(self) -> int:
        return self.groups * self.groups

    @cached_property
    def listed(self) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
        """The listed words, and their leaves and log-probabilities."""
        leaves, logs = zip(*self.known.values(), strict=True) if self.known else ((), ())
        return pa.array(list(self.known), pa.binary()), np.array(leaves, np.int64), np.array(logs, np.float64)

    def look_up(self, words: list[bytes] | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' leaves and log-probabilities, and whether they lack their count: those do that aren't listed, whose leaf is looked up once for each ending."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        kinds, own, own_logs = self.listed
        at = pc.index_in(words, value_set=kinds)
        lack = at.is_null().to_numpy(zero_copy_only=False)
        leaves, logs = np.zeros(len(words), np.int64), np.zeros(len(words))
        found = pc.drop_null(at).to_numpy()
        leaves[~lack], logs[~lack] = own[found], own_logs[found]
        ends = pc.binary_slice(words.filter(pa.array(lack)), -3).dictionary_encode()
        shared = np.array([shared_leaf(w, self.n_own, self.n_leaves) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        leaves[lack], logs[lack] = shared, self.other[shared]
        return leaves, logs, lack


def count_words(docs: DataFrame) -> DataFrame:
    """(word: binary, n) over all texts, added up in each task before the shuffle."""
    session_defaults(docs.sparkSession)

    def counts(batches):
        for batch in batches:
            total = split(batch.column("text"))[0].value_counts()
            if len(total):
                yield pa.RecordBatch.from_arrays([total.field("values"), total.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _least_listed(counted: DataFrame) -> int:
    """The smallest count with which a word is listed, such that at most VOCABULARY are; from a histogram of the counts, whose bars grow with the count."""
    bars = counted.groupBy(F.floor(F.log2("n") * 16).alias("bar")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).collect()
    bound, listed = (1 << 63) - 1, 0
    for r in sorted(bars, key=lambda r: -r["bar"]):
        listed += r["kinds"]
        if listed > VOCABULARY:
            break
        bound = r["least"]
    return bound


def fit_lexicon(counted: DataFrame) -> Lexicon:
    """From the counts of all words, as count_words() returns them. The driver gets VOCABULARY words at most, and one sum for each shared leaf."""
    groups = n_groups_for(counted.count())
    top = [(bytes(r["word"]), r["n"]) for r in counted.where(F.col("n") >= _least_listed(counted)).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    own, listed = top[: groups * groups // 2], top[groups * groups // 2 :]
    n_own, n_leaves = len(own), groups * groups
    spell = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % (n_leaves - n_own) + n_own
    total = np.zeros(n_leaves)
    for r in counted.groupBy(spell.cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():
        total[r["c"]] = r["n"]
    for word, n in own:
        total[shared_leaf(word, n_own, n_leaves)] -= n
    # a word that no document had counts as one more
    total += 1
    known = {w: (i, 0.0) for i, (w, _) in enumerate(own)} | {w: (c := shared_leaf(w, n_own, n_leaves), float(np.log(n / total[c]))) for w, n in listed}
    return Lexicon(known, -np.log(total), n_own, groups)


def encoded(docs: DataFrame, lexicon: Lexicon, leaves: str, total: str, lacking: str) -> DataFrame:
    """docs without their text, with each word's leaf (16 bits each), the sum of the words' log-probabilities within their leaves, and the words whose count that sum lacks."""
    session_defaults(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # VOCABULARY words at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ends = split(batch.column("text"))
        at, logs, lack = shared.value.look_up(words)
        short = at.astype("<u2")
        sums = np.add.reduceat(np.append(logs, 0.0), ends[:-1]) * (np.diff(ends) > 0)
        missing = np.concatenate([[0], np.cumsum(lack)])[ends]
        rest = pa.ListArray.from_arrays(pa.array(missing, pa.int32()), words.take(pa.array(np.flatnonzero(lack))))
        cells = [short[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return with_columns(batch.drop_columns(["text"]), **{leaves: pa.array(cells, pa.binary()), total: pa.array(sums), lacking: rest})

    return map_batches(docs, step, ddl(docs.drop("text"), f"`{leaves}` binary, `{total}` double, `{lacking}` array<binary>"))


@dataclass
class Network:
    """Logits of the groups, and of the leaves of each group: matrices times tanh(sum of one column per place, and of the mean of the bag)."""

    place: np.ndarray  # places and the bag x hidden x (leaves and one for outside)
    bias: np.ndarray  # hidden x 1
    group: np.ndarray  # groups x hidden
    group_bias: np.ndarray  # groups x 1
    leaf: np.ndarray  # groups x leaves of a group x hidden
    leaf_bias: np.ndarray  # groups x leaves of a group x 1

    @classmethod
    def start(cls, groups: int, seed: int = 1) -> Network:
        rng, hidden = np.random.default_rng(seed), n_hidden_for(groups)
        shapes = ((2 * SIDE + 1, hidden, groups * groups + 1), (groups, hidden), (groups, groups, hidden))
        place, group, leaf = (rng.normal(0, 0.1, x).astype(np.float32) for x in shapes)
        zeros = lambda *x: np.zeros(x, np.float32)
        return cls(place, zeros(hidden, 1), group, zeros(groups, 1), leaf, zeros(groups, groups, 1))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.place, self.bias, self.group, self.group_bias, self.leaf, self.leaf_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([x.size for x in self.parts()])[:-1]
        return Network(*(x.astype(np.float32).reshape(y.shape) for x, y in zip(np.split(flat, ends), self.parts(), strict=True)))

    def hidden(self, leaves: np.ndarray, around: Around) -> np.ndarray:
        """A column for each word."""
        bag = self.place[-1].take(leaves, axis=1)
        out = around.mean_of_others(bag)
        for p, near in enumerate(around.near):
            out += self.place[p].take(near, axis=1)
        out += self.bias
        return np.tanh(out, out=out)

    def log_probabilities(self, leaves: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of each word's leaf, given the words around it in its document; doc says where a document ends, and comes in order."""
        out = np.empty(len(leaves))
        for a in range(0, len(leaves), 2 * STEP):
            b = min(len(leaves), a + 2 * STEP)
            low, high = max(0, a - BAG), min(len(leaves), b + BAG)
            block = leaves[low:high]
            hidden = self.hidden(block, Around.of(block, doc[low:high], self.place.shape[2] - 1))
            out[a:b] = self._softmax(hidden[:, a - low : b - low], leaves[a:b], None)
        return out

    def _softmax(self, hidden: np.ndarray, leaves: np.ndarray, learner: Learner | None) -> np.ndarray:
        """The leaves' log-probabilities. A learner gets the gradients of the mean of these, with a minus: of the matrices, and of hidden, which they replace."""
        size, n, at = self.group.shape[0], len(leaves), np.arange(len(leaves))
        order = np.argsort((leaves // size).astype(np.int16), kind="stable")
        group, own = leaves[order] // size, leaves[order] % size
        sorted_ = hidden.take(order, axis=1)
        back = np.zeros_like(sorted_) if learner else None
        logs = _level(self.group, self.group_bias, sorted_, group, n, learner, back, learner and learner.group)
        ends = np.searchsorted(group, np.arange(size + 1)).tolist()
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a:
                logs[a:b] += _level(self.leaf[k], self.leaf_bias[k], sorted_[:, a:b], own[a:b], n, learner, back[:, a:b] if learner else None, learner and learner.leaf[k])
        place = np.empty(n, np.int64)
        place[order] = at
        if learner:
            back.take(place, axis=1, out=hidden)
        return logs[place]


def _level(matrix: np.ndarray, bias: np.ndarray, hidden: np.ndarray, own: np.ndarray, n: int, learner: Learner | None, back: np.ndarray | None, sums) -> np.ndarray:
    """Log-probabilities of one softmax. With a learner, back gets the gradient of hidden on top, and matrix and bias take a step."""
    at = np.arange(len(own))
    logits = matrix @ hidden
    logits += bias
    logits -= logits.max(axis=0)
    logs = logits[own, at].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    logs -= np.log(total)
    if learner:
        logits /= total
        logits[own, at] -= 1
        logits /= n
        back += matrix.T @ logits
        learner.step(matrix, sums[0], logits @ hidden.T)
        learner.step(bias, sums[1], logits.sum(axis=1, keepdims=True))
    return logs


@dataclass
class Around:
    """What surrounds each word of a block in its document: the nearest words' leaves, a row for each place (outside where there is none), and from where to where its bag reaches."""

    near: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, leaves: np.ndarray, doc: np.ndarray, outside: int) -> Around:
        n = len(leaves)
        near = np.full((2 * SIDE, n), outside, np.int64)
        for p, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            a, b = max(0, -shift), n - max(0, shift)
            if b > a:
                near[p, a:b] = np.where(doc[a + shift : b + shift] == doc[a:b], leaves[a + shift : b + shift], outside)
        at, new = np.arange(n), np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[new, n])
        first = np.repeat(new, sizes)
        return cls(near, np.maximum(at - BAG, first), np.minimum(at + BAG + 1, first + np.repeat(sizes, sizes)))

    def _others(self, columns: np.ndarray) -> np.ndarray:
        """The sum of the bag's columns for each word, without its own."""
        sums = np.zeros((columns.shape[0], columns.shape[1] + 1))
        np.cumsum(columns, axis=1, out=sums[:, 1:])
        out = (sums.take(self.high, axis=1) - sums.take(self.low, axis=1)).astype(np.float32)
        out -= columns
        return out

    def _share(self) -> np.ndarray:
        return (1 / np.maximum(self.high - self.low - 1, 1)).astype(np.float32)

    def mean_of_others(self, columns: np.ndarray) -> np.ndarray:
        return self._others(columns) * self._share()

    def mean_gradient(self, back: np.ndarray) -> np.ndarray:
        """The gradient of the columns of mean_of_others() from that of its result: who is in my bag has me in its own."""
        return self._others(back * self._share())


class Learner:
    """A network that walks words by AdaGrad: each weight's step shrinks with the sum of its squared gradients."""

    def __init__(self, network: Network):
        self.network = network
        place, self.bias, *rest = (np.full(x.shape, SMALL, np.float32) for x in network.parts())
        self.place, self.group, self.leaf = place, (rest[0], rest[1]), list(zip(rest[2], rest[3], strict=True))

    @staticmethod
    def step(weights: np.ndarray, sums: np.ndarray, gradient: np.ndarray) -> None:
        sums += gradient * gradient
        weights -= RATE * gradient / np.sqrt(sums)

    def _scatter(self, p: int, leaves: np.ndarray, back: np.ndarray) -> None:
        """A step of the columns that leaves name: their gradients are sums over the words that have them."""
        order = np.argsort(leaves.astype(np.int16), kind="stable")
        leaves = leaves[order]
        first = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
        columns, gradient = leaves[first], np.add.reduceat(back.take(order, axis=1), first, axis=1)
        sums = self.place[p][:, columns] + gradient * gradient
        self.place[p][:, columns] = sums
        self.network.place[p][:, columns] -= RATE * gradient / np.sqrt(sums)

    def train(self, leaves: np.ndarray, doc: np.ndarray) -> None:
        """One step on the mean negative log-probability of the leaves."""
        around = Around.of(leaves, doc, self.network.place.shape[2] - 1)
        hidden = self.network.hidden(leaves, around)
        back = hidden.copy()
        self.network._softmax(back, leaves, self)
        back *= 1 - hidden * hidden
        self.step(self.network.bias, self.bias, back.sum(axis=1, keepdims=True))
        for p, near in enumerate(around.near):
            self._scatter(p, near, back)
        self._scatter(2 * SIDE, leaves, around.mean_gradient(back))


def _walk(start: Network, shards: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, Network]]:
    """Words and resulting network of each shard; rows (shard, leaves) come in order of shard. Steps are of STEP words, whatever documents they are from."""
    learner, number, n_docs, held, size, words = None, None, 0, [], 0, 0

    def step():
        leaves, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        for a in range(0, len(leaves) - STEP + 1, STEP):
            learner.train(leaves[a : a + STEP], doc[a : a + STEP])
        rest = len(leaves) // STEP * STEP
        return leaves[rest:], doc[rest:]

    def end():
        leaves, doc = step()
        if len(leaves):
            learner.train(leaves, doc)
        return words, learner.network

    for shard, raw in shards:
        if shard != number:
            if learner is not None and held:
                yield end()
            learner, number, held, size, words = Learner(start.filled(start.flat())), shard, [], 0, 0
        leaves = np.frombuffer(raw, "<u2").astype(np.int64)
        if not len(leaves):
            continue
        held.append((leaves, np.full(len(leaves), n_docs)))
        n_docs += 1
        size += len(leaves)
        words += len(leaves)
        if size >= 16 * STEP:
            held = [step()]
            size = len(held[0][0])
    if learner is not None and held:
        yield end()


def _trained(shards: DataFrame, start: Network) -> Network:
    """The average of what the shards (shard, leaves; all of one in one partition, in order) make of the start, with their words as weights."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast(start)

    def walk(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("shard").to_pylist(), batch.column("leaves").to_pylist(), strict=True)

        total, n = 0, 0
        for words, network in _walk(shared.value, rows()):
            total = total + np.rint(network.flat().astype(np.float64) * SCALE).astype(np.int64) * words
            n += words
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["n", "weights"])

    parts = shards.mapInArrow(walk, "n bigint, weights array<bigint>").select("n", F.posexplode("weights").alias("i", "w"))
    sums = parts.groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()  # a row for each weight
    if not sums:
        return start
    found = np.zeros(len(sums))
    for r in sums:
        found[r["i"]] = float(r["w"] / r["n"]) / SCALE
    return start.filled(found)


def fit_network(rows: DataFrame, groups: int, leaves: str = "leaves") -> Network:
    """A network trained on every word of rows (doc_id, and leaves as encoded() gives them). The first shard makes the start for all."""
    spark = rows.sparkSession
    session_defaults(spark)
    words = rows.agg(F.sum(F.octet_length(f"`{leaves}`"))).first()[0] or 0
    words //= 2
    n_shards = max(1, -(-words // SHARD_WORDS))
    tasks = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_WORDS)))
    own = F.xxhash64("doc_id", f"`{leaves}`")
    dealt = rows.select(F.pmod(own, F.lit(n_shards)).alias("shard"), own.alias("turn"), F.col(f"`{leaves}`").alias("leaves"))
    ordered = lambda df, n: df.repartition(n, "shard").sortWithinPartitions("shard", "turn").select("shard", "leaves")
    start = _trained(ordered(dealt.where("shard = 0"), 1), Network.start(groups))
    return _trained(ordered(dealt, tasks), start)


def score(docs: DataFrame, counted: DataFrame, lexicon: Lexicon, network: Network) -> DataFrame:
    """docs without their text, with n_words, pseudo_loglik (the sum; 0 without words) and mean_loglik (null without words).

    Null text is empty. Equal texts get equal scores, up to rounding of the last digits, which are cut off. Columns of
    docs with one of the three names are replaced.
    """
    docs = without(docs, *NEW)
    leaves, total, lacking = free(docs, "leaves", "total", "lacking")
    return _scored(written(encoded(docs, lexicon, leaves, total, lacking), "lm-encoded"), counted, network, leaves, total, lacking)


NEW = ("n_words", "pseudo_loglik", "mean_loglik")


def _scored(rows: DataFrame, counted: DataFrame, network: Network, leaves: str, total: str, lacking: str) -> DataFrame:
    """Words that the lexicon doesn't list are joined to counted; the most frequent ones, which would make large keys, are listed. What the join adds to a document are whole numbers, so that their order doesn't matter."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    row, n, sum_, word, added = free(rows, "row", "n_words", "sum", "word", "added")
    own = [f"`{c}`" for c in rows.columns if c not in (leaves, total, lacking)]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = batch.column(leaves).to_pylist()
        size = np.array([len(x) // 2 for x in cells], np.int64)
        doc = np.repeat(np.arange(len(cells)), size)
        logs = shared.value.log_probabilities(np.frombuffer(b"".join(cells), "<u2").astype(np.int64), doc)
        found = np.bincount(doc, logs, minlength=len(cells)) + np.array(batch.column(total).to_pylist())
        return with_columns(batch.drop_columns([leaves, total]), **{n: pa.array(size), sum_: pa.array(found)})

    numbered = rows.withColumn(row, F.monotonically_increasing_id())
    parts = written(map_batches(numbered, step, ddl(numbered.drop(leaves, total), f"`{n}` bigint, `{sum_}` double")), "lm-parts")
    # a word that no document had counts as one more
    logs = F.coalesce(F.round(F.log("n") * SCALE).cast("bigint"), F.lit(0).cast("bigint"))
    words = parts.select(F.col(row).alias("row"), F.explode(lacking).alias("word"))
    sums = words.join(counted, "word", "left").groupBy("row").agg(F.sum(logs).alias("sum")).select(F.col("row").alias(row), F.col("sum").alias(added))
    found = parts.drop(lacking).join(sums, row, "left")
    whole = F.col(sum_) + F.coalesce(added, F.lit(0).cast("bigint")) / SCALE
    return found.select(*own, F.col(n).alias("n_words"), F.round(whole, 2).alias("pseudo_loglik"), F.when(F.col(n) > 0, F.round(whole / F.col(n), 4)).alias("mean_loglik"))


def pseudo_likelihoods(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, pseudo_loglik and mean_loglik of every document, by a model trained on docs.

    Rows of equal doc_id and text meet in one shard. An empty table gives no rows.
    """
    slim = docs.select("doc_id", "text")
    counted = written(count_words(slim), "lm-words")
    lexicon = fit_lexicon(counted)
    rows = written(encoded(slim, lexicon, "leaves", "total", "lacking"), "lm-encoded")
    return _scored(rows, counted, fit_network(rows, lexicon.groups), "leaves", "total", "lacking")
