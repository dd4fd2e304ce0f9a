"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram's vector is the element-wise product of its
letters' vectors, the first rotated by two places and the second by one, so that order matters. A text's vector
is the sum of its trigrams' vectors; a language's prototype is the sum over the texts to learn from. The
prediction is the language whose prototype has the largest cosine with the text's vector.

Letters are Unicode letters in lower case; every run of other characters counts as one space, and a text has a
space at either end. Texts are taken in blocks of characters, so that memory doesn't grow with a batch or a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, ddl, held_out, map_batches, mix64, session_defaults, texts, with_columns, without

DIMENSIONS = 1024
UNKNOWN = "und"
MAX_LANGUAGES = 10_000
#: Documents of one matrix product, and trigrams of one block of it.
DOCS, TRIGRAMS = 128, 4096
#: Characters of a block; each takes about 100 bytes while its trigrams are counted.
BLOCK = 1 << 19


@cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 (int8) for each code point, always the same."""
    words = points.astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions // 64, dtype=np.uint64)
    bits = np.unpackbits(mix64(words).view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bound vectors (int8) of trigrams, given as rows of three code points."""
    seen, at = np.unique(points, return_inverse=True)
    at = at.reshape(points.shape)
    vectors = letter_vectors(seen, dimensions)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    return twice[at[:, 0]] * once[at[:, 1]] * vectors[at[:, 2]]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and for each value its number among them; values are small."""
    there = np.bincount(values, minlength=1) > 0
    return np.flatnonzero(there) if len(values) else np.zeros(0, np.int64), (np.cumsum(there) - 1)[values]


def trigram_counts(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram, count) for each trigram of each text, and the trigrams' code points.

    Empty texts, and texts with no letter, have none.
    """
    return _counted([f" {x.lower()} " for x in docs])


def _counted(spaced: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [code_points(x) for x in spaced]
    doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 0)
    first = np.ones(len(points), bool)
    first[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    points, doc = points[first], doc[first]
    seen, points = _numbered(points)
    bits = max(1, int(len(seen) - 1).bit_length())
    whole = doc[2:] == doc[:-2]
    a, b, c = points[:-2][whole], points[1:-1][whole], points[2:][whole]
    tri = ((a << (2 * bits)) | (b << bits) | c).astype(np.uint64)
    space = int(np.searchsorted(seen, 0)) if len(seen) and seen[0] == 0 else -1
    key = (doc[2:][whole].astype(np.uint64) << np.uint64(3 * bits)) | tri
    key = key[(a != space) | (b != space) | (c != space)]
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    count = np.diff(np.r_[at, len(key)])
    key = key[at]
    doc = (key >> np.uint64(3 * bits)).astype(np.int64)
    kinds, kind = np.unique(key & np.uint64((1 << (3 * bits)) - 1), return_inverse=True)
    mask = np.uint64((1 << bits) - 1)
    rows = np.stack([seen[((kinds >> np.uint64(s * bits)) & mask).astype(np.int64)] for s in (2, 1, 0)], axis=1) if len(kinds) else np.zeros((0, 3), np.uint32)
    return doc, kind, count, rows


def bundle(group: np.ndarray, kind: np.ndarray, count: np.ndarray, rows: np.ndarray, groups: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For each group, the sum of its trigrams' vectors times their counts; exact, as long as counts stay below 2**24."""
    out = np.zeros((groups, dimensions), np.float64)
    for start in range(0, len(rows), TRIGRAMS):
        vectors = trigram_vectors(rows[start : start + TRIGRAMS], dimensions).astype(np.float32)
        own = (kind >= start) & (kind < start + TRIGRAMS)
        x = np.bincount(group[own] * len(vectors) + kind[own] - start, count[own], groups * len(vectors))
        out += x.astype(np.float32).reshape(groups, len(vectors)) @ vectors
    return out


def _last_two(text: str) -> str:
    """The last two characters of a text whose runs of other characters than letters are one space each."""
    out = ""
    for c in reversed(text):
        c = c if c.isalpha() else " "
        if c != " " or out[:1] != " ":
            out = c + out
        if len(out) == 2:
            break
    return out


def _blocks(docs: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lower case and in pieces of BLOCK characters, about as many together, with their numbers. A piece begins with what the trigrams across its start need of the one before."""
    numbers, pieces, size = [], [], 0
    for i, x in enumerate(docs):
        text, before = f" {x.lower()} ", ""
        for a in range(0, len(text), BLOCK):
            piece = before + text[a : a + BLOCK]
            if pieces and size + len(piece) > BLOCK:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
            numbers.append(i)
            pieces.append(piece)
            size += len(piece)
            if a + BLOCK < len(text):
                before = _last_two(piece)
    if pieces:
        yield numbers, pieces


def profiles(docs: list[str], group: np.ndarray, groups: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """For each group, the sum of the vectors of its texts; and whether they have any trigram. group has the number of each text's group."""
    out, known = np.zeros((groups, dimensions)), np.zeros(groups, bool)
    for numbers, pieces in _blocks(docs):
        doc, kind, count, rows = _counted(pieces)
        own, at = np.unique(group[numbers], return_inverse=True)
        out[own] += bundle(at[doc], kind, count, rows, len(own), dimensions)
        known[own[at[doc]]] = True
    return out, known


def fit(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of all languages of docs (columns doc_id, text, lang).

    It learns from every document with a text and a lang, but for those that held_out() names. Sums are of
    integers, so that the order of rows doesn't matter. One vector per language comes to the driver; languages
    are a closed set, however many documents there are: more than MAX_LANGUAGES are an error. No rows to learn from:
    no prototypes.
    """
    spark = docs.sparkSession
    session_defaults(spark)

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs])
            for name, row in zip(names, profiles(texts(batch), at, len(names), dimensions)[0], strict=True):
                total[name] = total.get(name, 0) + row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([np.rint(x).astype(np.int64).tolist() for x in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    part = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(sums, "lang string, v array<bigint>")
    rows = part.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array([x["x"] for x in r["v"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict_texts(docs: list[str], prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """For each text, the most similar language and the cosine (0 if negative). Ties go to the first by code point.

    A text without a letter, or any text when there are no prototypes, is `und` with score 0.
    """
    names = list(prototypes)
    lang, score = [UNKNOWN] * len(docs), np.zeros(len(docs))
    if not names:
        return lang, score
    matrix = np.stack([prototypes[x] for x in names])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    for start in range(0, len(docs), DOCS):
        part = docs[start : start + DOCS]
        vectors, known = profiles(part, np.arange(len(part)), len(part), matrix.shape[1])
        cosines = np.round(vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), 9)
        best = cosines.argmax(axis=1)
        for i in np.flatnonzero(known):
            lang[start + i], score[start + i] = names[best[i]], min(1.0, max(0.0, cosines[i, best[i]]))
    return lang, score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs, with the predicted language and its score after its own columns; only `text` is read for it.

    Null text: `und`, score 0. Repeated rows get equal results. Columns of docs with one of the two names are replaced.
    """
    session_defaults(docs.sparkSession)
    docs = without(docs, lang, score)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = predict_texts(texts(batch), prototypes)
        return with_columns(batch, **{lang: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    return map_batches(docs, step, ddl(docs, f"`{lang}` string, `{score}` double"))


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by prototypes learned from docs itself."""
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(slim, fit(docs, dimensions)).drop("text")
