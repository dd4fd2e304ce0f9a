"""Byte-pair encoding and decoding for vocabularies with word ends, by batched merge rounds in numpy.

The symbols of many words lie in one flat array. In a round, every neighbouring pair's rank is found by binary
search over the sorted keys of all merges; in each word the pair of lowest rank is merged wherever it stands,
from left to right. Words without a pair left to merge drop out of the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ddl, map_batches, texts, with_columns, without
from .prefix_counts import byte_letters

TOKENIZER = "word_bpe_49k.json"
#: How the tokenizer cuts normalised text into words, and its word end (fixed values).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
#: White-space runs that a worker's table may hold, and characters in them; it starts anew beyond that.
TABLE, TABLE_CHARS = 350_000, 16 << 20
#: These count as white space for Python's split(), but not for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (so that a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.tokens = [""] * (max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"])) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        #: The decimal ids of white-space-free runs of text, joined by spaces.
        self.known: dict[str, str] = {}
        self.held = 0
        self.token_of = {str(i): x for i, x in enumerate(self.tokens)}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin (with the end of the last)."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inside[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.into)
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.ranks[at], none), none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.r_[starts, len(symbols)]))
            ended = low == none
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
                symbols, word, rank, low = symbols[~ended], word[~ended], rank[~ended], low[~ended]
                if not len(symbols):
                    break
            hit = rank == low
            # of hits in a row (as in aaaa), the first, third, ... merge
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            symbols[hit] = self.into[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~hit[:-1]
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def _learn(self, runs: list[str]) -> None:
        """Puts the ids of white-space-free runs of text into the table."""
        words = [PATTERN.findall(x) for x in runs]
        kinds = list({w for x in words for w in x})
        ids, at = self.encode_words(kinds)
        ids, at = ids.tolist(), at.tolist()
        own = {w: ids[at[k] : at[k + 1]] for k, w in enumerate(kinds)}
        for run, parts in zip(runs, words, strict=True):
            self.known[run] = " ".join([str(i) for w in parts for i in own[w]])
            self.held += len(run)

    def forget(self) -> None:
        """Empties the table."""
        self.known.clear()
        self.held = 0

    def encode(self, docs: list[str]) -> list[str]:
        """For each text, its decimal ids, joined by one space."""
        parts = [[x] if not any(s in x for s in self.special) else self.split_special.split(x) for x in docs]
        runs = [[p if k % 2 else self._runs(p) for k, p in enumerate(x)] for x in parts]
        if len(self.known) > TABLE or self.held > TABLE_CHARS:
            self.forget()
        new = set().union(*(r for x in runs for r in x[::2])).difference(self.known)
        if new:
            self._learn(list(new))
        get, out = self.known.__getitem__, []
        for x in runs:
            found = []
            for k, r in enumerate(x):
                if k % 2:
                    found.append(str(self.special[r]))
                else:
                    found += map(get, r)
            out.append(" ".join(found))
        return out

    @staticmethod
    def _runs(text: str) -> list[str]:
        text = normalised(text)
        if any(c in text for c in SEPARATORS):
            return regex.findall(r"\S+", text)
        return text.split()

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder, so tokens are joined by a space."""
        return " ".join([self.tokens[i] for i in ids])

    def decode_joined(self, ids: str) -> str:
        """The same of decimal ids joined by one space."""
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def ids_of(joined: str) -> np.ndarray:
    return np.array(joined.split(), np.int32) if joined else np.zeros(0, np.int32)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, digests: bool = True, outputs: bool = False) -> DataFrame:
    """docs (with a text), with n_tokens; digests adds ids_sha256 and decoded_sha256, outputs adds ids and decoded.

    Null text is empty: no tokens, digests of the empty text. Rows with equal texts get equal results. The decoded
    text is decoded from the ids that the text was encoded to. Columns of docs with one of the new names are replaced.
    The table of a worker is emptied at the end of each task: Spark keeps the worker for what comes next.
    """
    new = ("n_tokens", *("ids_sha256", "decoded_sha256") * digests, *("ids", "decoded") * outputs)
    kinds = {"n_tokens": "bigint", "ids": "array<int>"}
    docs = without(docs, *new)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = word_bpe(public_tokenizers.path(tokenizer))
        ids = bpe.encode(texts(batch))
        decoded = [bpe.decode_joined(x) for x in ids]
        more = {"n_tokens": pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())}
        if digests:
            for name, column in (("ids_sha256", ids), ("decoded_sha256", decoded)):
                more[name] = pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in column], pa.string())
        if outputs:
            more |= {"ids": pa.array([ids_of(x) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        return with_columns(batch, **more)

    return map_batches(docs, step, ddl(docs, ", ".join(f"{x} {kinds.get(x, 'string')}" for x in new)), lambda: word_bpe(public_tokenizers.path(tokenizer)).forget())
