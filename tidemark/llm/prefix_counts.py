"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding, the tokens of a prefix are the tokens of a shorter prefix and one last token: the one
vocabulary entry that ends there and that, next to the shorter prefix's last token, encodes to just these two. So
one walk over a text gives the count at every prefix, and any later question on truncation or on a token budget
is a look-up. The walk is made once for each unit of text (see vocab.py) and kept as steps between prefixes.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ddl, map_batches, texts, with_columns, without
from .vocab import TABLE, TABLE_CHARS, is_odd, special_tokens, split_units

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: How the byte-level tokenizer cuts text into words (a fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class PrefixCounter:
    """Steps between the token counts of neighbouring prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda x: bytes(byte[c] for c in x)
        self.vocab = {raw(x): i for x, i in model["vocab"].items() if all(c in byte for c in x)}
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        #: Tokens by their bytes from the last to the first; at None, the token that ends this way.
        self.backwards: dict = {}
        for token in self.vocab:
            node = self.backwards
            for i in range(len(token), 0, -1):
                node = node.setdefault(token[i - 1], {})
            node[None] = token
        self.pairs: dict[bytes, dict[bytes, bool]] = {}
        self.n_pairs = 0
        self.words: dict[str, list[int]] = {}
        self.units: dict[str, bytes | None] = {}
        #: Characters in the keys of either table.
        self.word_chars = self.unit_chars = 0

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a word, by merging the neighbours of lowest rank until none can be merged."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(x, len(self.rank)) for x in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == len(self.rank):
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, a: bytes, b: bytes) -> bool:
        """Do these two tokens, side by side, encode to themselves? An empty first one stands for a word's start."""
        if self.n_pairs > 4 * TABLE:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def word_counts(self, raw: bytes) -> list[int]:
        """The number of tokens of each prefix of a word, in bytes, the empty one first."""
        last, count, pairs, root = [b""], [0], self.pairs, self.backwards
        for end in range(len(raw)):
            node, start = root, end
            while start >= 0 and (node := node.get(raw[start])) is not None:
                token = node.get(None)
                if token is not None:
                    before = last[start]
                    known = pairs.get(before)
                    fits = known.get(token) if known is not None else None
                    if fits or fits is None and self.together(before, token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
                start -= 1
            else:
                raise ValueError(f"no token ends at byte {end} of {raw!r}")
        return count

    def char_counts(self, word: str) -> list[int]:
        """The number of tokens of each prefix of a word, in code points, without the empty one."""
        if (known := self.words.get(word)) is not None:
            return known
        raw = word.encode()
        counts = self.word_counts(raw)
        if len(raw) == len(word):
            counts = counts[1:]
        else:  # a code point ends where no byte that continues it follows
            counts = [c for c, b in zip(counts[1:], [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]
        if word in ("'re", "'ve", "'ll"):  # its first two characters alone are two words
            counts[1] = 2
        if len(self.words) > TABLE or self.word_chars > TABLE_CHARS // 4:
            self.words.clear()
            self.word_chars = 0
        self.words[word] = counts
        self.word_chars += len(word)
        return counts

    def text_counts(self, text: str) -> np.ndarray:
        """The number of tokens of each prefix of any text without special tokens, in code points."""
        out: list[int] = []
        words = PATTERN.findall(text)
        done, i = 0, 0
        while i < len(words):
            start, run = i, ""
            while i < len(words) and SPACES.fullmatch(words[i]):
                run += words[i]
                i += 1
            word = words[i] if i < len(words) else ""
            if run or word.startswith(" "):
                # a prefix that ends in white space has all of it in one word; later the last character may go to the next
                own = run + (" " if word.startswith(" ") else "")
                ahead = self.char_counts(own)
                out += [done + x for x in ahead]
            done += sum(self.char_counts(x)[-1] for x in words[start:i])
            if word:
                own = self.char_counts(word)
                out += [done + x for x in own[word.startswith(" ") :]]
                done += own[-1]
                i += 1
        return np.array(out, np.int64)

    def unit_steps(self, unit: str) -> bytes:
        """The counts of a unit's prefixes as steps, one signed byte each. In a unit no run of white space is longer than one."""
        steps: list[int] = []
        for word in PATTERN.findall(unit):
            before = 0
            for x in self.char_counts(word):
                steps.append(x - before & 0xFF)
                before = x
        return bytes(steps)

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of each prefix of a text, in code points, the empty one not included."""
        units = split_units(text)
        if units is None:
            return self.text_counts(text)
        known = self.units
        new = set(units).difference(known)
        if new:
            if len(known) > TABLE or self.unit_chars > TABLE_CHARS:
                known.clear()
                self.unit_chars = 0
                new = set(units)
            self.unit_chars += sum(map(len, new))
            for u in new:
                known[u] = None if is_odd(u) else self.unit_steps(u)
        try:
            steps = b"".join(map(known.__getitem__, units))
        except TypeError:  # an odd unit
            return self.text_counts(text)
        return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class PrefixTable:
    """The counts at every prefix of one text, and the questions that they answer."""

    def __init__(self, text: str, tokenizer: str = TOKENIZER):
        self.text = text
        inside = [s for s in special_tokens(tokenizer) if s in text]
        if not inside:
            self.counts = counter(public_tokenizers.path(tokenizer)).prefix_counts(text)
            return
        # a special token counts as one; before its end, its characters are ordinary text
        parts = regex.split("(" + "|".join(map(regex.escape, inside)) + ")", text)
        own, done, found = counter(public_tokenizers.path(tokenizer)), 0, []
        for k, part in enumerate(parts):
            if k % 2:
                before = parts[k - 1]
                counts = own.text_counts(before + part)[len(before) :] - (own.text_counts(before)[-1] if before else 0)
                counts[-1] = 1
            else:
                counts = own.text_counts(part) if part else np.zeros(0, np.int64)
            found.append(done + counts)
            done += int(counts[-1]) if len(counts) else 0
        self.counts = np.concatenate(found) if found else np.zeros(0, np.int64)

    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def at(self, n_chars: int) -> int:
        """The tokens of the first n_chars code points."""
        return int(self.counts[min(n_chars, len(self.counts)) - 1]) if n_chars > 0 and len(self.counts) else 0

    def fitting(self, limit: int) -> int:
        """The length in code points of the longest prefix of at most limit tokens. Counts may fall as a prefix grows."""
        fits = np.flatnonzero(self.counts <= limit)
        return int(fits[-1]) + 1 if len(fits) else 0


def count_tokens(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, prefixes: bool = False) -> DataFrame:
    """docs (with a text), with n_bytes, n_tokens, over_limit and fitting_chars, and with prefixes also prefix_tokens.

    n_tokens is what the library gives for the whole text (null: empty, 0 tokens), over_limit says that it exceeds
    limit, fitting_chars is the length of the longest prefix within it, and prefix_tokens has the count at every
    prefix. Rows with equal texts get equal results. Columns of docs with one of the new names are replaced.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit", "fitting_chars", *["prefix_tokens"] * prefixes)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch)
        tables = [PrefixTable(x, tokenizer) for x in rows]
        n = np.array([x.total() for x in tables], np.int64)
        more = {"prefix_tokens": pa.array([x.counts for x in tables], pa.list_(pa.int64()))} if prefixes else {}
        return with_columns(
            batch, n_bytes=pa.array([len(x.encode()) for x in rows], pa.int64()), n_tokens=pa.array(n), over_limit=pa.array(n > limit),
            fitting_chars=pa.array([x.fitting(limit) if k > limit else len(x.counts) for x, k in zip(tables, n.tolist(), strict=True)], pa.int64()), **more,
        )

    return map_batches(docs, step, ddl(docs, "n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint" + ", prefix_tokens array<bigint>" * prefixes))
