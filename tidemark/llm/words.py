"""Hashes of the words of many texts at once, in blocks, so that memory beyond one number a word doesn't grow with a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

from .common import mix64

#: Bytes of a block.
BLOCK = 1 << 18
_BASE, _ALL = 0x9E3779B97F4A7C55, (1 << 64) - 1


@dataclass(frozen=True, eq=False)
class Alphabet:
    """Which bytes of UTF-8 stand in words, and what each of them counts as."""

    inside: np.ndarray
    fold: np.ndarray


def _alphabet(outside: list[int]) -> Alphabet:
    """Words of all bytes but those, with A-Z as a-z."""
    inside, fold = np.ones(256, bool), np.arange(256, dtype=np.uint64)
    inside[outside] = False
    fold[65:91] += np.uint64(32)
    return Alphabet(inside, fold + np.uint64(1))


#: Everything but ASCII white space; and letters, digits and what isn't ASCII (upper case counts as lower case before words are taken).
NOT_SPACE = _alphabet([32, *range(9, 14)])
ALPHANUMERIC = _alphabet([b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of a fixed odd number and of its inverse, modulo 2**64, for a block."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def hashed(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, in order, and the number of its text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    powers, inverse = _powers()
    hashes, starts, sizes, open_ = [], [], [], None
    with np.errstate(over="ignore"):
        for a in range(0, len(raw), BLOCK):
            block = raw[a : a + BLOCK]
            ok, last = alphabet.inside[block], a + BLOCK >= len(raw)
            edge = np.diff(ok.view(np.int8), prepend=0, append=0)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(alphabet.fold[block] * powers[: len(block)], out=sums[1:])
            h = (sums[e] - sums[s]) * inverse[s]
            if open_ is not None:  # a word that began in a block before
                begin, h0, n0 = open_
                if ok[0]:
                    h0, n0 = (h0 + pow(_BASE, n0, 1 << 64) * int(h[0])) & _ALL, n0 + int(e[0])
                    through = e[0] == len(block) and not last
                    s, e, h = s[1:], e[1:], h[1:]
                    if through:
                        open_ = begin, h0, n0
                        continue
                hashes.append(np.array([h0], np.uint64))
                starts.append(np.array([begin]))
                sizes.append(np.array([n0]))
                open_ = None
            if len(e) and e[-1] == len(block) and not last:
                open_ = a + int(s[-1]), int(h[-1]), int(e[-1] - s[-1])
                s, e, h = s[:-1], e[:-1], h[:-1]
            hashes.append(h)
            starts.append(a + s)
            sizes.append(e - s)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = mix64(np.concatenate(hashes) + np.concatenate(sizes).astype(np.uint64))
    return found, np.searchsorted(begins, np.concatenate(starts), "right") - 1


def grams(words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of k words, all of them or those that begin at the given places. The length is part of the hash."""
    n = max(0, len(words) - k + 1) if at is None else len(at)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k if n else 0):
            h = h * np.uint64(0xD6E8FEB86659FD93) + (words[j : j + n] if at is None else words[at + j])
        return mix64(h)
