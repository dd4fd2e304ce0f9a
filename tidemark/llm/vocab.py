"""Byte-pair encoding with the public tokenizer files: the library on whole texts, sped up by a table of units.

A unit is a space or line feed with what follows it up to the next one. In a text where no two white-space
characters stand together, the byte-level pattern can't match across the start of a unit, so that a text's token
ids are its units' ids in a row. Each worker encodes a unit with the library once and looks it up from then on.
Texts of another form, and texts that name a special token, go to the library whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import public_tokenizers

#: Units that a worker's table may hold, and characters in them; it starts anew beyond that.
TABLE, TABLE_CHARS = 700_000, 16 << 20
#: Units of one call of the library.
UNITS = 2000
TWO = ("  ", "\n\n", " \n", "\n ", "\0")
#: White space other than space and line feed; a unit that holds some is odd.
ODD = {c for c in map(chr, range(0x10000)) if c.isspace()} - {" ", "\n"}


def split_units(text: str) -> list[str] | None:
    """The units of a text, or None if white space stands together in it. Whoever looks at units must see to odd ones."""
    if any(x in text for x in TWO):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def is_odd(unit: str) -> bool:
    """Such a unit's tokens may depend on its neighbours: it has other white space than the one at its start."""
    return not ODD.isdisjoint(unit)


@cache
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_padding()
    found.no_truncation()
    return found


@cache
def special_tokens(name: str) -> tuple[str, ...]:
    return tuple(x.content for x in library(name).get_added_tokens_decoder().values())


class UnitEncoder:
    """Encodes batches of texts as the library does with add_special_tokens=False; ids come as little-endian bytes."""

    def __init__(self, name: str):
        self.library, self.special = library(name), special_tokens(name)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: For each id, the number of bytes that it stands for: a letter each, in a byte-level vocabulary.
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)
        self.known: dict[str, bytes | None] = {"": b""}
        self.held = 0

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _packed_units(self, units: list[str]) -> list[bytes]:
        """The ids of units, from one call of the library on a text made of them and cut again by the tokens' lengths.

        A unit without white space in front (the first of a text) gets a line feed, whose token is left out. No unit given ends in
        white space.
        """
        front = [not u.startswith((" ", "\n")) for u in units]
        parts = ["\n" + u if f else u for u, f in zip(units, front, strict=True)]
        ids = np.array(self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x.encode()) for x in parts])) + 1
        starts = np.r_[0, ends[:-1]] + front
        packed, size = ids.tobytes(), self.dtype.itemsize
        return [packed[a * size : b * size] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in x for s in self.special) else split_units(x) for x in texts]
        if len(self.known) > TABLE or self.held > TABLE_CHARS:
            self.known, self.held = {"": b""}, 0
        new = set().union(*(x for x in split if x)).difference(self.known)
        self.held += sum(map(len, new))
        self.known.update((u, None) for u in new if is_odd(u))
        self._learn([u for u in new if u not in self.known])
        get, out = self.known.__getitem__, []
        for text, units in zip(texts, split, strict=True):
            try:
                out.append(b"".join(map(get, units or ())) if units is not None else None)
            except TypeError:  # an odd unit
                out.append(None)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._packed([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _learn(self, new: list[str]) -> None:
        alone = [u for u in new if u[-1] in " \n"]
        self.known.update(zip(alone, self._packed(alone), strict=True))
        new = [u for u in new if u[-1] not in " \n"]
        for start in range(0, len(new), UNITS):
            part = new[start : start + UNITS]
            self.known.update(zip(part, self._packed_units(part), strict=True))


@cache
def unit_encoder(name: str) -> UnitEncoder:
    return UnitEncoder(name)
