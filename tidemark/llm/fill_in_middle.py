"""Fill-in-the-middle transformation: texts cut into units at boundaries that look at both neighbours.

A unit grammar is what may end a unit and what may begin the next one, two character classes. Its boundary is a
regex of width zero, one class looked behind for and the other ahead, so that splitting there loses no character.
Everything is DataFrame functions: the split, the parts, and what is rebuilt from an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, quoted, without

#: Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
NEW = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Units:
    """A unit ends between a character of `last` and one of `first` (classes as they stand in a regex); a text without such a place is one unit."""

    last: str
    first: str

    @property
    def boundary(self) -> str:
        return f"(?<={self.last})(?={self.first})"


_SPACE, _WORD, _ANY = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\x{0}-\x{10FFFF}]"
#: A word with the white space before it; white space at the end is a unit of its own.
WORDS = Units(_WORD, _SPACE)
#: A word with the white space after it; white space at the beginning is a unit of its own.
WORDS_THEN_SPACE = Units(_SPACE, _WORD)
LINES = Units(r"\n", _ANY)
SENTENCES = Units(r"[.!?]", _SPACE)
CHARACTERS = Units(_ANY, _ANY)


def units(text: str | Column, grammar: Units = WORDS) -> Column:
    """The units of a text, in order; concatenated they are the text. Null and the empty text have none (a split alone would give one empty piece)."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def _draws(doc_id: str, seed: int) -> list[Column]:
    """Four pseudo-random numbers of 32 bits by document; of a null doc_id, those of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, grammar: Units = WORDS, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs (doc_id, text), with their own columns and n, form, prefix, middle, suffix and output after them.

    n is the number of units. A text stays plain (the parts are null) if it is null or empty, if it has one of the
    three markers in it, or if the draw says so; else its output is one of
    psm <P>prefix<S>suffix<M>middle and spm <S>suffix<P>prefix<M>middle. Parts may be empty. Draws depend on doc_id
    alone, so that rows of equal doc_id are cut by the same draws, and repeated rows alike. Columns of docs with one
    of the new names are replaced. A row's memory grows with its text.
    """
    docs = without(docs, *NEW)
    pieces, text, first, second, form_draw, order_draw = free(docs, "fim_units", "fim_text", "fim_a", "fim_b", "fim_c", "fim_d")
    found = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(pieces, units("text", grammar)).withColumn("n", F.size(pieces).cast("bigint"))
    h = _draws("doc_id", seed)
    cuts = [x % (F.col("n") + 1) for x in h[:2]]
    found = found.withColumns({first: F.least(*cuts).cast("int"), second: F.greatest(*cuts).cast("int"), form_draw: h[2] % 100, order_draw: h[3] % 100})
    plain = (F.col(text) == "") | F.col(text).contains(PREFIX) | F.col(text).contains(SUFFIX) | F.col(text).contains(MIDDLE) | (F.col(form_draw) >= fim_percent)
    found = found.withColumn("form", F.when(plain, PLAIN).when(F.col(order_draw) < spm_percent, SPM).otherwise(PSM))
    part = lambda start, end: F.when(F.col("form") != PLAIN, F.array_join(F.slice(pieces, start + 1, end - start), ""))
    a, b, n = F.col(first), F.col(second), F.col("n").cast("int")
    found = found.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b), "suffix": part(b, n)})
    marked = [(F.lit(PREFIX), F.col("prefix")), (F.lit(SUFFIX), F.col("suffix")), (F.lit(MIDDLE), F.col("middle"))]
    psm, spm = (F.concat(*(x for i in order for x in marked[i])) for order in ((0, 1, 2), (1, 0, 2)))
    return found.withColumn("output", F.when(F.col("form") == PLAIN, F.col(text)).when(F.col("form") == PSM, psm).otherwise(spm)).select(*quoted(docs), *NEW)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of this form was made from. No text with a marker in it is ever cut, so that each marker stands in an output once."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*(F.element_at(parts, i) for i in places))
    return F.when(F.col(form) == PLAIN, F.col(output)).when(F.col(form) == PSM, at(2, 4, 3)).otherwise(at(3, 4, 2))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle in code points, and digests of the output and of the text rebuilt from it."""
    found = transform(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", "n", "form", F.char_length("prefix").cast("bigint").alias("prefix_chars"), F.char_length("middle").cast("bigint").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
