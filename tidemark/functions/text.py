"""Small tests of texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What hints at each fault of a research protocol (case doesn't matter), and the form of an ISO duration.
ADVISORIES = {
    "FULL_SAMPLE": r"\b(full|whole|entire)[-_ ]?(sample|period|history)\b|\b(over|across) all (dates|years|periods)\b|\bglobal (mean|average|std|scaler|normali[sz]ation)|\.fit_transform\b",
    "FUTURE_FUNCTION": r"\.shift\(\s*-|\blead\(|\blook[- ]?ahead\b|\b(next|future|tomorrow'?s?)[-_ ](day'?s?[-_ ])?(return|price|close|data)|\[\s*\w+\s*\+\s*1\s*\]",
    "SURVIVORSHIP": r"\bsurvivor(s|ship)?\b|\b(today'?s|current|latest|present)\s+(index\s+)?(members|membership|constituents|universe|listing)",
}
DURATION = r"^P([0-9]+(\.[0-9]+)?Y)?([0-9]+(\.[0-9]+)?M)?([0-9]+(\.[0-9]+)?W)?([0-9]+(\.[0-9]+)?D)?(T([0-9]+(\.[0-9]+)?H)?([0-9]+(\.[0-9]+)?M)?([0-9]+(\.[0-9]+)?S)?)?$"


def advisory(text: Column, code: str) -> Column:
    """Whether a text hints at the fault, anywhere in it. A hint blocks nothing. Null: no."""
    return F.coalesce(text.rlike(f"(?i){ADVISORIES[code]}"), F.lit(False))


def positive_duration(text: Column) -> Column:
    """Whether a text is an ISO duration above 0: units in order, at least one, and one after a T. Null: no."""
    t = F.trim(text)
    return F.coalesce(t.rlike(DURATION) & ~t.endswith("T") & t.rlike("[1-9]"), F.lit(False))


def metric_tokens(name: Column) -> Column:
    """The lower-case words of a metric's name, be it in camel case or with separators."""
    return F.split(F.lower(F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")


def seed(text: Column, size: int) -> Column:
    """A number from 0 to less than size: the first four bytes of the text's SHA-256, modulo size."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % size


#: The smallest double that has all its bits.
_LEAST_NORMAL = 2.0**-1022


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shortest(x: Column, raw: Column) -> Column:
    """The fewest digits that give a number x above 0, in Java's form; raw is what Java makes of it. Java before 19 may have some too many, and the last one wrong: where it has 16 or 17, and among numbers below the normal ones."""
    ok = lambda k: let(F.upper(F.format_string(f"%.{k - 1}e", x)), lambda less: F.when(less.cast("double") == x, less))
    n_digits = F.length(F.regexp_replace(F.regexp_replace(raw, "E.*|[.]", ""), "^0+", ""))
    return F.when(x < _LEAST_NORMAL, F.coalesce(*(ok(k) for k in range(1, 18)), raw)).when(n_digits >= 16, F.coalesce(ok(15), ok(16), raw)).otherwise(raw)


def _as_json(raw: Column) -> Column:
    """Java's form of a number above 0 (such as 1.25E-7) as JSON's."""
    mantissa, power = F.split_part(raw, F.lit("E"), F.lit(1)), F.coalesce(F.try_element_at(F.split(raw, "E"), F.lit(2)).cast("int"), F.lit(0))
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), "0+$", "")
    both = F.concat(whole, part)
    # the digits, and how many of them are before the point
    found = F.struct(F.regexp_replace(F.regexp_replace(both, "^0+", ""), "0+$", "").alias("digits"), (F.length(whole) + power - F.length(F.regexp_extract(both, "^(0*)", 1))).alias("before"))

    def shown(x: Column) -> Column:
        digits, before = x["digits"], x["before"]
        n = F.length(digits)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise("")
        exponent = F.concat(F.when(before > 0, "e+").otherwise("e-"), F.abs(before - 1))
        form = F.when((before > 21) | (before < -5), F.concat(F.substring(digits, 1, 1), tail, exponent))
        form = form.when(before <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -before), digits)).when(before >= n, F.concat(digits, F.repeat(F.lit("0"), before - n)))
        return form.otherwise(F.concat(F.substr(digits, F.lit(1), before), F.lit("."), F.substr(digits, before + 1)))

    return let(found, shown)


def canonical_number(x: Column) -> Column:
    """A double as JSON in its canonical form: the shortest digits that give it, whole numbers without a point, powers of ten only from 1e21 on and below 1e-6, and no negative zero."""
    size = F.abs(x)
    form = let(F.struct(size.alias("size"), size.cast("string").alias("raw")), lambda v: let(_shortest(v["size"], v["raw"]), _as_json))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), form))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def canonical_json(**fields: Column) -> Column:
    """An object with its keys in order and no blanks; values are texts and whole numbers, null if they are null."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def domain_hash(domain: str, json: Column) -> Column:
    """SHA-256 of a domain's name, a zero byte and a JSON text: equal texts of different domains differ."""
    return F.sha2(F.concat(F.lit(domain + "\0"), json), 256)


def identity(value: Column, kind: str) -> Column:
    """An entity's identity with its kind in front, so that the text "1" and the number 1 are two."""
    return F.concat(F.lit(f"{kind}:"), quoted(value) if kind == "string" else value.cast("string"))
