"""Canonical JSON of a column of any schema: keys in order, no blanks, one form for each value.

The form is compiled from the schema into one column expression. Values that JSON has no form for are texts with a
tag: whole numbers that a double can't hold, decimals, and binary data; times are ISO instants in UTC with
milliseconds. A number that isn't finite is an error when the row is read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.declaration import PlanError
from .text import canonical_number

#: Whole numbers beyond this in size aren't exact as doubles.
MOST_WHOLE = 2**53 - 1
#: What JSON names by a letter; other control characters are written by their number.
_SHORT = {"\b": "b", "\t": "t", "\n": "n", "\f": "f", "\r": "r"}
_NEEDS = r'[\x00-\x1f"\\]'


def quoted(text: Column) -> Column:
    """A text as a JSON string: only the quote, the backslash and control characters are escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\{_SHORT[chr(code)]}" if chr(code) in _SHORT else f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(_NEEDS), out).otherwise(text), F.lit('"'))


def _instant(x: Column, kind: T.DataType) -> Column:
    utc = x if isinstance(kind, T.TimestampNTZType) else F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone())
    shown = F.date_format(x.cast("timestamp_ntz") if isinstance(kind, T.DateType) else utc, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.lit('"'), shown, F.lit('Z"'))


def _number(x: Column) -> Column:
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, canonical_number(x)).otherwise(F.raise_error(F.lit("CANONICAL: a number is not finite")).cast("string"))


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{tag}:'), text, F.lit('"'))


def _object(parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _of(x: Column, kind: T.DataType) -> Column:
    """The JSON of a value that isn't null."""
    if isinstance(kind, T.StringType):
        return quoted(x)
    if isinstance(kind, T.BooleanType):
        return x.cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return x.cast("string")
    if isinstance(kind, T.LongType):
        return F.when(x.between(-MOST_WHOLE, MOST_WHOLE), x.cast("string")).otherwise(_tagged("bigint", x.cast("string")))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number(x.cast("double"))
    if isinstance(kind, T.DecimalType):
        return _tagged("decimal", x.cast("string"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _instant(x, kind)
    if isinstance(kind, T.BinaryType):
        return _tagged("base64", F.regexp_replace(F.base64(x), r"[\r\n]", ""))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: canonical(v, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.array_sort(F.map_keys(x))
        return _object(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), canonical(x[k], kind.valueType))))
    if isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind.fields)
        if len(set(names)) < len(names):
            raise PlanError("CANONICAL", "a key repeats")
        return _object(F.array(*(F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), canonical(x.getField(n) if not re.search(r"[.`]", n) else x[f"`{n}`"], kind[n].dataType)) for n in names)) if names else F.array().cast("array<string>"))
    raise PlanError("CANONICAL", f"no canonical form of {kind.simpleString()}")


def canonical(x: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of the given type. Keys are in order of their UTF-8 bytes. Null is `null`, wherever it stands; a type without a form is an error."""
    return F.when(x.isNull(), "null").otherwise(_of(x, kind))
