"""Canonical JSON as native expressions: keys sorted at every depth, no white space, ASCII only.

The text of a value is that of the usual JSON writer with sorted keys: strings escape all but printable
ASCII (beyond the basic plane as two halves), doubles have their shortest digits with an exponent below 1e-4 and from
1e16 on, and what JSON has no form for (decimals, dates, times, binaries as hex) is a string. A null is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that JSON escapes by a letter.
_LETTERS = (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_PLAIN = r"\A[ !#-\[\]-~]*\z"


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_string(text: Column) -> Column:
    """A quoted and escaped string."""

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 0x10000
        out = F.when(c.rlike(_PLAIN), c)
        for plain, letter in _LETTERS:
            out = out.when(c == plain, letter)
        return out.when(code > 0xFFFF, F.concat(_unit(F.lit(0xD800) + F.shiftright(beyond, 10)), _unit(F.lit(0xDC00) + beyond.bitwiseAND(0x3FF)))).otherwise(_unit(code))

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1)), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(_PLAIN), text).otherwise(whole), F.lit('"'))


def json_double(x: Column) -> Column:
    """Fewest digits that give the double back (subnormal ones may have one more), plain from 1e-4 to below 1e16."""
    shape = r"^(-?)(\d+)\.(\d+)(?:[Ee]([+-]?\d+))?$"
    tries = [F.format_string(f"%.{p}e", x) for p in (14, 15, 16)]
    shown = F.coalesce(*[F.when(t.try_cast("double") == x, t) for t in tries], x.cast("string"))
    part = lambda i: F.regexp_extract(shown, shape, i)
    sign, whole, rest, power = part(1), part(2), F.regexp_replace(part(3), "0+$", ""), F.coalesce(part(4).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.concat(whole, rest), "^0+(?=.)", "")
    # the decimal point stands after so many of the digits
    point = F.length(whole) + power - (F.length(F.concat(whole, rest)) - F.length(digits))
    short = F.regexp_replace(digits, "0+$", "")
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short))
        .when(F.length(short) <= point, F.concat(F.rpad(short, point, "0"), F.lit(".0")))
        .otherwise(F.concat(F.substring(short, F.lit(1), point), F.lit("."), F.substring(short, point + 1, F.length(short))))
    )
    exponent = point - 1
    tail = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    science = F.concat(F.substring(short, 1, 1), F.when(F.length(short) > 1, F.concat(F.lit("."), F.substring(short, F.lit(2), F.length(short)))).otherwise(""), tail)
    number = F.concat(sign, F.when((point > -4) & (point <= 16), plain).otherwise(science))
    odd = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == -float("inf"), "-Infinity").when(x == 0, F.concat(sign, F.lit("0.0")))
    return F.coalesce(odd, number)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a value of a type; a null value is the text null."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        parts = F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), canonical_json(e["v"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: canonical_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_double(value.cast("double"))
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, T.BinaryType):
        text = json_string(F.lower(F.hex(value)))
    else:
        text = json_string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def content_hash(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_json(value, kind), 256)
