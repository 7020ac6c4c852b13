"""Canonical JSON of any column: sorted keys, no blanks, ASCII only, shortest floats; and its hash.

The serialiser is an expression that is compiled from the column's type, so nested rows are
written in the JVM, field by field, whatever their depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short escapes of JSON. Fixed values.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _bound(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def text(value: Column) -> Column:
    """A quoted string; characters beyond ASCII are escaped as UTF-16 units, in pairs where they need two."""

    def char(c: Column) -> Column:
        code = F.ascii(c)
        pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), _unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
        out = F.when(code >= 0x10000, pair).when((code < 0x20) | (code >= 0x7F), _unit(code)).otherwise(c)
        for plain, escaped in SHORT.items():
            out = F.when(c == plain, F.lit(escaped)).otherwise(out)
        return out

    # most texts hold nothing to escape
    plain = value.rlike(r'^[ !#-\[\]-~]*$')
    return F.when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(value, ""), char), ""), F.lit('"')))


def number(value: Column) -> Column:
    """A float by the fewest digits that give it back: plain from 1e-4 up to below 1e16, else with an exponent of two digits and more."""
    found = F.coalesce(*[F.when(F.format_string(f"%.{p}e", value).try_cast("double") == value, F.format_string(f"%.{p}e", value)) for p in range(17)])

    def shown(s: Column) -> Column:
        sign, parts = F.regexp_extract(s, "^-", 0), F.regexp_extract(s, r"^-?([\d.]+)e", 1)
        digits = F.regexp_replace(F.replace(parts, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        exponent = F.regexp_extract(s, r"e(.*)$", 1).try_cast("int")
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        whole = F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - n), F.lit(".0"))
        mixed = F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
        tail = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
        far = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), tail)
        near = F.when(exponent < 0, small).when(n <= exponent + 1, whole).otherwise(mixed)
        return F.concat(sign, F.when((exponent < -4) | (exponent >= 16), far).otherwise(near))

    odd = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity")
    zero = F.when(value == 0, F.when(F.startswith(value.cast("string"), F.lit("-")), "-0.0").otherwise("0.0"))
    return F.coalesce(odd, zero, _bound(found, shown))


def json(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of that type; null is null.  Binary and intervals have none; times and dates are ISO texts."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(text(F.lit(f.name)), F.lit(":"), json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of an object are strings")
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), json(F.element_at(value, k), kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = text(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, (T.DateType,)):
        out = text(value.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = text(F.replace(value.cast("string"), F.lit(" "), F.lit("T")))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(json(value, kind).cast("binary"), 256)
