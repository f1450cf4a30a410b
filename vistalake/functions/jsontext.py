"""Canonical JSON with built-in functions: ASCII only, sorted keys, no blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))


def plain(text: Column) -> Column:
    """Whether nothing in a text is escaped."""
    return ~text.rlike(r'[^ -~]|["\\]')


def quoted(text: Column) -> Column:
    """A JSON string: quotes and backslashes escaped, all but printable ASCII as \\uXXXX (pairs beyond 16 bits); null gives null."""

    def one(c: Column) -> Column:
        n = F.ascii(c)
        high = n - 0x10000
        return (
            F.when(c == "", c)
            .when(c == '"', F.lit('\\"'))
            .when(c == "\\", F.lit("\\\\"))
            .when((n >= 32) & (n < 127), c)
            .when(n == 10, F.lit("\\n"))
            .when(n == 13, F.lit("\\r"))
            .when(n == 9, F.lit("\\t"))
            .when(n == 8, F.lit("\\b"))
            .when(n == 12, F.lit("\\f"))
            .when(n < 0x10000, _unit(n))
            .otherwise(F.concat(_unit(0xD800 + F.shiftright(high, 10)), _unit(0xDC00 + high.bitwiseAND(0x3FF))))
        )

    body = F.when(plain(text), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def string(text: Column) -> Column:
    return F.coalesce(quoted(text), F.lit("null"))


def array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def object_(**members: Column) -> Column:
    """Members are JSON texts; they come in the order of their names."""
    cells = [F.concat(F.lit(f'"{k}":'), members[k]) for k in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
