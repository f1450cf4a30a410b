"""Match positions with built-in functions only.

Spark has functions for the texts of all matches and for the texts between them, and none for
positions. Both follow the same leftmost, non-overlapping matches, so the lengths of the gaps and of
the matches, summed up from the left, are the positions in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element type of a span array.
SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def matches(text: Column, pattern: str, kind: str, trigger: Column | None = None) -> Column:
    """Array of (kind, start, end, match) of all leftmost non-overlapping matches; ``end`` is exclusive.

    The pattern never matches the empty string. ``trigger`` is a cheap test without which a text
    can have no match.
    """
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    # the last gap has no match after it
    found = F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, add, lambda acc: acc["out"])
    has = text.rlike(pattern) if trigger is None else trigger & text.rlike(pattern)
    return F.when(has, found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
