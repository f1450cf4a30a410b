"""Boxes that lie close to each other, by a grid on both axes with cells for each class of size.

Classes are powers of four: a box stands in cells of its own class, at most two by two of them, and looks up the cells of its own and of
each larger class that occurs, again two by two at most. So a pair meets in cells of its larger box's class, whatever the sizes of both, and it
counts in one of them: the one that holds the lower corner of what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x", "y", "width", "height")


def _level(side: Column) -> Column:
    return F.greatest(F.ceil(F.log(4.0, F.greatest(side, F.lit(1.0)))), F.lit(0)).cast("int")


def _cells(low: Column, high: Column, cell: Column) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def close_pairs(boxes: DataFrame, by: str, key: str, carry: list[str], reach: float = 0.0) -> DataFrame:
    """Pairs of boxes of a group whose gap is at most ``reach`` in each axis, each once, in no order: ``by``, and key, x, y, width, height and ``carry`` with the prefixes a_ and b_.

    A row with a null or negative side, or a null corner, meets none. How many classes there are follows from the range of a double, not from the rows.
    """
    names = [key, *BOX, *carry]
    sound = boxes.filter((F.col("width") >= 0) & (F.col("height") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull()).select(by, *dict.fromkeys(names))
    sound = sound.withColumn("_level", _level(F.greatest("width", "height") + reach))
    levels = sorted(r[0] for r in sound.select("_level").distinct().collect())
    names = list(dict.fromkeys(names))
    cell = F.pow(F.lit(4.0), F.col("_at"))

    def laid(prefix: str, grown: float, rows: DataFrame) -> DataFrame:
        c = lambda n: F.col(f"{prefix}{n}")
        spread = lambda lo, side: F.explode(_cells(c(lo) - grown, c(lo) + c(side) + grown, cell))
        named = rows.select(by, "_level", "_at", *[F.col(n).alias(f"{prefix}{n}") for n in names])
        return named.withColumn("_cx", spread("x", "width")).withColumn("_cy", spread("y", "height"))

    stored = laid("b_", 0.0, sound.withColumn("_at", F.col("_level"))).withColumnRenamed("_level", "_b_level")
    larger = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("_level")) if levels else F.array().cast("array<int>")
    probes = laid("a_", float(reach), sound.withColumn("_at", F.explode(larger)))
    met = probes.join(stored, [by, "_at", "_cx", "_cy"])
    touch = lambda lo, side: (F.col(f"a_{lo}") - reach <= F.col(f"b_{lo}") + F.col(f"b_{side}")) & (F.col(f"b_{lo}") <= F.col(f"a_{lo}") + F.col(f"a_{side}") + reach)
    corner = lambda lo: F.floor(F.greatest(F.col(f"a_{lo}") - reach, F.col(f"b_{lo}")) / cell)
    own = (F.col("_cx") == corner("x")) & (F.col("_cy") == corner("y"))
    # boxes of one class look each other up
    once = (F.col("_level") < F.col("_b_level")) | (F.col(f"a_{key}") < F.col(f"b_{key}"))
    return met.filter(touch("x", "width") & touch("y", "height") & own & once).drop("_at", "_cx", "_cy", "_level", "_b_level")
