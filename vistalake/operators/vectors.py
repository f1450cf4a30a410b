"""Bipolar vectors: binding, bundling, permutation, and clean-up against a codebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed thresholds of the clean-up.
HIGH, MEDIUM, GAP = 0.7, 0.3, 0.1


def bipolar(v: Column) -> Column:
    """Signs of a vector as 1 and -1; zero counts as 1."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def bind(a: Column, b: Column) -> Column:
    """Product by element; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x * y)


def permute(v: Column, shifts: int = 1) -> Column:
    """Cyclic shift to the right; negative to the left."""
    n = F.size(v)
    k = F.pmod(F.lit(shifts), n)
    return F.when(k == 0, v).otherwise(F.concat(F.slice(v, n - k + 1, k), F.slice(v, F.lit(1), n - k)))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two bipolar vectors."""
    return F.aggregate(bind(a, b), F.lit(0), lambda s, x: s + x) / F.size(a)


def packed(v: Column) -> Column:
    """The signs of a bipolar vector as words of 64 bits, 1 for a positive element, the first one highest; the last word may hold fewer."""
    word = lambda k: F.aggregate(F.slice(v, k * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), word))


def packed_similarity(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """similarity() of packed vectors: elements less twice those that differ. Null where sizes differ."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(size_a == size_b, (size_a - 2 * differ) / size_a)


def bundle(vectors: DataFrame, *by: str) -> DataFrame:
    """Majority vote of the vectors of each group; ties give 1. Elements are summed apart, so that a group of any size needs no array of all its vectors."""
    parts = vectors.select(*by, F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy(*by, "at").agg(F.sum("x").alias("s"))
    sign = F.when(F.col("s") >= 0, 1).otherwise(-1)
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", sign.alias("x")))), lambda e: e["x"]).alias("v"))


def _candidates(queries: DataFrame, codebook: DataFrame, block: int) -> DataFrame:
    """Each query with the symbols of its blocks' codebook entries by falling similarity, ties by symbol.

    The codebook stands in rows of about ``block`` entries; queries are laid out once for each block and meet it by an equality. Vectors travel
    and are compared as words of signs.
    """
    # the number of blocks is a number, not data
    n = max(1, -(-codebook.count() // block))
    book = codebook.select("symbol", F.size("v").alias("n"), packed(F.col("v")).alias("w"))
    blocks = book.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("symbol", "n", "w")).alias("entries"))
    # each block stands once for each salt, so that queries spread over as many keys as there are partitions
    salts = max(1, -(-int(codebook.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    blocks = blocks.withColumn("salt", each(salts))
    words = queries.select("id", F.size("v").alias("n"), packed(F.col("v")).alias("w"))
    laid = words.withColumn("block", each(n)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    far = lambda e: -packed_similarity(F.col("w"), e["w"], F.col("n"), e["n"])
    scored = laid.join(blocks, ["block", "salt"]).select("id", F.transform("entries", lambda e: F.struct(far(e).alias("far"), e["symbol"].alias("symbol"))).alias("c"))
    return scored


def top_k_symbols(queries: DataFrame, codebook: DataFrame, k: int = 3, block: int = 1024) -> DataFrame:
    """id, rank, symbol, similarity: the k best symbols of each query (id, v) in a codebook (symbol, v)."""
    some = _candidates(queries, codebook, block).select("id", F.slice(F.array_sort("c"), 1, k).alias("c"))
    best = some.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k).alias("c"))
    return best.select("id", F.posexplode("c").alias("at", "e")).select("id", (F.col("at") + 1).alias("rank"), "e.symbol", (-F.col("e.far")).alias("similarity"))


def cleanup(queries: DataFrame, codebook: DataFrame, block: int = 1024) -> DataFrame:
    """Per query the best symbol, the runner-up, their gap and CLEAN_MATCH, AMBIGUOUS, WEAK_MATCH or NO_MATCH; ERROR where the codebook is empty or the vector null. A single entry has the runner-up -1."""
    two = top_k_symbols(queries.filter("v is not null"), codebook, 2, block).groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("symbol"))).alias("symbol"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("similarity"))), F.lit(-1.0)).alias("second")
    )
    gap = F.col("best") - F.col("second")
    verdict = F.when(F.col("best").isNull(), "ERROR").when(F.col("best") <= MEDIUM, "NO_MATCH").when((F.col("best") > HIGH) & (gap > GAP), "CLEAN_MATCH").when(gap <= GAP, "AMBIGUOUS").otherwise("WEAK_MATCH")
    # an empty codebook has no row for a query
    return queries.select("id").join(two, "id", "left").select("id", "symbol", "best", "second", gap.alias("gap"), verdict.alias("verdict"))
