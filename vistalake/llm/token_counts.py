"""Token counts by a digest cache.

The cache holds one row for each content digest and tokenizer-version digest. Digests of the input are
joined to it; of those it lacks, the text of one document each is encoded and the counts are
appended; then every document takes its count from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import query, shared_dir, table, text_or_empty
from vistalake.llm.wordwise import piece_counter

CACHE = "digest string, tokenizer string, n_tokens long"
LIMIT = 4096


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its file's content and the library's version."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; one that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``); brings the cache up to date.

    The content is digested as it is but for null, which counts as empty (0 tokens): the tokenizer keeps
    every byte, so any further normalisation would merge texts with different counts. Repeated
    rows, a null key and clashing extra columns are harmless; an empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    content = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("digest", F.sha2("text", 256))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    # a digest's hot group shrinks to one small row on the map side; text moves once
    one = content.groupBy("digest").agg(F.min("doc_id").alias("at"))
    misses = one.join(known, "digest", "left_anti").withColumnRenamed("digest", "of")
    due = content.join(misses, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("of"))).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for b in batches:
            n = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    due.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    # rows that repeat a key were encoded more than once
    counts = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    sized = content.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_dir(spark))
