"""SHA-256 signatures of pages, sequences of pages and collections of sequences, and contracts over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.operators import digests

# Fixed value: the version line of every canonical text.
VERSION = "V1.0"


def in_order(value: str, position: str) -> Column:
    """Aggregate: values in the order of their positions. Its parent is one page, sequence or collection, which its own length bounds."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).alias("v")))), lambda s: s["v"])


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), v) for k, v in parts], F.lit(f"version={VERSION}")), 256)


def set_signature(contract: Column, families: Column, verdicts: Column) -> Column:
    """Of a page; null without families or where verdicts and families differ in number."""
    ok = (F.size(families) > 0) & (F.size(families) == F.size(verdicts))
    return F.when(ok, _lines(("contract", contract), ("families", F.array_join(families, ",")), ("verdicts", F.array_join(verdicts, ","))))


def _parent(kind: str, count: str, sigs: str, name: Column, signatures: Column, expected: Column) -> Column:
    ok = (F.size(signatures) > 0) & (F.size(signatures) == expected) & ~F.exists(signatures, lambda s: F.coalesce(F.length(s) != 64, F.lit(True)))
    return F.when(ok, _lines((kind, name), (count, expected.cast("string")), (sigs, F.array_join(signatures, ","))))


def sequence_signature(name: Column, signatures: Column, expected: Column) -> Column:
    """Of ordered page signatures; null when one is missing or their number is not the expected one."""
    return _parent("seq_contract", "page_count", "page_sigs", name, signatures, expected)


def collection_signature(name: Column, signatures: Column, expected: Column) -> Column:
    return _parent("coll_contract", "seq_count", "seq_sigs", name, signatures, expected)


def _signed_parents(rows: DataFrame, by: list[str], position: str, signature: str, name: Column, kind: str, count: str, sigs: str) -> DataFrame:
    per = digests.counted(rows, by, [position], _k=F.count(F.when(F.length(signature) == 64, 1)))
    n = F.col("_n").cast("string")
    before = F.concat(F.lit(f"{kind}="), name, F.lit(f"\n{count}="), n, F.lit(f"\n{sigs}="))
    done = digests.ordered_digest(per, by, [position], F.col(signature), ",", before, F.lit(f"\nversion={VERSION}"), ["_k"])
    return done.select(*by, "n", F.when(F.col("_k") == F.col("n"), F.col("digest")).alias("signature"))


def signed_sequences(pages: DataFrame, by: list[str], position: str, signature: str, name: Column) -> DataFrame:
    """``by``, n and signature of sequences from signed pages, one row each: as sequence_signature() without an array of a sequence. Null when a page is not signed."""
    return _signed_parents(pages, by, position, signature, name, "seq_contract", "page_count", "page_sigs")


def signed_collections(sequences: DataFrame, by: list[str], position: str, signature: str, name: Column) -> DataFrame:
    return _signed_parents(sequences, by, position, signature, name, "coll_contract", "seq_count", "seq_sigs")


def structural_hashes(pages: DataFrame, by: list[str], order: list[str], page: str, name: Column) -> DataFrame:
    """``by``, n and digest: as structural_hash() without an array of a sequence."""
    before = F.concat_ws("|", name, F.col("_n").cast("string"), F.lit(""))
    return digests.ordered_digest(digests.counted(pages, by, order), by, order, F.col(page), "|", before)


def structural_hash(name: Column, pages: Column) -> Column:
    """Of a sequence's name, number of pages and page names."""
    return F.sha2(F.concat_ws("|", name, F.size(pages).cast("string"), F.array_join(pages, "|")), 256)


def disagreeing_members(sections: DataFrame) -> DataFrame:
    """Members (collection, member, hash) that collections hold in more than one form: forms, collections, least and largest hash."""
    per = sections.groupBy("member", "hash").agg(F.count("*").alias("n"))
    return per.groupBy("member").agg(F.count("*").alias("forms"), F.sum("n").alias("collections"), F.min("hash").alias("low"), F.max("hash").alias("high")).filter("forms > 1")


def page_contract_verdict(families: Column, expected: Column, recovered: Column) -> Column:
    """RECOVERY_FAILED, VIOLATED_COUNT, SATISFIED, VIOLATED_ORDER (the same families in another order) or VIOLATED_FAMILY."""
    return (
        F.when(~recovered, "RECOVERY_FAILED")
        .when(F.size(families) != F.size(expected), "VIOLATED_COUNT")
        .when(families == expected, "SATISFIED")
        .when(F.array_sort(families) == F.array_sort(expected), "VIOLATED_ORDER")
        .otherwise("VIOLATED_FAMILY")
    )
