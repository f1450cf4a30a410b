"""Secret scans by an incremental blob ledger.

Every historical version of a text is a blob, addressed by the SHA-256 of its content. A ledger
holds one row for each blob and rule version that was ever scanned. A run finds the pairs that the
ledger lacks, fetches the text of one document of each such blob, scans it, appends the result, and
joins the ledger's findings back to all paths that hold the blob. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm import spans as S
from vistalake.llm.common import query, shared_dir, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts when ``group`` of it has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Patterns of the base rules in order, then those of well-known token formats. Fixed values.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

LEDGER = f"blob string, kind string, version int, spans {S.SPAN}"


def find(text: Column, rule: Rule) -> Column:
    """Spans of one rule in ``text``. A match that is too short is dropped and its characters stay used up."""
    found = S.matches(text, rule.pattern, rule.kind)
    if rule.least > 1:
        found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least)
    return found


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; one that does not exist yet is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, path, kinds: blobs with rule versions that the ledger lacks, and one path that holds the blob."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    one = versions.groupBy("blob").agg(F.min("path").alias("path"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")))
    return one.join(seen, "blob", "left").select("blob", "path", F.transform(left, lambda x: x["kind"]).alias("kinds")).filter(F.size("kinds") > 0)


def blobs(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, text and blob of every row; a null text counts as empty."""
    return docs.select(F.col(path).alias("path"), text_or_empty(text).alias("text")).withColumn("blob", F.sha2("text", 256))


def findings(docs: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Brings the ledger up to date and returns its findings under ``rules``: blob, spans, for blobs that have some.

    ``spans`` are ordered by start and then by the order of ``rules``. The ledger may hold blobs that ``docs`` lacks.
    """
    spark = docs.sparkSession
    content = blobs(docs, path, text)
    todo = unseen(content.select("path", "blob"), read_ledger(spark, ledger_path), rules)
    # the text moves once, and only for blobs that need a scan; ids of blobs are small rows
    due = content.join(todo.withColumnsRenamed({"path": "at", "blob": "of"}), F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("of")))
    result = F.array(
        *[
            F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("text"), r).alias("spans")))
            for r in rules
        ]
    )
    rows = due.select("blob", F.explode(F.array_compact(result)).alias("x")).select("blob", "x.kind", "x.version", "x.spans")
    rows.write.mode("append").parquet(ledger_path)

    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    current = spark.read.schema(LEDGER).parquet(ledger_path).filter(F.array_contains(now, F.struct("kind", "version")) & (F.size("spans") > 0))
    order = F.array(*[F.lit(r.kind) for r in rules])
    # repeated rows scan a blob twice; the set holds each finding once
    found = current.groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    by_place = F.transform("spans", lambda s: F.struct(s["start"].alias("at"), F.array_position(order, s["kind"]).alias("place"), s.alias("s")))
    return found.select("blob", F.transform(F.array_sort(by_place), lambda x: x["s"]).alias("spans"))


def scan(docs: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Brings the ledger up to date and returns one row per row of ``docs``: path, blob, spans.

    A null text counts as empty and has no spans. Rows with equal paths are kept apart by their content; repeated
    rows give repeated results. A null path is kept. Columns other than the two named are not read.
    An empty table gives no rows.
    """
    found = findings(docs, ledger_path, path, text, rules)
    return blobs(docs, path, text).select("path", "blob").join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(S.SPAN)).alias("spans"))


def redacted(docs: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``, overlapping ones by one; other rows and all columns stay as they are."""
    found = findings(docs, ledger_path, path, text).withColumnsRenamed({"blob": "_blob", "spans": "_spans"})
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), grown.alias("out"))

    whole = F.aggregate("_spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))))
    joined = docs.withColumn("_of", F.sha2(text_or_empty(text), 256)).join(found, F.col("_of") == F.col("_blob"), "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(whole)).select(*docs.columns)


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The columns of the contract, from what scan() gives."""
    base = [r.kind for r in rules if r.base]
    mine = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"),
        *[S.count_of(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(S.joined(mine), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )


def _duck(rule: Rule, place: int) -> str:
    """The same spans in DuckDB: gaps and matches summed up from the left."""
    p = rule.pattern.replace("'", "''")
    hits, gaps = f"regexp_extract_all(t, '{p}')", f"regexp_split_to_array(t, '{p}')"
    keep = f" and length(regexp_extract(h[i], '{p}', {rule.group})) >= {rule.least}" if rule.least > 1 else ""
    begin = "list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i-1]]), 0)"
    return (
        f"select doc_id, {place} as place, '{rule.kind}' as kind, {begin} as s, {begin} + length(h[i]) as e from "
        f"(select doc_id, h, g, unnest(range(1, len(h) + 1)) as i from (select doc_id, {hits} as h, {gaps} as g from d)) where true{keep}"
    )


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(_duck(r, i) for i, r in enumerate(RULES))}),
j as (select doc_id, count(*) filter (where place = 0) as n_assign, count(*) filter (where place = 1) as n_access, count(*) filter (where place = 2) as n_hex,
  coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, place) filter (where place < 3), '') as base,
  coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, place), '') as spans from f group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (doc_id)
"""


@query("op10_secret_scans", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), shared_dir(spark)))
