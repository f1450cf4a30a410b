"""Tampering, gluing and ordered digests beyond what the given tables hold."""

import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from vistalake.functions import jsontext
from vistalake.operators import digests, gluing
from vistalake.sources import programs

PROGRAM = "source_file string, frame_index long, evidence_tier string, evidence_chain array<string>, pixel_coordinates string, processing_timestamp string, note string"


def some(spark):
    rows = [(f"f{i}.mp4", i, "real-capture" if i % 2 else "lab", [f"z{i}", "a"], '{"x": 1}', f"t{i}", "n") for i in range(20)]
    rows += [(None, None, None, None, None, None, None), ('q"\\/é😀\u007f\n', 30, "earned", ["b", 'é"', ""], "\t", "\x01", "x")]
    return spark.createDataFrame(rows, PROGRAM)


def test_json_text_is_canonical(spark):
    texts = ["", "plain", 'a"b\\c/d', "é ü 中 😀", "\n\r\t\b\f\x01\x1f\x7f", "a b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsontext.quoted(F.col("t"))).collect()]
    assert got == [json.dumps(t) for t in texts]


def test_round_trip_and_hash(spark, tmp_path):
    path = str(tmp_path / "s")
    programs.write_programs(some(spark), path, "now")
    good, bad = programs.read_programs(spark, path, some(spark).schema)
    assert bad.count() == 0 and good.count() == 22
    want = some(spark).fillna({"evidence_tier": "lab", "frame_index": 0}).collect()
    assert sorted(map(str, good.collect())) == sorted(map(str, want))
    for r in programs.documents(some(spark), "now").collect():
        p = r.program
        text = {"source_file": p.source_file, "frame_index": p.frame_index, "evidence_tier": p.evidence_tier, "evidence_chain": sorted(p.evidence_chain or []), "pixel_coordinates": p.pixel_coordinates or "", "processing_timestamp": p.processing_timestamp or ""}
        assert r.integrity_hash == "sha256:" + hashlib.sha256(json.dumps(text, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def altered(spark, tmp_path, change):
    path = tmp_path / "s"
    programs.write_programs(some(spark).repartition(1), str(path), "now")
    (file,) = path.glob("part-*.json")
    for crc in path.glob(".*.crc"):
        crc.write_bytes(b"")
    file.write_text("\n".join(change(line) for line in file.read_text().splitlines()))
    pathlib.Path(path / f".{file.name}.crc").unlink()
    return str(path)


@pytest.mark.parametrize(
    "old,new,reason,n",
    [("f3.mp4", "f4.mp4", "INTEGRITY_MISMATCH", 1), ('"evidence_tier":"lab"', '"evidence_tier":"earned"', "INTEGRITY_MISMATCH", 11), ("PROGRAM_V1", "PROGRAM_V2", "UNSUPPORTED_VERSION", 22), ('"program":{"source_file":"f5.mp4"', '"program":{"source_file"', "UNREADABLE", 1), ("sha256:", "sha1:", "INTEGRITY_MISMATCH", 22)],
)
def test_tampering_is_quarantined(spark, tmp_path, old, new, reason, n):
    path = altered(spark, tmp_path, lambda line: line.replace(old, new))
    good, bad = programs.read_programs(spark, path, some(spark).schema)
    assert [(r.reason, r["count"]) for r in bad.groupBy("reason").count().collect()] == [(reason, n)] and good.count() == 22 - n
    with pytest.raises(Exception, match="not trusted"):
        programs.trusted(spark, path, some(spark).schema).collect()


def test_minimum_tier(spark, tmp_path):
    path = str(tmp_path / "s")
    programs.write_programs(some(spark), path)
    good, bad = programs.read_programs(spark, path, some(spark).schema, "real-capture")
    assert good.count() == 11 and {r.reason for r in bad.collect()} == {"TIER_TOO_LOW"}
    assert programs.read_programs(spark, path, some(spark).schema, "lab")[1].count() == 0


def sections(spark, *rows):
    return spark.createDataFrame([(c, i, m, n, k, h) for i, (c, m, n, k, h) in enumerate(rows)], "collection string, ord long, member string, names string, n_pages long, hash string")


def test_gluing(spark):
    s = sections(spark, ("A", "m", "n", 2, "h"), ("B", "m", "n", 2, "h"), ("B", "x", "n", 1, "hx"), ("C", "x", "n", 1, "hx"))
    a = gluing.compose_assignment(s)
    assert gluing.composition_verdict(gluing.verify_composition(s, a)).first().verdict == "COMPOSABLE" and gluing.detect_obstructions(s, a).count() == 0
    o = spark.createDataFrame([("B", "m", "n2", 2, "h2"), ("C", "x", "n", 1, None)], "collection string, member string, names string, n_pages long, hash string")
    assert gluing.composition_verdict(gluing.verify_composition(s, a, o)).first().verdict == "NOT_COMPOSABLE"
    got = {(r.kind, r.member, r.against, r.representative, r.collections, r.conflicts) for r in gluing.detect_obstructions(s, a, o).collect()}
    assert got == {
        ("PAGE_STRUCTURE_CONFLICT", "m", "collections", "A", 1, 1), ("PAGE_STRUCTURE_CONFLICT", "m", "collections", "B", 1, 1), ("HASH_CYCLE_CONFLICT", "m", "collections", "A", 1, 1), ("HASH_CYCLE_CONFLICT", "m", "collections", "B", 1, 1),
        ("COVERAGE_GAP", "x", "collections", "C", 1, 1), ("ASSIGNMENT_CONTRADICTION", "m", "(global)", "B", 1, 1),
    }
    # without a global form
    assert {(r.kind, r.member, r.conflicts) for r in gluing.detect_obstructions(s, a.filter("member = 'm'")).collect()} == {("COVERAGE_GAP", "x", 2)}


def test_obstructions_of_a_member_that_all_share(spark):
    """A third of all sections are one member; its conflicts are counted by form."""
    s = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("collection"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("m"), "id")).alias("member"), F.lit("n").alias("names"), F.lit(1).alias("n_pages"), F.concat(F.lit("h"), F.col("id") % 2).alias("hash"))
    got = {(r.kind, r.form, r.collections, r.conflicts) for r in gluing.detect_obstructions(s, gluing.compose_assignment(s)).collect()}
    assert got == {("HASH_CYCLE_CONFLICT", "h0", 5000, 25_000_000), ("HASH_CYCLE_CONFLICT", "h1", 5000, 25_000_000), ("ASSIGNMENT_CONTRADICTION", "h1", 5000, 5000)}


def test_obstructions_read_the_sections_once(spark):
    """Conflicts come from the table of forms; digests may be binary and are shown in hexadecimal."""
    text = sections(spark, ("A", "m", "aa", 2, "0a"), ("B", "m", "ab", 2, "0b"), ("C", "m", "aa", 2, "0a"), ("C", "x", "aa", 1, None), ("A", "x", "aa", 1, "0c"))
    packed = text.withColumns({"names": F.unhex("names"), "hash": F.unhex("hash")})
    found = [sorted(map(str, gluing.detect_obstructions(s, gluing.compose_assignment(s)).collect())) for s in (text, packed)]
    assert found[0] == found[1] and any("'aa'" in r or "2/aa" in r for r in found[1])
    marked = text.withColumn("member", F.udf(lambda m: m)("member"))
    plan = gluing.detect_obstructions(marked, gluing.compose_assignment(text))._jdf.queryExecution().optimizedPlan().toString()
    # the only lambdas are the sections', and forms are written before the plan is made
    assert "<lambda>" not in plan


def test_verification_joins_overrides_by_flags(spark, monkeypatch):
    """An override may lack a hash or repeat, a section may repeat; no hash travels to the join by collection and member."""
    s = sections(spark, ("A", "m", "n", 2, "h"), ("B", "m", "n", 2, "h"), ("B", "m", "n", 2, "g"), ("C", "m", "n", 2, None), ("C", "y", "n", 1, "hy"))
    a = gluing.compose_assignment(s).filter("member = 'm'")
    o = spark.createDataFrame([("B", "m", "z", 9, "g"), ("B", "m", "n", 2, "h"), ("C", "m", "n", 2, "h"), ("A", "m", "n", 2, None), ("Z", "m", "n", 2, "h")], "collection string, member string, names string, n_pages long, hash string")
    monkeypatch.setattr(gluing, "with_overrides", None)
    got = gluing.verify_composition(s, a, o)
    assert {(r.collection, r.checked, r.agree, r.disagree, r.first_disagreement, r.passed) for r in got.collect()} == {("A", 1, 0, 1, "m", False), ("B", 2, 2, 0, None, True), ("C", 2, 1, 1, "y", False)}


def test_ordered_digest(spark):
    rows = [("a", i, f"v{i}") for i in (3, 1, 2)] + [("b", 1, None), ("b", 2, "é"), (None, 1, "x")]
    got = {(r.g, r.n): r.digest for r in digests.ordered_digest(spark.createDataFrame(rows, "g string, p int, v string"), ["g"], ["p"], F.col("v"), ",", F.lit("<"), F.lit(">")).collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {("a", 3): h("<v1,v2,v3>"), ("b", 2): h("<,é>"), (None, 1): h("<x>")}
    big = spark.range(200_000).select(F.lit(1).alias("g"), "id", F.col("id").cast("string").alias("v"))
    (one,) = digests.ordered_digest(big, ["g"], ["id"], F.col("v"), "|").collect()
    assert (one.n, one.digest) == (200_000, h("|".join(map(str, range(200_000)))))
