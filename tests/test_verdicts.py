"""Verdicts that must occur in the given tables, and small cases beyond them."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect
from vistalake.operators import hypervectors, intake, matching, pixels, signals, signatures, spatial, vectors
from vistalake.operators.grid import close_pairs
from vistalake.plans import catalog

WANTED = {
    ("match_ingest_case", "verdict"): {"ACCEPTED", "REJECTED_NO_MATCHING_CASE", "REJECTED_MISSING_METADATA", "REJECTED_ASSUMPTION_VIOLATED"},
    ("preflight_sessions", "verdict"): {"CLEARED", "REJECTED"},
    ("session_manifest", "verdict"): {"VALID", "EMPTY"},
    ("dispatch_signals", "verdict"): {"EMPTY_SIGNAL", "UNKNOWN_MODE", "DECODE_FAILED", "ROUTE_FAILED", "DISPATCHED"},
    ("decode_stripes", "verdict"): {"STRIPE_ERROR", "SYNC_FAILED", "ROUTE_FAILED", "DECODED"},
    ("decode_chroma", "verdict"): {"CHROMINANCE_ERROR", "SYNC_FAILED", "ROUTE_FAILED", "DECODED"},
    ("fuse_channels", "verdict"): {"EMPTY_PAYLOAD", "UNSUPPORTED_LENGTH", "BOTH_AGREE", "DISAGREE", "RS_ONLY", "CC_ONLY", "BOTH_FAILED"},
    ("validate_sequence", "verdict"): set(matching.SEQUENCE_WORDS),
    ("validate_collection", "verdict"): set(matching.COLLECTION_WORDS),
    ("match_set_signature", "verdict"): {"MATCH", "MISMATCH", "SIGN_FAILED"},
    ("match_sequence_signature", "verdict"): {"MATCH", "MISMATCH", "UNSUPPORTED"},
    ("match_collection_signature", "verdict"): {"MATCH", "MISMATCH", "SIGN_FAILED", "UNSUPPORTED"},
    ("check_vector_consistency", "verdict"): {"CONSISTENT", "MISMATCH", "VSA_FAILED", "UNKNOWN_TARGET"},
    ("process_frames", "verdict"): {"EMPTY", "FAIL", "PARTIAL", "PASS", "SKIPPED"},
    ("detect_obstructions", "kind"): {"COVERAGE_GAP", "PAGE_STRUCTURE_CONFLICT", "HASH_CYCLE_CONFLICT", "ASSIGNMENT_CONTRADICTION"},
    ("read_programs", "reason"): {"OK", "UNSUPPORTED_VERSION", "INTEGRITY_MISMATCH", "TIER_TOO_LOW"},
    ("status_ladder", "status"): {"EXECUTABLE", "VALIDATED", "ESTIMATED", "DESCRIPTIVE"},
}


def test_verdicts_occur():
    con = connect("/root/testdata/sf0.01")
    for (name, column), want in WANTED.items():
        assert {r[0] for r in con.execute(f"select distinct {column} from ({catalog.SQL[name]})").fetchall()} == want, name


def test_pairs_on_the_grid_equal_all_pairs(spark):
    r = random.Random(1)
    rows = [(g, i, r.uniform(-300, 300), r.uniform(-300, 300), r.choice([0.0, 1.0, 7.0, 16.0, 90.0, 1000.0]), r.choice([0.0, 2.0, 15.0, 64.0]), 1.0) for g in range(3) for i in range(60)] + [(0, 100, None, 0.0, 1.0, 1.0, 1.0), (0, 101, 0.0, 0.0, -1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame_id int, prim_idx int, x double, y double, width double, height double, confidence double")
    for reach in (0.0, 10.0):
        got = sorted((p.frame_id, *sorted((p.a_prim_idx, p.b_prim_idx))) for p in close_pairs(df, "frame_id", "prim_idx", [], reach).collect())
        near = lambda a, b: a[2] - reach <= b[2] + b[4] and b[2] - reach <= a[2] + a[4] and a[3] - reach <= b[3] + b[5] and b[3] - reach <= a[3] + a[5]  # noqa: B023, E731
        assert got == sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(rows[:-2], 2) if a[0] == b[0] and near(a, b))


def test_merging_reaches_on(spark):
    # 0 and 1 merge; only their common box reaches 2; 3 stays alone and small
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 150), (1, 1, 40.0, 200.0 - 160, 10.0, 10.0, 60), (1, 2, 0.0, 85.0, 10.0, 10.0, 1), (1, 3, 500.0, 500.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "frame_id int, prim_idx int, x double, y double, width double, height double, pixels int")
    got = [(r.cluster, r.boxes, r.pixels, r.kept, r.position, r.x0, r.y1) for r in pixels.merge_boxes(df).orderBy("position").collect()]
    assert got == [(0, 3, 211, True, 1, 0.0, 100.0), (3, 1, 1, False, 2, 495.0, 506.0)]


def test_a_spiral_is_one_component(spark):
    art = ["#########", "#.......#", "#.#####.#", "#.#...#.#", "#.###.#.#", "#.....#.#", "#######.#", ".......#."]
    px = [(1, x, y) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"]
    c = pixels.connected_components(spark.createDataFrame(px, "image int, x int, y int"), spark.createDataFrame([(1, 9, 8)], "image int, width int, height int")).orderBy("area").collect()
    assert [(r.area, r.label) for r in c] == [(1, 7 * 2**32 + 7), (len(px) - 1, 0)]


def test_ingest_has_no_nested_loop(spark):
    files = spark.createDataFrame([("a", ".JPG", 10, 100, 100, {"d": "x", "ok": "true"}), ("b", ".jpg", 10, 100, 100, {"ok": "false", "d": ""}), ("c", ".jpg", 11, 0, 100, None), ("d", ".jpg", None, 100, 100, None)], "file string, extension string, size long, width int, height int, metadata map<string,string>")
    cases = spark.createDataFrame([(2, "wide", ".jpg", 10, 1, 1, 10**9, 10**9, ["d"], ["ok"]), (1, "narrow", ".jpg", 10, 100, 100, 100, 100, ["d"], ["ok"]), (0, "none", ".jpg", 10, 9, 9, 3, 3, [], [])], "ord int, name string, extension string, max_size long, min_width int, min_height int, max_width int, max_height int, required_metadata array<string>, required_assumptions array<string>")
    df = intake.match_ingest_case(files, cases)
    assert {(r.file, r.case, r.verdict) for r in df.collect()} == {("a", "narrow", "ACCEPTED"), ("b", "narrow", "REJECTED_ASSUMPTION_VIOLATED"), ("c", None, "REJECTED_NO_MATCHING_CASE"), ("d", None, "REJECTED_NO_MATCHING_CASE")}
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_repeated_pages_are_no_permutation(spark):
    def verdict(pages, contract):
        c = spark.createDataFrame([("s", i, p) for i, p in enumerate(pages)], "sequence string, position int, signature string")
        k = spark.createDataFrame([("s", i, p) for i, p in enumerate(contract)], c.schema)
        return matching.validate_sequence(c, k).first().verdict

    assert verdict("abc", "abc") == "SEQUENCE_SATISFIED" and verdict("bca", "abc") == "WRONG_PAGE_ORDER" and verdict("aab", "aba") == "PAGE_MATCH_FAILED"
    assert verdict("aab", "aab") == "SEQUENCE_SATISFIED" and verdict(["a", None, "c"], "abc") == "PAGE_MATCH_FAILED" and verdict("ab", "abc") == "WRONG_PAGE_COUNT"


def test_stripes_at_their_centres(spark):
    rows = [("s", i, [250.0 if b else 5.0] * 4, False) for i, b in enumerate(b for b in (1, 0, 1, 0, 1, 1, 1) for _ in range(3))]
    df = spark.createDataFrame(rows, "signal string, row_idx int, channels array<double>, is_float boolean")
    slots = spark.createDataFrame([("s", 7), ("t", 7)], "signal string, slots int")
    got = {r.signal: (r.bits, r.payload, r.route, r.verdict) for r in signals.decode_stripes(df, slots, row_us=1000 / 3).collect()}
    assert got == {"s": ("1010111", "0111", "containment", "DECODED"), "t": (None, None, None, "STRIPE_ERROR")}
    both = signals.fuse_channels(spark.createDataFrame([("p", 4)], "payload_id string, length int"), *[spark.createDataFrame(r, "payload_id string, payload string, route string, verdict string") for r in ([("p", "0111", "containment", "DISPATCHED")], [])], allow_fallback=False)
    assert [(r.verdict, r.source, r.payload) for r in both.collect()] == [("FALLBACK_DENIED", "none", None)]


def test_vectors_of_symbols(spark):
    import hashlib
    import struct

    def plain(symbol, dim):
        bits = [1 if (byte >> k) & 1 else -1 for c in range(-(-dim // 256)) for byte in hashlib.sha256(f"{hypervectors.SEED}{symbol}".encode() + struct.pack(">I", c)).digest() for k in range(8)]
        return bits[:dim]

    book = hypervectors.codebook(spark.createDataFrame([("a",), ("é",), ("a",)], "symbol string"), 600)
    vs = {r.symbol: r.v for r in book.collect()}
    assert vs == {s: plain(s, 600) for s in ("a", "é")}
    members = spark.createDataFrame([("s", 0, "a"), ("s", 1, "é"), ("s", 601, "a"), ("t", 0, "missing")], "id string, position int, symbol string")
    got = {r.id: (r.members, r.unknown, r.v) for r in hypervectors.encode_ordered_set(members, book, "id").collect()}
    shifted = [vs["a"], vs["é"][-1:] + vs["é"][:-1], vs["a"][-1:] + vs["a"][:-1]]
    assert got == {"s": (3, 0, [1 if sum(x) >= 0 else -1 for x in zip(*shifted)]), "t": (1, 1, None)}
    empty = vectors.cleanup(book.select(F.col("symbol").alias("id"), "v"), book.limit(0))
    assert {r.verdict for r in empty.collect()} == {"ERROR"}


def test_clean_up_compares_words_of_signs(spark):
    """Sizes that fill no word; queries travel as words, not as arrays of elements."""
    for dim in (1, 63, 64, 70, 130):
        rnd = random.Random(dim)
        vs = {s: [rnd.choice((1, -1)) for _ in range(dim)] for s in "abcq"}
        df = spark.createDataFrame(list(vs.items()), "symbol string, v array<int>")
        queries = df.filter("symbol = 'q'").select(F.lit(1).alias("id"), "v")
        top = vectors.top_k_symbols(queries, df.filter("symbol <> 'q'"))
        want = sorted((-sum(x * y for x, y in zip(vs["q"], vs[s])) / dim, s) for s in "abc")
        assert [(-r.similarity, r.symbol) for r in top.orderBy("rank").collect()] == want
    assert "bit_count" in top._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_set_makes_no_row_an_element(spark):
    book = spark.createDataFrame([("a", [1] * 69 + [-1]), ("b", [-1] * 70)], "symbol string, v array<int>")
    members = spark.range(30_000).select(F.lit("s").alias("id"), F.col("id").cast("int").alias("position"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "none").otherwise("a").alias("symbol"))
    got = hypervectors.encode_ordered_set(members.unionByName(members.limit(1).select(F.lit(None).cast("string").alias("id"), "position", F.lit("b").alias("symbol"))), book, "id")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    sums = [0] * 70
    for p in range(30_000):
        for i in range(70):
            if p % 3 != 1:
                sums[(i + p) % 70] += -1 if p % 3 == 0 or i == 69 else 1
    assert {r.id: (r.members, r.unknown, r.v) for r in got.collect()} == {"s": (30_000, 10_000, [1 if s >= 0 else -1 for s in sums]), None: (1, 0, [-1] * 70)}


@pytest.mark.parametrize("ops,verdict", [([("ADJACENT", 0, 1)], "PASS"), ([("ADJACENT", 0, 2)], "FAIL"), ([("ADJACENT", 0, 9)], "EMPTY"), ([("ADJACENT", 1, 1)], "SKIPPED"), ([("CONTAINS", 1, 0)], "FAIL"), ([], "EMPTY")])
def test_process_frames(spark, ops, verdict):
    p = spark.createDataFrame([(1, i, "REGION", x, 0.0, w, 10.0, 1.0) for i, (x, w) in enumerate([(0.0, 10.0), (5.0, 0.0), (12.0, 10.0), (500.0, 10.0)])], "frame_id int, prim_idx int, kind string, x double, y double, width double, height double, confidence double")
    o = spark.createDataFrame([(1, *op) for op in ops], "frame_id int, op string, a_idx int, b_idx int")
    b = spark.createDataFrame([(1, 0, "n")], "frame_id int, prim_idx int, name string")
    assert [(r.n_parsed, r.verdict, r.calibration) for r in spatial.process_frames(p, o, b).collect()] == [(3, verdict, "UNCALIBRATED")]


def test_small_frames_merge_inside_tasks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f, i, float(rng.randrange(400)), float(rng.randrange(400)), float(rng.randrange(60)), float(rng.randrange(60)), rng.randrange(200)) for f in range(120) for i in range(rng.randrange(1, 12))]
    rows += [(500, 0, None, 1.0, 1.0, 1.0, 5), (500, 1, 1.0, 1.0, 1.0, 1.0, None), (501, None, 1.0, 1.0, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "frame_id long, prim_idx int, x double, y double, width double, height double, pixels int")
    monkeypatch.setattr(pixels, "SMALL_FRAME", 0)
    by_grid = sorted(map(tuple, pixels.merge_boxes(df).collect()), key=str)
    monkeypatch.setattr(pixels, "SMALL_FRAME", 64)
    assert sorted(map(tuple, pixels.merge_boxes(df).collect()), key=str) == by_grid
    # no round of the grid for frames that a task holds
    monkeypatch.setattr(pixels, "star_components", None)
    monkeypatch.setattr(pixels, "close_pairs", None)
    assert pixels.merge_boxes(df.filter("frame_id < 500")).count() == len([r for r in by_grid if r[0] < 500])


def test_manifest_escapes_what_needs_it(spark):
    sessions = spark.createDataFrame([(1, "d", "c")], "session long, description string, created_at string")
    row = ("a.jpg", ".jpg", 5, 2, 3, "case", "tier", 'cam "é"', "t", {"k\\": "v", "n": None})
    shape = "session long, position int, file_ref string, file_ext string, size long, width int, height int, case string, tier string, device string, captured_at string, metadata map<string,string>"
    files = spark.createDataFrame([(1, 0, *row), (1, 1, "b.jpg", *row[1:7], None, "t", {})], shape)
    records = [{"capture_device": d, "capture_timestamp": "t", "evidence_tier": "tier", "file_ext": ".jpg", "file_ref": r, "file_size_bytes": 5, "ingest_case_name": "case", "metadata": m, "resolution": "2x3"} for d, r, m in ((row[7], "a.jpg", {"k\\": "v", "n": "None"}), ("", "b.jpg", {}))]
    whole = {"created_at": "c", "description": "d", "file_count": 2, "finalized": False, "manifest_hash": "", "records": records, "session_id": "1", "version": "V1.0"}
    (m,) = intake.session_manifest(sessions, files).collect()
    assert m.manifest_hash == hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_groups_are_dealt_once(spark):
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    rows = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("position"), F.sha2(F.col("id").cast("string"), 256).alias("signature")).repartition(3, "g")
    assert exchanges(signatures.signed_sequences(rows, ["g"], "position", "signature", F.lit("s"))) == 1
    assert exchanges(matching.validate_sequence(rows, rows, "g")) == 2  # one a side


def test_order_against_pairs(spark):
    rng = random.Random(3)
    sides = [[(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([1, 2, 3, None]), rng.choice("abcd") if rng.random() < 0.9 else None) for _ in range(n)] for n in (24, 18)]
    df = [spark.createDataFrame(s, "sequence long, position int, signature string") for s in sides]
    got = {r.sequence: (r.n, r.expected, r.matched, r.first_failed) for r in matching.validate_sequence(*df).collect()}
    wanted = {}
    for g in {s for s, _, _ in sides[0]} - {None}:
        mine, named = ([r[1:] for r in s if r[0] == g] for s in sides)
        met = [(p, s, w) for p, s in mine for w in ([w for q, w in named if q == p and p is not None] or [None])]
        missed = [p for p, s, w in met if not (s is not None and s == w) and p is not None]
        wanted[g] = (len(mine), len(named) or None, len(met) - sum(not (s is not None and s == w) for _, s, w in met), min(missed, default=None))
    assert got == wanted
