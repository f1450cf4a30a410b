"""Cases that the given tables don't hold."""

import pytest

from vistalake.operators import delta, evidence, spatial, temporal

BOX = "frame_id long, prim_idx int, kind string, x double, y double, width double, height double, confidence double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, "REGION", *map(float, r[:4]), float(r[4]) if len(r) > 4 else 1.0) for i, r in enumerate(rows)], BOX)


@pytest.mark.parametrize(
    "b,gap",
    [((10, 0, 10, 10), 0.0), ((5, 5, 10, 10), 0.0), ((25, 0, 10, 10), 15.0), ((40, 0, 10, 10), 30.0), ((40.5, 0, 10, 10), None), ((28, 34, 5, 5), 30.0), ((31, 32, 5, 5), None), ((-40, 0, 10, 10), 30.0), ((0, -40, 10, 10), 30.0)],
)
def test_adjacent_at_and_beyond_the_threshold(spark, b, gap):
    got = [(r.i, r.j, r.measured) for r in spatial.adjacent(boxes(spark, (0, 0, 10, 10), b)).collect()]
    assert got == ([] if gap is None else [(0, 1, gap)])


def test_contains_is_not_symmetric(spark):
    got = {(r.outer_idx, r.inner_idx, r.measured) for r in spatial.contains(boxes(spark, (0, 0, 100, 100), (10, 10, 20, 20), (95, 95, 10, 10), (0, 0, 100, 100))).collect()}
    assert got == {(0, 1, 10.0), (3, 1, 10.0), (0, 3, 0.0), (3, 0, 0.0)}


def test_verdicts(spark):
    far, near = (500, 0, 10, 10), (12, 0, 10, 10)
    one = lambda *b: spatial.frame_verdict(boxes(spark, *b)).first().verdict
    assert one((0, 0, 10, 10)) == "EMPTY" and one((0, 0, 0, 10), (0, 0, 10, -1)) == "EMPTY"
    assert one((0, 0, 10, 10), near) == "PASS" and one((0, 0, 10, 10), near, far) == "FAIL"
    assert one((0, 0, 10, 10), (*near, 0.9)) == "PARTIAL"
    # an invalid box between two valid ones does not part them
    assert one((0, 0, 10, 10), (400, 400, 1, 1), near) == "PASS"


def test_more_than_two_hundred_boxes_all_count(spark):
    r = spatial.frame_verdict(boxes(spark, *[(i, 0, 10, 10) for i in range(450)])).first()
    assert (r.n_primitives, r.n_assertions, r.verdict) == (450, 449, "PASS")


def test_delta_verdicts(spark):
    def side(rows):
        return spark.createDataFrame([(1, n, k, float(x), 0.0, c) for n, k, x, c in rows], "frame_id long, name string, kind string, x double, y double, confidence double")

    base = [("a", "REGION", 0, 1.0), ("b", "EDGE", 5, 0.5)]
    cases = {
        "IDENTICAL": base,
        "WITHIN_TOLERANCE": [("a", "REGION", 5, 1.0), ("b", "EDGE", 5, 0.52)],
        "MISSING_PRIMITIVES": base[:1],
        "EXTRA_PRIMITIVES": [*base, ("c", "EDGE", 1, 1.0)],
        "MIXED": [("a", "EDGE", 0, 1.0), ("b", "EDGE", 5, 0.5)],
    }
    for verdict, rows in cases.items():
        assert delta.delta_verdict(delta.diff_primitives(side(base), side(rows))).first().verdict == verdict
    changed = spark.createDataFrame([(1, 0, 2)], "frame_id long, n_contracts int, n_signatures int")
    assert delta.delta_verdict(delta.diff_primitives(side(base), side(base)), changed).first().verdict == "DEGRADED"


def test_temporal_verdicts(spark):
    def verdict(rows):
        df = spark.createDataFrame([("s", i, v, float(x), n, 0.0, 0.0) for i, (v, x, n) in enumerate(rows)], "stream string, pos int, verdict string, value double, name string, cx double, cy double")
        return temporal.temporal_verdict(df).first().verdict

    p = ("PASS", 1, "a")
    assert verdict([p]) == "INSUFFICIENT" and verdict([p, ("FAIL", 1, "a")]) == "FLIPPED"
    assert verdict([p, ("PASS", 17, "a")]) == "DRIFTING" and verdict([p, ("PASS", 1, "b")]) == "DRIFTING"
    assert verdict([p, p]) == "CONSISTENT" and verdict([p, p, p]) == "CONFIRMED"


def test_all_temporal_verdicts_occur(spark):
    from vistalake.plans import catalog

    seen = {r.verdict for r in catalog.QUERIES["temporal_verdict"](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()}
    assert seen >= {"INSUFFICIENT", "FLIPPED", "DRIFTING"}
    assert {r.verdict for r in catalog.QUERIES["delta_verdict"](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()} == {"IDENTICAL", "WITHIN_TOLERANCE", "MISSING_PRIMITIVES", "EXTRA_PRIMITIVES", "MIXED", "DEGRADED"}
    assert {r.verdict for r in catalog.QUERIES["calibrate"](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()} == {"INVALID_PROFILE", "UNCAPPED", "DEGRADED", "CALIBRATED"}


def test_tiers_at_their_edges(spark):
    rows = spark.createDataFrame([(c, True, False, 0, "observed", None, "x") for c in (0.75, 0.45, 0.15, 0.14)], "confidence double, stable boolean, disagreement boolean, roles int, provenance string, expected string, predicted string")
    assert [r.tier for r in evidence.score_rows(rows).orderBy("confidence", ascending=False).collect()] == ["A", "B", "C", "D"]
