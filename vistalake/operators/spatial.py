"""Boxes of one frame: validity, distance, containment and the frame's verdict.

All take ``primitives``: frame_id, prim_idx, kind, x, y, width, height, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistalake.functions import law
from vistalake.operators.grid import close_pairs

BOX = ("x", "y", "width", "height")


def bbox_columns(df: DataFrame) -> DataFrame:
    """Adds x2, y2, cx, cy and area."""
    x, y, w, h = map(F.col, BOX)
    return df.withColumns({"x2": x + w, "y2": y + h, "cx": x + w / 2, "cy": y + h / 2, "area": w * h})


def valid_primitives(df: DataFrame, min_area: float = law.MIN_AREA) -> DataFrame:
    """Keeps boxes with positive sides and at least ``min_area``; a null side is invalid."""
    w, h = F.col("width"), F.col("height")
    return df.filter((w > 0) & (h > 0) & (w * h >= min_area))


def edge_distance(a: str, b: str) -> Column:
    """Euclidean gap between the edges of two boxes given by column prefix; 0 when they touch or overlap."""

    def gap(lo: str, side: str) -> Column:
        a1, b1 = F.col(f"{a}{lo}"), F.col(f"{b}{lo}")
        return F.greatest(F.lit(0.0), b1 - (a1 + F.col(f"{a}{side}")), a1 - (b1 + F.col(f"{b}{side}")))

    return F.sqrt(F.pow(gap("x", "width"), 2) + F.pow(gap("y", "height"), 2))


def containment_margin(outer: str, inner: str) -> Column:
    """Least of the four margins of ``inner`` inside ``outer``; negative when it sticks out."""
    o, i = (lambda c: F.col(f"{outer}{c}")), (lambda c: F.col(f"{inner}{c}"))
    return F.least(i("x") - o("x"), i("y") - o("y"), o("x") + o("width") - i("x") - i("width"), o("y") + o("height") - i("y") - i("height"))


def relation_status(a: str, b: str) -> Column:
    sure = (F.col(f"{a}confidence") >= 1.0) & (F.col(f"{b}confidence") >= 1.0)
    return F.when(sure, law.DETERMINISTIC).otherwise(law.HEURISTIC)


def neighbours(primitives: DataFrame) -> DataFrame:
    """Each valid primitive with the next valid one of its frame in index order (prefix ``n_``): one window, no join."""
    kept = valid_primitives(primitives).select("frame_id", "prim_idx", "kind", *BOX, "confidence")
    order = Window.partitionBy("frame_id").orderBy("prim_idx")
    after = {f"n_{c}": F.lead(c).over(order) for c in ("prim_idx", *BOX, "confidence")}
    return kept.withColumns(after)


def adjacent_neighbours(primitives: DataFrame, max_px: float = law.ADJACENT_MAX_PX) -> DataFrame:
    """The relation ADJACENT of every neighbouring pair: frame_id, a_idx, b_idx, measured, result, status."""
    pairs = neighbours(primitives).filter(F.col("n_prim_idx").isNotNull())
    return pairs.select(
        "frame_id",
        F.col("prim_idx").alias("a_idx"),
        F.col("n_prim_idx").alias("b_idx"),
        (d := edge_distance("", "n_")).alias("measured"),
        (d <= max_px).alias("result"),
        relation_status("", "n_").alias("status"),
    )


def frame_verdict(primitives: DataFrame, max_px: float = law.ADJACENT_MAX_PX) -> DataFrame:
    """One row per frame that has rows: EMPTY without a pair, FAIL with a false relation, else PARTIAL when an input is heuristic, else PASS.

    The frame is kept when none of its primitives is valid.
    """
    seen = primitives.withColumn("ok", (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") * F.col("height") >= law.MIN_AREA))
    seen = seen.withColumn("ok", F.coalesce("ok", F.lit(False)))
    # valid rows of a frame stand together, so that lead() meets only valid ones
    order = Window.partitionBy("frame_id").orderBy(F.col("ok").desc(), "prim_idx")
    after = seen.withColumns({f"n_{c}": F.lead(c).over(order) for c in ("ok", *BOX, "confidence")})
    pair = F.col("ok") & F.col("n_ok")
    return (
        after.withColumns({"pair": F.coalesce(pair, F.lit(False)), "hit": edge_distance("", "n_") <= max_px, "status": relation_status("", "n_")})
        .groupBy("frame_id")
        .agg(
            F.count_if("ok").alias("n_primitives"),
            F.count_if("pair").alias("n_assertions"),
            F.count_if(F.col("pair") & F.col("hit")).alias("n_true"),
            F.count_if(F.col("pair") & ~F.col("hit")).alias("n_false"),
            F.count_if(F.col("pair") & (F.col("status") == law.HEURISTIC)).alias("n_heuristic"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("n_assertions") == 0, law.EMPTY).when(F.col("n_false") > 0, law.FAIL).when(F.col("n_heuristic") > 0, law.PARTIAL).otherwise(law.PASS),
        )
    )


def near_pairs(primitives: DataFrame, max_px: float = law.ADJACENT_MAX_PX) -> DataFrame:
    """Pairs of valid boxes of a frame that are at most ``max_px`` apart, each once, with all box columns (prefixes a_ and b_): met on a grid, no all-pairs join of a frame."""
    pairs = close_pairs(valid_primitives(primitives), "frame_id", "prim_idx", ["kind", "confidence"], max_px)
    return pairs.filter(edge_distance("a_", "b_") <= max_px)


def adjacent(primitives: DataFrame, max_px: float = law.ADJACENT_MAX_PX) -> DataFrame:
    """All TRUE relations ADJACENT: frame_id, i < j, measured, status. How many are FALSE follows from the number of pairs."""
    pairs = near_pairs(primitives, max_px)
    return pairs.select(
        "frame_id",
        F.least("a_prim_idx", "b_prim_idx").alias("i"),
        F.greatest("a_prim_idx", "b_prim_idx").alias("j"),
        edge_distance("a_", "b_").alias("measured"),
        relation_status("a_", "b_").alias("status"),
    )


def contains(primitives: DataFrame, margin: float = law.CONTAINS_MIN_MARGIN_PX) -> DataFrame:
    """All TRUE relations CONTAINS, in either direction: frame_id, outer_idx, inner_idx, measured (the least of four margins)."""
    pairs = near_pairs(primitives, 0.0)
    out = None
    for o, i in (("a_", "b_"), ("b_", "a_")):
        some = pairs.select("frame_id", F.col(f"{o}prim_idx").alias("outer_idx"), F.col(f"{i}prim_idx").alias("inner_idx"), containment_margin(o, i).alias("measured"), relation_status(o, i).alias("status"))
        out = some if out is None else out.unionByName(some)
    return out.filter(F.col("measured") >= margin)


def frame_summary(primitives: DataFrame) -> DataFrame:
    """Per frame: primitives, valid ones, relations of all pairs (three each), TRUE ones of both kinds."""
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") * F.col("height") >= law.MIN_AREA)
    frames = primitives.groupBy("frame_id").agg(F.count("*").alias("n_primitives"), F.count_if(ok).alias("n_valid"))
    # a box inside another is no distance from it: one pass over near pairs gives both relations
    inside = sum((F.count_if(containment_margin(o, i) >= law.CONTAINS_MIN_MARGIN_PX) for o, i in (("a_", "b_"), ("b_", "a_"))), F.lit(0))
    near = near_pairs(primitives).groupBy("frame_id").agg(F.count("*").alias("adjacent_true"), inside.alias("contains_true"))
    return (
        frames.join(near, "frame_id", "left")
        .select("frame_id", "n_primitives", "n_valid", F.expr("n_valid * (n_valid - 1) div 2 * 3").alias("n_relations"), F.coalesce("adjacent_true", F.lit(0)).alias("adjacent_true"), F.coalesce("contains_true", F.lit(0)).alias("contains_true"))
    )


def margin_headroom(relations: DataFrame, threshold: float = law.ADJACENT_MAX_PX) -> DataFrame:
    """Adds how far an ADJACENT relation (measured, result) is from flipping, and the jitter under which it is stable."""
    headroom = F.when(F.col("result"), F.lit(threshold) - F.col("measured")).otherwise(F.col("measured") - threshold)
    return relations.withColumn("headroom", headroom).withColumn("stable_under", F.when(F.col("headroom") > 0, F.col("headroom") / 2).otherwise(0.0))


def bind(primitives: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings (frame_id, name, prim_idx) whose primitive exists and is valid, with its kind and centre."""
    boxes = bbox_columns(valid_primitives(primitives)).select("frame_id", "prim_idx", "kind", "cx", "cy")
    return bindings.join(boxes, ["frame_id", "prim_idx"]).select("frame_id", "name", "prim_idx", "kind", "cx", "cy")


def _ill_typed() -> dict[str, Column]:
    """Aggregates over operations with the areas of their boxes."""
    smaller = (F.col("op") == "CONTAINS") & (F.col("a_area") < F.col("b_area"))
    return {"n_self": F.count_if(F.col("a_idx") == F.col("b_idx")), "n_area": F.count_if(smaller)}


def type_check_frames(primitives: DataFrame, operations: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per frame: violations by rule and verdict EMPTY (no primitive), ILL_TYPED or WELL_TYPED.

    ``operations``: frame_id, op, a_idx, b_idx. Rules: an invalid primitive; an operation of a primitive with itself; CONTAINS with
    a smaller outer box; a blank binding name. Operations on missing primitives are skipped.
    """
    boxes = bbox_columns(primitives)
    side = lambda p: boxes.select("frame_id", F.col("prim_idx").alias(f"{p}_idx"), F.col("area").alias(f"{p}_area"))
    ops = operations.join(side("a"), ["frame_id", "a_idx"]).join(side("b"), ["frame_id", "b_idx"])
    return _type_verdicts(primitives, ops.groupBy("frame_id").agg(*[v.alias(k) for k, v in _ill_typed().items()]), bindings)


def _type_verdicts(primitives: DataFrame, by_op: DataFrame, bindings: DataFrame) -> DataFrame:
    boxes = bbox_columns(primitives)
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("area") >= law.MIN_AREA)
    frames = boxes.groupBy("frame_id").agg(F.count("*").alias("n_primitives"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_invalid"))
    blank = bindings.groupBy("frame_id").agg(F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("n_blank"))
    counts = ["n_invalid", "n_self", "n_area", "n_blank"]
    all_ = frames.join(by_op, "frame_id", "left").join(blank, "frame_id", "left").fillna(0, counts)
    bad = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return all_.select("frame_id", "n_primitives", *counts, F.when(F.col("n_primitives") == 0, "EMPTY").when(bad > 0, "ILL_TYPED").otherwise("WELL_TYPED").alias("verdict"))


def reading_order(boxes: DataFrame, band: float = 80.0) -> DataFrame:
    """Position of each box of a frame by bands of centre y, then centre x, then index."""
    b = bbox_columns(boxes).withColumn("row_band", F.floor(F.col("cy") / band))
    order = Window.partitionBy("frame_id").orderBy("row_band", "cx", "prim_idx")
    return b.select("frame_id", "prim_idx", "row_band", "cx", F.row_number().over(order).alias("position"))


def calibration_factors(profiles: DataFrame) -> DataFrame:
    """Profiles (profile, megapixels, noise, distortion, distance) with the ceiling that they set on confidence; null for an invalid one."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    mp, far = F.col("megapixels"), F.col("distance") - law.DISTANCE_BASE_M
    bonus = F.when(mp > 0, F.least(F.greatest(F.log2(F.greatest(mp, F.lit(0.1)) / law.RESOLUTION_BASE_MP) * law.RESOLUTION_PER_DOUBLING, F.lit(0.0)), F.lit(law.RESOLUTION_MAX))).otherwise(0.0)
    away = F.when(far > 0, far * law.DISTANCE_DECAY).otherwise(0.0)
    ceiling = law.CEILING_MAX + bonus - away - unit("noise") * law.NOISE_FACTOR - unit("distortion") * law.DISTORTION_FACTOR
    valid = (mp > 0) & (F.col("distance") >= 0)
    return profiles.withColumns({"bonus": bonus, "distance_penalty": away, "ceiling": F.when(valid, F.greatest(F.lit(law.CEILING_FLOOR), F.least(F.lit(1.0), ceiling)))})


def _calibrated(primitives: DataFrame, profiles: DataFrame) -> DataFrame:
    """The primitives with raw, calibrated and verdict."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    known = primitives.join(calibration_factors(profiles).select("profile", "ceiling"), "profile", "left").withColumn("raw", raw)
    capped = F.col("raw") > F.col("ceiling")
    verdict = F.when(F.col("ceiling").isNull(), "INVALID_PROFILE").when(~capped, "UNCAPPED").when(F.col("ceiling") < law.DEGRADED_BELOW, "DEGRADED").otherwise("CALIBRATED")
    told = known.withColumn("verdict", verdict)
    return told.withColumn("calibrated", F.when(F.col("verdict") != "INVALID_PROFILE", F.least("raw", "ceiling")).otherwise(F.lit(0.0)))


def calibrate(primitives: DataFrame, profiles: DataFrame) -> DataFrame:
    """Primitives (with a column profile) whose confidence the profile's ceiling caps; verdict INVALID_PROFILE for an unknown or invalid one."""
    return _calibrated(primitives, profiles).select("frame_id", "prim_idx", "profile", "raw", "calibrated", "verdict")


def indexed(primitives: DataFrame) -> DataFrame:
    """The valid primitives of each frame, numbered anew from 0 in their order: what operations and bindings refer to."""
    order = Window.partitionBy("frame_id").orderBy("prim_idx")
    return valid_primitives(primitives).withColumn("prim_idx", F.row_number().over(order) - 1)


def _met(primitives: DataFrame, operations: DataFrame) -> DataFrame:
    """The operations whose two primitives a frame has, with the columns of both (prefixes a_ and b_)."""
    side = lambda p: primitives.select("frame_id", *[F.col(c).alias(f"{p}{c}") for c in (*BOX, "confidence")], F.col("prim_idx").alias(f"{p}idx"))
    return operations.join(side("a_"), ["frame_id", "a_idx"]).join(side("b_"), ["frame_id", "b_idx"])


def _applied(met: DataFrame, max_px: float, margin: float) -> DataFrame:
    near = F.col("op") == "ADJACENT"
    measured = F.when(near, edge_distance("a_", "b_")).otherwise(containment_margin("a_", "b_"))
    result = F.when(near, measured <= max_px).otherwise(measured >= margin)
    return met.withColumns({"measured": measured, "result": result, "status": relation_status("a_", "b_")})


def apply_operations(primitives: DataFrame, operations: DataFrame, max_px: float = law.ADJACENT_MAX_PX, margin: float = law.CONTAINS_MIN_MARGIN_PX) -> DataFrame:
    """frame_id, op, a_idx, b_idx, measured, result, status of the operations (frame_id, op, a_idx, b_idx) ADJACENT and CONTAINS on indexed primitives. An
    operation on a primitive that a frame lacks, or of another name, is skipped; a null index is none."""
    met = _met(primitives, operations.filter(F.col("op").isin("ADJACENT", "CONTAINS")))
    return _applied(met, max_px, margin).select("frame_id", "op", "a_idx", "b_idx", "measured", "result", "status")


def process_frames(primitives: DataFrame, operations: DataFrame, bindings: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """frame_id, calibration, n_parsed, n_assertions, n_true, n_false, n_heuristic, type_verdict, verdict: the whole chain of a frame.

    With ``profiles``, confidences are first capped by the frame's profile (column profile of the primitives; an unknown one leaves no confidence). Invalid primitives go and
    the others are numbered anew; operations are evaluated, the frame is checked, and only a well-typed frame gets EMPTY, FAIL, PARTIAL or PASS, another one SKIPPED. Frames without a valid
    primitive stay. All joins are by frame.
    """
    frames = primitives.select("frame_id").distinct()
    if profiles is not None:
        primitives = _calibrated(primitives.dropna(subset=["frame_id", "prim_idx"]), profiles).withColumn("confidence", F.col("calibrated")).select(*primitives.columns)
    parsed = indexed(primitives)
    # operations meet their boxes once: what they give and what is wrong with them is counted together
    met = _applied(_met(parsed, operations), law.ADJACENT_MAX_PX, law.CONTAINS_MIN_MARGIN_PX).withColumns({f"{p}_area": F.col(f"{p}_width") * F.col(f"{p}_height") for p in "ab"})
    named = F.col("op").isin("ADJACENT", "CONTAINS")
    told = met.groupBy("frame_id").agg(
        F.count_if(named).alias("n_assertions"), F.count_if(named & F.col("result")).alias("n_true"), F.count_if(named & ~F.col("result")).alias("n_false"), F.count_if(named & (F.col("status") == law.HEURISTIC)).alias("n_heuristic"),
        *[v.alias(k) for k, v in _ill_typed().items()],
    )
    applied = told.drop("n_self", "n_area")
    bound = bindings.join(parsed.select("frame_id", "prim_idx"), ["frame_id", "prim_idx"], "left_semi")
    checked = _type_verdicts(parsed, told.select("frame_id", "n_self", "n_area"), bound).select("frame_id", F.col("n_primitives").alias("n_parsed"), F.col("verdict").alias("type_verdict"))
    counts = ["n_assertions", "n_true", "n_false", "n_heuristic"]
    all_ = frames.join(checked, "frame_id", "left").join(applied, "frame_id", "left").fillna(0, ["n_parsed", *counts]).fillna("EMPTY", ["type_verdict"])
    ran = F.when(F.col("n_assertions") == 0, law.EMPTY).when(F.col("n_false") > 0, law.FAIL).when(F.col("n_heuristic") > 0, law.PARTIAL).otherwise(law.PASS)
    verdict = F.when(F.col("type_verdict") == "ILL_TYPED", "SKIPPED").otherwise(ran)
    return all_.select("frame_id", F.lit("UNCALIBRATED" if profiles is None else "CALIBRATED").alias("calibration"), "n_parsed", *counts, "type_verdict", verdict.alias("verdict"))
