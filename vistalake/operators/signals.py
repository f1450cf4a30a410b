"""Signals in time: stripes of rolling shutters and colour samples, decoded to bits, routed and fused.

``samples``: signal, row_idx (from 0), channels (array of doubles), is_float. Decoding only; slots are sampled by arithmetic on row positions, so no
row meets a table of slots, and what a signal is follows from facts of one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the two transports.
RATE_HZ, ROW_READOUT_US, STRIPE_THRESHOLD, STRIPE_SYNC, STRIPE_LENGTHS = 1000, 25.0, 128, "101", (4, 5, 6, 7, 8)
CHROMA_SYNC, CHROMA_PAIR, CHROMA_THRESHOLD = "010", "cyan_red", 0.0
COLOR_PAIRS = {"cyan_red": ((0, 255, 255), (255, 0, 0)), "magenta_green": ((255, 0, 255), (0, 255, 0)), "yellow_blue": ((255, 255, 0), (0, 0, 255))}
ROUTES = {"00": "adjacent_pair", "01": "containment", "10": "three_regions"}
FUSED_LENGTHS = (4, 5, 6)
DISPATCH_VERSION = "V1.0"
STRIPES, CHROMA = "rolling_shutter", "complementary_color"


def _bits(order: str, bit: Column) -> Column:
    """Aggregate: bits in their order as a text of 0 and 1, one for each slot or sample of one signal."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), bit.cast("string").alias("bit")))), lambda s: s["bit"]), "")


def _read(decoded: DataFrame, sync: str, failed: str) -> DataFrame:
    """signal, bits, payload, route, verdict from signal and bits (null where decoding failed): ``failed``, SYNC_FAILED, ROUTE_FAILED or DECODED."""
    payload = F.when(F.col("bits").startswith(sync), F.substring(F.col("bits"), len(sync) + 1, 2**31 - 1))
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    route = F.try_element_at(table, F.substring(F.col("payload"), 1, 2))
    verdict = F.when(F.col("bits").isNull(), failed).when(F.col("payload").isNull(), "SYNC_FAILED").when(F.col("route").isNull(), "ROUTE_FAILED").otherwise("DECODED")
    return decoded.withColumn("payload", payload).withColumn("route", route).withColumn("verdict", verdict).select("signal", "bits", "payload", "route", "verdict")


def decode_stripes(samples: DataFrame, slots: DataFrame, rate_hz: float = RATE_HZ, row_us: float = ROW_READOUT_US, threshold: float = STRIPE_THRESHOLD) -> DataFrame:
    """signal, bits, payload, route, verdict of the signals of ``slots`` (signal, slots: how many to read).

    A slot spans as many rows as its time takes to read; its bit is 1 where the mean of its centre row reaches the threshold. Less than one row a slot, a
    slot beyond the rows, a centre row that is missing or has no channels: STRIPE_ERROR, as for no slot at all.
    """
    per = 1_000_000.0 / rate_hz / row_us
    slot = F.floor(F.col("row_idx") / per).cast("int")
    # the centre of slot k lies in [k * per, (k + 1) * per): a row is a centre of its own slot or of none
    centre = F.floor((F.col("slot") + 0.5) * per) == F.col("row_idx")
    level = F.aggregate("channels", F.lit(0.0), lambda s, x: s + x) / F.size("channels")
    given = samples.withColumn("slot", slot).filter(centre & (F.size("channels") > 0)) if per >= 1 else samples.limit(0).withColumn("slot", slot)
    read = given.join(slots, "signal").filter(F.col("slot") < F.col("slots")).groupBy("signal").agg(F.countDistinct("slot").alias("n"), _bits("slot", F.when(level >= threshold, 1).otherwise(0)).alias("read"))
    whole = slots.join(read, "signal", "left").withColumn("bits", F.when((F.col("n") == F.col("slots")) & (F.col("slots") > 0), F.col("read")))
    return _read(whole, STRIPE_SYNC, "STRIPE_ERROR")


def decode_chroma(samples: DataFrame, pair: str = CHROMA_PAIR, threshold: float = CHROMA_THRESHOLD) -> DataFrame:
    """signal, bits, payload, route, verdict: a sample's bit is 0 on the side of the pair's first colour and 1 on the other's; a sample on the midpoint, or
    without three channels, fails its whole signal (CHROMINANCE_ERROR)."""
    first, second = COLOR_PAIRS[pair]
    size = sum((a - b) ** 2 for a, b in zip(first, second, strict=True)) ** 0.5
    along = F.lit(0.0)
    for k, (a, b) in enumerate(zip(first, second, strict=True)):
        along = along + (F.col("channels")[k] - (a + b) / 2.0) * ((a - b) / size)
    sound = F.size("channels") == 3
    bit = F.when(sound & (along > threshold), 0).when(sound & (along < -threshold), 1)
    read = samples.withColumn("bit", bit).groupBy("signal").agg(F.count("*").alias("n"), F.count("bit").alias("k"), _bits("row_idx", F.col("bit")).alias("read"))
    return _read(read.withColumn("bits", F.when(F.col("n") == F.col("k"), F.col("read"))), CHROMA_SYNC, "CHROMINANCE_ERROR")


def identify_mode(samples: DataFrame) -> DataFrame:
    """signal, elements, mode: complementary_color where all rows are three floats, rolling_shutter where all are whole numbers of one length above three, else null."""
    wide = F.coalesce(F.size("channels"), F.lit(0))
    per = samples.groupBy("signal").agg(F.count("*").alias("elements"), F.bool_and("is_float").alias("floats"), F.bool_or("is_float").alias("some"), F.min(wide).alias("least"), F.max(wide).alias("most"))
    mode = F.when(F.col("floats") & (F.col("least") == 3) & (F.col("most") == 3), CHROMA).when(~F.col("some") & (F.col("least") == F.col("most")) & (F.col("least") > 3), STRIPES)
    return per.select("signal", "elements", mode.alias("mode"))


def dispatch_signals(signals: DataFrame, samples: DataFrame, rate_hz: float = RATE_HZ, row_us: float = ROW_READOUT_US) -> DataFrame:
    """signal, mode, elements, payload, route, inner, signature, verdict of all ``signals`` (signal, slots): EMPTY_SIGNAL without samples, UNKNOWN_MODE, DECODE_FAILED, ROUTE_FAILED or
    DISPATCHED. Null or non-positive slots stand for the sync strip and the longest payload."""
    longest = len(STRIPE_SYNC) + max(STRIPE_LENGTHS)
    modes = identify_mode(samples)
    known = signals.join(modes, "signal", "left").withColumn("slots", F.when(F.col("slots") > 0, F.col("slots")).otherwise(longest))
    of = lambda mode: samples.join(modes.filter(F.col("mode") == mode).select("signal"), "signal", "left_semi")
    stripes = decode_stripes(of(STRIPES), known.filter(F.col("mode") == STRIPES).select("signal", "slots"), rate_hz, row_us)
    read = stripes.unionByName(decode_chroma(of(CHROMA))).select("signal", "payload", "route", F.col("verdict").alias("inner"))
    met = known.join(read, "signal", "left")
    verdict = F.when(F.col("elements").isNull(), "EMPTY_SIGNAL").when(F.col("mode").isNull(), "UNKNOWN_MODE").when(F.col("inner") == "DECODED", "DISPATCHED").when(F.col("inner") == "ROUTE_FAILED", "ROUTE_FAILED").otherwise("DECODE_FAILED")
    commas = F.array_join(F.split("payload", ""), ",")
    signed = F.sha2(F.concat(F.lit("dispatch_mode="), "mode", F.lit("\npayload="), commas, F.lit(f"\nversion={DISPATCH_VERSION}")), 256)
    return met.select("signal", "mode", F.coalesce("elements", F.lit(0)).alias("elements"), "payload", "route", "inner", verdict.alias("verdict")).withColumn("signature", F.when(F.col("verdict") == "DISPATCHED", signed))


def fuse_channels(intended: DataFrame, stripes: DataFrame, chroma: DataFrame, allow_fallback: bool = True) -> DataFrame:
    """payload_id, payload, route, source, verdict for intended payloads (payload_id, length) and what each channel dispatched (payload_id, payload, route, verdict).

    EMPTY_PAYLOAD, UNSUPPORTED_LENGTH, then BOTH_AGREE, DISAGREE, RS_ONLY, CC_ONLY (FALLBACK_DENIED where one channel is not enough) or BOTH_FAILED. A channel without a row has
    failed; of rows that repeat a payload the smallest counts.
    """
    side = lambda df, p: df.filter("verdict = 'DISPATCHED'").groupBy("payload_id").agg(F.min(F.struct("payload", "route")).alias(p))
    met = intended.join(side(stripes, "rs"), "payload_id", "left").join(side(chroma, "cc"), "payload_id", "left")
    rs, cc = F.col("rs").isNotNull(), F.col("cc").isNotNull()
    one = lambda word: word if allow_fallback else "FALLBACK_DENIED"
    verdict = (
        F.when(F.coalesce("length", F.lit(0)) == 0, "EMPTY_PAYLOAD")
        .when(~F.col("length").isin(*FUSED_LENGTHS), "UNSUPPORTED_LENGTH")
        .when(rs & cc, F.when(F.col("rs.payload") == F.col("cc.payload"), "BOTH_AGREE").otherwise("DISAGREE"))
        .when(rs, one("RS_ONLY"))
        .when(cc, one("CC_ONLY"))
        .otherwise("BOTH_FAILED")
    )
    told = met.withColumn("verdict", verdict)
    chosen = F.when(F.col("verdict").isin("BOTH_AGREE", "RS_ONLY"), F.col("rs")).when(F.col("verdict") == "CC_ONLY", F.col("cc"))
    source = F.when(F.col("verdict") == "BOTH_AGREE", "both").when(F.col("verdict") == "RS_ONLY", STRIPES).when(F.col("verdict") == "CC_ONLY", CHROMA).when(~F.col("verdict").isin("EMPTY_PAYLOAD", "UNSUPPORTED_LENGTH"), "none")
    return told.withColumn("_chosen", chosen).select("payload_id", F.col("_chosen.payload").alias("payload"), F.col("_chosen.route").alias("route"), source.alias("source"), "verdict")
