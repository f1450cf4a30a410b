"""Capture sessions: preflight checks, the ingest case of a file, and the manifest of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.functions import jsontext
from vistalake.operators import digests

# Fixed values.
MANIFEST_VERSION = "V1.0"
EXTENSIONS = (".jpg", ".png", ".tif")
FILE_NAME = r"^[a-zA-Z0-9_\-.]+$"
CONDITIONS = ("adequate_lighting", "subject_in_frame")
FILE_FIELDS = ("file_ref", "file_ext", "file_size_bytes", "width_px", "height_px", "capture_device", "capture_timestamp")
CHECKS = ("session_fields_present", "session_id_valid", "files_array_valid", "file_fields_complete", "file_extensions_allowed", "filenames_valid", "no_duplicate_files", "file_sizes_positive", "resolutions_valid", "conditions_declared")
ACCEPTED, NO_CASE, NO_METADATA, VIOLATED = "ACCEPTED", "REJECTED_NO_MATCHING_CASE", "REJECTED_MISSING_METADATA", "REJECTED_ASSUMPTION_VIOLATED"
CASE_SHAPE = ("extension", "max_size", "min_width", "min_height", "max_width", "max_height")


def _bin(width: Column) -> Column:
    """Bins by powers of two: a range of widths spans as many bins as its ends are doublings apart, 64 at most."""
    return F.floor(F.log2(F.greatest(width, F.lit(1)).cast("double"))).cast("int")


def match_ingest_case(files: DataFrame, cases: DataFrame) -> DataFrame:
    """file, case (name), missing, violated, verdict for files (file, extension, size, width, height, metadata map).

    A file's case is the first by ``ord`` of ``cases`` (ord, name, extension, max_size, min_width, ..., required_metadata, required_assumptions) with its extension, in lower case,
    and its size and sides in range. Each case is laid on the bins of widths that it spans and a file meets one bin; exact bounds decide afterwards. Spark broadcasts the cases only where their
    size, as it measures it, is below its threshold. A null size or side fits no case; a metadata value of null, '', '0' or 'false' satisfies no assumption.
    """
    laid = cases.withColumn("bin", F.explode(F.sequence(_bin(F.col("min_width")), _bin(F.col("max_width"))))).filter("min_width <= max_width")
    laid = laid.select(*[F.col(c).alias(f"_{c}") for c in CASE_SHAPE], "bin", F.struct("ord", "name", "required_metadata", "required_assumptions").alias("_case"))
    shape = files.select("file", F.lower("extension").alias("_extension"), "size", "width", "height", _bin(F.col("width")).alias("bin"))
    fits = (F.col("size") <= F.col("_max_size")) & F.col("width").between(F.col("_min_width"), F.col("_max_width")) & F.col("height").between(F.col("_min_height"), F.col("_max_height"))
    first = shape.join(laid, ["_extension", "bin"]).filter(fits).groupBy("file").agg(F.min_by("_case", F.struct("_case.ord", "_case.name")).alias("_case"))
    met = files.select("file", "metadata").join(first, "file", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    missing = F.array_except("_case.required_metadata", F.map_keys("metadata"))
    unmet = F.filter("_case.required_assumptions", lambda a: F.coalesce(F.lower(F.try_element_at("metadata", a)), F.lit("")).isin("", "0", "false"))
    verdict = F.when(F.col("case").isNull(), NO_CASE).when(F.size("missing") > 0, NO_METADATA).when(F.col("violated").isNotNull(), VIOLATED).otherwise(ACCEPTED)
    told = met.select("file", F.col("_case.name").alias("case"), missing.alias("missing"), F.try_element_at(unmet, F.lit(1)).alias("violated"))
    # an assumption counts only once the metadata is whole
    told = told.withColumn("violated", F.when(F.size("missing") == 0, F.col("violated")))
    return told.withColumn("verdict", verdict)


def preflight_sessions(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session, n_files, the ten checks as booleans, failed (names in order), verdict CLEARED or REJECTED.

    ``sessions``: session, session_id, description, created_at, conditions (map to booleans, or null where a session declares none: that passes when it has files). ``files``: session and FILE_FIELDS;
    a null stands for an absent field. Duplicates are counted by file and then by session, so a session of any size costs no array.
    """
    absent = F.lit(False)
    for c in FILE_FIELDS:
        absent = absent | F.col(c).isNull()
    bad = {
        "absent": absent,
        "extension": ~F.coalesce(F.lower("file_ext"), F.lit("")).isin(*EXTENSIONS),
        "name": ~F.coalesce("file_ref", F.lit("")).rlike(FILE_NAME),
        "size": ~F.coalesce(F.col("file_size_bytes") > 0, F.lit(False)),
        "sides": ~(F.coalesce(F.col("width_px") > 0, F.lit(False)) & F.coalesce(F.col("height_px") > 0, F.lit(False))),
    }
    by_ref = files.groupBy("session", F.coalesce("file_ref", F.lit("")).alias("ref")).agg(F.count("*").alias("k"), *[F.count_if(v).alias(c) for c, v in bad.items()])
    per = by_ref.groupBy("session").agg(F.sum("k").alias("n_files"), F.count_if(F.col("k") > 1).alias("repeated"), *[F.sum(c).alias(c) for c in bad])
    all_ = sessions.join(per, "session", "left").fillna(0, ["n_files", "repeated", *bad])
    n = F.col("n_files")
    declared = F.lit(True)
    for c in CONDITIONS:
        declared = declared & F.try_element_at("conditions", F.lit(c)).isNotNull()
    passed = [
        F.col("session_id").isNotNull() & F.col("description").isNotNull() & F.col("created_at").isNotNull() & (n > 0),
        F.trim(F.coalesce("session_id", F.lit(""))) != "",
        n > 0,
        *[F.col(c) == 0 for c in ("absent", "extension", "name", "repeated", "size", "sides")],
        F.when(F.col("conditions").isNull(), n > 0).otherwise(declared),
    ]
    told = all_.select("session", "n_files", *[p.alias(c) for p, c in zip(passed, CHECKS, strict=True)])
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CHECKS]))
    return told.withColumn("failed", failed).withColumn("verdict", F.when(F.size("failed") == 0, "CLEARED").otherwise("REJECTED"))


def session_manifest(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session, n_files, total_bytes, devices (sorted), cases (map from case to number), manifest_hash, verdict VALID or EMPTY.

    ``sessions``: session, description, created_at. ``files``: session, position, file_ref, file_ext, size, width, height, case, tier, device, captured_at, metadata (map). The hash is the
    SHA-256 of the manifest's canonical JSON with its records in the order of ``position``, taken row by row: no array of a session. Null texts count as empty.
    """
    named = {"capture_device": "device", "capture_timestamp": "captured_at", "evidence_tier": "tier", "file_ext": "file_ext", "file_ref": "file_ref", "ingest_case_name": "case"}
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))

    def recorded(string: Callable[[Column], Column]) -> Column:
        pairs = F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(string(e["key"]), F.lit(":"), string(F.coalesce(e["value"], F.lit("None")))))
        return jsontext.object_(
            **{k: string(F.coalesce(F.col(c), F.lit(""))) for k, c in named.items()}, file_size_bytes=F.col("size").cast("string"), metadata=F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")),
            resolution=F.concat(F.lit('"'), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit('"')),
        )

    # one look at all texts of a record: most have nothing to escape
    plain = jsontext.plain(F.concat_ws("", *named.values(), F.map_keys(given), F.map_values(given)))
    record = F.when(plain, recorded(lambda c: F.concat(F.lit('"'), c, F.lit('"')))).otherwise(recorded(jsontext.string))
    text = lambda c: jsontext.string(F.coalesce(F.col(c), F.lit("")))
    rows = digests.counted(files, ["session"], ["position"]).join(sessions.select("session", "description", "created_at"), "session")
    before = F.concat(F.lit('{"created_at":'), text("created_at"), F.lit(',"description":'), text("description"), F.lit(',"file_count":'), F.col("_n").cast("string"), F.lit(',"finalized":false,"manifest_hash":"","records":['))
    after = F.concat(F.lit('],"session_id":'), jsontext.string(F.col("session").cast("string")), F.lit(f',"version":"{MANIFEST_VERSION}"}}'))
    hashed = digests.ordered_digest(rows.withColumn("_record", record), ["session"], ["position"], F.col("_record"), ",", before, after)
    # numbers by case first: a session holds no more entries than there are cases
    by_case = files.groupBy("session", F.coalesce("case", F.lit("")).alias("case")).agg(F.count("*").alias("k"), F.sum("size").alias("bytes"), F.collect_set(F.when(F.trim("device") != "", F.col("device"))).alias("devices"))
    summary = by_case.groupBy("session").agg(
        F.sum("k").alias("n_files"), F.sum("bytes").alias("total_bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("devices")))).alias("devices"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("case", "k")))).alias("cases")
    )
    all_ = sessions.select("session").join(summary, "session", "left").join(hashed.select("session", F.col("digest").alias("manifest_hash")), "session", "left")
    nothing = {"n_files": 0, "total_bytes": 0}
    return all_.fillna(nothing).withColumns({"devices": F.coalesce("devices", F.array().cast("array<string>")), "verdict": F.when(F.col("n_files") > 0, "VALID").otherwise("EMPTY")})
