"""Fixed values of the rules: thresholds and verdict names."""

# Fixed values.
ADJACENT_MAX_PX = 30.0
CONTAINS_MIN_MARGIN_PX = 0.0
MIN_AREA = 4.0
DETERMINISTIC = "DETERMINISTIC"
HEURISTIC = "HEURISTIC_INPUT"
EMPTY, FAIL, PARTIAL, PASS = "EMPTY", "FAIL", "PARTIAL", "PASS"

# Fixed values of the calibration law.
RESOLUTION_BASE_MP, RESOLUTION_PER_DOUBLING, RESOLUTION_MAX = 2.0, 0.1, 0.3
DISTANCE_BASE_M, DISTANCE_DECAY = 1.0, 0.15
NOISE_FACTOR, DISTORTION_FACTOR = 0.5, 0.3
CEILING_MAX, CEILING_FLOOR, DEGRADED_BELOW = 1.0, 0.1, 0.5

# Fixed values of the temporal law.
MIN_FRAMES, CONFIRMATION_WINDOW, DRIFT_MAX_PX = 2, 3, 15.0

# Fixed tolerances of expected against observed.
CONFIDENCE_TOLERANCE, POSITION_TOLERANCE = 0.05, 5.0
