"""Table schemas and the fixed thresholds every operator defaults to."""

from pyspark.sql import types as T

# Thresholds of the behaviour being reproduced.
SPEEDING_MS = 13.89
HARD_BRAKING_MS2 = -4.0
AGGRESSIVE_ACCEL_MS2 = 3.5
COLLISION_M = 2.0
PROXIMITY_M = 5.0
COOLDOWN_S = 3.0
STOPPED_MS = 0.5
BRAKING_MS2 = -2.0
ACCELERATING_MS2 = 1.5
MIN_SEGMENT_S = 0.5
HISTORY_S = 5.0
DETECTION_CONF = 0.3
CROWDED_TRACKS = 25
MOTION_SKIP = 2.0
FIRST_FRAME_MOTION = 999.0
CLIP_FRAMES = 6
STABLE_THRESHOLD = 8.0
STABLE_WINDOW = 10
MAX_MISSED = 5
SG_WINDOW = 15
SG_ORDER = 3
HISTORY_ALERTS = 200
METRES_PER_DEGREE = 111320.0
ENTITY_TYPES = ("Vehicle", "Pedestrian", "Infrastructure")
MOTION_STATES = ("APPROACHING", "DIVERGING", "PARALLEL", "STATIONARY")
PHASES = ("approach", "conflict", "resolution", "normal")

BOXES = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("box_ord", T.IntegerType()),
    T.StructField("track_id", T.LongType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("cls", T.IntegerType()),
])

TRAJECTORIES = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("track_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("vx", T.DoubleType()),
    T.StructField("vy", T.DoubleType()),
    T.StructField("ax", T.DoubleType()),
    T.StructField("ay", T.DoubleType()),
    T.StructField("warm", T.BooleanType()),
])

CALIBRATIONS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("h", T.ArrayType(T.DoubleType())),
])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

GATE = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("p1x", T.DoubleType()),
    T.StructField("p1y", T.DoubleType()),
    T.StructField("p2x", T.DoubleType()),
    T.StructField("p2y", T.DoubleType()),
])

ZONES = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("zone_id", T.StringType()),
    T.StructField("polygon", T.ArrayType(POINT)),
    T.StructField("gates", T.ArrayType(GATE)),
])

CROSSINGS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("track_id", T.LongType()),
    T.StructField("zone_id", T.StringType()),
    T.StructField("gate_idx", T.IntegerType()),
    T.StructField("gate_name", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("pixel_x", T.DoubleType()),
    T.StructField("pixel_y", T.DoubleType()),
    T.StructField("real_x", T.DoubleType()),
    T.StructField("real_y", T.DoubleType()),
])

TRIPLE = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("subject_type", T.StringType()),
    T.StructField("predicate", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("object_type", T.StringType()),
    T.StructField("motion_state", T.StringType()),
    T.StructField("phase", T.StringType()),
])
