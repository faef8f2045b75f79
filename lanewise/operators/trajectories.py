"""Ground-plane trajectories: projection, gap filling, velocity and acceleration."""

from fractions import Fraction
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.geometry import project
from lanewise.functions.motion import bottom_centre
from lanewise.plans.chunks import CHUNK, with_chunk, with_halo
from lanewise.plans.joins import interval_join, lookup_join
from lanewise.schemas import CROWDED_TRACKS, DETECTION_CONF, MAX_MISSED, SG_ORDER, SG_WINDOW

TRACK = ["video_id", "track_id"]


def filter_detections(boxes: DataFrame, conf: float = DETECTION_CONF, classes: list[int] | None = None) -> DataFrame:
    kept = boxes.where(F.col("conf") >= conf)
    return kept if classes is None else kept.where(F.col("cls").isin(classes))


def dedup_boxes(boxes: DataFrame) -> DataFrame:
    """One row per (video, frame, track): the one the tracker listed last.

    Values are kept column by column, so that a hash map holds them and columns nobody reads are left out.
    Rows dealt by video, or by video and chunk, stay where they are.
    """
    rest = [c for c in boxes.columns if c not in ("video_id", "frame_id", "track_id")]
    chunked = boxes if "chunk" in boxes.columns else with_chunk(boxes)
    last = chunked.groupBy("video_id", "chunk", "frame_id", "track_id").agg(
        *[F.max_by(c, F.col("box_ord")).alias(c) for c in rest if c != "chunk"]
    )
    return last.select(*[c for c in boxes.columns if c != "chunk"])


def project_to_ground(boxes: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Adds pixel bottom-centre ``px, py`` and ground position ``x, y`` in metres.

    A camera without calibration is an error, not a silent loss of its boxes.
    """
    joined = lookup_join(boxes, calibrations.select("video_id", "h"), ["video_id"])
    h = F.coalesce(
        F.col("h"),
        F.raise_error(F.concat(F.lit("no calibration for "), F.col("video_id"))).cast("array<double>"),
    )
    px, py = bottom_centre()
    with_pixels = joined.withColumns({"px": px, "py": py, "h": h})
    x, y = project("px", "py")
    return with_pixels.withColumns({"x": x, "y": y}).drop("h")


def savgol_weights(window: int, order: int, deriv: int) -> tuple[list[int], int]:
    """Integer taps (oldest first) and common divisor of the derivative at the newest sample.

    The least-squares polynomial of ``order`` over samples at -(window-1)..0, solved exactly.
    """
    at = range(1 - window, 1)
    n = order + 1
    rows = [[Fraction(sum(t ** (i + j) for t in at)) for j in range(n)] for i in range(n)]
    target = [Fraction(int(i == deriv)) for i in range(n)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i] != 0)
        rows[i], rows[pivot], target[i], target[pivot] = rows[pivot], rows[i], target[pivot], target[i]
        for r in range(n):
            if r != i and rows[r][i]:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i])]
                target[r] -= f * target[i]
    coef = [target[i] / rows[i][i] for i in range(n)]
    taps = [factorial(deriv) * sum(c * t**p for p, c in enumerate(coef)) for t in at]
    scale = lcm(*(t.denominator for t in taps))
    return [int(t * scale) for t in taps], scale


def track_segments(positions: DataFrame, max_missed: int = MAX_MISSED, chunk_frames: int = CHUNK) -> DataFrame:
    """Adds ``gap`` (missed frames before the row) and ``segment``, which a longer gap restarts.

    One window within chunks; gaps across chunks and the segments before come from a row per chunk.
    """
    here = "over (partition by video_id, track_id, chunk order by frame_id)"
    along = "over (partition by video_id, track_id order by chunk)"
    within = (
        with_chunk(positions, "frame_id", chunk_frames)
        .withColumn("_gap", F.expr(f"frame_id - lag(frame_id) {here} - 1"))
        .withColumn("_inner", F.expr(f"sum(if(_gap > {max_missed}, 1, 0)) {here}"))
    )
    edges = within.groupBy(*TRACK, "chunk").agg(
        F.min("frame_id").alias("_first"), F.max("frame_id").alias("_last"), F.max("_inner").alias("_starts")
    )
    carried = (
        edges.withColumn("_edge_gap", F.expr(f"_first - lag(_last) {along} - 1"))
        .withColumn("_opens", F.expr(f"if(_edge_gap <= {max_missed}, 0, 1)"))
        .withColumn("_base", F.expr(f"sum(_opens + _starts) {along} - _starts"))
        .select(*TRACK, "chunk", "_edge_gap", "_base")
    )
    return within.join(carried, [*TRACK, "chunk"]).select(
        *positions.columns, F.coalesce("_gap", "_edge_gap").alias("gap"), (F.col("_base") + F.col("_inner")).alias("segment")
    )


def _filled(positions: DataFrame, history: int, max_missed: int, chunk_frames: int) -> DataFrame:
    """Positions with short gaps filled linearly, per (track, chunk) with halo rows.

    ``history`` is how many filled samples back a caller looks. Adds ``chunk, owned, is_real``
    and moves ``frame_id, x, y`` of filled rows; other columns keep the real row's values.
    """
    haloed = with_halo(positions, "frame_id", back=history + max_missed, size=chunk_frames)
    here = "over (partition by video_id, track_id, chunk order by frame_id)"
    fills = f"case when frame_id - _f - 1 between 1 and {max_missed} then frame_id - _f - 1 else 0L end"

    def between(c: str) -> Column:
        return F.expr(f"case when _back = 0 then {c} else _{c} + (_n - _back) / _n * ({c} - _{c}) end")

    return (
        haloed.withColumns({f"_{c[0]}": F.expr(f"lag({c}) {here}") for c in ("frame_id", "x", "y")})
        .withColumn("_n", F.expr(f"{fills} + 1"))
        .withColumn("_back", F.expr("explode_outer(sequence(_n - 1, 0L, -1L))"))
        .withColumns(
            {
                "is_real": F.expr("_back = 0"),
                "x": between("x"),
                "y": between("y"),
                "frame_id": F.expr("frame_id - _back"),
            }
        )
        .drop("_f", "_x", "_y", "_n", "_back")
    )


def fill_gaps(positions: DataFrame, max_missed: int = MAX_MISSED, chunk_frames: int = CHUNK) -> DataFrame:
    """The real rows plus linear points for gaps of up to ``max_missed`` frames, flagged ``is_real``."""
    cols = [*TRACK, "frame_id", "x", "y"]
    filled = _filled(positions.select(*cols), 1, max_missed, chunk_frames)
    # A filled point belongs to the chunk of the real row that closes its gap.
    return filled.where("owned").select(*cols, "is_real")


def trajectories(
    positions: DataFrame,
    fps: int = 30,
    window: int = SG_WINDOW,
    order: int = SG_ORDER,
    max_missed: int = MAX_MISSED,
    chunk_frames: int = CHUNK,
) -> DataFrame:
    """State vectors ``x, y, vx, vy, ax, ay, warm`` for every real detection.

    Needs one row per (video, track, frame). Warm rows (a full history of ``window`` filled
    samples) carry the Savitzky-Golay derivatives; cold rows the difference to the history
    sample before and no acceleration. The history spans ``window`` consecutive frames, so one
    shuffle on (track, chunk) is enough, whatever the length of a track.
    """
    window += window % 2 == 0
    back = window - 1
    filled = _filled(positions, back, max_missed, chunk_frames)
    here = "over (partition by video_id, track_id, chunk order by frame_id)"
    lags = {f"_{axis}{n}": f"lag({axis}, {n}) {here}" for axis in "xy" for n in range(1, back + 1)}
    lags |= {"_f1": f"lag(frame_id) {here}", "_fn": f"lag(frame_id, {back}) {here}"}
    lagged = filled.select("*", *[F.expr(sql).alias(name) for name, sql in lags.items()])

    def derivative(axis: str, deriv: int) -> str:
        taps, divisor = savgol_weights(window, order, deriv)
        samples = [f"_{axis}{n}" for n in range(back, 0, -1)] + [axis]
        total = " + ".join(f"{s} * {float(w)}D" for s, w in zip(samples, taps))
        return f"({total}) / {float(divisor)}D" + f" * {float(fps)}D" * deriv

    def vector(name: str, axis: str, deriv: int, cold: str) -> Column:
        return F.expr(f"case when warm then {derivative(axis, deriv)} else {cold} end").alias(name)

    def step(axis: str) -> str:
        return f"case when _f1 = frame_id - 1 then ({axis} - _{axis}1) * {float(fps)}D else 0D end"

    return (
        lagged.where("owned and is_real")
        .withColumn("warm", F.expr(f"coalesce(_fn = frame_id - {back}, false)"))
        .select(
            *positions.columns,
            vector("vx", "x", 1, step("x")),
            vector("vy", "y", 1, step("y")),
            vector("ax", "x", 2, "0D"),
            vector("ay", "y", 2, "0D"),
            "warm",
        )
    )


def trajectory_window(trajectories: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of each requested (video, track) between ``t0`` and ``t1``, both included."""
    return interval_join(trajectories, requests.select(*TRACK, "t0", "t1"), TRACK, "t0", "t1")


def track_lifespan(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy(*TRACK).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("points")
    )


def scene_density(boxes: DataFrame, crowded: int = CROWDED_TRACKS) -> DataFrame:
    """Truncated box centroids with the drawing mode a frame's crowding calls for.

    The count is pre-aggregated and joined back, so a crowded frame is never one task's window.
    """
    per_frame = boxes.groupBy("video_id", "frame_id").agg(F.count("*").alias("density"))
    return (
        boxes.join(per_frame, ["video_id", "frame_id"])
        .withColumns(
            {
                "centre_x": ((F.col("x1") + F.col("x2")) / 2).cast("int"),
                "centre_y": ((F.col("y1") + F.col("y2")) / 2).cast("int"),
                "hue": F.col("track_id") * 37 % 180,
                "mode": F.when(F.col("density") > crowded, "minimal").otherwise("moderate"),
            }
        )
        .select("video_id", "frame_id", "track_id", "centre_x", "centre_y", "hue", "density", "mode")
    )
