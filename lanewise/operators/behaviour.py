"""Behaviour runs, lookback summaries, and the choice of frames worth a closer look."""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.motion import behaviour_state, window_start, with_motion
from lanewise.plans.chunks import CHUNK, following, ordinal, previous, with_chunk, with_halo
from lanewise.plans.staging import staged
from lanewise.schemas import (
    CLIP_FRAMES,
    FIRST_FRAME_MOTION,
    HISTORY_S,
    MIN_SEGMENT_S,
    MOTION_SKIP,
    STABLE_THRESHOLD,
    STABLE_WINDOW,
)

TRACK = ["video_id", "track_id"]


def with_state(trajectories: DataFrame) -> DataFrame:
    return with_motion(trajectories).withColumn("state", behaviour_state())


def behaviour_runs(trajectories: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    """Stretches of equal state over a whole track; each ends where the next begins, the last at its last row.

    One pass within chunks keeps the rows where a state begins and each chunk's first; only these are
    staged and looked at across chunks.
    """
    states = with_chunk(with_state(trajectories).select(*TRACK, "frame_id", "ts", "state"), "frame_id", chunk_frames)
    chunk = Window.partitionBy(*TRACK, "chunk")
    rows = staged(
        states.withColumns(
            {"before": F.lag(F.struct("state")).over(chunk.orderBy("frame_id")), "last_ts": F.max("ts").over(chunk)}
        )
        .where("before is null or not before.state <=> state")
        .drop("before", "chunk")
    )
    starts = previous(rows, TRACK, "frame_id", ["state"], chunk_frames).where("not state <=> prev_state")
    last = rows.groupBy(*TRACK).agg(F.max("last_ts").alias("_end"))
    return (
        following(starts, TRACK, "frame_id", ["ts"], chunk_frames)
        .join(last, TRACK)
        .select(*TRACK, "state", F.col("ts").alias("start_ts"), F.coalesce("next_ts", "_end").alias("end_ts"))
    )


def lookback(
    active: DataFrame,
    trajectories: DataFrame,
    fps: int = 30,
    seconds: float = HISTORY_S,
    chunk_frames: int = CHUNK,
) -> DataFrame:
    """``history`` of each active (video, track, frame, ts): its trajectory rows of the last ``seconds``.

    Active rows travel with the trajectory as markers into short stretches of a track, which hold
    the samples once, in order, for all their ticks. A stretch is as long as a few histories.
    """
    reach = ceil(seconds * fps) + 1
    sample = F.struct("ts", "state", "speed", "signed_accel")
    rows = with_state(trajectories).select(
        *TRACK, "frame_id", "ts", sample.alias("sample"), F.lit(False).alias("is_tick")
    )
    ticks = active.select(*TRACK, "frame_id", "ts", F.lit(None).alias("sample"), F.lit(True).alias("is_tick"))
    both = with_halo(rows.unionByName(ticks), "frame_id", back=reach, size=min(chunk_frames, 2 * reach))
    tick = F.when(
        F.col("is_tick") & F.col("owned"), F.struct("frame_id", "ts", window_start("ts", seconds).alias("since"))
    )
    near = "filter(samples, s -> s.ts between t.since and t.ts)"
    looked_back = f"transform(ticks, t -> named_struct('frame_id', t.frame_id, 'ts', t.ts, 'history', {near}))"
    return (
        both.groupBy(*TRACK, "chunk")
        .agg(F.collect_list("sample").alias("samples"), F.collect_list(tick).alias("ticks"))
        .where("size(ticks) > 0")
        .select(*TRACK, "ticks", F.array_sort("samples").alias("samples"))
        .select(*TRACK, F.expr(f"explode_outer({looked_back}) as t"))
        .select(*TRACK, "t.*")
    )


def lookback_segments(history: DataFrame, min_seconds: float = MIN_SEGMENT_S) -> DataFrame:
    """Adds ``segments``: runs of equal state; short ones are dropped unless there is only one run.

    Read them with an outer explode: an inner one makes Spark work them out once more as a filter.
    """
    starts = "filter(history, (s, i) -> i = 0 or s.state <> get(history, i - 1).state)"
    closed = (
        "transform(starts, (s, i) -> named_struct('state', s.state, 'start_ts', s.ts,"
        " 'end_ts', coalesce(get(starts, i + 1).ts, element_at(history, -1).ts)))"
    )
    long = f"filter(runs, s -> s.end_ts - s.start_ts >= {float(min_seconds)}D)"
    return (
        history.withColumn("starts", F.expr(starts))
        .withColumn("runs", F.expr(f"if(size(history) > 0, {closed}, null)"))
        .withColumn("segments", F.expr(f"if(size(runs) > 1, {long}, runs)"))
        .drop("starts", "runs")
    )


def lookback_summary(history: DataFrame, min_seconds: float = MIN_SEGMENT_S) -> DataFrame:
    """One line of text per active vehicle, with its current speed and signed acceleration as numbers."""
    words = (
        "array_join(transform(segments, s -> format_string('%s for %.1fs',"
        " if(s.state = 'STOPPED', 'stationary', lower(s.state)), round(s.end_ts - s.start_ts, 1))), ' → ')"
    )
    current = "format_string(' | now: speed=%.1f m/s, accel=%+.1f m/s²', round(now_speed, 1), round(now_accel, 1))"
    return (
        lookback_segments(history, min_seconds)
        .withColumns(
            {
                "now_speed": F.expr("get(history, size(history) - 1).speed"),
                "now_accel": F.expr("get(history, size(history) - 1).signed_accel"),
            }
        )
        .select(
            *TRACK, "frame_id", "ts", "segments", "now_speed", "now_accel",
            F.expr(
                f"concat('Vehicle ', track_id, ': ', if(now_speed is null, 'no history yet (just appeared)',"
                f" concat({words}, {current}))) as summary"
            ),
        )
    )


def tick_summaries(summary: DataFrame) -> DataFrame:
    """The lines of all vehicles active at a tick, by track id: as many as the frame has vehicles."""
    lines = F.array_sort(F.collect_list(F.struct("track_id", "summary")))
    return summary.groupBy("video_id", "frame_id", "ts").agg(
        F.array_join(F.transform(lines, lambda s: s["summary"]), "\n").alias("behaviour")
    )


def interval_ticks(boxes: DataFrame, fps: int = 30) -> DataFrame:
    """Frames after the first with boxes, about three per second."""
    every = max(1, fps // 3)
    return eligible_frames(boxes).where(F.col("frame_id") % every == 0)


def eligible_frames(boxes: DataFrame) -> DataFrame:
    return boxes.where("frame_id > 0").groupBy("video_id", "frame_id").agg(F.min("ts").alias("ts"))


def frame_changes(batches):
    """Each sorted frame's mean absolute change since the one before in its chunk; one frame is held at a time.

    The first and last frame of a chunk keep their pixels. Frames of unlike sizes have no change to tell.
    """

    def numbers(value):
        if value is None or not value.is_valid:
            return None
        if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type):
            return np.frombuffer(value.as_buffer(), np.uint8).astype(np.int16)
        return value.values.to_numpy(zero_copy_only=False).astype(float)

    def change(now, before):
        if now is None or not len(now) or len(now) != len(before):
            return None
        mean = float(np.abs(now - before).mean())
        return None if np.isnan(mean) else mean

    schema, waiting = None, None

    def batch_of(rows):
        names = ["video_id", "frame_id", "chunk", "score", "is_first", "is_last", "edge"]
        types = [schema.field("video_id").type, schema.field("frame_id").type, pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
        columns = list(zip(*rows)) if rows else [[]] * 7
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        edges = pa.array([None if e is None else e.as_py() for e in columns[6]], schema.field("pixels").type)
        return pa.RecordBatch.from_arrays([*arrays, edges], names=names)

    def done(row, is_last):
        keys, score, is_first, pixels, _ = row
        return (*keys, score, is_first, is_last, pixels if is_first or is_last else None)

    for batch in batches:
        schema, rows = batch.schema, []
        video, frame, chunk = (batch.column(schema.get_field_index(c)).to_pylist() for c in ("video_id", "frame_id", "chunk"))
        pixels = batch.column(schema.get_field_index("pixels"))
        for i in range(batch.num_rows):
            now = numbers(pixels[i])
            same = waiting is not None and (waiting[0][0], waiting[0][2]) == (video[i], chunk[i])
            if waiting is not None:
                rows.append(done(waiting, not same))
            before = waiting[4] if same else None
            score = FIRST_FRAME_MOTION if before is None else change(now, before)
            waiting = ((video[i], frame[i], chunk[i]), score, not same, pixels[i], now)
        yield batch_of(rows)
    if waiting is not None:
        yield batch_of([done(waiting, True)])


def motion_energy(frames: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    """Mean absolute pixel change since the frame before; the first frame counts as fully changed.

    ``pixels`` is an array of numbers or a binary of bytes. A frame after one without pixels counts as
    fully changed too; one without pixels itself, or of another size than the one before, has a null
    score. Frames are compared within chunks; across a border only the last frame of a chunk and the
    first of the next one meet.
    """
    pixels = frames.schema["pixels"].dataType
    types = {c: frames.schema[c].dataType.simpleString() for c in ("video_id", "frame_id")}
    schema = (
        f"video_id {types['video_id']}, frame_id {types['frame_id']}, chunk long, score double,"
        f" is_first boolean, is_last boolean, edge {pixels.simpleString()}"
    )

    def compared(rows):
        keys = ["video_id", "chunk"]
        return rows.repartition(*keys).sortWithinPartitions(*keys, "frame_id").mapInArrow(frame_changes, schema)

    scored = staged(compared(with_chunk(frames.select("video_id", "frame_id", "pixels"), "frame_id", chunk_frames)))
    edge = ["video_id", "frame_id", "chunk", F.col("edge").alias("pixels")]
    followed = scored.where("is_last").select(
        "video_id", "chunk", F.lead("chunk").over(Window.partitionBy("video_id").orderBy("chunk")).alias("after")
    )
    last = (
        scored.where("is_last")
        .select(*edge)
        .join(followed.where("after is not null"), ["video_id", "chunk"])
        .select("video_id", "frame_id", F.col("after").alias("chunk"), "pixels")
    )
    met = compared(last.unionByName(scored.where("is_first").select(*edge)))
    # Of such a pair the later frame counts; a video's first one stands alone.
    return scored.where("not is_first").unionByName(met.where("is_last")).select("video_id", "frame_id", "score")


def forced_ticks(eligible: DataFrame, fired: DataFrame) -> DataFrame:
    """Frames a collision or hard-braking alert forces; an alert before any eligible frame waits for the first.

    Alerts come from boxes, so only those of frame 0 fall on a frame that may not run.
    """
    critical = fired.where(F.col("alert_type").isin("COLLISION_SUSPECTED", "HARD_BRAKING"))
    at_once = eligible.join(critical, ["video_id", "frame_id"], "left_semi")
    waiting = critical.where("frame_id <= 0").select("video_id").distinct()
    first = eligible.groupBy("video_id").agg(F.min_by(F.struct("frame_id", "ts"), F.col("frame_id")).alias("f"))
    delayed = first.join(waiting, "video_id", "left_semi").select("video_id", "f.*")
    return at_once.unionByName(delayed).distinct()


def macro_ticks(
    eligible: DataFrame, scores: DataFrame, forced: DataFrame, fps: int = 30, threshold: float = MOTION_SKIP
) -> DataFrame:
    """Ticks that run, flagged ``forced``, plus interval frames the motion gate skipped (``runs`` false)."""
    every = max(1, fps // 3)
    flags = forced.select("video_id", "frame_id", F.lit(True).alias("forced"))
    due = (
        eligible.join(scores, ["video_id", "frame_id"], "left")
        .join(flags, ["video_id", "frame_id"], "left")
        .withColumn("forced", F.coalesce("forced", F.lit(False)))
        .where((F.col("frame_id") % every == 0) | F.col("forced"))
    )
    moving = F.coalesce("score", F.lit(FIRST_FRAME_MOTION)) >= threshold
    return due.withColumn("runs", F.col("forced") | moving)


def motion_gate(ticks: DataFrame, scores: DataFrame, threshold: float = MOTION_SKIP) -> DataFrame:
    return ticks.join(scores, ["video_id", "frame_id"]).where(F.col("score") >= threshold)


def tick_counts(macro: DataFrame) -> DataFrame:
    """Per video: ticks run, ticks forced, interval frames skipped for lack of motion."""
    return macro.groupBy("video_id").agg(
        F.count_if("runs").alias("ticks"),
        F.count_if("forced").alias("forced_ticks"),
        F.count_if(~F.col("runs")).alias("motion_skips"),
    )


def clip_buffer(ticks: DataFrame, length: int = CLIP_FRAMES, chunk_frames: int = CHUNK) -> DataFrame:
    """The last ``length`` tick frames at each tick, oldest first."""
    numbered = ordinal(ticks.select("video_id", "frame_id"), ["video_id"], "frame_id", "tick", chunk_frames)
    haloed = with_halo(numbered, "tick", back=length - 1, size=max(chunk_frames, length))
    here = Window.partitionBy("video_id", "chunk").orderBy("tick").rowsBetween(1 - length, 0)
    return (
        haloed.withColumn("clip", F.collect_list("frame_id").over(here))
        .where("owned")
        .select("video_id", "frame_id", "tick", "clip")
    )


def stable_start(
    scores: DataFrame,
    threshold: float = STABLE_THRESHOLD,
    window: int = STABLE_WINDOW,
    scan: int | None = None,
    chunk_frames: int = CHUNK,
) -> DataFrame:
    """First frame of the first ``window`` calm scores in a row, else 0; ``scan`` limits the frames looked at."""
    within = scores if scan is None else scores.where(F.col("frame_idx") < scan)
    scanned = within.withColumn("calm", F.col("score") < threshold)
    numbered = ordinal(scanned, ["video_id"], "frame_idx", "n", chunk_frames)
    here = Window.partitionBy("video_id", "chunk").orderBy("n")
    ahead = with_halo(numbered, "n", ahead=window - 1, size=chunk_frames)
    full = F.min(F.col("calm")).over(here.rowsBetween(0, window - 1)) & (
        F.count("*").over(here.rowsBetween(0, window - 1)) == window
    )
    starts = ahead.withColumn("full", full).where("owned")
    return starts.groupBy("video_id").agg(
        F.coalesce(F.min(F.when(F.col("full"), F.col("frame_idx"))), F.lit(0)).alias("stable_frame")
    )


def profile_snapshots(
    summary: DataFrame, trajectories: DataFrame, chunk_frames: int = CHUNK
) -> DataFrame:
    """Summary lines that changed since the vehicle's line before, with the time it was first seen.

    The time is added first, while the lines still lie by video: once written they would be shuffled for it.
    """
    first = trajectories.groupBy(*TRACK).agg(F.min("ts").alias("first_seen"))
    lines = summary.select(*TRACK, "frame_id", "ts", "summary").join(first, TRACK, "left")
    return changed_profiles(lines, chunk_frames).select(
        *TRACK, "frame_id", "summary",
        F.coalesce("first_seen", "ts").alias("first_seen"), F.col("ts").alias("last_seen"),
    )


def changed_profiles(profiles: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    """Drops blank summaries and those equal to the vehicle's summary before.

    One pass within chunks keeps the lines that change, and each chunk's first. These are staged, as their text is
    costly to put together; only a chunk's first and last of them meet those of other chunks.
    """
    chunk = Window.partitionBy(*TRACK, "chunk").orderBy("frame_id")
    # Blank lines go after the window: a filter before it would make Spark put the text together twice.
    said = with_chunk(profiles, "frame_id", chunk_frames).withColumn("_said", F.expr("if(trim(summary) <> '', summary, null)"))
    kept = staged(
        said.withColumn("_before", F.expr("lag(_said) ignore nulls over (partition by video_id, track_id, chunk order by frame_id)"))
        .where("_said is not null and not _said <=> _before")
        .withColumns({"_first": F.col("_before").isNull(), "_last": F.lead(F.lit(1)).over(chunk).isNull()})
        .drop("_before", "_said", "chunk")
    )
    edges = previous(kept.where("_first or _last"), TRACK, "frame_id", ["summary"], chunk_frames)
    opening = edges.where("_first and not summary <=> prev_summary").drop("prev_summary")
    return kept.where("not _first").unionByName(opening).drop("_first", "_last")
