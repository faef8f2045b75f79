import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import alerts as al
from lanewise.operators import trajectories as tr
from lanewise.operators import zones as zo
from lanewise.streaming import alerts as sa
from lanewise.streaming import kinematics as sk
from lanewise.streaming import sinks as ss
from lanewise.streaming import zones as sz
from tests.test_zones import boxes as make_boxes
from tests.test_zones import zones as make_zones

POS = "video_id string, track_id bigint, frame_id bigint, ts double, box_ord int, x double, y double"


def in_files(df, folder, bounds):
    """One file per range of frames: a micro-batch each."""
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = df.where((F.col("frame_id") >= a) & (F.col("frame_id") < b)).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, df, folder, bounds=(0, 40, 90, 10_000)):
    path = in_files(df, folder, bounds)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return ss.with_event_time(reader.parquet(path)).withWatermark("event_time", "0 seconds")


def collect(spark, df, tmp_path, name):
    q = (
        df.writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture(scope="module")
def positions(spark):
    rng = random.Random(5)
    rows = []
    for track in range(6):
        x, v, f = rng.uniform(0, 20), rng.uniform(3, 20), rng.randrange(4)
        for _ in range(110):
            rows.append(("v", track, f, f / 10.0, track, x, 1.5 * track + rng.uniform(-0.2, 0.2)))
            f += rng.choice([1] * 15 + [2, 5, 8])
            x += v / 10
    return spark.createDataFrame(rows, POS).cache()


def key(rows, *cols, digits=6):
    return sorted(tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in cols) for r in rows)


def test_kinematics_match_batch(spark, positions, tmp_path):
    live = sk.stream_trajectories(stream(spark, positions, tmp_path / "in"), fps=10)
    got = collect(spark, live, tmp_path, "kin").collect()
    want = tr.trajectories(positions, fps=10).collect()
    cols = ["track_id", "frame_id", "vx", "vy", "ax", "ay", "warm"]
    a, b = key(got, *cols), key(want, *cols)
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert p[:2] == q[:2] and p[-1] == q[-1] and p[2:6] == pytest.approx(q[2:6], abs=1e-5)


def test_cooldown_matches_batch(spark, positions, tmp_path):
    rows = tr.trajectories(positions, fps=10)
    live = stream(spark, rows, tmp_path / "in")
    fired = sa.stream_cooldown(sa.stream_vehicle_candidates(live))
    cols = ["alert_type", "track_id", "frame_id"]
    got = key(collect(spark, fired, tmp_path, "cool").collect(), *cols)
    assert got == key(al.cooldown(al.vehicle_candidates(rows), fps=10).collect(), *cols) and got


def test_proximity_matches_batch(spark, positions, tmp_path):
    rows = tr.trajectories(positions, fps=10)
    left, right = (stream(spark, rows, tmp_path / side) for side in ("l", "r"))
    got = collect(spark, sa.stream_close_pairs(left, right), tmp_path, "near").collect()
    cols = ["frame_id", "a_id", "b_id", "distance_m", "closing"]
    assert key(got, *cols) == key(al.close_pairs(rows).collect(), *cols) and got


def test_crossings_match_batch(spark, tmp_path):
    rng = random.Random(8)
    paths = {}
    for t in range(15):
        x, y, f, path = rng.uniform(0, 1000), rng.uniform(0, 800), 0, []
        for _ in range(60):
            path.append((f, x, y))
            x, y, f = x + rng.uniform(-120, 120), y + rng.uniform(-120, 120), f + rng.choice([1, 2, 3])
        paths[t] = path
    boxes, zones = make_boxes(spark, paths), make_zones(spark)
    reader = spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", 1)
    live = reader.parquet(in_files(boxes, tmp_path / "in", (0, 30, 70, 10_000)))
    events = collect(spark, sz.stream_gate_events(live, zones), tmp_path, "events")
    again = spark.readStream.schema(events.schema).parquet(in_files(events, tmp_path / "ev", (0, 50, 10_000)))
    got = collect(spark, sz.drop_late_guesses(again), tmp_path, "cross").collect()
    cols = ["track_id", "frame_id", "gate_name", "direction", "confidence", "pixel_x", "pixel_y"]
    want = zo.crossings(boxes, zones)
    assert key(got, *cols) == key(want.collect(), *cols) and got

    counted = ss.with_event_time(spark.readStream.schema(want.schema).parquet(in_files(want, tmp_path / "cr", (0, 10_000))))
    counts = collect(spark, sz.live_gate_counts(counted, "1 second", "0 seconds"), tmp_path, "flow")
    closed = counts.agg(F.max(F.unix_timestamp("end") - F.unix_timestamp(F.lit("2000-01-01 00:00:00")))).first()[0]
    total = counts.agg(F.sum(F.col("enter") + F.col("exit"))).first()[0]
    assert total == want.where(F.floor("ts") + 1 <= closed).count() > 0


def test_moves_forget_and_repeat(spark, tmp_path):
    boxes = make_boxes(spark, {1: [(0, 10.0, 10.0), (1, 20.0, 20.0), (2000, 30.0, 30.0)], 2: [(1000, 0.0, 0.0), (1001, 0.0, 0.0)]})
    again = boxes.where("track_id = 1 and frame_id = 1").withColumns(
        {"box_ord": F.lit(99).cast(boxes.schema["box_ord"].dataType), "y2": F.col("y2") + 5}
    )
    boxes = boxes.unionByName(again)
    path = in_files(boxes, tmp_path / "in", (0, 500, 1001, 1500, 10_000))

    def moves(name, ttl_s):
        read = ss.with_event_time(spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", 1).parquet(path))
        out = collect(spark, sz.stream_moves(read.withWatermark("event_time", "0 seconds"), ttl_s), tmp_path, name)
        return {r.frame_id: (r.py, r.prev_py) for r in out.where("track_id = 1").collect()}

    kept, forgot = moves("kept", None), moves("forgot", 5.0)
    assert kept.keys() == forgot.keys() == {0, 1, 2000}
    assert kept[1][0] - kept[0][0] == 15 and kept[2000][1] == kept[1][0]
    assert forgot[1] == kept[1] and forgot[2000] == (kept[2000][0], None)


def test_alert_sinks(spark, positions, tmp_path):
    rows = tr.trajectories(positions, fps=10)
    fired = sa.stream_cooldown(sa.stream_vehicle_candidates(stream(spark, rows, tmp_path / "in")))
    q = ss.start_alert_sink(fired, str(tmp_path / "cp"), "parquet", path=str(tmp_path / "out"))
    q.awaitTermination(120)
    want = al.cooldown(al.vehicle_candidates(rows), fps=10).count()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == want and "alert_type" in out.first().value

    seen = []
    fired = sa.stream_cooldown(sa.stream_vehicle_candidates(stream(spark, rows, tmp_path / "in2")))
    q = ss.start_alert_handler(fired, str(tmp_path / "cp2"), lambda batch, n: seen.append(batch.count()))
    q.awaitTermination(120)
    assert sum(seen) == want


def test_alerts_follow_kinematics_through_a_table(spark, positions, tmp_path):
    """Spark takes one such stateful step per query: the second reads what the first appends."""
    live = sk.stream_trajectories(stream(spark, positions, tmp_path / "in"), fps=10)
    q = (
        live.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "rows"))
        .option("checkpointLocation", str(tmp_path / "cp-rows")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    rows = spark.readStream.schema(live.schema).parquet(str(tmp_path / "rows")).withWatermark("event_time", "1 hour")
    got = collect(spark, sa.stream_cooldown(sa.stream_vehicle_candidates(rows)), tmp_path, "chain").collect()
    want = al.cooldown(al.vehicle_candidates(tr.trajectories(positions, fps=10)), fps=10).collect()
    cols = ["alert_type", "track_id", "frame_id"]
    assert key(got, *cols) == key(want, *cols)
