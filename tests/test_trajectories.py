import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import trajectories as tr
from tests import model

SCHEMA = "video_id string, track_id bigint, frame_id bigint, ts double, x double, y double"


def positions(spark, points, fps=30.0):
    return spark.createDataFrame([("v", t, f, f / fps, float(x), float(y)) for (t, f), (x, y) in points.items()], SCHEMA)


def by_frame(df):
    return {(r.track_id, r.frame_id): r for r in df.collect()}


def test_weights_differentiate_a_cubic_exactly():
    for deriv, want in ((1, 1.0), (2, 4.0)):
        taps, div = tr.savgol_weights(15, 3, deriv)
        assert sum(w * (t + 2 * t**2 + 3 * t**3) for w, t in zip(taps, range(-14, 1))) / div == pytest.approx(want)
    assert tr.savgol_weights(15, 3, 1)[0][-1] == 115115


def test_constant_speed_warms_up_at_the_fifteenth_sample(spark):
    rows = by_frame(tr.trajectories(positions(spark, {(1, f): (f, 0) for f in range(20)})))
    assert [f for f in range(20) if rows[1, f].warm] == list(range(14, 20))
    assert rows[1, 0].vx == 0 and rows[1, 1].vx == pytest.approx(30)
    assert rows[1, 19].vx == pytest.approx(30) and rows[1, 19].ax == pytest.approx(0, abs=1e-6)


def test_quadratic_motion(spark):
    rows = by_frame(tr.trajectories(positions(spark, {(1, f): ((f / 30.0) ** 2, 0) for f in range(35)})))
    assert rows[1, 34].vx == pytest.approx(2.266667, abs=1e-6) and rows[1, 34].ax == pytest.approx(2.0)


def test_five_missed_frames_are_filled_six_start_anew(spark):
    line = {(1, f): (f, 0) for f in range(20)}
    short = by_frame(tr.trajectories(positions(spark, line | {(1, 25): (25, 0)})))
    assert short[1, 25].warm and short[1, 25].vx == pytest.approx(30)
    long = by_frame(tr.trajectories(positions(spark, line | {(1, 26): (26, 0)})))
    assert not long[1, 26].warm and long[1, 26].vx == 0 and long[1, 26].ax == 0
    filled = tr.fill_gaps(positions(spark, line | {(1, 25): (25, 0)})).where("not is_real")
    assert sorted((r.frame_id, r.x) for r in filled.collect()) == [(f, float(f)) for f in range(20, 25)]
    segments = by_frame(tr.track_segments(positions(spark, line | {(1, 26): (26, 0)})))
    assert segments[1, 19].segment == 1 and segments[1, 26].segment == 2 and segments[1, 26].gap == 6


def test_no_boxes_no_rows(spark):
    assert tr.trajectories(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("chunk", [20, 33, 8192])
def test_chunks_do_not_show(spark, chunk):
    rng = random.Random(chunk)
    points = {}
    for track in (1, 2, 3):
        frame = rng.randrange(5)
        for _ in range(90):
            points[track, frame] = (rng.uniform(0, 50), rng.uniform(0, 50))
            frame += rng.choice([1] * 12 + [2, 4, 6, 7, 9])
    got = by_frame(tr.trajectories(positions(spark, points, 10.0), fps=10, chunk_frames=chunk))
    want = model.kinematics(points, 10)
    assert got.keys() == want.keys()
    for key, (vx, vy, ax, ay, warm) in want.items():
        r = got[key]
        assert r.warm == warm
        assert (r.vx, r.vy, r.ax, r.ay) == pytest.approx((vx, vy, ax, ay), abs=1e-6)


def test_last_row_of_a_frame_wins(spark):
    rows = [("v", 1, 0.1, o, 7, 1.0 * o, 0.0, 2.0, 3.0, 0.9, 2) for o in (0, 5, 2)]
    from lanewise.schemas import BOXES

    kept = tr.dedup_boxes(spark.createDataFrame(rows, BOXES)).collect()
    assert len(kept) == 1 and kept[0].box_ord == 5 and kept[0].x1 == 5.0


def test_missing_calibration_is_an_error(spark):
    from lanewise.schemas import BOXES, CALIBRATIONS

    boxes = spark.createDataFrame([("v", 1, 0.1, 0, 7, 0.0, 0.0, 2.0, 3.0, 0.9, 2)], BOXES)
    with pytest.raises(Exception, match="no calibration for v"):
        tr.project_to_ground(boxes, spark.createDataFrame([], CALIBRATIONS)).collect()
    h = [30 / 1280, 0.0, 0.0, 0.0, -20 / 720, 20.0, 0.0, 0.0, 1.0]
    corner = boxes.withColumns({"x1": F.lit(1280.0), "x2": F.lit(1280.0), "y2": F.lit(720.0)})
    row = tr.project_to_ground(corner, spark.createDataFrame([("v", h)], CALIBRATIONS)).first()
    assert (row.x, row.y) == pytest.approx((30.0, 0.0))


def test_scene_density(spark):
    from lanewise.schemas import BOXES

    boxes = [(100, 200, 250, 320, 4), (500, 300, 650, 420, 9), (900, 100, 1000, 200, 3)]
    df = spark.createDataFrame(
        [("v", 1, 0.1, i, t, float(a), float(b), float(c), float(d), 0.9, 2) for i, (a, b, c, d, t) in enumerate(boxes)], BOXES
    )
    got = {r.track_id: (r.centre_x, r.centre_y, r.density, r.mode) for r in tr.scene_density(df).collect()}
    assert got == {4: (175, 260, 3, "moderate"), 9: (575, 360, 3, "moderate"), 3: (950, 150, 3, "moderate")}
