import random

import pytest

from lanewise.operators import zones as zo
from lanewise.schemas import BOXES, ZONES
from tests import model

POLYGON = [(120.0, 180.0), (820.0, 180.0), (820.0, 620.0), (120.0, 620.0)]
GATES = [
    ("North", (120.0, 180.0), (820.0, 180.0)),
    ("South", (120.0, 620.0), (820.0, 620.0)),
    ("East", (820.0, 180.0), (820.0, 620.0)),
    ("West", (120.0, 180.0), (120.0, 620.0)),
]


def zones(spark, polygon=POLYGON, gates=GATES):
    return spark.createDataFrame(
        [("v", "z", [tuple(p) for p in polygon], [(i, n, *a, *b) for i, (n, a, b) in enumerate(gates)])], ZONES
    )


def boxes(spark, paths):
    rows = [
        ("v", f, f / 30, 0, t, x - 10, y - 20, x + 10, y, 0.9, 2) for t, path in paths.items() for f, x, y in path
    ]
    return spark.createDataFrame(rows, BOXES)


def events(df):
    rows = sorted(df.collect(), key=lambda r: (r.track_id, r.frame_id, r.gate_idx))
    return [(r.frame_id, r.gate_name, r.direction, r.confidence) for r in rows]


@pytest.mark.parametrize(
    "path, want",
    [
        ([(400, 100), (400, 200)], [(1, "North", "enter", "confirmed")]),
        ([(400, 100), (400, 200), (400, 600), (400, 640)], [(1, "North", "enter", "confirmed"), (3, "South", "enter", "confirmed")]),
        ([(400, 200), (400, 100)], [(0, "North", "enter", "estimated"), (1, "North", "exit", "confirmed")]),
        ([(470, 600)], [(0, "South", "enter", "estimated")]),
        ([(900, 400), (700, 400)], [(1, "East", "enter", "confirmed")]),
        ([(200, 180), (300, 180)], [(0, "West", "enter", "estimated")]),
        ([(400, 700), (400, 640)], []),
        ([(400, 700), (400, 600)], [(1, "South", "exit", "confirmed")]),
    ],
)
def test_worked_paths(spark, path, want):
    b = boxes(spark, {1: [(i, float(x), float(y)) for i, (x, y) in enumerate(path)]})
    assert events(zo.crossings(b, zones(spark))) == want


def test_crossing_point_and_empty_configs(spark):
    b = boxes(spark, {1: [(0, 400.0, 100.0), (1, 400.0, 200.0)]})
    r = zo.crossings(b, zones(spark)).first()
    assert (r.pixel_x, r.pixel_y, r.real_x, r.real_y) == (400.0, 180.0, 0.0, 0.0)
    assert zo.crossings(b, zones(spark, gates=[])).count() == 0
    assert events(zo.crossings(b, zones(spark, polygon=[]))) == [(1, "North", "enter", "confirmed")]


@pytest.mark.parametrize("chunk", [7, 8192])
def test_random_paths_equal_the_model(spark, chunk):
    rng = random.Random(11)
    polygon = POLYGON[:2] + [(900.0, 400.0)] + POLYGON[2:]
    paths = {}
    for t in range(40):
        x, y, f, path = rng.uniform(0, 1000), rng.uniform(0, 800), rng.randrange(3), []
        for _ in range(60):
            path.append((f, x, y))
            x, y, f = x + rng.uniform(-120, 120), y + rng.uniform(-120, 120), f + rng.choice([1, 1, 1, 2, 30])
        paths[t] = path
    got = {}
    for r in zo.crossings(boxes(spark, paths), zones(spark, polygon), chunk).collect():
        got.setdefault(r.track_id, []).append((r.frame_id, r.gate_idx, r.gate_name, r.direction, r.confidence))
    for t, path in paths.items():
        assert [(f, n, d, c) for f, _, n, d, c in sorted(got.get(t, []))] == model.crossings(path, polygon, GATES), t


def test_flow(spark):
    paths = {
        1: [(0, 400.0, 100.0), (60, 400.0, 200.0), (120, 900.0, 400.0)],
        2: [(0, 400.0, 300.0), (30, 400.0, 100.0)],
    }
    b, z = boxes(spark, paths), zones(spark)
    ev = zo.crossings(b, z)
    od = {r.track_id: r for r in zo.od_summary(ev).collect()}
    assert (od[1].origin_gate, od[1].dest_gate, od[1].dwell_s, od[1].od_confidence) == ("North", "East", 2.0, "confirmed")
    assert (od[2].entry_confidence, od[2].dest_gate, od[2].od_confidence) == ("estimated", "North", "estimated")
    counts = {r.gate_name: (r.entered, r.exited) for r in zo.gate_vehicle_counts(ev, z).collect()}
    assert counts["South"] == (0, 0) and counts["East"] == (0, 1) and sum(a for a, _ in counts.values()) == 2
    assert zo.occupancy(b, z).first().occupancy == 0
    assert zo.occupancy(b, z, at=0.5).first().occupancy == 1
    assert [(r.frame_id, r.occupancy) for r in zo.occupancy_series(b, z).orderBy("frame_id").collect()] == [
        (0, 1), (30, 0), (60, 1), (120, 0),
    ]
    assert zo.gate_counts(zo.in_period(ev, gate_name="East")).collect()[0].exit == 1
    assert zo.top_dwell(zo.od_summary(ev), 1).first().track_id == 1


@pytest.mark.parametrize("gates", [GATES, [], [("Middle", (400.0, 390.0), (520.0, 410.0))], [("Odd", (float("nan"), 1.0), (2.0, 3.0))]])
def test_quick_boxes_tell_what_the_walls_tell(spark, gates):
    """Moves that touch no wall are told by ``reach`` and ``clear``, and no other move is."""
    rng = random.Random(3)
    points = [tuple(rng.uniform(-100, 1100) if rng.random() < 0.9 else rng.choice([120.0, 820.0, 180.0, 620.0]) for _ in range(4)) for _ in range(3000)]
    points += [(None, None, 1.0, 2.0), (float("nan"), 300.0, 300.0, 300.0), (float("inf"), 300.0, 300.0, 300.0)]
    moves = spark.createDataFrame(
        [("v", i, *p) for i, p in enumerate(points)], "video_id string, track_id long, prev_px double, prev_py double, px double, py double"
    )
    polygon = POLYGON[:2] + [(900.0, 400.0)] + POLYGON[2:]
    seen = zo.against_zones(moves, zones(spark, polygon, gates), near_walls_only=False)
    exact = {r.track_id for r in seen.where(f"prev_px is null or exists(walls, w -> {zo._meets('w')})").collect()}
    near = zo.against_zones(moves, zones(spark, polygon, gates))
    assert {r.track_id for r in near.collect()} == exact
    inside = seen.where(f"{zo._within('clear')} or not {zo._meets('reach')}").count()
    assert inside > 600 if gates in (GATES, []) else inside > 0
