"""Streams whose states many keys share, and whose rows come in packs: few states, the same rows."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries as q
from checks import round_trips as rt
from lanewise.operators import alerts as al
from lanewise.operators import trajectories as tr
from lanewise.sources import writers as wr
from lanewise.streaming import alerts as sa
from lanewise.streaming import buckets as bk
from lanewise.streaming import kinematics as sk
from lanewise.streaming import live as lv
from lanewise.streaming import sinks as ss
from lanewise.streaming import zones as sz
from tests.test_streaming import collect, key, positions, stream  # noqa: F401
from tests.test_zones import boxes as make_boxes


def run(df, tmp_path, name):
    """The rows of a stream, and the most rows its first state had."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        query.processAllAvailable()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    return df.sparkSession.table(name), max(states)


def test_tracks_share_states(spark, positions, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(sk, "shared_state", partial(bk.shared_state, buckets=1))
    got, states = run(sk.stream_trajectories(stream(spark, positions, tmp_path / "in"), fps=10), tmp_path, "tracks")
    cols = ["track_id", "frame_id", "vx", "vy", "warm"]
    assert key(got.collect(), *cols, digits=4) == key(tr.trajectories(positions, fps=10).collect(), *cols, digits=4)
    assert states == 1


def test_moves_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sz, "shared_state", partial(bk.shared_state, buckets=1))
    boxes = make_boxes(spark, {t: [(f, 10.0 * f + t, 5.0) for f in range(t, 120, t + 1)] for t in range(1, 9)})
    got, states = run(sz.stream_moves(stream(spark, boxes, tmp_path / "in")), tmp_path, "moves")
    got = {(r.track_id, r.frame_id): (r.px, r.prev_px) for r in got.collect()}
    assert got == {
        (t, f): (10.0 * f + t, 10.0 * (f - t - 1) + t if f > t else None) for t in range(1, 9) for f in range(t, 120, t + 1)
    }
    assert states == 1


def test_pairs_are_joined_in_packs(spark, positions, tmp_path):  # noqa: F811
    rows = tr.trajectories(positions, fps=10)
    left, right = (stream(spark, rows, tmp_path / side) for side in "lr")
    got, states = run(sa.stream_close_pairs(left, right), tmp_path, "packs")
    cols = ["frame_id", "a_id", "b_id", "distance_m", "closing"]
    assert key(got.collect(), *cols) == key(al.close_pairs(rows).collect(), *cols)
    assert states < 50 < rows.count()


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_keep_keys_apart(seed):
    rng = np.random.default_rng(seed)
    n = 300
    keys = rng.integers(0, 2, n), rng.integers(0, 3, n)
    x, y = (np.round(rng.uniform(-30, 30, n), 1) for _ in "xy")
    x[:3], y[3:6], x[6] = np.nan, np.inf, -np.inf
    p, q_ = sa.near_pairs(keys, x, y, 5.0)
    with np.errstate(invalid="ignore"):
        want = {
            (i, j) for i in range(n) for j in range(i)
            if keys[0][i] == keys[0][j] and keys[1][i] == keys[1][j] and np.hypot(x[i] - x[j], y[i] - y[j]) < 5.0
        }
    got = [(max(a, b), min(a, b)) for a, b in zip(p.tolist(), q_.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert [len(e) for e in sa.near_pairs((keys[0][:0],), x[:0], y[:0], 5.0)] == [0, 0]


def test_videos_of_one_table_do_not_meet():
    row = {"track_id": [1, 2, 3], "frame_id": 7, "ts": 0.7, "event_time": pd.Timestamp("2000-01-01"), "box_ord": [2, 0, 1], "y": 0.0}
    table = pd.DataFrame(row | {"video_id": ["u", "v", "v"], "x": [0.0, 0.5, 1.0], "vx": 1.0, "vy": 0.0, "warm": True})
    found = lv.close_pairs(table, 5.0)
    assert [(r.video_id, r.a_id, r.b_id, r.distance_m) for r in found.itertuples()] == [("v", 2, 3, 0.5)]


def test_packs_hold_all_rows_once(spark):
    rows = spark.range(1000).selectExpr(
        "cast(id % 7 as int) as bucket", "if(id % 11 = 0, null, id div 128) as block", "id",
        "if(id % 5 = 0, null, concat('v', id)) as name", "timestamp_seconds(id) as event_time",
    )
    packs = bk.packs(rows.repartition(3), ["bucket", "block"])
    table = packs.toPandas()
    assert len(table) <= 3 * 7 * 9
    seen = []
    for r in table.itertuples():
        part = bk.unpacked(r.rows)
        assert bk.all_millis(part).min() == r.first and part["event_time"].max() == r.event_time
        assert {i % 7 for i in part["id"]} == {r.bucket}
        assert {None if i % 11 == 0 else i // 128 for i in part["id"]} == {None if pd.isna(r.block) else int(r.block)}
        seen += zip(part["id"], part["name"])
    assert sorted(seen) == [(i, None if i % 5 == 0 else f"v{i}") for i in range(1000)]


def test_a_stream_is_fed_from_rows_written_once(spark, monkeypatch):
    rows = spark.range(600).selectExpr(
        "'v' as video_id", "if(id = 5, null, id) as frame_id", "id / 10.0D as ts", "cast(id % 2 as double) as x"
    ).repartition(4, "frame_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    feed, sizes = rt.Feed(rows), []
    plan = feed.stream()._jdf.queryExecution().analyzed().toString()
    writer = feed.stream().writeStream.foreachBatch(lambda df, n: sizes.append(df.agg(F.min("frame_id"), F.max("frame_id"), F.count("*")).first()))
    feed.run(writer.option("checkpointLocation", rt.folder(spark)).trigger(availableNow=True).start)
    assert [tuple(s) for s in sizes if s[2]] == [(0, 132, 132), (133, 265, 133), (266, 599, 334)]
    assert "event_time" in plan and spark.conf.get("spark.sql.shuffle.partitions") == before
    # Each task wrote a file for a batch: nothing was dealt again.
    files = spark.read.parquet(f"{feed.path}/read/*").inputFiles()
    assert len(files) > 3 and not list(feed.held)


def test_states_grow_in_number(spark):
    cores = spark.sparkContext.defaultParallelism
    with ss.sized(spark, 10):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(cores)
    with ss.sized(spark, 5 * cores * ss.ROWS_PER_STORE):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(5 * cores)


def test_rows_dealt_by_video_are_written_where_they_lie(spark, sf_dir, tmp_path, monkeypatch):
    rows, hinted = q.traj(spark, sf_dir), []
    hint = type(rows).hint
    monkeypatch.setattr(type(rows), "hint", lambda df, *by: (hinted.append(by), hint(df, *by))[1])
    wr.write_trajectories(rows, str(tmp_path / "dealt"))
    assert not hinted
    wr.write_trajectories(rows.repartition(3), str(tmp_path / "scattered"))
    wr.write_trajectories(rows.repartition(3, "video_id", "track_id"), str(tmp_path / "tracks"))
    assert hinted == [("rebalance", "video_id")] * 2
    dealt, scattered = (spark.read.parquet(str(tmp_path / n)) for n in ("dealt", "scattered"))
    assert dealt.count() == rows.count() and not dealt.exceptAll(scattered.select(dealt.columns)).count()
