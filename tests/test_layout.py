"""Events are dealt to tasks by video, so that boxes need no shuffle, and tasks grow in number only."""

import pandas as pd
import pytest

from checks import queries as q
from lanewise.operators import alerts as al
from lanewise.operators import behaviour as be
from lanewise.operators import rules as ru
from lanewise.operators import trajectories as tr
from lanewise.operators import zones as zo
from lanewise.plans.chunks import following, previous
from lanewise.sources import adapters as ad
from lanewise.sources import readers as rd
from lanewise.streaming.kinematics import Steps


def dealt_by(df) -> set[str]:
    """What the exchanges of the plan deal rows by, without attribute numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    return {", ".join(c.split("#")[0] for c in keys.split(", ")[:-1]) for keys in found}


PLANS = {
    "close pairs": lambda s, sf: al.close_pairs(q.traj(s, sf)),
    "alert candidates": lambda s, sf: al.alert_candidates(q.traj(s, sf)),
    "sightings": lambda s, sf: zo.sightings(q.ground(s, sf), ad.zones(s, sf), q.CHUNK),
    "lookback": lambda s, sf: be.lookback_summary(q.history(s, sf)),
    "windows": q.trajectory_window,
    "stats in windows": q.physics_stats_window,
    "rules": lambda s, sf: ru.evaluate_rules(q.traj(s, sf)),
    "dedup": q.read_boxes_dedup,
    "motion": ad.motion_scores,
}


@pytest.mark.parametrize("name", PLANS)
def test_boxes_are_not_shuffled(spark, sf_dir, name):
    assert dealt_by(PLANS[name](spark, sf_dir)) <= {"video_id"}


def test_tasks_grow_in_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ad, "EVENTS_PER_TASK", 10)
    boxes = ad.boxes(spark, sf_dir)
    assert boxes.rdd.getNumPartitions() == 100
    assert boxes.count() == tr.dedup_boxes(boxes).count()


def test_neighbours_across_chunks_with_null_keys_and_values(spark):
    rows = [("a", 0, 5), ("a", 1, None), ("a", 9, 7), ("a", 40, 8), (None, 3, 1), (None, 33, 2), ("b", 7, None), ("b", 8, 4)]
    df = spark.createDataFrame(rows, "k string, f long, v long")
    got = previous(df, ["k"], "f", ["v", "f"], 4)
    assert got.columns == ["k", "f", "v", "prev_v", "prev_f"]
    assert {(r.k, r.f): (r.prev_v, r.prev_f) for r in got.collect()} == {
        ("a", 0): (None, None), ("a", 1): (5, 0), ("a", 9): (None, 1), ("a", 40): (7, 9),
        (None, 3): (None, None), (None, 33): (1, 3), ("b", 7): (None, None), ("b", 8): (None, 7),
    }
    after = following(df, ["k"], "f", ["v"], 4)
    assert {(r.k, r.f): r.next_v for r in after.collect()} == {
        ("a", 0): None, ("a", 1): 7, ("a", 9): 8, ("a", 40): None, (None, 3): 2, (None, 33): None, ("b", 7): 4, ("b", 8): None,
    }


def test_a_track_is_advanced_without_pandas_groups(monkeypatch):
    """The same rows in two calls as in one, repeats, late rows and long gaps included; groups took 9 ms of 11 a call."""
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    frames = [*range(20), 22, 22, 40, 41, 43, *range(60, 80)]
    rows = pd.DataFrame({"video_id": "v", "track_id": 1, "frame_id": frames, "box_ord": range(len(frames))}).assign(
        ts=lambda r: r.frame_id / 10, x=lambda r: r.frame_id**2 / 7 + r.box_ord, y=lambda r: -r.frame_id * 1.0,
        event_time=lambda r: pd.Timestamp("2000-01-01") + pd.to_timedelta(r.frame_id, unit="s"),
    )
    steps = Steps(10)
    whole, history, latest = steps.advance(rows[::-1], None)
    assert list(whole.frame_id) == sorted(set(frames)) and whole.warm.sum() == 13
    assert whole[whole.frame_id == 22].box_ord.item() == 21
    first, kept, _ = steps.advance(rows[:24], None)
    second, after, until = steps.advance(rows[20:], kept)
    pd.testing.assert_frame_equal(pd.concat([first, second], ignore_index=True), whole)
    assert (after, until) == (history, latest)
    assert steps.advance(rows[:5], after) == (None, None, None)


def test_candidates_are_written_once_where_they_lie_and_only_if_they_may_fire(spark, sf_dir, monkeypatch):
    written, write = [], al.staged
    monkeypatch.setattr(al, "staged", lambda df: (written.append(df), write(df))[1])
    candidates = al.alert_candidates(q.traj(spark, sf_dir))
    fired, seen = al.cooldown_tallied(candidates, fps=q.FPS, chunk_frames=q.CHUNK)
    assert len(written) == 1 and dealt_by(written[0]) <= {"video_id"}
    known = {r.alert_type: r["count"] for r in candidates.groupBy("alert_type").count().collect()}
    assert {r.alert_type: r.n for r in seen.groupBy("alert_type").agg({"seen": "sum"}).toDF("alert_type", "n").collect()} == known
    assert fired.count() <= written[0].where("sure is not null").count() < sum(known.values()) / 2
    told = al.alert_effectiveness(candidates, fired).collect()
    assert sorted(al.alert_effectiveness(seen, fired).collect()) == sorted(told)


def test_boxes_from_files_are_dealt_once_and_only_the_columns_read(spark, tmp_path, sf_dir):
    ad.boxes(spark, sf_dir).write.parquet(str(tmp_path / "b"))
    boxes = rd.read_boxes(spark, str(tmp_path / "b")).groupBy("video_id").agg({"x1": "sum"})
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "conf" not in plan.split("ReadSchema")[1]
    assert dealt_by(boxes) <= {"video_id, chunk", "video_id"}


def test_profile_lines_are_compared_where_they_lie(spark, sf_dir, monkeypatch):
    written, write = [], be.staged
    monkeypatch.setattr(be, "staged", lambda df: (written.append(df), write(df))[1])
    lines = q.profile_snapshots(spark, sf_dir)
    assert len(written) == 1 and dealt_by(written[0]) <= {"video_id"}
    assert written[0].where("not _first and not _last").count() > 0 and lines.count() > 0


def test_profile_lines_across_chunks(spark):
    said = {0: "a", 1: "a", 2: " ", 3: "b", 5: "b", 9: "b", 10: "c", 13: "a", 14: None, 30: "a", 31: "b"}
    rows = [(v, 1, f, t) for v in ("u", "v") for f, t in said.items()]
    got = be.changed_profiles(spark.createDataFrame(rows, "video_id string, track_id long, frame_id long, summary string"), 4)
    for v in ("u", "v"):
        assert sorted(r.frame_id for r in got.where(got.video_id == v).collect()) == [0, 3, 10, 13, 31]


@pytest.mark.parametrize("small", [True, False])
def test_only_vehicles_with_a_journey_become_trajectories(spark, sf_dir, monkeypatch, small):
    monkeypatch.setattr("lanewise.plans.joins.small_enough", lambda *_: small)
    plan = q.brake_before_exit(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Picked among events, below the repartition, so that no box is shuffled for it.
    assert "LeftSemi" in plan and plan.index("RepartitionByExpression") < plan.index("LeftSemi")
    # The derivative is worked out once, not once more in the filter.
    assert not [line for line in plan.splitlines() if "Filter" in line and "SQRT" in line]
