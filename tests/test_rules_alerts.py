import itertools
import random

import pytest

from lanewise.operators import alerts as al
from lanewise.operators import rules as ru
from tests import model

STATE = (
    "video_id string, track_id bigint, frame_id bigint, ts double, box_ord int, x double, y double,"
    " vx double, vy double, ax double, ay double, warm boolean"
)


def euler(spark, n, v0, a):
    rows, x, v = [], 0.0, v0
    for f in range(n):
        v += a / 30
        x += v / 30
        rows.append(("v", 1, f, f / 30, 0, x, 0.0, v, 0.0, a, 0.0, True))
    return spark.createDataFrame(rows, STATE)


def broken(df):
    return {r.rule_id: r for r in ru.evaluate_rules(df).collect()}


@pytest.mark.parametrize(
    "n, v0, a, rules",
    [
        (90, 5.0, 0.0, set()),
        (90, 20.0, 0.0, {"SPEEDING"}),
        (60, 12.0, -5.0, {"HARD_BRAKING", "AGGRESSIVE_ACCELERATION"}),
        (60, 0.0, 4.0, {"AGGRESSIVE_ACCELERATION"}),
        (90, 10.0, -1.0, set()),
        (90, 13.39, 0.0, set()),
    ],
)
def test_rules_fire_where_they_should(spark, n, v0, a, rules):
    assert set(broken(euler(spark, n, v0, a))) == rules


def test_rule_evidence(spark):
    r = broken(euler(spark, 90, 20.0, 0.0))["SPEEDING"]
    assert r.severity == "violation" and r.first_occurrence_s == 0
    assert r.evidence["max_speed_ms"] == 20.0 and r.evidence["max_speed_kmh"] == 72.0
    assert r.evidence["duration_over_limit_s"] == 2.97 and r.evidence["threshold_kmh"] == 50
    both = broken(euler(spark, 90, 12.0, -5.5))
    assert both["HARD_BRAKING"].evidence["frames_in_hard_braking"] < 90
    assert both["AGGRESSIVE_ACCELERATION"].evidence["frames_flagged"] == 90
    assert ru.evaluate_rules(spark.createDataFrame([], STATE)).count() == 0
    assert ru.rule_report(euler(spark, 9, 5.0, 0.0)).first().result == "NO_VIOLATIONS"


def frame(spark, *rows, ts=1.0, warm=True):
    return spark.createDataFrame(
        [("v", t, int(ts * 30), ts, i, *map(float, rest), warm) for i, (t, *rest) in enumerate(rows)], STATE
    )


def kinds(df):
    return sorted(r.alert_type for r in al.alerts(df).collect())


def test_single_frame_alerts(spark):
    assert kinds(frame(spark, (10, 0, 0, 20, 0, 0, 0))) == ["SPEEDING"]
    assert kinds(frame(spark, (10, 0, 0, 20, 0, 0, 0), warm=False)) == []
    assert kinds(frame(spark, (2, 0, 0, 0, 10, 0, -5))) == ["AGGRESSIVE_ACCEL", "HARD_BRAKING"]
    assert kinds(frame(spark, (1, 0, 0, 3, 0, 0, 0), (2, 1.5, 0, -3, 0, 0, 0))) == ["COLLISION_SUSPECTED"]
    assert kinds(frame(spark, (1, 0, 0, 3, 0, 0, 0), (2, 4, 0, -3, 0, 0, 0))) == ["PROXIMITY_WARNING"]
    assert kinds(frame(spark, (1, 0, 0, -3, 0, 0, 0), (2, 4, 0, 3, 0, 0, 0))) == []
    assert kinds(frame(spark, (1, 0, 0, -3, 0, 0, 0), (2, 4, 0, 3, 0, 0, 0), warm=False)) == ["PROXIMITY_WARNING"]
    assert kinds(frame(spark, (1, 0, 0, 3, 0, 0, 0), (2, 50, 0, 0, 0, 0, 0))) == []


def test_alert_carries_evidence_and_both_vehicles(spark):
    r = al.alerts(frame(spark, (7, 0, 0, 3, 0, 0, 0), (2, 1.5, 0, -3, 0, 0, 0))).first()
    assert r.track_id == 7 and r.involved_ids == [7, 2] and (r.id_lo, r.id_hi) == (2, 7)
    assert r.severity == "critical" and r.evidence["distance_m"] == 1.5 and "1.50 m" in r.message


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    # Half of one frame's vehicles sit in one hot spot; others straddle strip and block borders.
    spots = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(25)]
    spots += [(rng.uniform(-80, 150), rng.uniform(-20, 20)) for _ in range(60)]
    spots += [(64.0 * i + d, 5.005 * i + e) for i in (-1, 0, 1) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01)]
    df = frame(spark, *[(i, x, y, 0, 0, 0, 0) for i, (x, y) in enumerate(spots)])
    want = {
        (i, j)
        for (i, a), (j, b) in itertools.combinations(enumerate(spots), 2)
        if ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 < 5
    }
    got = [(r.a_id, r.b_id) for r in al.close_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


CAND = "video_id string, alert_type string, id_lo bigint, id_hi bigint, track_id bigint, frame_id bigint, ts double, measure double"


@pytest.mark.parametrize("seconds, times, want", [(5, [1, 2], [1]), (2, [1, 4], [1, 4]), (3, [1, 2, 4, 4.5, 7], [1, 4, 7])])
def test_cooldown_examples(spark, seconds, times, want):
    rows = [("v", "SPEEDING", 1, 1, 1, int(t * 10), float(t), 0.0) for t in times]
    got = al.cooldown(spark.createDataFrame(rows, CAND), seconds, fps=10).collect()
    assert sorted(r.ts for r in got) == want


@pytest.mark.parametrize("chunk", [31, 40, 97])
def test_cooldown_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    frames = {
        1: list(range(1000)),  # never quiet: every chunk hands on to the next
        2: sorted(rng.sample(range(1000), 500)),
        3: sorted(rng.sample(range(1000), 60)),
        4: [5, 500, 999],
    }
    rows = [("v", "SPEEDING", k, k, k, f, f / 10.0, 0.0) for k, fs in frames.items() for f in fs]
    got = {}
    for r in al.cooldown(spark.createDataFrame(rows, CAND), 3.0, fps=10, chunk_frames=chunk).collect():
        got.setdefault(r.track_id, []).append(r.ts)
    for k, fs in frames.items():
        assert sorted(got[k]) == model.cooldown([f / 10.0 for f in fs], 3.0), k


def test_history_and_effectiveness(spark):
    rows = [("v", "SPEEDING", 1, 1, 1, t, t / 10.0, 0.0) for t in range(100)]
    cand = spark.createDataFrame(rows, CAND)
    fired = al.cooldown(cand, 3.0, fps=10)
    assert [r.ts for r in al.alert_history(fired, 2).collect()] == [6.0, 9.0]
    many = al.cooldown(spark.createDataFrame([("v", "SPEEDING", 1, 1, 1, t, t / 1.0, 0.0) for t in range(700)], CAND), 0.5, fps=1)
    assert al.alert_history(many, 600).count() == 600
    # A cool-down longer than a chunk.
    assert al.cooldown(cand, 3.0, fps=10, chunk_frames=4).count() == 4
    r = al.alert_effectiveness(cand, fired).first()
    assert (r.fired, r.suppressed, r.effectiveness) == (4, 96, 0.96)


def test_extension_rule(spark):
    rule = ru.Rule("SLOW", "speed < 6", "warning", {"n": "{hits}"}, "concat('slow ', track_id)")
    r = ru.evaluate_rules(euler(spark, 10, 5.0, 0.0), (rule,)).first()
    assert (r.rule_id, r.description, r.evidence["n"]) == ("SLOW", "slow 1", 10.0)
