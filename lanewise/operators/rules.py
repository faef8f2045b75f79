"""Auditable per-vehicle traffic rules, all evaluated in one aggregate pass."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.motion import kmh, with_motion
from lanewise.plans.joins import interval_join
from lanewise.schemas import AGGRESSIVE_ACCEL_MS2, HARD_BRAKING_MS2, SPEEDING_MS

TRACK = ["video_id", "track_id"]


@dataclass(frozen=True)
class Rule:
    """A rule as SQL text: ``when`` per row, ``evidence`` as aggregates, ``{hits}`` the rows that broke it.

    Rows offer ``ts, vx, vy, ax, ay, speed, accel_mag, signed_accel``. ``description`` may use
    ``track_id`` and the evidence names.
    """

    rule_id: str
    when: str
    severity: str
    evidence: dict[str, str] = field(default_factory=dict)
    description: str = "''"


DEFAULT_RULES = (
    Rule(
        "SPEEDING",
        f"speed > {SPEEDING_MS}D",
        "violation",
        {
            "max_speed_ms": "round(max(speed), 2)",
            "max_speed_kmh": "round(max(speed) * 3.6D, 1)",
            "threshold_kmh": f"round({SPEEDING_MS}D * 3.6D, 0)",
            "duration_over_limit_s": "round({hits} / count(*) * (max(ts) - min(ts)), 2)",
        },
        "format_string('Vehicle %d exceeded %.0f km/h, peak %.1f km/h', track_id, threshold_kmh, max_speed_kmh)",
    ),
    Rule(
        "HARD_BRAKING",
        f"signed_accel < {HARD_BRAKING_MS2}D",
        "warning",
        {
            "peak_deceleration_ms2": "round(abs(min(signed_accel)), 2)",
            "threshold_ms2": f"{-HARD_BRAKING_MS2}D",
            "frames_in_hard_braking": "{hits}",
        },
        "format_string('Vehicle %d hard braking, peak deceleration %.2f m/s2', track_id, peak_deceleration_ms2)",
    ),
    Rule(
        "AGGRESSIVE_ACCELERATION",
        f"accel_mag > {AGGRESSIVE_ACCEL_MS2}D",
        "warning",
        {
            "peak_accel_ms2": "round(max(accel_mag), 2)",
            "threshold_ms2": f"{AGGRESSIVE_ACCEL_MS2}D",
            "frames_flagged": "{hits}",
        },
        "format_string('Vehicle %d aggressive acceleration, peak %.2f m/s2', track_id, peak_accel_ms2)",
    ),
)


def evaluate_rules(trajectories: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One row per (vehicle, broken rule) with first time, severity, description and evidence map."""
    aggs = []
    for i, rule in enumerate(rules):
        hits = f"count_if({rule.when})"
        aggs.append(F.expr(hits).alias(f"_hits{i}"))
        aggs.append(F.expr(f"min(case when {rule.when} then ts end)").alias(f"_first{i}"))
        for name, sql in rule.evidence.items():
            aggs.append(F.expr(sql.format(hits=hits)).cast("double").alias(f"_{i}_{name}"))
    per_track = with_motion(trajectories).groupBy(*TRACK).agg(*aggs)

    described = per_track
    outcomes = []
    for i, rule in enumerate(rules):
        named = {name: F.col(f"_{i}_{name}") for name in rule.evidence}
        described = described.withColumns(named).withColumn(f"_text{i}", F.expr(rule.description)).drop(*named)
        evidence = F.create_map(*[part for name, value in named.items() for part in (F.lit(name), value)])
        outcomes.append(
            F.struct(
                F.lit(i).alias("rule_ord"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.severity).alias("severity"),
                F.col(f"_first{i}").alias("first_occurrence_s"),
                F.col(f"_text{i}").alias("description"),
                evidence.alias("evidence"),
                F.col(f"_hits{i}").alias("hits"),
            )
        )
    broken = F.filter(F.array(*outcomes), lambda o: o["hits"] > 0)
    return described.select(*TRACK, F.explode(broken).alias("o")).select(*TRACK, "o.*")


def rule_report(trajectories: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Every vehicle with its violation count; NO_VIOLATIONS where nothing fired."""
    count = sum((F.expr(f"cast(count_if({r.when}) > 0 as int)") for r in rules), F.lit(0))
    return (
        with_motion(trajectories)
        .groupBy(*TRACK)
        .agg(count.alias("violation_count"))
        .withColumn("result", F.when(F.col("violation_count") == 0, "NO_VIOLATIONS").otherwise("VIOLATIONS"))
    )


def physics_stats(trajectories: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Peak speed, strongest deceleration and row count per vehicle, or per requested time window."""
    keys = list(TRACK)
    if requests is not None:
        trajectories = interval_join(trajectories, requests.select(*TRACK, "t0", "t1"), TRACK, "t0", "t1")
        keys += ["t0", "t1"]
    return (
        with_motion(trajectories)
        .groupBy(*keys)
        .agg(
            F.round(F.max("speed"), 2).alias("max_speed_ms"),
            F.round(kmh(F.max("speed")), 1).alias("max_speed_kmh"),
            F.round(F.min("signed_accel"), 2).alias("min_signed_accel_ms2"),
            (F.min("signed_accel") < HARD_BRAKING_MS2).alias("hard_braking_detected"),
            F.count("*").alias("data_points"),
        )
    )
