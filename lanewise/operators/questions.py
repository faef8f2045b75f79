"""Questions that chain several operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.motion import with_motion
from lanewise.functions.text import vehicle_number
from lanewise.operators.rules import evaluate_rules
from lanewise.operators.zones import in_period
from lanewise.plans.chunks import CHUNK, asof
from lanewise.plans.joins import interval_join, lookup_join
from lanewise.plans.staging import staged
from lanewise.schemas import HARD_BRAKING_MS2

TRACK = ["video_id", "track_id"]


def braked_before_exit(summary: DataFrame, trajectories: DataFrame, gate: str | None = None) -> DataFrame:
    """Vehicles that entered (through ``gate``) and braked hard before they left.

    Braking rows are filtered first; a vehicle has one journey per zone, so the join adds no rows
    beyond zones. Trajectories of other vehicles add nothing: leave their boxes out before they
    become trajectories, at best where they are still narrow.
    """
    trips = summary if gate is None else summary.where(F.col("origin_gate") == gate)
    # An outer explode, because Spark puts the whole derivative into the filter for each time it is named, in a method
    # too long to be compiled.
    moving = with_motion(trajectories).withColumn("signed_accel", F.explode_outer(F.array("signed_accel")))
    braking = moving.where(F.col("signed_accel") < HARD_BRAKING_MS2)
    return (
        braking.join(trips.select("zone_id", *TRACK, "origin_gate", "entry_time", "exit_time"), TRACK)
        .where(F.col("ts").between(F.col("entry_time"), F.col("exit_time")))
        .groupBy("zone_id", *TRACK, "origin_gate")
        .agg(F.count("*").alias("braking_frames"), F.round(F.abs(F.min("signed_accel")), 2).alias("peak_deceleration_ms2"))
    )


def interaction_speed(
    edges: DataFrame, trajectories: DataFrame, partner_type: str = "Pedestrian", chunk_frames: int = CHUNK
) -> DataFrame:
    """Speed of each vehicle at its interactions with ``partner_type``: its latest row up to the edge.

    Only tracks that met a partner are looked at. Edges and speeds are staged, as they are read more than once.
    """
    seen = F.array(
        F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("kind"), F.col("object_type").alias("other")),
        F.struct(F.col("object").alias("name"), F.col("object_type").alias("kind"), F.col("subject_type").alias("other")),
    )
    wanted = F.filter(seen, lambda e: (e["kind"] == "Vehicle") & (e["other"] == partner_type))
    vehicles = staged(
        edges.select("video_id", "frame_id", "predicate", F.explode(wanted).alias("e"))
        .withColumn("track_id", vehicle_number(F.col("e.name")))
        .where("track_id is not null")
        .select(*TRACK, "frame_id", "predicate")
    )
    met = lookup_join(trajectories, vehicles.select(*TRACK).distinct(), TRACK, "left_semi")
    rows = staged(with_motion(met).select(*TRACK, "frame_id", "speed"))
    return asof(vehicles, rows, TRACK, "frame_id", ["speed"], chunk_frames)


def top_acceleration(trajectories: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` vehicles with the highest speed-up: per-task top-k, never a full sort."""
    return (
        with_motion(trajectories.where("warm"))
        .groupBy(*TRACK)
        .agg(F.round(F.max("signed_accel"), 2).alias("peak_accel_ms2"), F.round(F.max("speed"), 2).alias("max_speed_ms"))
        .orderBy(F.col("peak_accel_ms2").desc(), F.col("max_speed_ms").desc(), *TRACK)
        .limit(k)
    )


def top_speed(trajectories: DataFrame, k: int = 10) -> DataFrame:
    return (
        with_motion(trajectories)
        .groupBy(*TRACK)
        .agg(F.round(F.max("speed"), 2).alias("max_speed_ms"))
        .orderBy(F.col("max_speed_ms").desc(), *TRACK)
        .limit(k)
    )


def incident(events: DataFrame, edges: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Rules broken, within each found event's window, by the vehicles that interacted in it.

    ``events``: found event chunks with ``incident_id, video_id, win_start, win_end``.
    """
    windows = events.select("incident_id", "video_id", "win_start", "win_end").distinct()
    involved = (
        lookup_join(edges, windows, ["video_id", "win_start", "win_end"], "inner")
        .select(
            "incident_id", "video_id", "win_start", "win_end",
            F.explode(
                F.array(F.struct(F.col("subject").alias("n"), F.col("subject_type").alias("t")),
                        F.struct(F.col("object").alias("n"), F.col("object_type").alias("t")))
            ).alias("e"),
        )
        .where("e.t = 'Vehicle'")
        .withColumn("track_id", vehicle_number(F.col("e.n")))
        .where("track_id is not null")
        .select("incident_id", *TRACK, "win_start", "win_end")
        .distinct()
    )
    rows = interval_join(trajectories, involved, TRACK, "win_start", "win_end")
    # One rule pass per (incident, vehicle): the incident takes the place of the video in the key.
    keyed = rows.withColumn("video_id", F.struct("incident_id", "video_id"))
    return evaluate_rules(keyed).select(
        "video_id.incident_id", "video_id.video_id", "track_id", "rule_id", "first_occurrence_s", "hits"
    )


def interactions_by_predicate(edges: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Interactions and last occurrence per predicate and pair of types."""
    kept = edges if predicates is None else edges.where(F.col("predicate").isin(predicates))
    return kept.groupBy("predicate", "subject_type", "object_type").agg(
        F.count("*").alias("times"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def timeline(runs: DataFrame, edges: DataFrame, fired: DataFrame, events: DataFrame) -> DataFrame:
    """What every vehicle did: state runs, interactions, alerts and crossings as one list of facts.

    Filter by vehicle and time, then order by ``ts``; the filter reaches each part.
    """
    ends = F.array(
        F.struct(F.col("subject").alias("n"), F.col("subject_type").alias("t")),
        F.struct(F.col("object").alias("n"), F.col("object_type").alias("t")),
    )
    parts = [
        runs.select(*TRACK, F.col("start_ts").alias("ts"), F.lit("state").alias("kind"), F.col("state").alias("what")),
        edges.select("video_id", "ts", "predicate", F.explode(ends).alias("e"))
        .where("e.t = 'Vehicle'")
        .select(
            "video_id", vehicle_number(F.col("e.n")).alias("track_id"), "ts",
            F.lit("interaction").alias("kind"), F.col("predicate").alias("what"),
        )
        .where("track_id is not null"),
        fired.select("video_id", "ts", "alert_type", F.explode("involved_ids").alias("track_id")).select(
            *TRACK, "ts", F.lit("alert").alias("kind"), F.col("alert_type").alias("what")
        ),
        events.select(
            *TRACK, "ts", F.lit("crossing").alias("kind"), F.concat_ws(" ", "gate_name", "direction").alias("what")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def early_entries(events: DataFrame, until: float = 30.0) -> DataFrame:
    """Entries per gate in the first ``until`` seconds."""
    return (
        in_period(events, 0.0, until)
        .where("direction = 'enter'")
        .groupBy("video_id", "zone_id", "gate_name")
        .agg(F.count("*").alias("entries"), F.count_distinct("track_id").alias("vehicles"))
    )
