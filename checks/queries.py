"""Every registered query: operators over inputs derived from the given tables.

Chunks are kept far shorter than the default, so that the chunk borders of every windowed
operator are checked too.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import motion as fm
from lanewise.functions.geometry import nearest_gate
from lanewise.functions.text import entity_is_active, normalise_label
from lanewise.operators import alerts as al
from lanewise.operators import behaviour as be
from lanewise.operators import graph as gr
from lanewise.operators import metrics as me
from lanewise.operators import questions as qu
from lanewise.operators import rules as ru
from lanewise.operators import trajectories as tr
from lanewise.operators import triples as tp
from lanewise.operators import vectors as ve
from lanewise.operators import zones as zo
from lanewise.plans.joins import beside
from lanewise.plans.staging import staged
from lanewise.sources import adapters as ad
from lanewise.sources import readers as rd
from lanewise.sources import writers as wr

CHUNK = 256
FPS = ad.FPS
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(name):
    return F.round(name, 6).alias(name)


# ---- shared inputs ------------------------------------------------------------------------


def ground(spark, sf) -> DataFrame:
    return tr.project_to_ground(ad.boxes(spark, sf), ad.calibrations(spark, sf))


def positions(spark, sf) -> DataFrame:
    return ground(spark, sf).select("video_id", "track_id", "frame_id", "ts", "box_ord", "x", "y")


def traj(spark, sf) -> DataFrame:
    return tr.trajectories(positions(spark, sf), fps=FPS, chunk_frames=CHUNK)


def fired_alerts(spark, sf) -> DataFrame:
    return al.alerts(traj(spark, sf), fps=FPS, chunk_frames=CHUNK)


def gate_events(spark, sf) -> DataFrame:
    return zo.crossings(ground(spark, sf), ad.zones(spark, sf), CHUNK)


def interactions(spark, sf) -> DataFrame:
    return tp.drop_hallucinated(tp.normalise_triples(tp.extract_triples(ad.model_texts(spark, sf))))


def edges(spark, sf) -> DataFrame:
    return gr.interaction_edges(interactions(spark, sf))


def precedes(spark, sf) -> DataFrame:
    active = ad.model_texts(spark, sf).select("video_id", "frame_id", F.explode("active_ids").alias("track_id"))
    return gr.precedes_edges(interactions(spark, sf), active, chunk_frames=CHUNK)


def ticks(spark, sf) -> DataFrame:
    boxes = ad.boxes(spark, sf)
    eligible = be.eligible_frames(boxes)
    forced = be.forced_ticks(eligible, fired_alerts(spark, sf))
    return be.macro_ticks(eligible, ad.motion_scores(spark, sf), forced, FPS)


def history(spark, sf) -> DataFrame:
    """Lookback of every box at every interval tick over the confident detections only, so that
    some vehicles have none."""
    boxes = ad.boxes(spark, sf)
    every = max(1, FPS // 3)
    active = boxes.where((F.col("frame_id") > 0) & (F.col("frame_id") % every == 0))
    seen = tr.project_to_ground(tr.filter_detections(boxes), ad.calibrations(spark, sf))
    rows = tr.trajectories(
        seen.select("video_id", "track_id", "frame_id", "ts", "x", "y"), fps=FPS, chunk_frames=CHUNK
    )
    return be.lookback(active.select("video_id", "track_id", "frame_id", "ts"), rows, FPS, chunk_frames=CHUNK)


def centroids(spark, sf) -> DataFrame:
    """One query vector per label: the mean of all its vectors, in whole millionths so that it adds up exactly."""
    items = ad.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
    mean = (
        items.groupBy("label", "i")
        .agg(F.sum(F.floor(F.col("e").cast("double") * 1000000)).alias("s"), F.count("*").alias("n"))
        .select("label", "i", (F.col("s") / F.col("n") / 1000000.0).alias("m"))
    )
    # 64 numbers per label.
    return mean.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("query_vec")
    )


def model_calls(spark, sf) -> DataFrame:
    counts = tp.triple_drop_counts(ad.model_texts(spark, sf))
    return counts.select(
        "triples", "hallucinated", F.col("malformed").alias("incomplete"),
        (F.col("frame_id") * 3 + F.col("elements")).cast("double").alias("latency_ms"),
    )


def operations(spark, sf) -> DataFrame:
    return ad.table(spark, sf, "events").select(
        F.col("event_type").alias("op"), F.col("value").alias("ms"),
        (F.col("user_id") % 100).alias("rows"), F.lit(None).cast("double").alias("similarity"),
    )


def agent_questions(spark, sf) -> DataFrame:
    """One question per conversation; a turn is a tool call of its role, the last turn the answer."""
    turns = F.collect_list(F.struct("turn", "role"))
    return (
        ad.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(
            F.transform(F.array_sort(turns), lambda t: t["role"]).alias("tools"),
            F.max_by("text", "turn").alias("answer"),
            F.sum(F.length("text")).cast("double").alias("latency_ms"),
        )
        .withColumn(
            "route", F.when(F.array_contains("tools", "system"), "full_analysis").otherwise("semantic_lookup")
        )
    )


# ---- sources, projections, scalars --------------------------------------------------------


@query
def read_boxes_dedup(spark, sf):
    """Every box twice, the repeat listed later and moved: only the repeats stay."""
    boxes = ad.boxes(spark, sf)
    again = boxes.withColumns(
        {"box_ord": F.col("box_ord") + 500, "x1": F.col("x1") + F.col("cls"), "y2": F.col("y2") - 1}
    )
    both = boxes.unionByName(again.where("track_id % 3 <> 0"))
    return tr.dedup_boxes(both).groupBy("video_id", "cls").agg(
        F.count("*").alias("n"), F.sum("box_ord").alias("sum_ord"),
        F.sum("x1").alias("sum_x1"), F.sum("y2").alias("sum_y2"),
    )


@query
def filter_detections(spark, sf):
    return (
        tr.filter_detections(ad.boxes(spark, sf), 0.3, [2, 3, 5])
        .groupBy("video_id", "cls")
        .agg(F.count("*").alias("n"), F.min("conf").alias("min_conf"), F.sum("frame_id").alias("sum_frame"))
    )


@query
def label_lookup(spark, sf):
    events = ad.table(spark, sf, "events")
    labels = events.select(
        "event_id",
        F.concat(
            F.element_at(F.array(*map(F.lit, ["A ", "the ", " AN ", "", "the a "])), (F.col("user_id") % 5 + 1).cast("int")),
            F.upper("event_type"), F.lit(" "),
        ).alias("label"),
    )
    vocab = events.where("event_type <> 'error'").groupBy(F.col("event_type").alias("label")).agg(
        F.min("event_id").alias("class_id")
    )
    return tp.label_lookup(labels, vocab).groupBy("label", "class_id").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("sum_id")
    )


@query
def scene_density(spark, sf):
    return (
        tr.scene_density(ad.boxes(spark, sf))
        .groupBy("video_id", "density", "mode")
        .agg(
            F.count("*").alias("n"), F.sum("centre_x").alias("sum_x"),
            F.sum("centre_y").alias("sum_y"), F.sum("hue").alias("sum_hue"),
        )
    )


@query
def project_to_ground(spark, sf):
    return ground(spark, sf).select("video_id", "frame_id", "track_id", "px", "py", r6("x"), r6("y"))


@query
def frame_times(spark, sf):
    """Frame times at each event's own frame rate, cut to whole frames, 0 meaning 30."""
    rated = ad.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 500).alias("frame_id"), F.col("value").alias("fps")
    )
    return rated.select("event_id", F.round(fm.frame_time("fps"), 6).alias("ts"))


@query
def window_pointers(spark, sf):
    frames = ad.boxes(spark, sf).groupBy("video_id", "frame_id").agg(F.min("ts").alias("ts"))
    starts = frames.withColumns({"s": F.round(fm.window_start("ts"), 1), "e": F.round("ts", 1)})
    labelled = starts.withColumn("pointer", fm.window_pointer("s", "e"))
    return labelled.select("video_id", "frame_id", "pointer", fm.pointer_start("pointer").alias("start_ts"))


@query
def latlon_to_local(spark, sf):
    return rd.latlon_to_local(ad.placemarks(spark, sf))


@query
def nearest_gates(spark, sf):
    near = nearest_gate(f"({fm.BOTTOM_CENTRE[0]})", fm.BOTTOM_CENTRE[1])
    joined = ad.boxes(spark, sf).join(ad.zones(spark, sf), "video_id")
    return (
        joined.select("video_id", near.alias("near"))
        .groupBy("video_id", F.col("near.name").alias("gate_name"))
        .agg(F.count("*").alias("n"), F.round(F.max("near.d2"), 4).alias("max_d2"))
    )


@query
def validate_zones(spark, sf):
    """Zones that lose corners, gates or their name by supplier number."""
    n = F.substring("video_id", 4, 20).cast("bigint")
    broken = ad.zones(spark, sf).withColumns(
        {
            "polygon": F.slice("polygon", F.lit(1), F.when(n % 4 == 1, 2).otherwise(5)),
            "gates": F.slice("gates", F.lit(1), F.when(n % 4 == 2, 0).otherwise(4)),
            "zone_id": F.when(n % 4 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("zone_id"))),
        }
    )
    return rd.validate_zones(broken).select(
        "video_id", "zone_id", F.coalesce("error", F.lit("ok")).alias("error")
    )


# ---- trajectories -------------------------------------------------------------------------


@query
def track_segments(spark, sf):
    return tr.track_segments(positions(spark, sf), chunk_frames=CHUNK).select(
        "video_id", "track_id", "frame_id", F.coalesce("gap", F.lit(-1)).alias("gap"), "segment"
    )


@query
def fill_gaps(spark, sf):
    return tr.fill_gaps(positions(spark, sf), chunk_frames=CHUNK).select(
        "video_id", "track_id", "frame_id", "is_real", r6("x"), r6("y")
    )


@query
def kinematics_cold(spark, sf):
    return traj(spark, sf).where("not warm").select(
        "video_id", "track_id", "frame_id", r6("vx"), r6("vy"), r6("ax"), r6("ay")
    )


@query
def kinematics_sg(spark, sf):
    return traj(spark, sf).where("warm").select(
        "video_id", "track_id", "frame_id", r6("vx"), r6("vy"), r6("ax"), r6("ay")
    )


@query
def warm_share(spark, sf):
    return traj(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if("warm").alias("warm_rows")
    )


@query
def trajectory_window(spark, sf):
    """Each vehicle's rows in the first two seconds after its event's start."""
    asked = ad._passages(spark, sf).select(
        "video_id", "track_id", (F.col("start_frame") / 10.0).alias("t0"), (F.col("start_frame") / 10.0 + 2.0).alias("t1")
    )
    return tr.trajectory_window(traj(spark, sf), asked).select("video_id", "track_id", "frame_id", "ts", r6("vx"), r6("vy"))


@query
def track_lifespan(spark, sf):
    return tr.track_lifespan(positions(spark, sf))


@query
def motion_columns(spark, sf):
    return fm.with_motion(traj(spark, sf)).select(
        "video_id", "track_id", "frame_id", r6("speed"), r6("accel_mag"), r6("signed_accel")
    )


@query
def behaviour_states(spark, sf):
    return be.with_state(traj(spark, sf)).groupBy("video_id", "track_id", "state").agg(F.count("*").alias("n"))


# ---- rules --------------------------------------------------------------------------------


def _rule(spark, sf, rule_id, *evidence):
    rules = ru.evaluate_rules(traj(spark, sf)).where(F.col("rule_id") == rule_id)
    return rules.select(
        "video_id", "track_id", "severity", "first_occurrence_s", *[F.col("evidence")[e].alias(e) for e in evidence]
    )


@query
def rule_speeding(spark, sf):
    return _rule(spark, sf, "SPEEDING", "max_speed_ms", "max_speed_kmh", "threshold_kmh", "duration_over_limit_s")


@query
def rule_hard_braking(spark, sf):
    return _rule(spark, sf, "HARD_BRAKING", "peak_deceleration_ms2", "threshold_ms2", "frames_in_hard_braking")


@query
def rule_aggressive_accel(spark, sf):
    return _rule(spark, sf, "AGGRESSIVE_ACCELERATION", "peak_accel_ms2", "threshold_ms2", "frames_flagged")


@query
def rule_violations(spark, sf):
    return ru.evaluate_rules(traj(spark, sf)).select(
        "video_id", "track_id", "rule_id", "severity", "first_occurrence_s", "hits"
    )


@query
def rule_custom(spark, sf):
    """A rule of one's own: crawling below walking pace."""
    crawl = ru.Rule("CRAWLING", "warm and speed < 1.5D", "warning", {"slowest_ms": "round(min(speed), 2)"})
    return ru.evaluate_rules(traj(spark, sf), (crawl,)).select(
        "video_id", "track_id", "rule_id", F.col("evidence")["slowest_ms"].alias("slowest_ms"), "hits"
    )


@query
def rule_report(spark, sf):
    return ru.rule_report(traj(spark, sf))


@query
def physics_stats(spark, sf):
    return ru.physics_stats(traj(spark, sf))


@query
def physics_stats_window(spark, sf):
    asked = ad._passages(spark, sf).select(
        "video_id", "track_id", (F.col("start_frame") / 10.0 + 1.0).alias("t0"), (F.col("start_frame") / 10.0 + 3.0).alias("t1")
    )
    return ru.physics_stats(traj(spark, sf), asked)


# ---- alerts -------------------------------------------------------------------------------


def _vehicle_alert(spark, sf, kind, value):
    found = al.describe(al.vehicle_candidates(traj(spark, sf)).where(F.col("alert_type") == kind))
    return found.select("video_id", "track_id", "frame_id", "severity", F.col("evidence")[value].alias(value))


@query
def alert_speeding(spark, sf):
    return _vehicle_alert(spark, sf, "SPEEDING", "speed_kmh")


@query
def alert_hard_braking(spark, sf):
    return _vehicle_alert(spark, sf, "HARD_BRAKING", "signed_accel_ms2")


@query
def alert_aggressive(spark, sf):
    return _vehicle_alert(spark, sf, "AGGRESSIVE_ACCEL", "accel_mag_ms2")


@query
def pair_distances(spark, sf):
    return al.close_pairs(traj(spark, sf)).select("video_id", "frame_id", "a_id", "b_id", r6("distance_m"), "closing")


def _pair_alert(spark, sf, kind):
    found = al.describe(al.pair_candidates(al.close_pairs(traj(spark, sf))).where(F.col("alert_type") == kind))
    return found.select(
        "video_id", "frame_id", "track_id", "id_lo", "id_hi", "severity", F.col("evidence")["distance_m"].alias("distance_m")
    )


@query
def alert_collision(spark, sf):
    return _pair_alert(spark, sf, "COLLISION_SUSPECTED")


@query
def alert_proximity(spark, sf):
    return _pair_alert(spark, sf, "PROXIMITY_WARNING")


@query
def alert_cooldown(spark, sf):
    return fired_alerts(spark, sf).select("video_id", "alert_type", "id_lo", "id_hi", "frame_id", "track_id")


@query
def alert_history(spark, sf):
    return al.alert_history(fired_alerts(spark, sf), 500).select(
        "video_id", "alert_type", "id_lo", "id_hi", "frame_id", "severity"
    )


@query
def alert_effectiveness(spark, sf):
    fired, seen = al.cooldown_tallied(al.alert_candidates(traj(spark, sf)), fps=FPS, chunk_frames=CHUNK)
    return al.alert_effectiveness(seen, fired)


# ---- zones --------------------------------------------------------------------------------

EVENT_COLS = ["video_id", "zone_id", "track_id", "frame_id", "gate_idx", "gate_name", "direction", "confidence"]


@query
def zone_membership(spark, sf):
    inside = zo.zone_membership(ad.boxes(spark, sf), ad.zones(spark, sf))
    return inside.select("video_id", "zone_id", "track_id", "frame_id", F.col("inside").cast("int").alias("inside"))


@query
def confirmed_crossings(spark, sf):
    return zo.confirmed_crossings(ground(spark, sf), ad.zones(spark, sf), CHUNK).select(
        *EVENT_COLS, F.round("pixel_x", 4).alias("pixel_x"), F.round("pixel_y", 4).alias("pixel_y")
    )


@query
def estimated_crossings(spark, sf):
    return gate_events(spark, sf).where("confidence = 'estimated'").select(*EVENT_COLS)


@query
def crossings(spark, sf):
    return gate_events(spark, sf).select(
        *EVENT_COLS, "ts", F.round("pixel_x", 4).alias("pixel_x"), F.round("pixel_y", 4).alias("pixel_y"),
        r6("real_x"), r6("real_y"),
    )


@query
def gate_counts(spark, sf):
    return zo.gate_counts(gate_events(spark, sf))


@query
def gate_counts_window(spark, sf):
    return zo.gate_counts(zo.in_period(gate_events(spark, sf), 10.0, 60.0, gate_name="North"))


@query
def gate_vehicle_counts(spark, sf):
    return zo.gate_vehicle_counts(gate_events(spark, sf), ad.zones(spark, sf))


OD_COLS = ["origin_gate", "dest_gate", "entry_time", "exit_time", "entry_confidence", "exit_confidence", "dwell_s", "od_confidence"]


@query
def od_pairs(spark, sf):
    return zo.od_pairs(gate_events(spark, sf)).select("video_id", "zone_id", "track_id", *OD_COLS)


@query
def od_summary(spark, sf):
    return zo.od_summary(gate_events(spark, sf)).select("video_id", "zone_id", "track_id", *OD_COLS)


@query
def od_matrix(spark, sf):
    return zo.od_matrix(zo.od_summary(gate_events(spark, sf)))


@query
def zone_volume(spark, sf):
    return zo.zone_volume(gate_events(spark, sf))


@query
def occupancy(spark, sf):
    return zo.occupancy(ad.boxes(spark, sf), ad.zones(spark, sf), at=30.0)


@query
def occupancy_series(spark, sf):
    return zo.occupancy_series(ad.boxes(spark, sf), ad.zones(spark, sf), CHUNK)


@query
def top_dwell(spark, sf):
    return zo.top_dwell(zo.od_summary(gate_events(spark, sf)), 20).select("video_id", "zone_id", "track_id", "dwell_s")


# ---- behaviour and sampling ---------------------------------------------------------------


@query
def behaviour_runs(spark, sf):
    return be.behaviour_runs(traj(spark, sf), CHUNK)


@query
def lookback_rows(spark, sf):
    return history(spark, sf).select(
        "video_id", "track_id", "frame_id", F.size("history").alias("n"),
        F.try_element_at("history", F.lit(1))["ts"].alias("first_ts"),
    )


@query
def lookback_segments(spark, sf):
    return (
        be.lookback_segments(history(spark, sf))
        .select("video_id", "track_id", "frame_id", F.explode_outer("segments").alias("s"))
        .where("s is not null")
        .select("video_id", "track_id", "frame_id", "s.state", "s.start_ts", "s.end_ts")
    )


@query
def lookback_summary(spark, sf):
    return be.lookback_summary(history(spark, sf)).select(
        "video_id", "track_id", "frame_id", F.round("now_speed", 4).alias("now_speed"),
        F.round("now_accel", 4).alias("now_accel"), F.col("now_speed").isNull().cast("int").alias("just_appeared"),
    )


@query
def tick_summaries(spark, sf):
    return be.tick_summaries(be.lookback_summary(history(spark, sf)))


@query
def interval_ticks(spark, sf):
    return be.interval_ticks(ad.boxes(spark, sf), FPS)


@query
def motion_energy(spark, sf):
    return be.motion_energy(ad.grey_frames(spark, sf), 32).select("video_id", "frame_id", r6("score"))


@query
def motion_energy_bytes(spark, sf):
    return be.motion_energy(ad.byte_frames(spark, sf), 32).select("video_id", "frame_id", r6("score"))


@query
def motion_gate(spark, sf):
    return be.motion_gate(be.interval_ticks(ad.boxes(spark, sf), FPS), ad.motion_scores(spark, sf)).select(
        "video_id", "frame_id", "score"
    )


@query
def forced_ticks(spark, sf):
    return be.forced_ticks(be.eligible_frames(ad.boxes(spark, sf)), fired_alerts(spark, sf)).select("video_id", "frame_id")


@query
def macro_ticks(spark, sf):
    return ticks(spark, sf).select(
        "video_id", "frame_id", F.col("forced").cast("int").alias("forced"), F.col("runs").cast("int").alias("runs")
    )


@query
def tick_counts(spark, sf):
    return be.tick_counts(ticks(spark, sf))


@query
def clip_buffer(spark, sf):
    chosen = be.interval_ticks(ad.boxes(spark, sf), FPS)
    return be.clip_buffer(chosen, chunk_frames=32).select(
        "video_id", "frame_id", "tick", F.array_join("clip", ",").alias("clip")
    )


@query
def stable_start(spark, sf):
    return be.stable_start(ad.shake_scores(spark, sf), threshold=45.0, chunk_frames=32)


@query
def profile_snapshots(spark, sf):
    summary = be.lookback_summary(history(spark, sf))
    return be.profile_snapshots(summary, positions(spark, sf), CHUNK)


# ---- triples and graph --------------------------------------------------------------------


@query
def extract_triples(spark, sf):
    return tp.extract_triples(ad.model_texts(spark, sf)).select(
        "video_id", "frame_id", "ord", "subject", "predicate", "object"
    )


@query
def normalise_triples(spark, sf):
    return tp.normalise_triples(tp.extract_triples(ad.model_texts(spark, sf))).select(
        "video_id", "frame_id", "ord", "subject_type", "object_type", "motion_state", "phase", "ts"
    )


@query
def drop_hallucinated(spark, sf):
    return interactions(spark, sf).select("video_id", "frame_id", "ord", "subject", "object")


@query
def triple_drop_counts(spark, sf):
    return tp.triple_drop_counts(ad.model_texts(spark, sf))


@query
def entity_check(spark, sf):
    """Names of every shape against an active list."""
    docs = ad.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.upper("event_type"), F.lit(" "), F.when(F.col("user_id") % 3 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string"))).alias("name"),
        F.when(F.col("event_id") % 4 == 0, "Pedestrian").otherwise("Vehicle").alias("kind"),
        F.array(F.col("event_id") % 150, F.col("user_id") % 40).alias("active"),
    )
    valid = entity_is_active(F.col("name"), F.col("kind"), F.col("active"))
    return docs.select("event_id", valid.cast("int").alias("valid"))


@query
def tick_sentences(spark, sf):
    return tp.tick_sentences(interactions(spark, sf)).select("video_id", "frame_id", "text")


@query
def event_chunks(spark, sf):
    """Documents as event texts, some of them blanked; whole texts are kept."""
    docs = ad.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "   ").otherwise(F.col("text")).alias("text"),
        (F.col("doc_id") / 10.0).alias("start_time"), (F.col("doc_id") / 10.0 + 5.0).alias("end_time"),
    )
    return wr.event_chunk_rows(docs).select("doc_id", "time_window", F.length("text").alias("n_chars"))


@query
def migrate_interactions(spark, sf):
    old = edges(spark, sf).drop("phase").withColumn(
        "motion_state", F.when(F.col("motion_state") != "PARALLEL", F.col("motion_state"))
    )
    return wr.migrate_interactions(old).groupBy("motion_state", "phase").agg(F.count("*").alias("n"))


@query
def merge_entities(spark, sf):
    return gr.merge_entities(edges(spark, sf))


@query
def count_entities(spark, sf):
    return gr.count_entities(gr.merge_entities(edges(spark, sf)))


@query
def interaction_edges(spark, sf):
    return gr.with_pointer(edges(spark, sf)).drop("ts")


@query
def precedes_edges(spark, sf):
    return precedes(spark, sf)


@query
def match_edges(spark, sf):
    return gr.match_edges(edges(spark, sf), "Vehicle", "Infrastructure", "click").select(
        "video_id", "frame_id", "subject", "object", "phase"
    )


@query
def window_chain(spark, sf):
    return gr.window_chain(precedes(spark, sf), 3)


@query
def entity_history(spark, sf):
    return gr.entity_history(edges(spark, sf))


@query
def graph_totals(spark, sf):
    return gr.graph_totals(edges(spark, sf), precedes(spark, sf))


@query
def interaction_partners(spark, sf):
    return gr.interaction_partners(edges(spark, sf))


@query
def entity_degree(spark, sf):
    return gr.entity_degree(edges(spark, sf))


# ---- vectors ------------------------------------------------------------------------------


def _store(spark, sf, key):
    return ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding", "label")


@query
def search_events(spark, sf):
    return ve.search_events(_store(spark, sf, "chunk_id"), centroids(spark, sf), 3).select(
        "query_id", "chunk_id", "rank", "score"
    )


QUESTIONS = ("braking, then stationary", "accelerating after moving for 1.0", "no history yet", "stationary for 3.0, speed 0.0")


@query
def search_profiles(spark, sf):
    """Which snapshots of vehicle profiles read most like each of four questions?"""
    named = F.format_string("%s/%d/%d", "video_id", "track_id", "frame_id")
    snapshots = staged(profile_snapshots(spark, sf).select(named.alias("profile_id"), F.col("summary").alias("text")))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")
    return ve.search_profiles(snapshots, asked, 20)


@query
def search_profile_vectors(spark, sf):
    return ve.search_profiles(_store(spark, sf, "profile_id"), centroids(spark, sf), 3).select(
        "query_id", "profile_id", "rank", "score"
    )


@query
def search_many(spark, sf):
    """Every twentieth vector against all of them."""
    asked = ad.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    return ve.search(_store(spark, sf, "chunk_id"), asked, "chunk_id", 5).select("query_id", "chunk_id", "rank", "score")


@query
def search_events_window(spark, sf):
    """Chunks with times: what is found says where to look it up."""
    timed = _store(spark, sf, "chunk_id").withColumns(
        {"start_time": F.expr("chunk_id * 2.5D"), "end_time": F.expr("chunk_id * 2.5D + 5D")}
    )
    return ve.search_events(timed, centroids(spark, sf), 4).select("query_id", "chunk_id", "rank", "time_window")


@query
def search_cosine(spark, sf):
    return ve.search(_store(spark, sf, "chunk_id"), centroids(spark, sf), "chunk_id", 5, "cosine").select(
        "query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance")
    )


@query
def classify_intent(spark, sf):
    prototypes = centroids(spark, sf).select(
        F.when(F.col("query_id") < 5, "full_analysis").otherwise("semantic_lookup").alias("intent"),
        F.col("query_vec").alias("embedding"),
    )
    asked = ad.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    return ve.classify_intent(asked, prototypes).select("vec_id", "intent", r6("full_score"), r6("lookup_score"))


@query
def approx_search(spark, sf):
    """Rows found for each query, and whether at least nine tenths of all true neighbours are among them."""
    asked = ad.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    store = _store(spark, sf, "chunk_id").select("chunk_id", "embedding")
    near = staged(ve.approx_search(store, asked, "chunk_id", 5))
    met = ve.recall(near, ve.search(store, asked, "chunk_id", 5), "chunk_id")
    share = beside(met.select("query_id"), met.agg((F.sum("found") >= 0.9 * F.sum("asked")).alias("recall_ok")))
    return near.groupBy("query_id").agg(F.count("*").alias("n")).join(share, "query_id").select("query_id", "n", "recall_ok")


@query
def text_vectors(spark, sf):
    docs = ad.table(spark, sf, "documents").select("doc_id", "text")
    vectors = ve.text_vectors(docs).select("doc_id", "n_words", vector_to_array("features").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select("doc_id", "n_words", F.round(norm, 6).alias("norm"))


# ---- metrics ------------------------------------------------------------------------------


@query
def percentile_floor(spark, sf):
    return me.percentile_floor(operations(spark, sf), ["op"], "ms", (50, 95, 99))


@query
def throughput(spark, sf):
    return me.throughput(ad.boxes(spark, sf), 142.3)


@query
def model_quality(spark, sf):
    return me.model_quality(model_calls(spark, sf))


@query
def alert_metrics(spark, sf):
    fired, seen = al.cooldown_tallied(al.alert_candidates(traj(spark, sf)), fps=FPS, chunk_frames=CHUNK)
    return me.alert_metrics(seen, fired).withColumn("distribution", F.to_json("distribution"))


@query
def store_metrics(spark, sf):
    """Store operations with the similarity of a search where the op is one."""
    ops = operations(spark, sf).withColumn(
        "similarity", F.when(F.col("op") == "view", F.floor(F.col("ms") * 100) / 10000.0)
    )
    return me.store_metrics(ops)


@query
def agent_metrics(spark, sf):
    return me.agent_metrics(agent_questions(spark, sf))


@query
def tool_distribution(spark, sf):
    return me.tool_distribution(agent_questions(spark, sf))


@query
def route_distribution(spark, sf):
    return me.route_distribution(agent_questions(spark, sf))


@query
def metrics_report(spark, sf):
    """The whole report; its maps as JSON."""
    fired, seen = al.cooldown_tallied(al.alert_candidates(traj(spark, sf)), fps=FPS, chunk_frames=CHUNK)
    boxes = ad.boxes(spark, sf)
    eligible = be.eligible_frames(boxes)
    run = be.macro_ticks(eligible, ad.motion_scores(spark, sf), be.forced_ticks(eligible, fired), FPS)
    graph = gr.graph_totals(edges(spark, sf), precedes(spark, sf))
    report = me.metrics_report(
        boxes, 142.3, model_calls(spark, sf), be.tick_counts(run), seen, fired,
        operations(spark, sf), graph, agent_questions(spark, sf),
    )
    return report.withColumns({c: F.to_json(c) for c in ("distribution", "stores", "tools", "routes")})


@query
def reprojection_error(spark, sf):
    return me.reprojection_error(ad.point_pairs(spark, sf), ad.calibrations(spark, sf))


@query
def point_errors(spark, sf):
    return me.point_errors(ad.point_pairs(spark, sf), ad.calibrations(spark, sf)).select(
        "video_id", "l_orderkey", "l_linenumber", "l_partkey", "pixel_x", "error_m"
    )


# ---- composite questions ------------------------------------------------------------------


@query
def brake_before_exit(spark, sf):
    """Journeys first: only vehicles that made one become trajectories."""
    trips = staged(zo.od_summary(gate_events(spark, sf)).where("entry_time <= exit_time"))
    seen = tr.project_to_ground(ad.boxes(spark, sf, trips), ad.calibrations(spark, sf))
    rows = tr.trajectories(
        seen.select("video_id", "track_id", "frame_id", "ts", "x", "y"), fps=FPS, chunk_frames=CHUNK
    )
    return qu.braked_before_exit(trips, rows)


@query
def interaction_speed(spark, sf):
    return qu.interaction_speed(edges(spark, sf), traj(spark, sf), chunk_frames=CHUNK).select(
        "video_id", "track_id", "frame_id", "predicate", r6("speed")
    )


@query
def top_acceleration(spark, sf):
    return qu.top_acceleration(traj(spark, sf), 20)


@query
def top_speed(spark, sf):
    return qu.top_speed(traj(spark, sf), 20)


@query
def incident(spark, sf):
    """Each label's nearest vector names the event, and so the window, that is looked into."""
    found = ve.search_events(_store(spark, sf, "chunk_id"), centroids(spark, sf), 2).select("query_id", "chunk_id")
    chunks = edges(spark, sf).select("video_id", "win_start", "win_end", "subject").where("subject like 'Vehicle %'").distinct()
    windows = chunks.join(found, F.expr("subject = concat('Vehicle ', chunk_id)")).select(
        F.col("query_id").alias("incident_id"), "video_id", "win_start", "win_end"
    )
    return qu.incident(windows, edges(spark, sf), traj(spark, sf))


@query
def interactions_by_predicate(spark, sf):
    return qu.interactions_by_predicate(edges(spark, sf))


@query
def timeline(spark, sf):
    return qu.timeline(
        be.behaviour_runs(traj(spark, sf), CHUNK), edges(spark, sf), fired_alerts(spark, sf), gate_events(spark, sf)
    )


@query
def early_entries(spark, sf):
    return qu.early_entries(gate_events(spark, sf), 30.0)
