"""Zone membership, gate crossings and origin-destination flow."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.geometry import gate_hits, nearest_gate, point_in_polygon, with_edges
from lanewise.functions.motion import BOTTOM_CENTRE, bottom_centre
from lanewise.plans.chunks import CHUNK, previous, running_sum
from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

TRACK = ["video_id", "track_id"]
VISIT = ["video_id", "zone_id", "track_id"]


def sightings(
    boxes: DataFrame, zones: DataFrame, chunk_frames: int = CHUNK, near_walls_only: bool = True
) -> DataFrame:
    """Each box against each zone of its camera: positions, membership now and at the sighting before.

    Nothing can happen on a move that stays clear of every polygon edge and gate, so by default
    only first sightings and moves near one are kept.

    Boxes may bring ground positions ``x, y``; without them crossings report (0, 0).
    """
    moves = previous(box_points(boxes), TRACK, "frame_id", ["px", "py"], chunk_frames)
    return against_zones(moves, zones, near_walls_only)


def box_points(boxes: DataFrame, *keep: str) -> DataFrame:
    px, py = bottom_centre()
    if "x" not in boxes.columns:
        boxes = boxes.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return boxes.select(*TRACK, "frame_id", "ts", px.alias("px"), py.alias("py"), "x", "y", *keep)


def against_zones(moves: DataFrame, zones: DataFrame, near_walls_only: bool = True) -> DataFrame:
    """Moves ``prev_px, prev_py`` -> ``px, py`` joined with the zones of their camera."""
    no_gates = F.from_json(F.lit("[]"), zones.schema["gates"].dataType)
    ready = with_walls(with_edges(zones).withColumn("gates", F.coalesce("gates", no_gates))).drop("polygon")
    joined = lookup_join(moves, ready, ["video_id"], "inner")
    if near_walls_only:
        # Lambdas are slow: most moves are told by two boxes that the walls of the zone have in common.
        joined = joined.where(
            f"prev_px is null or ({_meets('reach')} and not coalesce({_within('clear')}, false)"
            f" and exists(walls, w -> {_meets('w')}))"
        )
    return joined.withColumns(
        {
            "inside": point_in_polygon("px", "py"),
            "was_inside": point_in_polygon("prev_px", "prev_py"),
            "first_seen": F.expr("prev_px is null"),
        }
    )


def _meets(box: str) -> str:
    """Whether the bounding box of a move touches ``box``."""
    return (
        f"(least(prev_px, px) <= {box}.x1 and greatest(prev_px, px) >= {box}.x0"
        f" and least(prev_py, py) <= {box}.y1 and greatest(prev_py, py) >= {box}.y0)"
    )


def _within(box: str) -> str:
    return (
        f"(least(prev_px, px) > {box}.x0 and greatest(prev_px, px) < {box}.x1"
        f" and least(prev_py, py) > {box}.y0 and greatest(prev_py, py) < {box}.y1)"
    )


def with_walls(zones: DataFrame, slack: float = 1e-3) -> DataFrame:
    """Adds ``walls``: the bounding boxes, a little widened, of polygon edges and gates; and two boxes for quick tests.

    No wall reaches out of ``reach``, none into ``clear``. The latter starts as the whole plane and is cut back at each
    wall that reaches into it, on the side on which most is left around the middle; it is empty if a wall lies there.
    """

    def box(v: str, ax: str, ay: str, bx: str, by: str) -> str:
        sides = [f"least({v}.{ax}, {v}.{bx})", f"greatest({v}.{ax}, {v}.{bx})", f"least({v}.{ay}, {v}.{by})", f"greatest({v}.{ay}, {v}.{by})"]
        named = zip(("x0", "x1", "y0", "y1"), sides, ("-", "+", "-", "+"))
        return f"{v} -> named_struct(" + ", ".join(f"'{n}', {side} {sign} {slack}D" for n, side, sign in named) + ")"

    edges, gates = box("e", "x", "y", "ox", "oy"), box("g", "p1x", "p1y", "p2x", "p2y")
    with_boxes = zones.withColumn("walls", F.expr(f"array_distinct(concat(transform(edges, {edges}), transform(gates, {gates})))"))
    ends = ", ".join(f"'{c}', array_{'min' if c[1] == '0' else 'max'}(transform(walls, w -> w.{c}))" for c in ("x0", "x1", "y0", "y1"))
    return with_boxes.withColumn("reach", F.expr(f"named_struct({ends})")).withColumn("clear", F.expr(_CLEAR))


def _clear() -> str:
    mid = {a: f"((reach.{a}0 + reach.{a}1) / 2)" for a in "xy"}
    left = {
        "x1": f"w.x0 - {mid['x']}", "x0": f"{mid['x']} - w.x1", "y1": f"w.y0 - {mid['y']}", "y0": f"{mid['y']} - w.y1"
    }
    wall = {"x1": "w.x0", "x0": "w.x1", "y1": "w.y0", "y0": "w.y1"}
    most = f"greatest({', '.join(left.values())})"

    def box(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{c}', {new.get(c, f'f.{c}')}" for c in ("x0", "x1", "y0", "y1")) + ")"

    cuts = " ".join(f"when {left[c]} = {most} then {box(**{c: wall[c]})}" for c in left)
    empty = box(x0="0D", x1="0D")
    reaches_in = "coalesce(w.x0 < f.x1 and w.x1 > f.x0 and w.y0 < f.y1 and w.y1 > f.y0, false)"
    plane = box(**{c: f"double('{'-' if c[1] == '0' else ''}infinity')" for c in ("x0", "x1", "y0", "y1")})
    return (
        f"aggregate(walls, {plane}, (f, w) -> case when not {reaches_in} then f"
        f" when coalesce({most} > 0, false) then case {cuts} else {empty} end else {empty} end)"
    )


_CLEAR = _clear()


def zone_membership(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    return lookup_join(boxes, with_edges(zones), ["video_id"], "inner").select(
        *VISIT, "frame_id", point_in_polygon(f"({BOTTOM_CENTRE[0]})", BOTTOM_CENTRE[1]).alias("inside")
    )


def confirmed_crossings(boxes: DataFrame, zones: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    return crossings(boxes, zones, chunk_frames).where(F.col("confidence") == "confirmed")


def crossings(boxes: DataFrame, zones: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    """Gate events of every vehicle: confirmed where its move touches a gate, else estimated.

    Membership that changes without a touched gate is put down to the nearest gate: an entry on
    first sight inside, an entry later only while the vehicle has none, an exit always.
    Order within a vehicle: ``frame_id, gate_idx``. The few events are staged on the way.
    """
    events = staged(gate_events(sightings(boxes, zones, chunk_frames)))
    first_enter = (
        events.where(F.col("e.direction") == "enter").groupBy(*VISIT).agg(F.min("frame_id").alias("first_enter"))
    )
    return (
        events.join(first_enter, VISIT, "left")
        .where("not coalesce(estimate = 'enter' and frame_id > first_enter, false)")
        .selectExpr(*CROSSING)
    )


CROSSING = [
    "video_id", "ts", "frame_id", "track_id", "zone_id", "e.idx as gate_idx", "e.name as gate_name",
    "e.direction as direction", "e.confidence as confidence", "e.x as pixel_x", "e.y as pixel_y",
    "x as real_x", "y as real_y",
]


def gate_events(seen: DataFrame, *keep: str) -> DataFrame:
    """Touched gates and guesses ``e`` of each sighting; ``estimate`` tells guesses apart. Needs no shuffle.

    Columns named in ``keep`` stay.
    """
    # An outer explode, because Spark turns an inner one into a filter that it pushes below the
    # projections, and so works everything out twice.
    return (
        seen.withColumn("hits", gate_hits("prev_px", "prev_py", "px", "py"))
        .withColumn("missed", F.expr("coalesce(size(hits), 0) <= 0 and size(gates) > 0"))
        .withColumn(
            "estimate",
            F.expr(
                "case when missed and inside and (first_seen or not was_inside) then 'enter'"
                " when missed and not first_seen and was_inside and not inside then 'exit' end"
            ),
        )
        .withColumn("near", F.when(F.col("estimate").isNotNull(), nearest_gate("px", "py")))
        .withColumn(
            "e",
            F.expr(
                "explode_outer(case when estimate is not null then array(named_struct('idx', near.idx, 'name', near.name,"
                " 'direction', estimate, 'x', px, 'y', py, 'confidence', 'estimated'))"
                " else transform(hits, m -> named_struct('idx', m.idx, 'name', m.name, 'direction', m.direction,"
                " 'x', m.x, 'y', m.y, 'confidence', 'confirmed')) end)"
            ),
        )
        .where("e is not null")
        .select(*VISIT, "frame_id", "ts", "x", "y", "estimate", "e", *keep)
    )


def in_period(
    events: DataFrame,
    start: float = 0.0,
    end: float = 9_999_999.0,
    zone_id: str | None = None,
    gate_name: str | None = None,
) -> DataFrame:
    """Flow filter, both time bounds included; apply before any of the flow aggregates."""
    kept = events.where(F.col("ts").between(start, end))
    if zone_id:
        kept = kept.where(F.col("zone_id") == zone_id)
    if gate_name:
        kept = kept.where(F.col("gate_name") == gate_name)
    return kept


def gate_counts(events: DataFrame) -> DataFrame:
    """Events per gate and direction."""
    return events.groupBy("video_id", "zone_id", "gate_name").agg(
        F.count_if(F.col("direction") == "enter").alias("enter"),
        F.count_if(F.col("direction") == "exit").alias("exit"),
    )


def _journeys(events: DataFrame) -> DataFrame:
    """First entry and last exit per vehicle and zone; null where there is none."""
    order = F.struct("frame_id", "gate_idx")
    what = F.struct("gate_name", "ts", "confidence")

    def only(direction, value):
        return F.when(F.col("direction") == direction, value)

    return events.groupBy(*VISIT).agg(
        F.min_by(what, only("enter", order)).alias("entry"), F.max_by(what, only("exit", order)).alias("exit")
    )


def gate_vehicle_counts(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Vehicles by first entry gate and by last exit gate, with zeros for every configured gate."""
    journeys = _journeys(events)
    used = (
        journeys.select(
            "video_id", "zone_id",
            F.explode(
                F.array(
                    F.struct(F.col("entry.gate_name").alias("gate_name"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                    F.struct(F.col("exit.gate_name").alias("gate_name"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                )
            ).alias("u"),
        )
        .where("u.gate_name is not null")
        .groupBy("video_id", "zone_id", F.col("u.gate_name").alias("gate_name"))
        .agg(F.sum("u.i").alias("entered"), F.sum("u.o").alias("exited"))
    )
    gates = zones.select("video_id", "zone_id", F.explode("gates.name").alias("gate_name"))
    return gates.join(used, ["video_id", "zone_id", "gate_name"], "left").fillna(0, ["entered", "exited"])


def od_pairs(events: DataFrame) -> DataFrame:
    """Every entry gate of a vehicle with every exit gate of the same zone, each by confidence."""
    keys = ["video_id", "zone_id", "track_id"]
    enters = (
        events.where("direction = 'enter'")
        .groupBy(*keys, F.col("gate_name").alias("origin_gate"), F.col("confidence").alias("entry_confidence"))
        .agg(F.min("ts").alias("entry_time"))
    )
    exits = (
        events.where("direction = 'exit'")
        .groupBy(*keys, F.col("gate_name").alias("dest_gate"), F.col("confidence").alias("exit_confidence"))
        .agg(F.max("ts").alias("exit_time"))
    )
    return _with_confidence(enters.join(exits, keys))


def od_summary(events: DataFrame) -> DataFrame:
    """First entry and last exit of each vehicle that has both."""
    done = _journeys(events).where("entry is not null and exit is not null")
    return _with_confidence(
        done.select(
            *VISIT,
            F.col("entry.gate_name").alias("origin_gate"),
            F.col("exit.gate_name").alias("dest_gate"),
            F.col("entry.ts").alias("entry_time"),
            F.col("exit.ts").alias("exit_time"),
            F.col("entry.confidence").alias("entry_confidence"),
            F.col("exit.confidence").alias("exit_confidence"),
        )
    )


def _with_confidence(od: DataFrame) -> DataFrame:
    both = (F.col("entry_confidence") == "confirmed") & (F.col("exit_confidence") == "confirmed")
    return od.withColumns(
        {
            "dwell_s": F.round(F.col("exit_time") - F.col("entry_time"), 2),
            "od_confidence": F.when(both, "confirmed").otherwise("estimated"),
        }
    )


def od_matrix(summary: DataFrame) -> DataFrame:
    """Vehicles per zone, origin and destination gate, long form."""
    return summary.groupBy("video_id", "zone_id", "origin_gate", "dest_gate").agg(F.count("*").alias("vehicles"))


def zone_volume(events: DataFrame) -> DataFrame:
    return events.groupBy("video_id", "zone_id").agg(F.count_if(F.col("direction") == "enter").alias("volume"))


def occupancy(boxes: DataFrame, zones: DataFrame, at: float | None = None) -> DataFrame:
    """Vehicles whose last known position (up to ``at`` seconds) is inside; vanished ones still count."""
    px, py = bottom_centre()
    seen = boxes if at is None else boxes.where(F.col("ts") <= at)
    last = seen.groupBy("video_id", "track_id").agg(
        F.max_by(F.struct(px.alias("px"), py.alias("py")), F.col("frame_id")).alias("p")
    )
    return (
        lookup_join(last, with_edges(zones), ["video_id"], "inner")
        .groupBy("video_id", "zone_id")
        .agg(F.count_if(point_in_polygon("p.px", "p.py")).alias("occupancy"))
    )


def occupancy_series(boxes: DataFrame, zones: DataFrame, chunk_frames: int = CHUNK) -> DataFrame:
    """Occupancy after each frame in which it changed hands. The few changes are staged, as the sum reads them twice."""
    change = (F.col("inside").cast("int") - F.col("was_inside").cast("int")).alias("change")
    per_frame = staged(
        sightings(boxes, zones, chunk_frames)
        .where("inside <> was_inside")
        .groupBy("video_id", "zone_id", "frame_id")
        .agg(F.sum(change).alias("change"))
    )
    return running_sum(per_frame, ["video_id", "zone_id"], ["frame_id"], "change", "occupancy", chunk_frames)


def top_dwell(summary: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` longest stays."""
    return summary.orderBy(F.col("dwell_s").desc(), "video_id", "zone_id", "track_id").limit(k)
