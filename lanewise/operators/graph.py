"""The interaction graph as edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.motion import window_pointer, window_start
from lanewise.functions.text import entity_type
from lanewise.plans.chunks import CHUNK, previous
from lanewise.plans.joins import beside
from lanewise.schemas import HISTORY_S


def interaction_edges(triples: DataFrame, seconds: float = HISTORY_S) -> DataFrame:
    """Directed edges with the time window that leads up to the tick; blank ends are dropped."""
    start = F.round(window_start("ts", seconds), 1)
    return (
        triples.withColumns({c: F.trim(c) for c in ("subject", "predicate", "object")})
        .where("subject <> '' and object <> ''")
        .select(
            "video_id", "frame_id", "ts",
            "subject", entity_type(F.col("subject_type"), F.col("subject")).alias("subject_type"),
            "predicate",
            "object", entity_type(F.col("object_type"), F.col("object")).alias("object_type"),
            F.upper(F.coalesce("motion_state", F.lit("APPROACHING"))).alias("motion_state"),
            F.lower(F.coalesce("phase", F.lit("normal"))).alias("phase"),
            start.alias("win_start"), F.round("ts", 1).alias("win_end"),
        )
    )


def with_pointer(edges: DataFrame) -> DataFrame:
    return edges.withColumn("window", window_pointer("win_start", "win_end"))


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge once per end: ``name, entity_type, partner, partner_type, role``."""
    def end(me, other, role):
        return F.struct(
            me[0].alias("name"), me[1].alias("entity_type"), other[0].alias("partner"),
            other[1].alias("partner_type"), F.lit(role).alias("role"),
        )

    sub = (F.col("subject"), F.col("subject_type"))
    obj = (F.col("object"), F.col("object_type"))
    return edges.withColumn("e", F.explode(F.array(end(sub, obj, "subject"), end(obj, sub, "object"))))


def merge_entities(edges: DataFrame) -> DataFrame:
    """Distinct typed nodes; duplicates collapse map-side before the shuffle."""
    return _ends(edges).select("video_id", "e.entity_type", "e.name").distinct()


def count_entities(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("entities"))


def precedes_edges(
    productive: DataFrame, active: DataFrame, seconds: float = HISTORY_S, chunk_frames: int = CHUNK
) -> DataFrame:
    """Per vehicle active at a tick: the window of the tick before -> this tick's window.

    ``productive``: (video, frame, ts) of ticks with at least one validated triple.
    ``active``: (video, frame, track_id).
    """
    ticks = (
        productive.select("video_id", "frame_id", "ts")
        .distinct()
        .select(
            "video_id", "frame_id",
            F.round(window_start("ts", seconds), 1).alias("win_start"),
            F.round("ts", 1).alias("win_end"),
        )
    )
    linked = previous(ticks, ["video_id"], "frame_id", ["win_start", "win_end"], chunk_frames).where(
        "prev_win_start is not null"
    )
    return active.join(linked, ["video_id", "frame_id"]).select(
        "video_id",
        F.concat(F.lit("Vehicle "), F.col("track_id").cast("string")).alias("name"),
        F.col("prev_win_start").alias("from_start"), F.col("prev_win_end").alias("from_end"),
        F.col("win_start").alias("to_start"), F.col("win_end").alias("to_end"),
        F.round(F.col("win_start") - F.col("prev_win_start"), 6).alias("gap_seconds"),
    )


def match_edges(
    edges: DataFrame,
    subject_type: str | None = None,
    object_type: str | None = None,
    predicate: str | None = None,
    window: tuple[float, float] | None = None,
) -> DataFrame:
    """Edges that fit all the given conditions; each reaches the scan as a filter."""
    for col, wanted in (("subject_type", subject_type), ("object_type", object_type), ("predicate", predicate)):
        if wanted is not None:
            edges = edges.where(F.col(col) == wanted)
    if window is not None:
        edges = edges.where((F.col("win_start") == window[0]) & (F.col("win_end") == window[1]))
    return edges


def window_chain(precedes: DataFrame, hops: int = 3) -> DataFrame:
    """Paths of 1 to ``hops`` linked windows of one entity, by first and last window.

    Windows of an entity are linked one to one, so a hop adds at most one row per path.
    """
    edge = precedes.select("video_id", "name", "from_start", "from_end", "to_start", "to_end").distinct()
    step = edge.select(
        "video_id", "name",
        F.col("from_start").alias("to_start"), F.col("from_end").alias("to_end"),
        F.col("to_start").alias("next_start"), F.col("to_end").alias("next_end"),
    )
    path = edge.withColumn("hops", F.lit(1))
    paths = path
    for n in range(2, hops + 1):
        path = path.join(step, ["video_id", "name", "to_start", "to_end"]).select(
            "video_id", "name", "from_start", "from_end",
            F.col("next_start").alias("to_start"), F.col("next_end").alias("to_end"), F.lit(n).alias("hops"),
        )
        paths = paths.unionByName(path)
    return paths


def entity_history(edges: DataFrame, name: str | None = None) -> DataFrame:
    """Edges seen from each entity they touch, or from one; order by ``ts`` for its story."""
    seen = _ends(edges).select(
        "video_id", "frame_id", "ts", "e.name", "e.entity_type", "e.role", "predicate", "e.partner", "phase"
    )
    return seen if name is None else seen.where(F.col("name") == name)


def graph_totals(edges: DataFrame, precedes: DataFrame) -> DataFrame:
    """Node and edge counts."""
    nodes = merge_entities(edges).select("video_id", "name").unionByName(precedes.select("video_id", "name")).distinct()
    totals = nodes.agg(F.count("*").alias("nodes"))
    totals = beside(totals, edges.agg(F.count("*").alias("interactions")))
    return beside(totals, precedes.agg(F.count("*").alias("precedes")))


def interaction_partners(edges: DataFrame) -> DataFrame:
    """Times each ordered pair met per predicate; the pair counts, not the rows, travel."""
    return edges.groupBy("video_id", "subject", "object", "predicate").agg(F.count("*").alias("times"))


def entity_degree(edges: DataFrame) -> DataFrame:
    """Edges and distinct partners per entity, from pair counts."""
    pairs = _ends(edges).groupBy("video_id", "e.name", "e.partner").agg(F.count("*").alias("n"))
    return pairs.groupBy("video_id", "name").agg(F.sum("n").alias("degree"), F.count("*").alias("partners"))
