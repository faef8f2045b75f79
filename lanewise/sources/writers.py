"""Append-only sinks. Files are laid out for the questions asked of them: by video, sorted by track and time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.motion import window_pointer
from lanewise.operators.behaviour import changed_profiles
from lanewise.operators.graph import interaction_edges

# Upper bound of rows per file, so that a video with very many rows becomes many files.
ROWS_PER_FILE = 5_000_000


def _append(df: DataFrame, path: str, sort: list[str], partition: str = "video_id", fmt: str = "parquet") -> None:
    """Brings a video's rows together for few files, while rebalancing splits a video too large for one task.

    Rows that are dealt by video are written where they lie.
    """
    together = df if _dealt_by(df, partition) else df.hint("rebalance", partition)
    writer = together.sortWithinPartitions(partition, *sort).write.mode("append").format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(partition).save(path)


def _dealt_by(df: DataFrame, column: str) -> bool:
    """Whether the plan already has all rows of a value of ``column`` in one task."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    dealt = plan.outputPartitioning().toString()
    return dealt.startswith("hashpartitioning(") and dealt.split("(")[1].split("#")[0] == column and dealt.count("#") == 1


def write_trajectories(df: DataFrame, path: str) -> None:
    _append(df, path, ["track_id", "ts"])


def write_crossings(df: DataFrame, path: str) -> None:
    _append(df, path, ["zone_id", "gate_name", "ts"])


def write_alerts(df: DataFrame, path: str) -> None:
    """Evidence goes out as JSON text."""
    _append(df.withColumn("evidence", F.to_json("evidence")), path, ["ts"])


def write_zones(df: DataFrame, path: str) -> None:
    """One zone per line, as ``read_zones(..., lines=True)`` takes it."""
    polygon = F.transform("polygon", lambda p: F.array(p["x"], p["y"]))
    gates = F.transform(
        F.array_sort("gates"),
        lambda g: F.struct(
            g["name"].alias("name"), F.array(g["p1x"], g["p1y"]).alias("p1"), F.array(g["p2x"], g["p2y"]).alias("p2")
        ),
    )
    df.select("video_id", "zone_id", polygon.alias("polygon"), gates.alias("gates")).write.mode("append").json(path)


def event_chunk_rows(df: DataFrame) -> DataFrame:
    """Event texts worth storing, with their window label; blank ones are dropped."""
    return df.where(F.trim("text") != "").withColumn(
        "time_window", window_pointer("start_time", "end_time")
    )


def write_event_chunks(df: DataFrame, path: str) -> None:
    _append(event_chunk_rows(df), path, ["frame_id"])


def write_profiles(df: DataFrame, path: str) -> None:
    """Only snapshots that differ from the vehicle's snapshot before."""
    _append(changed_profiles(df), path, ["track_id", "frame_id"])


def write_interactions(triples: DataFrame, path: str) -> None:
    _append(interaction_edges(triples), path, ["win_start", "subject"])


def write_precedes(df: DataFrame, path: str) -> None:
    _append(df, path, ["name", "to_start"])


def migrate_interactions(df: DataFrame) -> DataFrame:
    """Edges written before the columns existed get the defaults. Read with ``mergeSchema``."""
    for col, default in (("motion_state", "APPROACHING"), ("phase", "normal")):
        old = F.col(col) if col in df.columns else F.lit(None).cast("string")
        df = df.withColumn(col, F.coalesce(old, F.lit(default)))
    return df
