"""Traffic-shaped inputs derived row by row from the star-schema tables in TESTDATA.md.

One event becomes one vehicle passage of up to 40 detections, with detection gaps of 0 to 7
frames. 500 consecutive events make one video, so the crowding of a frame does not grow with
the data. Events are dealt to tasks by video while they are narrow: what is worked out per video,
frame or track then finds its rows together, and the forty times wider boxes need not be shuffled.
"""

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.plans.joins import lookup_join

FPS = 10
EVENTS_PER_VIDEO = 500
#: Tasks grow in number with the events, not in size.
EVENTS_PER_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _passages(spark: SparkSession, sf_dir: str, tracks: DataFrame | None = None) -> DataFrame:
    """One row per event: its video, start frame and integer driver ``k``; a video's rows in one task.

    With ``tracks``, those of the listed (video, track) only; they are picked before events are dealt.
    """
    events = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, ceil(events.count() / EVENTS_PER_TASK))
    passages = events.selectExpr(
        "concat('cam', cast(event_id div 500 as string)) as video_id",
        "event_id as track_id",
        "event_type",
        "cast(get_json_object(props, '$.k') as int) as k",
        "((event_id % 500) div 40) * 70 + (event_id % 500) % 40 as start_frame",
    )
    if tracks is not None:
        listed = tracks.select("video_id", "track_id").distinct()
        passages = lookup_join(passages, listed, ["video_id", "track_id"], "left_semi")
    return passages.repartition(tasks, "video_id")


def boxes(spark: SparkSession, sf_dir: str, tracks: DataFrame | None = None) -> DataFrame:
    """Tracked boxes; one row per (video, track, frame). With ``tracks``, the boxes of those only."""
    return (
        _passages(spark, sf_dir, tracks)
        .selectExpr("*", "explode(sequence(0, 39)) as j")
        .where("(j + k) % 24 >= k % 8")
        .selectExpr(
            "video_id",
            "start_frame + j as frame_id",
            "track_id",
            "cast((track_id * 7) % 500 as int) as box_ord",
            "100.0D + (k * 13) % 800 + (case when track_id % 2 = 0 then 1 else -1 end)"
            " * ((k % 37) * j + ((track_id % 17) - 8) * j * (j - 1) / 16.0D) + (k * j) % 3 as cx",
            "cast(120 + 30 * (track_id % 25) + j * (k % 5 - 2) as double) as cy",
            "((track_id + 3 * j) % 100) / 100.0D as conf",
            "cast(2 + k % 4 as int) as cls",
        )
        .selectExpr(
            "video_id", "frame_id", f"frame_id / {FPS}.0D as ts", "box_ord", "track_id",
            "cx - 20.0D as x1", "cy - 24.0D as y1", "cx + 20.0D as x2", "cy as y2", "conf", "cls",
        )
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One homography per camera, cameras numbered like suppliers."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('cam', cast(s_suppkey as string)) as video_id",
        "array(0.05D, 0.001D * (s_suppkey % 3), -5.0D, 0.0D, 0.05D, -2.0D,"
        " 0.0D, 0.00001D * (s_suppkey % 4), 1.0D) as h",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-cornered zone with four gates per camera; the East gate lies inside the East corner."""
    return (
        table(spark, sf_dir, "supplier")
        .selectExpr(
            "concat('cam', cast(s_suppkey as string)) as video_id",
            "concat('junction', cast(s_suppkey as string)) as zone_id",
            "120.0D + 10 * (s_suppkey % 5) as l",
            "820.0D + 10 * (s_suppkey % 5) as r",
        )
        .selectExpr(
            "video_id",
            "zone_id",
            "array(named_struct('x', l, 'y', 180.0D), named_struct('x', r, 'y', 180.0D),"
            " named_struct('x', r + 80, 'y', 400.0D), named_struct('x', r, 'y', 620.0D),"
            " named_struct('x', l, 'y', 620.0D)) as polygon",
            "array("
            "named_struct('idx', 0, 'name', 'North', 'p1x', l, 'p1y', 180.0D, 'p2x', r, 'p2y', 180.0D),"
            "named_struct('idx', 1, 'name', 'South', 'p1x', l, 'p1y', 620.0D, 'p2x', r, 'p2y', 620.0D),"
            "named_struct('idx', 2, 'name', 'East', 'p1x', r, 'p1y', 180.0D, 'p2x', r, 'p2y', 620.0D),"
            "named_struct('idx', 3, 'name', 'West', 'p1x', l, 'p1y', 180.0D, 'p2x', l, 'p2y', 620.0D)"
            ") as gates",
        )
    )


def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One motion score per (video, frame) that has boxes, between 0 and 5."""
    return (
        _passages(spark, sf_dir)
        .selectExpr("*", "explode(sequence(0, 39)) as j")
        .where("(j + k) % 24 >= k % 8")
        .groupBy("video_id", F.expr("start_frame + j").alias("frame_id"))
        .agg((F.sum("k") % 50 / 10.0).alias("score"))
    )


def shake_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera-shake score per event in arrival order: jittery first, then mostly calm."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('cam', cast(event_id div 500 as string)) as video_id",
        "event_id % 500 as frame_idx",
        "case when event_id % 500 < 30 + cast(get_json_object(props, '$.k') as int) % 10"
        " then 9.0D else value end as score",
    )


def grey_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-pixel grey frames from the vectors, 125 frames per video."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('cam', cast(vec_id div 125 as string)) as video_id",
        "vec_id % 125 as frame_id",
        "transform(embedding, e -> cast(cast(e as double) * 128 as int)) as pixels",
    )


def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as bytes, 128 brighter."""
    byte = "lpad(hex(least(255, p + 128)), 2, '0')"
    return grey_frames(spark, sf_dir).withColumn("pixels", F.expr(f"unhex(array_join(transform(pixels, p -> {byte}), ''))"))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scene descriptions in the shapes a language model returns them, one per event."""
    triples = (
        "concat('{\"subject\": \"Vehicle ', track_id, '\", \"predicate\": \"', event_type,"
        " '\", \"object\": \"', case k % 4 when 0 then concat('Vehicle ', track_id + 1)"
        " when 1 then concat('Pedestrian ', k % 9) when 2 then 'traffic_light'"
        " else concat('Vehicle ', track_id + 40) end,"
        " '\", \"motion_state\": \"', case k % 3 when 0 then 'parallel' when 1 then 'FLYING' else 'DIVERGING' end,"
        " '\", \"phase\": \"', case k % 5 when 0 then 'Conflict' when 1 then 'resolution' else '' end, '\"}')"
    )
    return (
        _passages(spark, sf_dir)
        .selectExpr(
            "*",
            f"{triples} as one",
            "concat('{\"subject\": \"Pedestrian ', k % 9, '\", \"predicate\": \"crossing\","
            " \"object\": \"Vehicle ', track_id, '\"}') as two",
            "start_frame + 20 as frame_id",
        )
        .selectExpr(
            "video_id",
            "frame_id",
            f"frame_id / {FPS}.0D as ts",
            "case k % 8"
            " when 0 then concat('[', one, ', ', two, ']')"
            " when 1 then concat('```json\\n[', one, ', ', two, ']\\n```')"
            " when 2 then concat('The scene is busy.\\nTwo users meet.\\n[', one, ']')"
            " when 3 then replace(concat('[', one, ']'), '\"', '\\'')"
            " when 4 then concat('[', one, ', ', two)"
            " when 5 then concat('[{\"subject\": \"Vehicle 1\", \"object\": \" \"}, ', two, ']')"
            " when 6 then concat('[', one, ', 5, \"x\", ', two, ']')"
            " else 'Nothing of note.' end as raw_text",
            "case when k % 11 = 0 then null when k % 11 = 1 then cast(array() as array<bigint>)"
            " else array(track_id, track_id + 1) end as active_ids",
        )
    )


def placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named points per map file; some files name their own origin."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('map', cast(c_nationkey as string)) as file_id",
        "c_custkey as ord",
        "case when c_custkey % 90 = 7 then 'Origin' else c_name end as name",
        "12.9D + (c_custkey % 1009) / 100000.0D as lat",
        "77.5D + (c_custkey % 997) / 100000.0D as lon",
    )


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel to ground point pairs per camera, a few centimetres off."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('cam', cast(l_suppkey as string)) as video_id",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity * 25.0D as pixel_x",
        "cast(l_partkey % 720 as double) as pixel_y",
        "l_quantity * 1.25D - 5.0D + l_tax as world_x",
        "(l_partkey % 720) / 20.0D - 2.0D + l_discount as world_y",
    )
