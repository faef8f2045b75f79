"""Readers for tracked boxes, calibrations, zones and map placemarks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.geometry import local_east, local_north
from lanewise.operators.trajectories import dedup_boxes
from lanewise.plans.chunks import with_chunk
from lanewise.plans.joins import lookup_join
from lanewise.schemas import BOXES, ZONES

# `CALIBRATION` documents: a 3x3 matrix, with the measured error if known.
CALIBRATION = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("homography", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("rmse_meters", T.DoubleType()),
])

ZONE_FILE = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("zone_id", T.StringType()),
    T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("gates", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("p1", T.ArrayType(T.DoubleType())),
        T.StructField("p2", T.ArrayType(T.DoubleType())),
    ]))),
])

PLACEMARK = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())])),
])


def read_boxes(spark: SparkSession, path: str, fmt: str = "parquet", dedup: bool = True, **options) -> DataFrame:
    """Tracked boxes of a fixed schema; of repeats in a frame the tracker's last row stays."""
    boxes = spark.read.format(fmt).options(**options).schema(BOXES).load(path)
    # Files say nothing of their layout: repeats meet by video and chunk, before they are sorted or counted.
    return dedup_boxes(with_chunk(boxes).repartition("video_id", "chunk")) if dedup else boxes


def read_calibrations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per camera with the matrix as nine numbers. A missing path is an error; so is a bad matrix.

    A file is one JSON document, or one camera per line (``lines``): many cameras want few files.
    """
    raw = spark.read.schema(CALIBRATION).option("multiLine", not lines).json(path)
    flat = F.flatten("homography")
    checked = F.when(F.size(flat) == 9, flat).otherwise(
        F.raise_error(F.concat(F.lit("not a 3x3 homography: "), F.coalesce("video_id", F.lit("?")))).cast("array<double>")
    )
    return raw.select("video_id", checked.alias("h"), "rmse_meters")


def read_zones(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Zone files; polygon and gates default to empty, gates keep their order as ``idx``.

    A file is one JSON document, or one zone per line (``lines``), as ``write_zones`` leaves it.
    """
    raw = spark.read.schema(ZONE_FILE).option("multiLine", not lines).json(path)
    polygon = F.transform(
        F.coalesce("polygon", F.array().cast("array<array<double>>")),
        lambda p: F.struct(p[0].alias("x"), p[1].alias("y")),
    )
    empty = F.from_json(F.lit("[]"), ZONE_FILE["gates"].dataType)
    gates = F.transform(
        F.coalesce("gates", empty),
        lambda g, i: F.struct(
            i.cast("int").alias("idx"), g["name"].alias("name"),
            g["p1"][0].alias("p1x"), g["p1"][1].alias("p1y"), g["p2"][0].alias("p2x"), g["p2"][1].alias("p2y"),
        ),
    )
    return raw.select("video_id", "zone_id", polygon.alias("polygon"), gates.alias("gates")).to(ZONES)


def validate_zones(zones: DataFrame) -> DataFrame:
    """Adds ``error``: why a zone cannot be saved, null if it can. The id is trimmed."""
    zone_id = F.trim(F.coalesce("zone_id", F.lit("")))
    return zones.withColumn("zone_id", zone_id).withColumn(
        "error",
        F.when(F.coalesce(F.size("polygon"), F.lit(0)) < 3, "polygon needs at least 3 points")
        .when(F.coalesce(F.size("gates"), F.lit(0)) < 1, "at least one gate is required")
        .when(zone_id == "", "zone_id is blank"),
    )


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Point placemarks ``file_id, ord, name, lat, lon``; nameless ones are called pt0, pt1, ...

    Each file is numbered on its own; a map file is one small document.
    """
    raw = (
        spark.read.format("xml")
        .schema(PLACEMARK)
        .options(rowTag="Placemark", ignoreNamespace=True)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file_id"),
            F.monotonically_increasing_id().alias("pos"),
            F.trim("name").alias("name"),
            F.split(F.trim("Point.coordinates"), ",").alias("c"),
        )
        .where(F.size("c") >= 2)
    )
    ord_ = F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1
    return raw.withColumn("ord", ord_).select(
        "file_id", "ord",
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("pt"), F.col("ord").cast("string"))).alias("name"),
        F.trim(F.col("c")[1]).cast("double").alias("lat"),
        F.trim(F.col("c")[0]).cast("double").alias("lon"),
    )


def latlon_to_local(placemarks: DataFrame) -> DataFrame:
    """East and north metres from each file's origin: the first point named "origin", else the first."""
    rank = F.struct((F.lower("name") != "origin").alias("unnamed"), F.col("ord").alias("ord"))
    origins = placemarks.groupBy("file_id").agg(
        F.min_by(F.struct(F.col("name").alias("origin_name"), "lat", "lon"), rank).alias("o")
    )
    east, north = local_east("o.lat", "o.lon", "lon"), local_north("o.lat", "lat")
    return lookup_join(placemarks, origins, ["file_id"], "inner").select(
        "file_id", "ord", "name", F.col("o.origin_name").alias("origin_name"),
        east.alias("world_x"), north.alias("world_y"),
    )
