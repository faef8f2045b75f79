"""Registered queries that go through files and streams: written below the staging folder, read back.

The SQL is that of the operators whose rows they carry.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import queries as q
from checks.oracle import SQL as BATCH_SQL
from lanewise.operators import graph as gr
from lanewise.operators import trajectories as tr
from lanewise.operators import zones as zo
from lanewise.plans.staging import staging_dir
from lanewise.sources import adapters as ad
from lanewise.sources import readers as rd
from lanewise.sources import writers as wr
from lanewise.streaming import alerts as sa
from lanewise.streaming import kinematics as sk
from lanewise.streaming import live as lv
from lanewise.streaming import sinks as ss
from lanewise.streaming import zones as sz

QUERIES = {}
SQL = {}
#: What the streams read; nothing else is written for them.
VEHICLE = ["video_id", "track_id", "frame_id", "ts", "vx", "vy", "ax", "ay", "warm"]
PLACED = ["video_id", "track_id", "frame_id", "ts", "box_ord", "x", "y", "vx", "vy", "warm"]
BOXES = ["video_id", "track_id", "frame_id", "ts", "box_ord", "x1", "x2", "y2", "x", "y"]


def round_trip(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def folder(spark: SparkSession) -> str:
    return f"{staging_dir(spark).rstrip('/')}/trip-{uuid.uuid4().hex}"


@round_trip(BATCH_SQL["read_boxes_dedup"])
def boxes_round_trip(spark, sf):
    boxes = ad.boxes(spark, sf)
    again = boxes.withColumns(
        {"box_ord": F.col("box_ord") + 500, "x1": F.col("x1") + F.col("cls"), "y2": F.col("y2") - 1}
    )
    path = folder(spark)
    boxes.unionByName(again.where("track_id % 3 <> 0")).write.option("compression", "zstd").parquet(path)
    return rd.read_boxes(spark, path).groupBy("video_id", "cls").agg(
        F.count("*").alias("n"), F.sum("box_ord").alias("sum_ord"),
        F.sum("x1").alias("sum_x1"), F.sum("y2").alias("sum_y2"),
    )


@round_trip(BATCH_SQL["project_to_ground"])
def calibrations_round_trip(spark, sf):
    """One JSON document per camera, a line each: a file each took longer to list and open than all else."""
    path = folder(spark)
    rows = F.array(*[F.slice("h", 3 * i + 1, 3) for i in range(3)])
    ad.calibrations(spark, sf).select("video_id", rows.alias("homography")).write.json(path)
    ground = tr.project_to_ground(ad.boxes(spark, sf), rd.read_calibrations(spark, path, lines=True))
    return ground.select("video_id", "frame_id", "track_id", "px", "py", q.r6("x"), q.r6("y"))


@round_trip(BATCH_SQL["gate_vehicle_counts"])
def zones_round_trip(spark, sf):
    path = folder(spark)
    wr.write_zones(ad.zones(spark, sf), path)
    return zo.gate_vehicle_counts(q.gate_events(spark, sf), rd.read_zones(spark, path, lines=True))


@round_trip(BATCH_SQL["kinematics_sg"])
def trajectories_round_trip(spark, sf):
    path = folder(spark)
    wr.write_trajectories(q.traj(spark, sf), path)
    return spark.read.parquet(path).where("warm").select(
        "video_id", "track_id", "frame_id", q.r6("vx"), q.r6("vy"), q.r6("ax"), q.r6("ay")
    )


@round_trip(BATCH_SQL["crossings"])
def crossings_round_trip(spark, sf):
    path = folder(spark)
    wr.write_crossings(q.gate_events(spark, sf), path)
    return spark.read.parquet(path).select(
        *q.EVENT_COLS, "ts", F.round("pixel_x", 4).alias("pixel_x"), F.round("pixel_y", 4).alias("pixel_y"),
        q.r6("real_x"), q.r6("real_y"),
    )


@round_trip(BATCH_SQL["alert_cooldown"])
def alerts_round_trip(spark, sf):
    path = folder(spark)
    wr.write_alerts(q.fired_alerts(spark, sf), path)
    return spark.read.parquet(path).select("video_id", "alert_type", "id_lo", "id_hi", "frame_id", "track_id")


@round_trip(BATCH_SQL["interaction_edges"])
def interactions_round_trip(spark, sf):
    path = folder(spark)
    wr.write_interactions(q.interactions(spark, sf), path)
    return gr.with_pointer(spark.read.parquet(path)).drop("ts")


@round_trip(BATCH_SQL["precedes_edges"])
def precedes_round_trip(spark, sf):
    path = folder(spark)
    wr.write_precedes(q.precedes(spark, sf), path)
    return spark.read.parquet(path)


# ---- streams ------------------------------------------------------------------------------


class Feed:
    """A folder that a stream reads, and the micro-batches that have yet to come into it."""

    def __init__(self, df: DataFrame, batches: int = 3, frames: int = 400):
        """Writes ``df`` once, where its rows lie: a folder for each range of frames, all beside the one that is read."""
        self.spark, self.schema, self.path = df.sparkSession, df.schema, folder(df.sparkSession)
        bounds = [i * frames // batches for i in range(1, batches)]
        batch = sum(((F.col("frame_id") >= b).cast("int") for b in bounds), F.lit(0))
        rows = df.withColumn("batch", batch).where("batch is not null")
        rows.write.option("compression", "zstd").partitionBy("batch").parquet(f"{self.path}/held")
        names = [f"{self.path}/held/batch={i}" for i in range(batches)]
        self.held = [n for n in names if self._file(n)[0].exists(self._file(n)[1])]
        if not self.held:
            df.where("false").write.parquet(names[0])
            self.held = names[:1]
        self.rows = sum(self.spark.read.schema(df.schema).parquet(n).count() for n in self.held)
        self.read = 0
        self.publish()

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def publish(self) -> None:
        """Moves the next micro-batch into the folder."""
        store, source = self._file(self.held.pop(0))
        target = self._file(f"{self.path}/read/{self.read}")[1]
        store.mkdirs(target.getParent())
        if not store.rename(source, target):
            raise OSError(f"{source} was not moved")
        self.read += 1

    def stream(self) -> DataFrame:
        """With event time and watermark."""
        read = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/read/*")
        return ss.with_event_time(read).withWatermark("event_time", "0 seconds")

    def run(self, start) -> None:
        """Lets ``start()`` take one micro-batch after the other; the watermark moves on between them."""
        with ss.sized(self.spark, self.rows):
            while True:
                with ss.conf(self.spark, "spark.sql.streaming.noDataMicroBatches.enabled", str(not self.held).lower()):
                    start().awaitTermination()
                if not self.held:
                    return
                # A micro-batch's shuffle files go when the driver collects its garbage.
                self.spark._jvm.System.gc()
                self.publish()


def sunk(df: DataFrame, feed: Feed | None = None) -> DataFrame:
    """Runs a stream until its input is used up and reads the sink."""
    spark = df.sparkSession
    path, checkpoint = folder(spark), folder(spark)
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if feed is None:
        writer.start().awaitTermination()
    else:
        feed.run(writer.start)
    return spark.read.schema(df.schema).parquet(path)


@round_trip(f"select * from ({BATCH_SQL['alert_cooldown']}) where id_lo = id_hi")
def stream_alerts(spark, sf):
    feed = Feed(q.traj(spark, sf).select(*VEHICLE))
    return sunk(sa.stream_cooldown(sa.stream_vehicle_candidates(feed.stream())), feed).select(
        "video_id", "alert_type", "id_lo", "id_hi", "frame_id", "track_id"
    )


@round_trip(BATCH_SQL["pair_distances"])
def stream_pairs(spark, sf):
    feed = Feed(q.traj(spark, sf).select(*PLACED))
    return sunk(sa.stream_close_pairs(feed.stream(), feed.stream()), feed).select(
        "video_id", "frame_id", "a_id", "b_id", q.r6("distance_m"), "closing"
    )


@round_trip(
    f"""select video_id, zone_id, gate_name, floor(ts / 60)::bigint as minute,
    count(*) filter (direction = 'enter') as enter, count(*) filter (direction = 'exit') as exit
    from ({BATCH_SQL['crossings']}) group by all"""
)
def stream_gate_counts(spark, sf):
    """Counts per minute; one later event per stream lets the watermark close the last window."""
    events = q.gate_events(spark, sf).select("video_id", "zone_id", "gate_name", "direction", "frame_id", "ts")
    end = spark.range(1).selectExpr(
        "'end' as video_id", "'end' as zone_id", "'end' as gate_name", "'end' as direction", "1000000L as frame_id",
        "cast(1e6 as double) as ts",
    )
    path = folder(spark)
    for part in (events, end):
        part.coalesce(1).write.mode("append").parquet(path)
    read = ss.with_event_time(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))
    counts = sunk(sz.live_gate_counts(read)).where("video_id <> 'end'")
    minute = (F.unix_timestamp("start") - F.unix_timestamp(F.lit("2000-01-01").cast("timestamp"))) / 60
    return counts.select("video_id", "zone_id", "gate_name", minute.cast("long").alias("minute"), "enter", "exit")


#: Whole thousandths, cut where no value lies: batch and stream differ in the last bits.
THOUSANDTHS = ", ".join(f"floor(({c} + 0.0003137::double) * 1000::double)::bigint as {c}" for c in ("vx", "vy", "ax", "ay"))


@round_trip(f"select video_id, track_id, frame_id, {THOUSANDTHS} from ({BATCH_SQL['kinematics_sg']})")
def stream_kinematics(spark, sf):
    feed = Feed(q.positions(spark, sf))
    cut = [F.floor((q.r6(c) + 0.0003137) * 1000.0).cast("long").alias(c) for c in ("vx", "vy", "ax", "ay")]
    return sunk(sk.stream_trajectories(feed.stream(), fps=q.FPS), feed).where("warm").select("video_id", "track_id", "frame_id", *cut)


@round_trip(f"select video_id, zone_id, track_id, frame_id, gate_idx, gate_name, direction, confidence from ({BATCH_SQL['crossings']})")
def stream_crossings(spark, sf):
    """Two queries: touched gates and guesses, then the guesses that hold."""
    feed = Feed(q.ground(spark, sf).select(*BOXES))
    events = sunk(sz.stream_gate_events(feed.stream(), ad.zones(spark, sf)), feed)
    again = spark.readStream.schema(events.schema).parquet(events.inputFiles()[0].rsplit("/", 1)[0])
    with ss.sized(spark, events.count()):
        return sunk(sz.drop_late_guesses(again)).select(*q.EVENT_COLS)


@round_trip(BATCH_SQL["alert_cooldown"])
def stream_boxes_to_alerts(spark, sf):
    """Kinematics, close pairs, vehicle alerts and the cool-down in one streaming query."""
    feed = Feed(q.positions(lv.ready(spark), sf))
    return sunk(lv.live_alerts(feed.stream(), fps=q.FPS), feed).select(
        "video_id", "alert_type", "id_lo", "id_hi", "frame_id", "track_id"
    )


@round_trip(BATCH_SQL["pair_distances"])
def stream_pairs_one_read(spark, sf):
    """Close pairs by state per frame, from a single source."""
    feed = Feed(q.traj(lv.ready(spark), sf).select(*PLACED))
    return sunk(lv.live_close_pairs(feed.stream()), feed).select(
        "video_id", "frame_id", "a_id", "b_id", q.r6("distance_m"), "closing"
    )


@round_trip(f"select video_id, zone_id, track_id, frame_id, gate_idx, gate_name, direction, confidence from ({BATCH_SQL['crossings']})")
def stream_boxes_to_crossings(spark, sf):
    """Moves, gates and the guesses that hold in one streaming query."""
    feed = Feed(q.ground(lv.ready(spark), sf).select(*BOXES))
    return sunk(lv.live_crossings(feed.stream(), ad.zones(spark, sf)), feed).select(*q.EVENT_COLS)


@round_trip(f"select * from ({BATCH_SQL['alert_cooldown']}) where id_lo = id_hi")
def stream_alert_store(spark, sf):
    """Alerts in a store that takes each micro-batch once: every batch is handed in twice."""
    feed, path = Feed(q.traj(spark, sf).select(*VEHICLE)), folder(spark)

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            ss.commit_batch(batch, batch_id, path)

    fired, checkpoint = sa.stream_cooldown(sa.stream_vehicle_candidates(feed.stream())), folder(spark)
    feed.run(lambda: ss.start_alert_handler(fired, checkpoint, twice))
    return ss.committed(spark, path).select("video_id", "alert_type", "id_lo", "id_hi", "frame_id", "track_id")


@round_trip(
    """select nation as file_id, ord, coalesce(nullif(trim(name), ''), 'pt' || ord) as name, lat, lon from (
      select c_nationkey as nation, c_custkey % 7 = 0 as blank, case when c_custkey % 7 = 0 then ' ' else c_name end as name,
        c_custkey / 100::double as lat, (c_custkey % 180)::double as lon,
        row_number() over (partition by c_nationkey order by c_custkey) - 1 as ord from customer)"""
)
def kml_round_trip(spark, sf):
    """One map document per nation, a placemark per customer."""
    path = folder(spark)
    marks = ad.table(spark, sf, "customer").select(
        "c_nationkey", "c_custkey",
        F.concat(
            F.lit("<Placemark><name>"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")),
            F.lit("</name><Point><coordinates>"), (F.col("c_custkey") % 180).cast("double").cast("string"), F.lit(","),
            (F.col("c_custkey") / 100.0).cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
        ).alias("mark"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "mark"))), lambda m: m["mark"]), "\n")
    head, tail = "<kml xmlns='http://www.opengis.net/kml/2.2'><Document>", "</Document></kml>"
    documents = marks.groupBy("c_nationkey").agg(F.concat(F.lit(head), listed, F.lit(tail)).alias("value"))
    documents.write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("file_id", r"c_nationkey=(\d+)", 1).cast("int")
    return rd.read_kml(spark, f"{path}/*").withColumn("file_id", nation)
