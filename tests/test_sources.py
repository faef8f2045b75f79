import json

import pytest
from pyspark.sql import functions as F

from lanewise.schemas import BOXES
from lanewise.sources import readers as rd
from lanewise.sources import writers as wr


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_read_boxes(spark, tmp_path, fmt):
    rows = [("v", 1, 0.1, o, 7, float(o), 0.0, 2.0, 3.0, 0.9, 2) for o in (0, 1)]
    spark.createDataFrame(rows, BOXES).write.format(fmt).save(str(tmp_path / fmt))
    got = rd.read_boxes(spark, str(tmp_path / fmt), fmt)
    assert got.schema.names == BOXES.names and [r.box_ord for r in got.collect()] == [1]
    assert rd.read_boxes(spark, str(tmp_path / fmt), fmt, dedup=False).count() == 2


def test_calibrations(spark, tmp_path):
    good = {"video_id": "v", "homography": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "rmse_meters": 0.5848}
    (tmp_path / "c.json").write_text(json.dumps(good, indent=1))
    r = rd.read_calibrations(spark, str(tmp_path / "c.json")).first()
    assert r.h == [1, 0, 0, 0, 1, 0, 0, 0, 1] and r.rmse_meters == 0.5848
    (tmp_path / "bad.json").write_text(json.dumps({"video_id": "w", "homography": [[1, 2]]}))
    with pytest.raises(Exception, match="not a 3x3 homography"):
        rd.read_calibrations(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.read_calibrations(spark, str(tmp_path / "none.json"))


def test_zones_round_trip(spark, tmp_path):
    zone = {
        "video_id": "v", "zone_id": "z", "polygon": [[0, 0], [9, 0], [9, 9]],
        "gates": [{"name": n, "p1": [0, i], "p2": [9, i]} for i, n in enumerate("CAB")],
    }
    (tmp_path / "z.json").write_text(json.dumps([zone, {"video_id": "w", "zone_id": " "}], indent=1))
    zones = rd.read_zones(spark, str(tmp_path / "z.json"))
    wr.write_zones(zones, str(tmp_path / "out"))
    again = rd.read_zones(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(str, zones.collect())) == sorted(map(str, again.collect()))
    r = zones.where("video_id = 'v'").first()
    assert [(g.idx, g.name) for g in r.gates] == [(0, "C"), (1, "A"), (2, "B")]
    errors = {r.video_id: r.error for r in rd.validate_zones(zones).collect()}
    assert errors == {"v": None, "w": "polygon needs at least 3 points"}


KML = """<?xml version="1.0"?><kml%s><Document>
<Placemark><name>kerb</name><Point><coordinates> 77.51,12.91,0 </coordinates></Point></Placemark>
<Placemark><Point><coordinates>77.52,12.92</coordinates></Point></Placemark>
<Placemark><name>a path</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>
<Placemark><name>Origin</name><Point><coordinates>77.50,12.90,5</coordinates></Point></Placemark>
<Placemark><name>broken</name><Point><coordinates>77.50</coordinates></Point></Placemark>
</Document></kml>"""


@pytest.mark.parametrize("ns", ["", ' xmlns="http://www.opengis.net/kml/2.2"'])
def test_kml(spark, tmp_path, ns):
    (tmp_path / "m.kml").write_text(KML % ns)
    points = rd.read_kml(spark, str(tmp_path / "m.kml"))
    assert [(r.name, r.lat, r.lon) for r in points.orderBy("ord").collect()] == [
        ("kerb", 12.91, 77.51), ("pt1", 12.92, 77.52), ("Origin", 12.90, 77.50),
    ]
    local = {r.name: r for r in rd.latlon_to_local(points).collect()}
    assert local["kerb"].origin_name == "Origin"
    assert (local["kerb"].world_x, local["kerb"].world_y) == (1085.1042, 1113.2)
    assert (local["Origin"].world_x, local["Origin"].world_y) == (0.0, 0.0)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alert = spark.range(3).select(
        F.lit("v").alias("video_id"), F.col("id").cast("double").alias("ts"),
        F.create_map(F.lit("speed_ms"), F.lit(20.0)).alias("evidence"),
    )
    wr.write_alerts(alert, path)
    wr.write_alerts(alert, path)
    back = spark.read.parquet(path)
    assert back.count() == 6 and json.loads(back.first().evidence) == {"speed_ms": 20.0}

    chunks = spark.createDataFrame([("v", 1, "hi", 1.0, 6.0), ("v", 2, "  ", 2.0, 7.0)], "video_id string, frame_id bigint, text string, start_time double, end_time double")
    wr.write_event_chunks(chunks, str(tmp_path / "chunks"))
    assert [r.time_window for r in spark.read.parquet(str(tmp_path / "chunks")).collect()] == ["1.0-6.0"]

    rows = spark.range(4).selectExpr("'v' as video_id", "id as track_id", "id as frame_id", "id / 10.0 as ts")
    wr.write_trajectories(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).where("video_id = 'v'").count() == 4

    said = spark.createDataFrame([("v", 1, i, s) for i, s in enumerate("aab")], "video_id string, track_id bigint, frame_id bigint, summary string")
    wr.write_profiles(said, str(tmp_path / "said"))
    assert spark.read.parquet(str(tmp_path / "said")).count() == 2

    triple = "video_id string, frame_id bigint, ts double, subject string, subject_type string, predicate string, object string, object_type string, motion_state string, phase string"
    wr.write_interactions(spark.createDataFrame([("v", 1, 7.0, "Vehicle 1", None, "near", "road", None, None, None)], triple), str(tmp_path / "edges"))
    edge = spark.read.parquet(str(tmp_path / "edges")).first()
    assert (edge.subject_type, edge.object_type, edge.motion_state) == ("Vehicle", "Infrastructure", "APPROACHING")
    wr.write_precedes(spark.createDataFrame([("v", "Vehicle 1", 0.0, 5.0)], "video_id string, name string, from_start double, to_start double"), str(tmp_path / "pre"))
    wr.write_crossings(spark.createDataFrame([("v", "z", "North", 1.0)], "video_id string, zone_id string, gate_name string, ts double"), str(tmp_path / "cross"))
    assert spark.read.parquet(str(tmp_path / "cross")).count() == 1


def test_migration_reads_old_and_new_files(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.createDataFrame([("a",)], "subject string").write.parquet(path)
    spark.createDataFrame([("b", "PARALLEL", "conflict")], "subject string, motion_state string, phase string").write.mode("append").parquet(path)
    got = wr.migrate_interactions(spark.read.option("mergeSchema", True).parquet(path))
    assert {r.subject: (r.motion_state, r.phase) for r in got.collect()} == {
        "a": ("APPROACHING", "normal"), "b": ("PARALLEL", "conflict"),
    }


def test_calibrations_of_many_cameras_in_few_files(spark, tmp_path):
    docs = ['{"video_id": "a", "homography": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}', '{"video_id": "b", "homography": [[2, 0, 0], [0, 2, 0], [0, 0, 1]]}']
    (tmp_path / "many.json").write_text("\n".join(docs))
    rows = rd.read_calibrations(spark, str(tmp_path / "many.json"), lines=True).collect()
    assert {r.video_id: r.h[0] for r in rows} == {"a": 1.0, "b": 2.0}


def test_calibrations_round_trip_writes_few_files(spark, sf_dir, monkeypatch):
    from checks import round_trips

    read, rd_read = [], rd.read_calibrations
    monkeypatch.setattr(round_trips.rd, "read_calibrations", lambda s, path, **how: read.append(path) or rd_read(s, path, **how))
    round_trips.calibrations_round_trip(spark, sf_dir)
    assert len(spark.read.text(read[0]).inputFiles()) <= spark.sparkContext.defaultParallelism
