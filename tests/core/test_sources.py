import datetime as dt
import gzip
import struct
import zipfile

import pytest

from paceline.operators import efficiency, pbs
from paceline.schema import ACTIVITY_SCHEMA
from paceline.sources import activities as src, fit, tracks

HEAD = "Activity ID,Activity Date,Activity Name,Activity Type,Elapsed Time,Moving Time,Distance,Filename,Average Heart Rate,Relative Effort"
ROWS = [
    '41,"Mar 09, 2022, 6:05:10 PM",Canal loop,Ride,4001,3900,21000,,118,12',
    '52,"Mar 10, 2022, 5:20:30 AM","Hills, ""the long way""",Run,1802.9,1777,4321.5,activities/h.tcx.gz,171,',
    "63,2022-03-11 22:59:01,Night,Run,x,,nan,activities/n.gpx,,3",
    "74,no date,Lost,Swim,1,1,1,,,",
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_export_becomes_the_22_columns(spark, tmp_path):
    df = src.load_activities(spark, write(tmp_path / "activities.csv", "\n".join([HEAD, *ROWS])))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in ACTIVITY_SCHEMA]
    got = {r.id: r for r in df.collect()}
    assert len(got) == 4
    assert got[41].start_date_local == dt.datetime(2022, 3, 9, 18, 5, 10) and got[52].start_date_local == dt.datetime(2022, 3, 10, 5, 20, 30) and got[63].date == dt.date(2022, 3, 11) and got[74].date is None
    assert got[52].name == 'Hills, "the long way"' and got[52].elapsed_time == 1802 and got[52].distance == 4321.5 and got[52].relative_effort is None
    assert got[63].elapsed_time is None and got[63].moving_time is None and got[41].sport_type == "Ride" and got[41].max_watts is None
    in_order = src.load_activities(spark, str(tmp_path / "activities.csv"), start_date="2022-01-01", ordered=True).collect()
    assert [r.id for r in in_order] == [41, 52, 63]


def test_repeated_headers(spark, tmp_path):
    text = "Activity ID,Activity Date,Activity Name,Activity Type,Elapsed Time,Distance,Moving Time,Elapsed Time,Distance,Moving Time\n1,2023-07-07 08:00:00,a,Run,12,0.7,11,731,689.5,702\n"
    r = src.load_activities(spark, write(tmp_path / "a.csv", text)).first()
    assert (r.distance, r.elapsed_time, r.moving_time) == (689.5, 731, 702)
    assert src.unique_headers(["Distance", "Distance", "Distance", "", "x"]) == ["Distance", "Distance.1", "Distance.2", "column4", "x"]


def test_filters_headers_and_empty_files(spark, tmp_path):
    path = write(tmp_path / "activities.csv", "\n".join([HEAD, *ROWS]))
    ids = lambda **o: sorted(r.id for r in src.load_activities(spark, path, **o).collect())
    assert ids(end_date="2022-03-09") == [41] and ids(start_date="2022-03-10") == [52, 63] and ids(activity_types="Run") == [52, 63]
    with pytest.raises(ValueError):
        src.load_activities(spark, path, activity_types=[1])
    empty = src.load_activities(spark, write(tmp_path / "empty.csv", HEAD + "\n"))
    assert empty.count() == 0 and len(empty.columns) == 22
    with pytest.raises(ValueError, match="Activity Date"):
        src.load_activities(spark, write(tmp_path / "de.csv", "Aktivitäts-ID,Datum\n1,2\n"))
    with pytest.raises(Exception):
        src.load_activities(spark, str(tmp_path / "nowhere.csv")).count()


def test_archives(spark, tmp_path):
    path = tmp_path / "export.ZIP"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/Activities.csv", "﻿" + "\n".join([HEAD, *ROWS]))
    assert sorted(r.id for r in src.load_activities(spark, str(path)).collect()) == [41, 52, 63, 74]
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("b/activities.csv", HEAD + "\n9,2024-01-01 08:00:00,n,Run,1,1,1,,,\n")
    with pytest.warns(UserWarning):
        assert src.load_activities(spark, str(path)).count() == 4
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(ValueError):
        src.load_activities(spark, str(tmp_path / "none.zip"))


def tcx(n=3, speed=3.0, zone="Z"):
    point = lambda i: f"""<Trackpoint><Time>2025-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}{zone}</Time><Position><LatitudeDegrees>1.3</LatitudeDegrees><LongitudeDegrees>103.8</LongitudeDegrees></Position>
      <AltitudeMeters>10</AltitudeMeters><DistanceMeters>{i * speed}</DistanceMeters><HeartRateBpm><Value>{120 + i % 3}</Value></HeartRateBpm><Cadence>80</Cadence><Extensions><n:TPX><n:Watts>150</n:Watts></n:TPX></Extensions></Trackpoint>"""  # noqa: E731
    return ('<?xml version="1.0"?><TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2" xmlns:n="urn:x"><Activities><Activity><Lap><Track>' + "".join(point(i) for i in range(n)) + "</Track></Lap></Activity></Activities></TrainingCenterDatabase>").encode()


GPX = b"""<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:q="urn:q"><trk><trkseg>
<trkpt lat="1.3" lon="103.8"><ele>10</ele><time>2025-01-01T00:00:00Z</time><extensions><q:T><q:hr>120</q:hr><q:cad>80</q:cad><q:PowerInWatts>200</q:PowerInWatts></q:T></extensions></trkpt>
<trkpt lat="1.3001" lon="103.8001"><time>2025-01-01T00:00:10Z</time></trkpt><trkpt lat="1.3001" lon="103.8001"><time>2025-01-01T00:00:10Z</time></trkpt><trkpt lat="1" lon="2"><time>2025-01-01T00:00:20</time></trkpt></trkseg></trk></gpx>"""


def fit_file(samples):
    fields = [(253, 4, 0x86), (3, 1, 2), (5, 4, 0x86), (6, 2, 0x84), (7, 2, 0x84), (0, 4, 0x85), (2, 2, 0x84)]
    body = struct.pack("<BBBHB", 0x40, 0, 0, 20, len(fields)) + b"".join(bytes(f) for f in fields)
    for t, hr, meters, speed, watts in samples:
        body += b"\x00" + struct.pack("<IBIHHiH", t, hr, int(meters * 100), int(speed * 1000), watts, 2**30, 2550)
    body += struct.pack(">BBBHB", 0x41, 0, 1, 20, 1) + bytes((3, 1, 2)) + bytes([0x80 | 1 << 5 | (samples[-1][0] + 2) & 31, 99])
    return struct.pack("<BBHI4sH", 14, 0x20, 0, len(body), b".FIT", 0) + body + b"\0\0"


def test_parsers():
    kind, status, ch = tracks.parse_file("x.TCX", b"\xef\xbb\xbf junk " + tcx())
    assert (kind, status) == ("tcx", "ok") and ch["watts"].tolist() == [150] * 3 and ch["heartrate"].tolist() == [120, 121, 122] and ch["speed"][1:].tolist() == [3, 3]
    assert ch["time_s"].tolist()[0] == dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert tracks.parse_file("x.tcx", tcx(zone=""))[1] == "ok"
    kind, status, ch = tracks.parse_file("x.gpx.gz", gzip.compress(GPX))
    assert status == "ok" and len(ch["time_s"]) == 3 and ch["watts"][0] == 200 and ch["cadence"][0] == 80
    assert ch["distance"][1] == pytest.approx(15.72, abs=0.02) and ch["speed"][1] == pytest.approx(1.572, abs=0.002) and ch["speed"][2] != ch["speed"][2]
    for name, content, want in (("x.txt", b"", "unsupported"), ("x.tcx", b"", "failed"), ("x.gpx", b"<gpx/>", "empty"), ("x.gpx", b"<gpx", "failed"), ("x.fit", b"zz", "failed"), ("x.fit.gz", b"zz", "failed")):
        assert tracks.parse_file(name, content)[1].startswith(want)


def test_fit_records():
    got = list(fit.fit_records(fit_file([(1000, 120, 0.0, 3.1, 200), (1001, 255, 3.0, 3.2, 65535)])))
    assert [r["time_s"] - fit.EPOCH for r in got] == [1000, 1001, 1003]
    assert got[0] == pytest.approx({"time_s": 1000 + fit.EPOCH, "heartrate": 120, "distance": 0, "speed": 3.1, "watts": 200, "latitude": 90, "elevation": 10}) and "heartrate" not in got[1] and "watts" not in got[1]
    assert got[2] == {"time_s": 1003.0 + fit.EPOCH, "heartrate": 99}


def test_from_archive_to_records(spark, tmp_path):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("activities.csv", "\n".join([HEAD, *[f'{i},"Jan 0{i}, 2025, 8:00:00 AM",n,Run,3600,3600,9000,{f},150,' for i, f in ((1, "activities/one.tcx"), (2, "ACTIVITIES\\two.tcx.gz"), (3, "activities/broken.gpx"), (4, "lost.tcx"))]]))
        z.writestr("activities/one.tcx", tcx(900, 3.0))
        z.writestr("activities/two.tcx.gz", gzip.compress(tcx(900, 4.0)))
        z.writestr("activities/broken.gpx", "<gpx")
        z.writestr("activities/other.tcx", tcx())
    acts = src.load_activities(spark, str(path))
    streams = tracks.activity_streams(spark, acts, str(path)).cache()
    assert {r.activity_id: r["count"] for r in streams.groupBy("activity_id").count().collect()} == {1: 900, 2: 900}
    got = pbs.calculate_pbs(acts, streams, "Run", "2025-01-01", "2025-02-01", [1000, 400]).orderBy("activity_id", "distance").collect()
    assert [(r.activity_id, r.distance_label, round(r.time_seconds, 3), r.is_pb) for r in got] == [(1, "400m", 133.333, True), (1, "1k", 333.333, True), (2, "400m", 100, True), (2, "1k", 250, True)]
    ef = {r.activity_id: r.status for r in efficiency.calculate_ef(acts, "Run", "speed_hr", "2024-12-31", "2025-02-01", min_steady_minutes=5, streams=streams).collect()}
    assert ef == {1: "ok", 2: "ok", 3: "no_streams", 4: "no_streams"}
    direct = efficiency.calculate_ef(acts, "Run", "speed_hr", "2024-12-31", "2025-02-01", min_steady_minutes=5, export_dir=str(path), ordered=True).collect()
    assert [(r.activity_id, r.status) for r in direct] == [(1, "ok"), (2, "ok"), (3, "no_streams"), (4, "no_streams")]
    drift = efficiency.calculate_decoupling(acts, activity_type="Run", start_date="2024-12-31", end_date="2025-02-01", min_steady_minutes=5, export_dir=str(path), ordered=True).collect()
    assert [(r.activity_id, r.status) for r in drift] == [(1, "ok"), (2, "ok")]
    again = pbs.calculate_pbs(acts, activity_type="Run", start_date="2025-01-01", end_date="2025-02-01", distances_m=[1000, 400], export_dir=str(path), ordered=True).collect()
    assert [(r.activity_id, r.distance_label, r.time_seconds) for r in again] == [(r.activity_id, r.distance_label, r.time_seconds) for r in got]
    one_stream = streams.filter("activity_id = 1").drop("athlete_id", "activity_id")
    alone = efficiency.calculate_decoupling(stream_df=one_stream, min_steady_minutes=5)
    assert alone.columns == ["decoupling"] and alone.first().decoupling is not None
    told = efficiency.calculate_decoupling(stream_df=one_stream, min_steady_minutes=5, return_diagnostics=True)
    assert told.first().status == "ok" and told.columns == ["decoupling", "status", "quality_score", "hr_coverage", "steady_duration_minutes", "sampling_interval_seconds"]
    for call in (lambda: efficiency.calculate_ef(acts, "Swim", checked=True), lambda: pbs.calculate_pbs(acts, streams, "Swim", checked=True), lambda: efficiency.calculate_decoupling(acts, streams, "Swim", checked=True), lambda: pbs.calculate_pbs(acts)):
        with pytest.raises(ValueError):
            call()
    one = tracks.parse_activity_file(spark, "one.TCX", str(path))
    assert one.count() == 900
    assert [r.parse_status[:6] for r in tracks.read_tracks(spark, str(path)).filter("seq_no is null").collect()] == ["failed"]


def test_folders_and_sinks(spark, tmp_path):
    folder = tmp_path / "export" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.gpx").write_bytes(GPX)
    (folder / "b.fit").write_bytes(fit_file([(1000, 120, 0.0, 3.1, 200)]))
    (folder / "c.txt").write_bytes(b"x")
    got = tracks.read_tracks(spark, str(tmp_path / "export"))
    assert {r.format: r["count"] for r in got.groupBy("format").count().collect()} == {"gpx": 3, "fit": 2}
    for form in ("parquet", "csv", "json", "orc"):
        src.write_table(got.drop("file"), str(tmp_path / form), form=form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() == 5


def test_names_of_any_number_are_a_join(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        for i in range(6):
            z.writestr(f"activities/a{i}.gpx", GPX)
    names = spark.range(3, 150_000).selectExpr("concat('activities/A', id, '.GPX') as file")
    got = tracks.read_tracks(spark, str(tmp_path / "export.zip"), only=names)
    assert {r.file for r in got.select("file").distinct().collect()} == {f"activities/a{i}.gpx" for i in (3, 4, 5)}


def test_activities_without_ids_are_numbered_alike_each_time(spark):
    acts = spark.createDataFrame([("x", dt.date(2024, 1, 1 + i % 3), 5000.0 + i, "Run", "f") for i in range(9)], "athlete_id string, date date, distance double, type string, filename string")
    samples = spark.createDataFrame([("x", k, i, float(i), i * (2.0 + k / 10)) for k in range(1, 10) for i in range(700)], "athlete_id string, activity_id long, seq_no long, time_s double, distance double")
    runs = [sorted((r.activity_id, r.activity_date, round(r.time_seconds, 6)) for r in pbs.calculate_pbs(a, samples, "Run", "2024-01-01", "2024-02-01", [1000]).collect()) for a in (acts, acts.repartition(5, "distance"))]
    assert runs[0] == runs[1] and len(runs[0]) == 9


def test_the_parsers_legs_are_those_of_the_column_function(spark):
    import numpy as np

    from paceline.functions import haversine
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    lat, lon = rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)
    df = spark.createDataFrame([(i, *map(float, (lat[i], lon[i], lat[i + 1], lon[i + 1]))) for i in range(59)], "i long, a double, b double, c double, d double")
    got = [r.m for r in df.select("i", haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).orderBy("i").collect()]
    assert np.allclose(got, tracks.leg_meters(lat, lon), rtol=1e-12)


@pytest.fixture
def fine_partitions(spark):
    """Exchanges are read in many partitions though the tables are small, as they are when tables are large."""
    more = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {c: spark.conf.get(c) for c in more}
    for c, v in more.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_a_key_of_a_union_is_one_file(spark, fine_partitions):
    from pathlib import Path

    from pyspark.sql import Window, functions as F

    from paceline.storage import as_files

    rows = spark.range(4000).selectExpr("id % 40 as key", "id", "repeat('x', cast(id % 40 * 10 as int) + 1) as line")
    points = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).select("key", "place", "line")
    ends = rows.groupBy("key").agg(F.count("*").alias("n")).selectExpr("key", "inline(array(struct(0 as place, 'head' as line), struct(cast(n as int) + 1 as place, 'foot' as line)))")
    files = list(Path(as_files(points.unionByName(ends), "t", "gpx")).glob("key=*/part-*"))
    assert len(files) == 40 and {(f.read_text().split()[0], f.read_text().split()[-1], len(f.read_text().split())) for f in files} == {("head", "foot", 102)}


def test_legs_are_those_of_sql():
    import math

    import numpy as np

    lat, lon = [float(f"{13000 + i}e-4") for i in range(1200)], [float(f"{1038000 + i % 50 * 2}e-4") for i in range(1200)]
    a, o = [math.radians(x) for x in lat], [math.radians(x) for x in lon]
    want = [2 * 6371000 * math.asin(math.sqrt(math.sin((a[i] - a[i - 1]) / 2) ** 2 + math.cos(a[i - 1]) * math.cos(a[i]) * math.sin((o[i] - o[i - 1]) / 2) ** 2)) for i in range(1, 1200)]
    assert np.abs(tracks.leg_meters(np.array(lat), np.array(lon)) - want).max() < 1e-11


def test_tracks_equal_their_sql(spark, fine_partitions, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from paceline.plans import oracles, queries

    sizes = [86_500, 700, 1033, 650, 900, 800]  # the first lasts longer than a day
    con = duckdb.connect()
    con.sql("create table events as " + " union all ".join(f"select {u * 100_000} + i as event_id, timestamp '2024-01-01' + i * interval 1 second as ts, cast({u * 15} + i % 15 as bigint) as user_id from range({n}) t(i)" for u, n in enumerate(sizes)))
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = queries.queries()["export_tracks"](spark, str(tmp_path))
    got, sql = sorted(map(tuple, df.collect()), key=str), con.sql(oracles.oracle_sql()["export_tracks"])
    assert df.columns == sql.columns and [r[3] for r in got] == sizes
    assert got == sorted(sql.fetchall(), key=str)
