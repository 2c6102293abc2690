import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.physics import spill_age
from tidemark.operators import ais, ordering, spatial, tracks
from tidemark.plans.ingest import clean_csv
from tidemark.sources.positions import append_positions, read_csv, read_json, read_positions
from tidemark.streaming import append_stream

HEADER = "mmsi,latitude,longitude,speed,course,heading,timestamp,name,ship_type\n"
CSV = HEADER + (
    "211000501,54.20,7.90,12.1,0.0,1.0,2025-03-02T21:15:00Z,\"STERN \"\"A\"\", I\",Cargo\n"
    "211000501,54.45,7.90,11.7,0.0,1.0,2025-03-02T22:40:00Z,\"STERN \"\"A\"\", I\",Cargo\n"
    "244777010,53.05,4.35,8.3,95.0,96.0,2025-03-02T21:20:00Z,ZEEHOND\\,Dredger\n"
    "211000501,54.80,7.90,12.4,0.0,1.0,2025-03-03T00:05:00Z,\"STERN \"\"A\"\", I\",Cargo\n")


def haversine(a, b, c, d):
    p, q = math.sin(math.radians(c - a) / 2), math.sin(math.radians(d - b) / 2)
    x = p * p + math.cos(math.radians(a)) * math.cos(math.radians(c)) * q * q
    return 6371.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distance_and_box(spark):
    lit = F.lit
    d = value(spark, geo.haversine_km(lit(18.9220), lit(72.8346), lit(15.4989), lit(73.8278)))
    assert d == pytest.approx(394.9745, abs=1e-4)
    b = value(spark, geo.box_around(lit(18.9), lit(72.8), lit(50.0)))
    assert (b.min_lon, b.min_lat, b.max_lon, b.max_lat) == (72.32525, 18.44781, 73.27475, 19.35219)


def test_age(spark):
    a = value(spark, spill_age(F.lit(8.5), F.lit(5.2), F.lit(6.5), F.lit(False)))
    assert (a.min_hours, a.max_hours, a.age_confidence, a.regime) == (7.7, 28.7, "MODERATE", "SHEARED_TRAILING_SLICK")
    assert value(spark, spill_age(F.lit(0.0), F.lit(5.2), F.lit(6.5), F.lit(False))).age_status == "AGE_UNAVAILABLE"


def test_csv_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    clean = ais.clean_positions(read_csv(spark, str(tmp_path / "a.csv")))
    s = ais.import_summary(clean).first()
    assert (s.imported_records, s.vessels_updated) == (4, 2)
    assert {r.name for r in clean.collect()} == {'STERN "A", I', "ZEEHOND\\"}
    # Along a meridian a degree of latitude has 6371 * pi / 180 km.
    km = sorted(r.step_km for r in tracks.steps(ais.with_ids(clean)).filter("mmsi = '211000501' AND step_km IS NOT NULL").collect())
    assert km == pytest.approx([0.25 * 111.19493, 0.35 * 111.19493], abs=1e-3)
    store = str(tmp_path / "store")
    append_positions(clean, store)
    append_positions(clean, store)
    assert spark.read.parquet(store).count() == 8
    for _ in range(2):
        append_positions(clean, store, "7")
    assert read_positions(spark, store).filter("batch = '7'").count() == 4 and read_positions(spark, store).count() == 12


def test_json_forms(spark, tmp_path):
    recs = [{"mmsi": "419111222", "lat": 19.0, "lon": 72.0, "timestamp": 1726300800, "sog": 5.5},
            {"mmsi": "419111222", "lat": 19.0, "lon": 72.0, "timestamp": 0}]
    (tmp_path / "list.json").write_text(json.dumps(recs))
    (tmp_path / "obj.json").write_text(json.dumps({"records": recs}))
    for name in ("list.json", "obj.json"):
        got = ais.clean_positions(read_json(spark, str(tmp_path / name))).collect()
        assert len(got) == 1 and got[0].speed == 5.5 and got[0].ts == datetime(2024, 9, 14, 8, 0)


def test_json_records_choose_their_headers(spark, tmp_path):
    recs = [{"mmsi": "211000501", "LAT": 54.0, "lon": 7.0, "time": "1740950100"}, {"MMSI": 211000502, "latitude": "54.5", "lon": 7.0, "timestamp": "2025-03-02T21:15Z"},
            {"mmsi": "211000503", "lon": 7.0, "time": "2/3/2025 9:05:00"}, {"mmsi": "211000504", "latitude": "x", "LAT": 54.0, "lon": 7.0, "time": "2/3/2025 9:05:00"}]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    got = ais.clean_positions(read_json(spark, str(tmp_path / "a.json")), ais.CleanRules(per_record=True)).orderBy("mmsi").collect()
    assert [(r.mmsi, r.lat, r.ts) for r in got] == [("211000501", 54.0, datetime(2025, 3, 2, 21, 15)), ("211000502", 54.5, datetime(2025, 3, 2, 21, 15)),
                                                    ("211000503", 0.0, datetime(2025, 3, 2, 9, 5))]


def test_csv_files_with_other_headers(spark, tmp_path):
    src = tmp_path / "in put"
    src.mkdir()
    (src / "a.csv").write_text(CSV)
    (src / "b.csv").write_text("LON,LAT,BaseDateTime,MMSI\n7.5,54.1,2025-03-02 1:02:03,211000777\n")
    got = clean_csv(spark, str(src))
    assert {(r.mmsi, r.lat, r.lon) for r in got.collect()} >= {("211000777", 54.1, 7.5), ("244777010", 53.05, 4.35)} and got.count() == 5
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(src)).collect()


def audit(spark, **fields):
    base = {"mmsi": "419000123", "latitude": "18.9", "longitude": "72.8", "timestamp": "2026-09-14T10:00:00Z"}
    base.update(fields)
    schema = ", ".join(f"`{k}` string" for k in base)
    return ais.audit_positions(spark.createDataFrame([tuple(base.values())], schema)).first()


@pytest.mark.parametrize("fields,reason", [
    ({}, None), ({"mmsi": "123"}, "MMSI"), ({"mmsi": " 419000123 "}, None), ({"latitude": "95"}, "POSITION"),
    ({"latitude": "0", "longitude": "0"}, "POSITION"), ({"latitude": ""}, "POSITION"), ({"latitude": "1.5f"}, "POSITION"),
    ({"latitude": "nan"}, "POSITION"), ({"speed": "120"}, "SPEED"), ({"speed": "-1"}, "SPEED"), ({"speed": "nan"}, None),
    ({"speed": "fast"}, None), ({"timestamp": "2026"}, "TIMESTAMP"), ({"timestamp": ""}, "TIMESTAMP"),
    ({"timestamp": "14/09/2026 10:00:00"}, None), ({"timestamp": "2026-09-14 10:00:00"}, None),
    ({"timestamp": "2026-09-14T10:00:00+05:30"}, None), ({"timestamp": "31/02/2026 10:00:00"}, "TIMESTAMP")])
def test_reject_rules(spark, fields, reason):
    assert audit(spark, **fields).reject_reason == reason


def test_field_rules(spark):
    r = audit(spark, course="-10", heading="x", name="  ", ship_type="")
    assert (r.course, r.heading, r.name, r.ship_type) == (350.0, 350.0, "VESSEL-419000123", "Tanker")
    assert audit(spark, timestamp="2026-09-14T10:00:00+05:30").ts == datetime(2026, 9, 14, 4, 30)
    # The first header that is present wins, even when its value is blank.
    assert audit(spark, latitude="", lat="10").reject_reason == "POSITION"


def test_cleaning_is_stable(spark):
    first = ais.clean_positions(spark.createDataFrame([("419000123", "18.9", "72.8", "2026-09-14T10:00:00Z", "n/a")],
                                                      "mmsi string, lat string, lon string, time string, sog string"))
    again = first.select("mmsi", "lat", "lon", F.col("ts").alias("timestamp"), "speed", "course", "heading", "name", "ship_type", "navigation_status")
    assert ais.clean_positions(again).collect() == first.collect()


def test_stream(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text(CSV + "12,1,1,1,1,1,2026-09-14T06:00:00Z,X,Y\n")
    schema = read_csv(spark, str(src)).schema
    q = append_stream(spark.readStream.schema(schema).option("header", True).csv(str(src)), store, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(store).count() == 4


def track(spark, rows, vessel=1):
    t0 = datetime(2026, 9, 14)
    data = [(i, vessel, t0 + timedelta(minutes=m), lon, lat, s, c) for i, (m, lon, lat, s, c) in enumerate(rows)]
    return spark.createDataFrame(data, "position_id bigint, vessel_id bigint, ts timestamp, lon double, lat double, speed double, course double")


STOPPED = [(0, 72.70, 18.80, 14.2, 180.0), (30, 72.70, 18.82, 13.8, 180.0), (60, 72.70, 18.83, 1.2, 190.0),
           (90, 72.71, 18.83, 0.8, 210.0), (120, 72.71, 18.84, 1.1, 220.0), (150, 72.73, 18.88, 12.5, 180.0)]


def test_anomaly_golden(spark):
    origin = (18.83, 72.70)
    flagged = tracks.step_flags(tracks.steps(track(spark, STOPPED)), origin)
    kinds = {r.signal_type: r for r in tracks.anomaly_signals(flagged, origin).collect()}
    assert set(kinds) == {"SUDDEN_SPEED_REDUCTION", "LOITERING_PATTERN"}
    assert kinds["SUDDEN_SPEED_REDUCTION"].description == "Vessel decelerated sharply from 13.8 kts to 1.2 kts (91% reduction while underway)."
    s = tracks.anomaly_summary(flagged).first()
    assert (s.has_anomaly, s.anomaly_count, s.max_gap_hours, s.average_speed_knots) == (True, 2, 0.5, 7.3)


def test_single_report(spark):
    s = tracks.anomaly_summary(tracks.step_flags(tracks.steps(track(spark, STOPPED[:1])))).first()
    assert (s.has_anomaly, s.anomaly_count) == (False, 0) and s.details.startswith("Insufficient")


def test_gap_stops_at_first_flag(spark):
    rows = [(0, 72.7, 18.8, 9.0, 0.0), (30, 72.7, 18.8, 9.0, 0.0), (150, 72.7, 18.8, 9.0, 0.0), (900, 72.7, 18.8, 9.0, 0.0)]
    flagged = tracks.step_flags(tracks.steps(track(spark, rows), bucket_seconds=3600))
    assert tracks.gap_until_first_flag(flagged).first().max_gap_h == 2.0


def test_hot_vessel_next_row(spark):
    """One ship owns most rows; buckets of an hour must give the plain lead."""
    df = spark.range(4000).select(
        F.col("id").alias("position_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("vessel_id"),
        F.timestamp_seconds((F.col("id") * 7919) % 900000).alias("ts"))
    got = ordering.with_next(df, ["position_id"], bucket_seconds=3600).select("position_id", "nxt.position_id")
    w = Window.partitionBy("vessel_id").orderBy("ts", "position_id")
    want = df.select("position_id", F.lead("position_id").over(w))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_numbering(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("k"), ((F.col("id") * 31) % 50).cast("double").alias("s"))
    got = ordering.number_rows(df, ["k"], F.col("s"), [F.col("id")], bucket_desc=True, total="n")
    w = Window.partitionBy("k").orderBy(F.col("s").desc(), "id")
    want = df.select("id", F.row_number().over(w).alias("r"))
    assert {r.id: r.row_no for r in got.collect()} == {r.id: r.r for r in want.collect()}
    assert {r.n for r in got.collect()} == {1500}


def scattered(spark):
    pts = spark.range(3000).select(F.col("id").alias("position_id"), (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon")).toPandas()
    # A berth: a third of all reports at one place, and some around it.
    pts.loc[:900, ["lat", "lon"]] = 18.95, 72.85
    pts.loc[900:1400, "lat"] = 18.0 + (pts.loc[900:1400, "lat"] + 90) / 90
    pts.loc[900:1400, "lon"] = 72.0 + (pts.loc[900:1400, "lon"] + 180) / 180
    cs = [(0, 89.9, 10.0), (1, -89.5, -170.0), (2, 0.0, 179.99), (3, 10.0, -179.9), (4, 60.0, 0.0), (5, 45.0, 180.0), (6, 18.9, 72.8), (7, 19.0, 72.0)]
    return pts, cs + [(i + 8, float(la), float(lo)) for i, (la, lo) in enumerate(zip(range(-80, 81, 20), range(-170, 171, 40)))]


@pytest.mark.parametrize("radius,load", [(300.0, 1 << 18), (300.0, 40), (2500.0, 300), (20.0, 7)])
def test_radius_join_equals_brute_force(spark, radius, load):
    pts, cs = scattered(spark)
    df = spark.createDataFrame(pts)
    got = spatial.within_radius(df, spark.createDataFrame(cs, "cid int, centre_lat double, centre_lon double"), radius, load=load)
    got = sorted((r.position_id, r.cid) for r in got.collect())
    want = sorted((int(i), c) for i, la, lo in pts.itertuples(index=False) for c, a, b in cs if haversine(a, b, la, lo) <= radius)
    assert got == want and len(set(got)) == len(got)


@pytest.mark.parametrize("load", [1 << 18, 25])
def test_radius_per_centre(spark, load):
    """Radii from 1 to 2,000 km in one call: each centre is listed at the level that suits it."""
    pts, cs = scattered(spark)
    radii = [1.0, 12.0, 25.0, 60.0, 140.0, 400.0, 900.0, 2000.0]
    rows = [(c, a, b, radii[c % len(radii)]) for c, a, b in cs]
    centres = spark.createDataFrame(rows, "cid int, centre_lat double, centre_lon double, r double")
    got = spatial.within_radius(spark.createDataFrame(pts), centres, 50.0, radius_column="r", load=load)
    got = sorted((r.position_id, r.cid) for r in got.collect())
    want = sorted((int(i), c) for i, la, lo in pts.itertuples(index=False) for c, a, b, r in rows if haversine(a, b, la, lo) <= r)
    assert got == want and len(set(got)) == len(got)


def test_busy_cells_cost_the_centres_few_copies(spark):
    """Only the centres at the busy cell are copied, by what was counted there."""
    pts, cs = scattered(spark)
    df, centres = spark.createDataFrame(pts), spark.createDataFrame(cs, "cid int, centre_lat double, centre_lon double")
    plan = spatial.within_radius(df, centres, 50.0, load=100)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearby_grows_with_radius(spark):
    df = track(spark, STOPPED)
    c = spark.createDataFrame([(1, 18.83, 72.70)], "centre_id int, centre_lat double, centre_lon double")
    n = [spatial.nearby_vessels(df, c, r).first().positions_count for r in (1.2, 3.0, 50.0)]
    assert n == sorted(n) and n[-1] == 6


def test_track_parts_keep_every_point(spark):
    parts = tracks.track_parts(track(spark, STOPPED), points_per_part=4, bucket_seconds=1800).orderBy("part").collect()
    assert [len(p.coordinates) for p in parts] == [4, 2]
    assert [c.lat for p in parts for c in p.coordinates] == [r[2] for r in STOPPED]


def test_catalogue_attributes(spark):
    items = spark.createDataFrame([("1", "S1A_X", [("orbitDirection", "ASCENDING"), ("orbitDirection", "DESCENDING"), (None, "x")], None), ("2", "Z", None, None)],
                                  "acquisition_id string, product_id string, attributes array<struct<Name:string,Value:string>>, acquisition_time timestamp")
    a, b = spatial.parse_catalogue(items).orderBy("acquisition_id").collect()
    assert (a.satellite, a.orbit_direction, a.polarization) == ("Sentinel-1A", "DESCENDING", "VV+VH")
    assert (b.satellite, b.orbit_direction, b.relative_orbit) == ("Sentinel-1", "DESCENDING", "121")


def test_freshness(spark):
    def at(h):
        return value(spark, spatial.freshness(F.lit("2026-01-10 00:00:00").cast("timestamp"), F.lit("2026-01-10 00:00:00").cast("timestamp") - F.expr(f"INTERVAL {h} HOURS")))
    assert [at(0), at(5), at(36)] == ["Acquired 0.1 hours ago", "Acquired 5.0 hours ago", "Acquired 1.5 days ago"]
