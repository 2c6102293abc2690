"""Position, track and radius queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import ANG, FIX, HAV, HOURS, R
from checks.views import Views, sql_views
from tidemark.functions import geo
from tidemark.functions.scalar import fixed, rnd
from tidemark.operators import ais, spatial, tracks
from tidemark.plans.ingest import clean_csv, import_positions
from tidemark.sources.json_lists import write_list
from tidemark.sources.positions import append_positions, read_csv, read_json, read_positions
from tidemark.sources.scratch import new_path


def us(name: str, out: str | None = None):
    return F.unix_micros(F.col(name)).alias(out or name)


NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
AUDIT = sql_views("raw_ais") + rf""",
p AS (SELECT *, CASE WHEN regexp_matches(latitude, {NUM}) THEN CAST(latitude AS DOUBLE) END AS la,
  CASE WHEN regexp_matches(longitude, {NUM}) THEN CAST(longitude AS DOUBLE) END AS lo,
  coalesce(CASE WHEN regexp_matches(speed, {NUM}) THEN CAST(speed AS DOUBLE) END, 0e0) AS sp,
  coalesce(((CASE WHEN regexp_matches(course, {NUM}) THEN CAST(course AS DOUBLE) END % 360e0) + 360e0) % 360e0, 0e0) AS co,
  CASE WHEN regexp_matches(timestamp, '^\d{{4}}-') THEN try_cast(replace(replace(timestamp, 'Z', ''), 'T', ' ') AS TIMESTAMP)
   ELSE try_strptime(timestamp, '%d/%m/%Y %H:%M:%S') END AS tt FROM raw_ais),
audit AS (SELECT ingest_seq, mmsi, CASE WHEN trim(name) = '' THEN concat('VESSEL-', mmsi) ELSE trim(name) END AS name, 'Tanker' AS ship_type,
  epoch_us(tt) AS ts, la AS lat, lo AS lon, sp AS speed, co AS course, co AS heading, 'Under way using engine' AS navigation_status,
  CASE WHEN NOT regexp_matches(mmsi, '^[0-9]{{9}}$') THEN 'MMSI'
   WHEN la IS NULL OR lo IS NULL OR NOT (la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180) OR (la = 0 AND lo = 0) THEN 'POSITION'
   WHEN tt IS NULL THEN 'TIMESTAMP' WHEN sp < 0 OR sp > 50 THEN 'SPEED' END AS reject_reason FROM p)
"""
CLEAN_COLUMNS = "ingest_seq, mmsi, name, ship_type, ts, lat, lon, speed, course, heading, navigation_status"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("ts"))


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def clean_positions(v: Views) -> DataFrame:
    return _flat(ais.clean_positions(v.raw_ais))


@query(AUDIT + "SELECT ingest_seq, reject_reason FROM audit WHERE reject_reason IS NOT NULL")
def rejected_positions(v: Views) -> DataFrame:
    return ais.audit_positions(v.raw_ais).filter("reject_reason IS NOT NULL").select("ingest_seq", "reject_reason")


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def csv_import(v: Views) -> DataFrame:
    """Through a CSV file with public-archive headers and back."""
    path = new_path(v.spark, "csv")
    renamed = v.raw_ais.withColumnsRenamed({"mmsi": "MMSI", "latitude": "LAT", "longitude": "LON", "speed": "SOG",
                                            "course": "COG", "timestamp": "BaseDateTime", "name": "VesselName"})
    renamed.write.csv(path, header=True)
    return _flat(ais.clean_positions(read_csv(v.spark, path))).withColumn("ingest_seq", F.col("ingest_seq").cast("bigint"))


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def json_import(v: Views) -> DataFrame:
    path = new_path(v.spark, "json")
    v.raw_ais.write.json(path)
    return _flat(ais.clean_positions(read_json(v.spark, path, lines=True)))


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def json_split_list(v: Views) -> DataFrame:
    """One file, one JSON list of all records, with braces and quotes inside strings and nested values, cut by many tasks."""
    path, mark = new_path(v.spark, "json"), '"}{[\\'
    marked = v.raw_ais.withColumn("name", F.when(F.trim("name") != "", F.concat("name", F.lit(mark))).otherwise(F.col("name")))
    record = F.to_json(F.struct(*v.raw_ais.columns, F.struct(F.array(F.lit("}"), F.lit("]")).alias("list")).alias("extra")))
    write_list(marked.select(record.alias("value")), path)
    clean = ais.clean_positions(read_json(v.spark, path, range_bytes=1 << 18)).drop("extra")
    plain = F.when(F.endswith("name", F.lit(mark)), F.col("name").substr(F.lit(1), F.length("name") - len(mark))).otherwise(F.col("name"))
    return _flat(clean).withColumns({"ingest_seq": F.col("ingest_seq").cast("bigint"), "name": plain})


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def csv_mixed_headers(v: Views) -> DataFrame:
    """Files of one folder with other headers in another order; names hold quotes, commas and backslashes."""
    path, mark = new_path(v.spark, "csv"), '", \\'
    marked = v.raw_ais.withColumn("name", F.when(F.trim("name") != "", F.concat("name", F.lit(mark))).otherwise(F.col("name")))
    marked.filter("ingest_seq % 2 = 0").write.option("escape", '"').csv(path, header=True)
    other = marked.filter("ingest_seq % 2 = 1").select(
        F.col("longitude").alias("LON"), F.col("latitude").alias("LAT"), F.col("timestamp").alias("BaseDateTime"), "ingest_seq",
        F.col("speed").alias("SOG"), F.col("course").alias("COG"), F.col("name").alias("VesselName"), F.col("mmsi").alias("MMSI"))
    other.write.mode("append").option("escape", '"').csv(path, header=True)
    clean = clean_csv(v.spark, path)
    plain = F.when(F.endswith("name", F.lit(mark)), F.col("name").substr(F.lit(1), F.length("name") - len(mark))).otherwise(F.col("name"))
    return _flat(clean).withColumns({"ingest_seq": F.col("ingest_seq").cast("bigint"), "name": plain})


@query(AUDIT + f"SELECT {CLEAN_COLUMNS} FROM audit WHERE reject_reason IS NULL")
def json_list_import(v: Views) -> DataFrame:
    """JSON lists and objects with records, whose records differ in their headers and kinds of time."""
    even = F.col("ingest_seq") % 2 == 0
    iso = F.when(F.col("timestamp").rlike(r"^\d{4}-.*Z$"), F.unix_seconds(F.col("timestamp").try_cast("timestamp")).cast("string"))
    record = F.to_json(F.struct(
        "ingest_seq", F.col("mmsi").alias("MMSI"),
        F.when(even, F.col("latitude")).alias("LAT"), F.when(~even, F.col("latitude")).alias("latitude"), F.col("longitude").alias("lon"),
        F.when(even, F.col("speed")).alias("sog"), F.when(~even, F.col("speed")).alias("speed"), F.col("course").alias("COG"), "name", F.coalesce(iso, F.col("timestamp")).alias("time")))
    bare = F.regexp_replace(record, r'"time":"(\d+)"', '"time":$1')
    files = v.raw_ais.select(F.floor(F.col("ingest_seq") / 1000).alias("file"), bare.alias("r")).groupBy("file").agg(F.array_join(F.collect_list("r"), ",").alias("r"))
    rules = ais.CleanRules(per_record=True)
    out = []
    for rest, form in ((0, F.concat(F.lit("["), "r", F.lit("]"))), (1, F.concat(F.lit('{"records":['), "r", F.lit("]}")))):
        path = new_path(v.spark, "json")
        files.filter(F.col("file") % 2 == rest).select(form.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
        if rest == 0 or not files.filter("file % 2 = 1").isEmpty():
            out.append(_flat(ais.clean_positions(read_json(v.spark, path), rules)).select(*CLEAN_COLUMNS.split(", ")))
    return reduce(DataFrame.unionByName, out)


@query(AUDIT + f""", o AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM audit WHERE reject_reason IS NULL WINDOW w AS (PARTITION BY mmsi ORDER BY ts, ingest_seq))
SELECT CAST(mmsi AS BIGINT) AS vessel_id, {R(f"coalesce(sum({HAV('lat', 'lon', 'lat2', 'lon2')}), 0)", 4)} AS length_km, count(*) AS waypoints, min(ts) AS start_us, max(ts) AS end_us FROM o GROUP BY 1""")
def imported_track_summary(v: Views) -> DataFrame:
    """From raw records through the store to tracks."""
    path = new_path(v.spark, "positions")
    import_positions(v.raw_ais, v.vessels, path, "ingest_seq")
    return tracks.track_summary(v.spark.read.parquet(path)).select(
        "vessel_id", rnd(F.col("length_km"), 4).alias("length_km"), "waypoints", us("start_time", "start_us"), us("end_time", "end_us"))


@query(AUDIT + "SELECT mmsi, CAST(count(*) AS BIGINT) AS n, max(ts) AS last_us FROM audit WHERE reject_reason IS NULL GROUP BY mmsi")
def position_store(v: Views) -> DataFrame:
    """Import in two batches, one of them twice, then read back."""
    path, clean = new_path(v.spark, "positions"), ais.clean_positions(v.raw_ais)
    even = F.col("ingest_seq") % 2 == 0
    append_positions(clean.filter(even), path, "even")
    append_positions(clean.filter(~even), path)
    append_positions(clean.filter(even), path, "even")
    return read_positions(v.spark, path).groupBy("mmsi").agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last_us"))


@query(AUDIT + """, v AS (SELECT CAST(419000000 + c_custkey AS VARCHAR) AS mmsi FROM customer WHERE c_acctbal > 0)
SELECT CAST(mmsi AS BIGINT) AS vessel_id, mmsi, arg_min(name, ingest_seq) AS name, 'Tanker' AS ship_type, 'India' AS flag FROM audit
WHERE reject_reason IS NULL AND mmsi NOT IN (SELECT mmsi FROM v) GROUP BY mmsi""")
def new_vessels(v: Views) -> DataFrame:
    known = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet").filter("c_acctbal > 0").select(
        (F.col("c_custkey") + 419000000).cast("string").alias("mmsi"))
    return ais.new_vessels(ais.clean_positions(v.raw_ais), known, "ingest_seq")


@query(AUDIT + "SELECT count(*) AS imported_records, count(DISTINCT mmsi) AS vessels_updated FROM audit WHERE reject_reason IS NULL")
def import_summary(v: Views) -> DataFrame:
    return ais.import_summary(ais.clean_positions(v.raw_ais))


@query(sql_views("vessels") + "SELECT * FROM vessels ORDER BY vessel_id LIMIT 50 OFFSET 25")
def vessels_page(v: Views) -> DataFrame:
    return ais.vessels_page(v.vessels, 50, 25)


@query(sql_views("vessels") + "SELECT * FROM vessels WHERE mmsi = '419000007'")
def vessel_by_mmsi(v: Views) -> DataFrame:
    return ais.vessel_by_mmsi(v.vessels, "419000007")


@query(sql_views("vessels") + "SELECT * FROM vessels WHERE contains(lower(name), 'auto') OR contains(lower(ship_type), 'auto') OR contains(mmsi, 'AUTO')")
def vessel_search(v: Views) -> DataFrame:
    return ais.search_vessels(v.vessels, "AUTO")


@query(sql_views("ais") + """SELECT position_id, epoch_us(ts) AS ts, lon, lat, speed, course FROM ais WHERE mmsi = '419000007'
AND ts >= TIMESTAMP '2024-01-01 03:00:00' AND ts <= TIMESTAMP '2024-01-01 12:00:00' ORDER BY ts, position_id LIMIT 1000""")
def vessel_track(v: Views) -> DataFrame:
    return ais.track(v.ais, "419000007", "2024-01-01 03:00:00", "2024-01-01 12:00:00").select(
        "position_id", us("ts"), "lon", "lat", "speed", "course")


@query(sql_views("ais") + """SELECT vessel_id, position_id, row_no FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY ts, position_id) AS row_no FROM ais) WHERE row_no <= 20""")
def first_reports_per_vessel(v: Views) -> DataFrame:
    return tracks.first_reports(v.ais, 20).select("vessel_id", "position_id", F.col("row_no").cast("bigint").alias("row_no"))


@query(sql_views("ais", "vessels") + "SELECT a.position_id, a.lon, a.lat, v.* FROM ais a JOIN vessels v USING (vessel_id)")
def positions_with_vessel(v: Views) -> DataFrame:
    return ais.join_vessels(v.ais, v.vessels).select("position_id", "lon", "lat", "vessel_id", "mmsi", "name", "ship_type", "flag")


STEPS = f""", o AS (SELECT *, lead(ts) OVER w AS ts2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(speed) OVER w AS speed2,
 lead(course) OVER w AS course2, lead(position_id) OVER w AS id2 FROM ais WINDOW w AS (PARTITION BY vessel_id ORDER BY ts, position_id)),
steps AS (SELECT *, {HAV('lat', 'lon', 'lat2', 'lon2')} AS step_km, {HOURS('ts2', 'ts')} AS gap_h FROM o)
"""


@query(sql_views("ais") + STEPS + f"SELECT position_id, id2 AS next_id, {R('step_km', 6)} AS step_km, {R('gap_h', 6)} AS gap_h FROM steps")
def track_segments(v: Views) -> DataFrame:
    return tracks.steps(v.ais).select("position_id", F.col("nxt.position_id").alias("next_id"),
                                      rnd(F.col("step_km"), 6).alias("step_km"), rnd(F.col("gap_h"), 6).alias("gap_h"))


@query(sql_views("ais") + STEPS + f""", s AS (SELECT vessel_id, coalesce(sum(step_km), 0) AS length_km, count(*) AS waypoints, min(ts) AS a, max(ts) AS b FROM steps GROUP BY 1),
d AS (SELECT *, greatest({HOURS('b', 'a')}, 0.001e0) AS duration_h FROM s)
SELECT vessel_id, {R('length_km', 4)} AS length_km, waypoints, epoch_us(a) AS start_us, epoch_us(b) AS end_us, {R('duration_h', 5)} AS duration_h, {R('length_km/duration_h', 4)} AS avg_kmh FROM d""")
def track_summary(v: Views) -> DataFrame:
    return tracks.track_summary(v.ais).select(
        "vessel_id", rnd(F.col("length_km"), 4).alias("length_km"), "waypoints", us("start_time", "start_us"), us("end_time", "end_us"),
        rnd(F.col("duration_h"), 5).alias("duration_h"), rnd(F.col("avg_kmh"), 4).alias("avg_kmh"))


@query(sql_views("ais") + f""", n AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY ts, position_id) AS rn FROM ais)
SELECT vessel_id, (rn - 1) // 40 AS part, count(*) AS points, string_agg({FIX('lon', 3)} || ' ' || {FIX('lat', 3)}, ',' ORDER BY rn) AS coordinates FROM n GROUP BY 1, 2""")
def track_coordinates(v: Views) -> DataFrame:
    text = F.array_join(F.transform("coordinates", lambda p: F.concat(fixed(p["lon"], 3), F.lit(" "), fixed(p["lat"], 3))), ",")
    return tracks.track_parts(v.ais, 40).select("vessel_id", "part", F.size("coordinates").cast("bigint").alias("points"), text.alias("coordinates"))


ORIGIN = (18.9, 72.5)


def _flag_sql(near: bool) -> str:
    dist = HAV(f"{ORIGIN[0]}e0", f"{ORIGIN[1]}e0", "lat", "lon") if near else "0e0"
    ok = "odist <= 30" if near else "true"
    where = "('(' || " + FIX("odist", 1) + " || ' km from estimated origin)')" if near else "''"
    within = "('within ' || " + FIX("odist", 1) + " || ' km of origin')" if near else "''"
    return sql_views("ais") + STEPS + f""", fl AS (SELECT *, {dist} AS odist, {ANG('course2', 'course')} AS turn FROM steps),
f AS (SELECT *, id2 IS NOT NULL AND coalesce(speed, 0) >= 8 AND coalesce(speed2, 0) <= (1e0 - 0.35e0)*coalesce(speed, 0) AS is_drop,
 coalesce(turn >= 45 AND {ok}, false) AS is_turn, coalesce(gap_h >= 1.5 AND {ok}, false) AS is_gap FROM fl),
one AS (SELECT *, row_number() OVER (PARTITION BY vessel_id, is_drop ORDER BY ts, position_id) AS rd, row_number() OVER (PARTITION BY vessel_id, is_turn ORDER BY ts, position_id) AS rt,
 row_number() OVER (PARTITION BY vessel_id, is_gap ORDER BY ts, position_id) AS rg FROM f),
loit AS (SELECT vessel_id, count(*) AS n, count(speed) AS k, count(*) FILTER (speed <= 3.5) AS slow, min(ts) AS t1 FROM f GROUP BY 1),
signals AS (SELECT vessel_id, 'SUDDEN_SPEED_REDUCTION' AS signal_type, 'MEDIUM' AS severity, epoch_us(ts2) AS signal_us,
  'Vessel decelerated sharply from ' || {FIX('coalesce(speed,0)', 1)} || ' kts to ' || {FIX('coalesce(speed2,0)', 1)} || ' kts (' || {FIX('(1e0 - coalesce(speed2,0)/speed)*100e0', 0)} || '% reduction while underway).' AS description FROM one WHERE is_drop AND rd = 1
 UNION ALL SELECT vessel_id, 'LOITERING_PATTERN', 'LOW', epoch_us(t1), 'Vessel exhibited low-speed loitering / slow steaming (<3.5 kts) across ' || CAST(slow AS VARCHAR) || ' reports.' FROM loit WHERE n >= 2 AND k >= 3 AND slow/k >= 0.5
 UNION ALL SELECT vessel_id, 'SHARP_COURSE_ALTERATION', 'MEDIUM', epoch_us(ts2), 'Sharp course alteration of ' || {FIX('turn', 0)} || '° detected ' || {where} || '.' FROM one WHERE is_turn AND rt = 1
 UNION ALL SELECT vessel_id, 'AIS_TRANSMISSION_GAP', 'MEDIUM', epoch_us(ts), 'AIS blackout / transmission gap of ' || {FIX('gap_h', 1)} || ' hours detected ' || {within} || '.' FROM one WHERE is_gap AND rg = 1)
"""


SUMMARY = f""", fg AS (SELECT vessel_id, min(ts) FILTER (is_gap) AS t0 FROM f GROUP BY 1),
mg AS (SELECT f.vessel_id, coalesce(max(gap_h) FILTER (t0 IS NULL OR ts <= t0), 0) AS g, count(*) AS reports, avg(speed) AS m FROM f JOIN fg USING (vessel_id) GROUP BY 1),
sc AS (SELECT vessel_id, count(*) AS k FROM signals GROUP BY 1)
SELECT vessel_id, reports, reports >= 2 AND coalesce(k, 0) > 0 AS has_anomaly, CASE WHEN reports >= 2 THEN coalesce(k, 0) ELSE 0 END AS anomaly_count,
 CASE WHEN reports >= 2 THEN {R('g', 2)} END AS max_gap_hours, CASE WHEN reports >= 2 THEN coalesce({R('m', 1)}, 0) END AS average_speed_knots FROM mg LEFT JOIN sc USING (vessel_id)"""
SIGNAL_COLUMNS = ("vessel_id", "signal_type", "severity")


def _signals(v: Views, origin) -> DataFrame:
    return tracks.anomaly_signals(tracks.step_flags(tracks.steps(v.ais), origin), origin).select(
        *SIGNAL_COLUMNS, us("signal_ts", "signal_us"), "description")


@query(_flag_sql(False) + "SELECT * FROM signals")
def anomaly_signals(v: Views) -> DataFrame:
    return _signals(v, None)


@query(_flag_sql(True) + "SELECT * FROM signals")
def anomaly_signals_near_origin(v: Views) -> DataFrame:
    return _signals(v, ORIGIN)


@query(_flag_sql(False) + SUMMARY)
def anomaly_summary(v: Views) -> DataFrame:
    return tracks.anomaly_summary(tracks.step_flags(tracks.steps(v.ais))).drop("details")


@query(_flag_sql(True) + SUMMARY)
def anomaly_summary_near_origin(v: Views) -> DataFrame:
    return tracks.anomaly_summary(tracks.step_flags(tracks.steps(v.ais), ORIGIN)).drop("details")


@query(sql_views("ais") + "SELECT vessel_id, position_id, lon, lat, speed, course FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY ts DESC, position_id DESC) AS rn FROM ais) WHERE rn = 1")
def last_positions(v: Views) -> DataFrame:
    return tracks.last_position(v.ais).select("vessel_id", "position_id", "lon", "lat", "speed", "course")


@query(sql_views("ais", "spills") + f""", p AS (SELECT spill_id AS centre_id, vessel_id, {HAV('s.lat', 's.lon', 'a.lat', 'a.lon')} AS d FROM ais a, spills s)
SELECT centre_id, vessel_id, count(*) AS positions_count, {R('min(d)', 4)} AS closest_distance_km FROM p WHERE d <= 50 GROUP BY 1, 2""")
def nearby_vessels(v: Views) -> DataFrame:
    return spatial.nearby_vessels(v.ais, _centres(v)).withColumn("closest_distance_km", rnd(F.col("closest_distance_km"), 4))


def _centres(v: Views) -> DataFrame:
    return v.spills.select(F.col("spill_id").alias("centre_id"), F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"), "detected_at")


@query(sql_views("ais", "spills") + f""", p AS (SELECT spill_id AS centre_id, vessel_id, {HAV('s.lat', 's.lon', 'a.lat', 'a.lon')} AS d FROM ais a, spills s
 WHERE ts BETWEEN detected_at - INTERVAL 6 HOUR AND detected_at)
SELECT centre_id, vessel_id, count(*) AS positions_count, {R('min(d)', 4)} AS closest_distance_km FROM p WHERE d <= 120 GROUP BY 1, 2""")
def nearby_vessels_in_window(v: Views) -> DataFrame:
    centres = _centres(v).withColumn("t_from", F.col("detected_at") - F.expr("INTERVAL 6 HOURS")).withColumnRenamed("detected_at", "t_to")
    near = spatial.nearby_vessels(v.ais, centres, 120.0, ts="ts", window=("t_from", "t_to"))
    return near.withColumn("closest_distance_km", rnd(F.col("closest_distance_km"), 4))


@query(sql_views("spills") + f""", d AS (SELECT spill_id, lon, lat, 50e0/110.574e0 AS dy, 50e0/(111.320e0*greatest(abs(cos(radians(lat))), 0.1e0)) AS dx FROM spills),
b AS (SELECT spill_id, {R('greatest(-180e0, lon-dx)', 5)} AS min_lon, {R('greatest(-90e0, lat-dy)', 5)} AS min_lat, {R('least(180e0, lon+dx)', 5)} AS max_lon, {R('least(90e0, lat+dy)', 5)} AS max_lat FROM d)
SELECT *, printf('POLYGON((%.5f %.5f, %.5f %.5f, %.5f %.5f, %.5f %.5f, %.5f %.5f))', min_lon, min_lat, max_lon, min_lat, max_lon, max_lat, min_lon, max_lat, min_lon, min_lat) AS wkt FROM b""")
def search_boxes(v: Views) -> DataFrame:
    b = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return (v.spills.withColumn("b", geo.box_around(F.col("lat"), F.col("lon"), F.lit(50.0))).select("spill_id", "b.*")
            .withColumn("wkt", geo.box_wkt(*b)))


@query(sql_views("catalogue") + """, top AS (SELECT * FROM catalogue WHERE min_lon <= 73 AND max_lon >= 72 AND min_lat <= 19.5 AND max_lat >= 18.5
 AND acquisition_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01' ORDER BY acquisition_time DESC, acquisition_id LIMIT 200)
SELECT acquisition_id, product_id, epoch_us(acquisition_time) AS acquired_us, polarization FROM top WHERE contains(upper(polarization), 'VH') AND upper(orbit_direction) = 'ASCENDING'""")
def catalogue_search(v: Views) -> DataFrame:
    hits = spatial.search_catalogue(v.catalogue, (72.0, 18.5, 73.0, 19.5), "1996-01-01", "1998-01-01", "vh", "ascending", 200)
    return hits.select("acquisition_id", "product_id", us("acquisition_time", "acquired_us"), "polarization")


LATEST_AT = "TIMESTAMP '1996-06-15 12:00:00'"


@query(sql_views("spills", "catalogue") + f""", p AS (SELECT spill_id, lon, lat, {LATEST_AT} + to_days(CAST(spill_id AS INTEGER) * CASE WHEN spill_id % 7 = 0 THEN 100 ELSE 1 END) AS at_ts, 50e0/110.574e0 AS dy, 50e0/(111.320e0*greatest(abs(cos(radians(lat))), 0.1e0)) AS dx FROM spills),
h AS (SELECT spill_id, at_ts, acquisition_id, acquisition_time FROM p, catalogue c WHERE c.min_lon <= {R('lon+dx', 5)} AND c.max_lon >= {R('lon-dx', 5)} AND c.min_lat <= {R('lat+dy', 5)} AND c.max_lat >= {R('lat-dy', 5)}
 AND acquisition_time BETWEEN at_ts - INTERVAL 14 DAY AND at_ts),
b AS (SELECT *, row_number() OVER (PARTITION BY spill_id ORDER BY acquisition_time DESC, acquisition_id DESC) AS rn, count(*) OVER (PARTITION BY spill_id) AS n, greatest(0.1e0, {HOURS('at_ts', 'acquisition_time')}) AS age FROM h)
SELECT spill_id, acquisition_id, epoch_us(acquisition_time) AS acquired_us, CASE WHEN acquisition_id IS NULL THEN 0 ELSE least(n, 5) END AS available,
 CASE WHEN acquisition_id IS NULL THEN NULL WHEN age < 24 THEN 'Acquired ' || {FIX('age', 1)} || ' hours ago' ELSE 'Acquired ' || {FIX('age/24', 1)} || ' days ago' END AS data_freshness FROM p LEFT JOIN (SELECT * EXCLUDE (at_ts) FROM b WHERE rn = 1) USING (spill_id)""")
def latest_scene(v: Views) -> DataFrame:
    at = F.expr(LATEST_AT) + F.make_dt_interval(days=(F.col("spill_id") * F.when(F.col("spill_id") % 7 == 0, 100).otherwise(1)).cast("int"))
    points = v.spills.select("spill_id", "lon", "lat", at.cast("timestamp").alias("at"))
    best = spatial.latest_scene(points, v.catalogue, key="spill_id")
    return best.select("spill_id", "acquisition_id", us("acquisition_time", "acquired_us"), "available", "data_freshness")


@query(sql_views("catalogue") + """SELECT acquisition_id, CASE WHEN contains(product_id, 'S1A') THEN 'Sentinel-1A' WHEN contains(product_id, 'S1B') THEN 'Sentinel-1B' ELSE 'Sentinel-1' END AS satellite,
 'IW' AS operational_mode, CASE WHEN polarization = 'VH' THEN 'VV+VH' ELSE polarization END AS polarization, CASE WHEN polarization = 'VV' THEN orbit_direction ELSE 'DESCENDING' END AS orbit_direction,
 '121' AS relative_orbit FROM catalogue""")
def catalogue_parse(v: Views) -> DataFrame:
    def pair(cond, name, value):
        return F.when(cond, F.struct(F.lit(name).alias("Name"), value.alias("Value")))
    pol = F.col("polarization")
    items = v.catalogue.withColumn("attributes", F.filter(F.array(
        pair(pol != "VH", "polarisationChannels", pol), pair(pol == "VV", "orbitDirection", F.col("orbit_direction"))), lambda x: x.isNotNull()))
    return spatial.parse_catalogue(items.drop("polarization", "orbit_direction")).select(
        "acquisition_id", "satellite", "operational_mode", "polarization", "orbit_direction", "relative_orbit")


@query(sql_views("ais") + STEPS + f"""SELECT vessel_id, max(speed) AS max_speed, min(speed) AS min_speed, {R('avg(speed)', 6)} AS mean_speed,
 coalesce(bool_or(speed < 4), false) AS any_slow, {R('coalesce(max(gap_h), 0)', 6)} AS max_gap FROM steps GROUP BY 1""")
def vessel_profile(v: Views) -> DataFrame:
    from tidemark.operators.attribution import vessel_profile as profile
    return profile(v.ais).withColumns({"mean_speed": rnd(F.col("mean_speed"), 6), "max_gap": rnd(F.col("max_gap"), 6)})
