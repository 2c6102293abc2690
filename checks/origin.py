"""Forcing, drift and attribution queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.ships import STEPS, us
from checks.sql import ANG, FIX, HAV, HOURS, MOD360, R
from checks.views import Views, sql_views
from tidemark.functions import geo, physics
from tidemark.functions.scalar import lit_f, rnd
from tidemark.operators import attribution, drift, forcing, regions, top_ships
from tidemark.operators.ordering import number_rows
from tidemark.sources.positions import read_candidates, replace_candidates
from tidemark.sources.scratch import cut_lineage, new_path

COND = ("wind_u", "wind_v", "wind_speed_mps", "wind_dir_deg", "current_u", "current_v", "current_speed_mps", "current_dir_deg")


def cond_columns():
    return [F.col(f"cond.{c}").alias(c) for c in (*COND, "is_demo")]


def clim_sql(ts: str) -> dict[str, str]:
    h = f"CAST(hour({ts}) AS DOUBLE)"
    sp = f"greatest(1.5e0, 6.8e0 + 0.8e0*sin({h}*pi()/12e0))"
    di = MOD360(f"235e0 + 5e0*cos({h}*pi()/6e0)")
    return {"wind_u": R(f"-({sp})*sin(radians({di}))", 3), "wind_v": R(f"-({sp})*cos(radians({di}))", 3), "wind_speed_mps": R(sp, 2), "wind_dir_deg": R(di, 1),
            "current_u": R("0.42e0*sin(radians(145e0))", 3), "current_v": R("0.42e0*cos(radians(145e0))", 3), "current_speed_mps": "0.42e0", "current_dir_deg": "145e0"}


def meas_sql() -> dict[str, str]:
    ws, wd = R("coalesce(wind_kmh, 18e0)/3.6e0", 2), R("coalesce(wind_dir, 225e0)", 1)
    cs, cd = R(f"coalesce(current_kmh, 0.35e0)*{1000.0/3600.0!r}", 2), R("coalesce(current_dir, 140e0)", 1)
    return {"wind_u": R(f"-{ws}*sin(radians({wd}))", 3), "wind_v": R(f"-{ws}*cos(radians({wd}))", 3), "wind_speed_mps": ws, "wind_dir_deg": wd,
            "current_u": R(f"{cs}*sin(radians({cd}))", 3), "current_v": R(f"{cs}*cos(radians({cd}))", 3), "current_speed_mps": cs, "current_dir_deg": cd}


def cascade_sql(points: str) -> str:
    """CTE "cond" over a CTE with lat, lon, ts."""
    cl, me = clim_sql("ts"), meas_sql()
    cols = ", ".join(f"CASE WHEN known THEN {me[c]} ELSE {cl[c]} END AS {c}" for c in COND)
    return f""", fx AS (SELECT CAST(round_even(cell_lat*100, 0) AS INTEGER) AS y, CAST(round_even(cell_lon*100, 0) AS INTEGER) AS x, hour, wind_kmh, wind_dir, current_kmh, current_dir FROM forcing),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY hour) AS rn FROM fx) WHERE rn = 1),
lk AS (SELECT p.*, f1.y IS NOT NULL AS known, e.y IS NOT NULL AS hour_matched, CASE WHEN e.y IS NOT NULL THEN e.wind_kmh ELSE f1.wind_kmh END AS wind_kmh,
 CASE WHEN e.y IS NOT NULL THEN e.wind_dir ELSE f1.wind_dir END AS wind_dir, CASE WHEN e.y IS NOT NULL THEN e.current_kmh ELSE f1.current_kmh END AS current_kmh,
 CASE WHEN e.y IS NOT NULL THEN e.current_dir ELSE f1.current_dir END AS current_dir
 FROM (SELECT *, CAST(round_even(lat*100, 0) AS INTEGER) AS py, CAST(round_even(lon*100, 0) AS INTEGER) AS px FROM {points}) p
 LEFT JOIN fx e ON e.y = py AND e.x = px AND e.hour = date_trunc('hour', ts) LEFT JOIN f1 ON f1.y = py AND f1.x = px),
cond AS (SELECT * EXCLUDE (wind_kmh, wind_dir, current_kmh, current_dir), {cols}, NOT known AS is_demo FROM lk)
"""


COLS = ", ".join((*COND, "is_demo"))


@query(sql_views("ais") + "SELECT position_id, " + ", ".join(f"{e} AS {c}" for c, e in clim_sql("ts").items()) + ", true AS is_demo FROM ais")
def climatology(v: Views) -> DataFrame:
    return forcing.conditions_at(v.ais).select("position_id", *cond_columns())


@query(sql_views("forcing") + f"""SELECT epoch_us(hour) AS hour_us, {R('cell_lat', 4)} AS cell_lat, {R('cell_lon', 4)} AS cell_lon, {R('-wind_kmh/3.6e0*sin(radians(wind_dir))', 3)} AS wind_u,
 {R('-wind_kmh/3.6e0*cos(radians(wind_dir))', 3)} AS wind_v, {R(f'current_kmh*{1000.0/3600.0!r}*sin(radians(current_dir))', 3)} AS current_u, {R(f'current_kmh*{1000.0/3600.0!r}*cos(radians(current_dir))', 3)} AS current_v FROM forcing""")
def wind_and_current_vectors(v: Views) -> DataFrame:
    wu, wv = physics.wind_uv(physics.kmh_to_mps_wind(F.col("wind_kmh")), F.col("wind_dir"))
    cu, cv = physics.current_uv(physics.kmh_to_mps_current(F.col("current_kmh")), F.col("current_dir"))
    return v.forcing.select(us("hour", "hour_us"), rnd(F.col("cell_lat"), 4).alias("cell_lat"), rnd(F.col("cell_lon"), 4).alias("cell_lon"),
                            wu.alias("wind_u"), wv.alias("wind_v"), cu.alias("current_u"), cv.alias("current_v"))


@query(sql_views("ais", "forcing") + cascade_sql("ais") + "SELECT position_id, known AS has_series, hour_matched, wind_kmh, wind_dir, current_kmh, current_dir FROM lk")
def forcing_lookup(v: Views) -> DataFrame:
    return forcing.lookup(v.ais, v.forcing).select("position_id", "has_series", "hour_matched", *forcing.SERIES)


@query(sql_views("ais", "forcing") + cascade_sql("ais") + f"SELECT position_id, {COLS}, hour_matched FROM cond")
def conditions_cascade(v: Views) -> DataFrame:
    return forcing.conditions_at(v.ais, v.forcing).select("position_id", *cond_columns(), "hour_matched")


@query(sql_views("spills", "forcing") + """, pts AS (SELECT spill_id, lat, lon, unnest(generate_series(detected_at - INTERVAL 24 HOUR, detected_at, INTERVAL 3 HOUR)) AS ts FROM spills)"""
       + cascade_sql("pts") + f"SELECT spill_id, epoch_us(ts) AS ts_us, {COLS} FROM cond")
def forcing_history(v: Views) -> DataFrame:
    pts = v.spills.select("spill_id", "lat", "lon", (F.col("detected_at") - F.expr("INTERVAL 24 HOURS")).alias("a"), F.col("detected_at").alias("b"))
    return forcing.history(pts, v.forcing, "a", "b").select("spill_id", us("ts", "ts_us"), *cond_columns())


def drift_sql(cfg: drift.DriftConfig) -> str:
    """CTEs "vel" (per spill and step) and "path" (per particle and step)."""
    dt = cfg.step_minutes * 60.0
    c, s = math.cos(math.radians(cfg.deflection_deg)), math.sin(math.radians(cfg.deflection_deg))
    sigma = math.sqrt(2.0 * cfg.diffusivity_m2s * dt) * cfg.noise
    spread = cfg.start_spread_m * cfg.noise

    def word(i: int) -> str:
        return f"((('0x' || substr(h, {1 + 8*i}, 8))::BIGINT + 0.5e0)/4294967296e0)"
    n1 = f"(sqrt(-2e0*ln({word(0)}))*cos({2*math.pi!r}*{word(1)}))"
    n2 = f"(sqrt(-2e0*ln({word(0)}))*sin({2*math.pi!r}*{word(1)}))"
    th = f"({2*math.pi!r}*{word(2)})"
    coslat = "greatest(abs(cos(radians({}))), 0.1e0)"
    return sql_views("spills", "forcing") + f""", st AS (SELECT spill_id, lon, lat, detected_at, unnest(range(0, {cfg.steps + 1})) AS step FROM spills),
pts AS (SELECT * EXCLUDE (detected_at), make_timestamp(epoch_us(detected_at) + step*{cfg.sign * cfg.step_minutes * 60_000_000}) AS ts FROM st)""" + cascade_sql("pts") + f""",
vel AS (SELECT spill_id, lon, lat, step, ts, CASE WHEN step > 0 THEN (current_u + {cfg.windage}e0*(wind_u*{c!r} - wind_v*{s!r}))*{cfg.sign} ELSE 0e0 END AS u,
 CASE WHEN step > 0 THEN (current_v + {cfg.windage}e0*(wind_u*{s!r} + wind_v*{c!r}))*{cfg.sign} ELSE 0e0 END AS v FROM cond),
pp AS (SELECT *, md5(concat_ws(':', '{cfg.seed}', spill_id, particle_id, step)) AS h FROM vel, (SELECT unnest(range(0, {cfg.particles})) AS particle_id)),
mv AS (SELECT *, CASE WHEN step = 0 THEN {spread}e0*{n1}*cos({th}) ELSE u*{dt} + {sigma!r}*{n1} END AS dx, CASE WHEN step = 0 THEN {spread}e0*{n1}*sin({th}) ELSE v*{dt} + {sigma!r}*{n2} END AS dy FROM pp),
la AS (SELECT *, lat + sum(dy/110574e0) OVER (PARTITION BY spill_id, particle_id ORDER BY step) AS p_lat FROM mv),
pv AS (SELECT *, coalesce(lag(p_lat) OVER (PARTITION BY spill_id, particle_id ORDER BY step), lat) AS prev FROM la),
path AS (SELECT spill_id, particle_id, step, ts, p_lat, lon + sum(dx/(111320e0*{coslat.format('prev')})) OVER (PARTITION BY spill_id, particle_id ORDER BY step) AS p_lon FROM pv)
"""


BACK = drift.DriftConfig()
CALM = drift.DriftConfig(noise=0.0, particles=1)
AHEAD = drift.DriftConfig(noise=0.0, particles=1, backward=False)
PATH = f"SELECT spill_id, step, epoch_us(ts) AS ts_us, {R('p_lon', 6)} AS lon, {R('p_lat', 6)} AS lat FROM path"


def _path(v: Views, cfg: drift.DriftConfig) -> DataFrame:
    return drift.simulate(v.spills, v.forcing, cfg).select(
        "spill_id", F.col("step").cast("bigint").alias("step"), us("ts", "ts_us"), rnd(F.col("lon"), 6).alias("lon"), rnd(F.col("lat"), 6).alias("lat"))


@query(drift_sql(BACK) + f"SELECT spill_id, step, {R('u', 6)} AS u, {R('v', 6)} AS v FROM vel")
def drift_velocities(v: Views) -> DataFrame:
    return drift.step_velocities(v.spills, v.forcing, BACK).select(
        "spill_id", F.col("step").cast("bigint").alias("step"), rnd(F.col("u"), 6).alias("u"), rnd(F.col("v"), 6).alias("v"))


@query(drift_sql(CALM) + PATH)
def drift_backward_path(v: Views) -> DataFrame:
    return _path(v, CALM)


@query(drift_sql(AHEAD) + PATH)
def drift_forward_path(v: Views) -> DataFrame:
    return _path(v, AHEAD)


@query(drift_sql(BACK) + f""", fin AS (SELECT * FROM path WHERE step = {BACK.steps}), m AS (SELECT spill_id, avg(p_lat) AS ma, avg(p_lon) AS mo FROM fin GROUP BY 1),
d AS (SELECT fin.*, {HAV('ma', 'mo', 'p_lat', 'p_lon')} AS d FROM fin JOIN m USING (spill_id))
SELECT spill_id, count(*) AS particle_count, {R('avg(p_lat)', 5)} AS origin_lat, {R('avg(p_lon)', 5)} AS origin_lon, greatest(2e0, least(50e0, {R('quantile_cont(d, 0.9)', 2)})) AS uncertainty_km, 0.82e0 AS confidence FROM d GROUP BY 1""")
def drift_origin(v: Views) -> DataFrame:
    """Origin of each spill: the drift of all its particles over all steps, then mean and spread of their ends."""
    return drift.origin_summary(drift.final_positions(drift.simulate(v.spills, v.forcing, BACK), BACK))


@query(drift_sql(BACK) + f"SELECT spill_id, particle_id, epoch_us(ts) AS ts_us, {R('p_lon', 5)} AS lon, {R('p_lat', 5)} AS lat FROM path WHERE particle_id < 35 AND step % {max(1, (BACK.steps + 1) // 6)} = 0")
def drift_waypoints(v: Views) -> DataFrame:
    w = drift.sampled_waypoints(drift.simulate(v.spills, v.forcing, BACK), BACK.steps)
    return w.select("spill_id", F.col("particle_id").cast("bigint").alias("particle_id"), us("ts", "ts_us"), "lon", "lat")


ENDS = sql_views("simulations", "particles") + """, runs AS (SELECT simulation_id, spill_id FROM simulations WHERE simulation_type = 'BACKWARD'),
ends AS (SELECT spill_id, particle_id, ts, simulation_id, lon + 3.14159e-7 AS lon, lat + 3.14159e-7 AS lat FROM particles JOIN runs USING (simulation_id))"""


def _stored(v: Views) -> DataFrame:
    # A little aside, so that no mean lies half-way between two rounded figures.
    aside = v.particles.withColumns({c: F.col(c) + lit_f(3.14159e-7) for c in ("lon", "lat")})
    return drift.stored_paths(aside, v.simulations)


@query(ENDS + f""", m AS (SELECT spill_id, avg(lat) AS ma, avg(lon) AS mo FROM ends GROUP BY 1),
d AS (SELECT ends.*, {HAV('ma', 'mo', 'lat', 'lon')} AS d FROM ends JOIN m USING (spill_id))
SELECT spill_id, count(*) AS particle_count, {R('avg(lat)', 5)} AS origin_lat, {R('avg(lon)', 5)} AS origin_lon, greatest(2e0, least(50e0, {R('quantile_cont(d, 0.9)', 2)})) AS uncertainty_km, 0.82e0 AS confidence FROM d GROUP BY 1""")
def stored_origin(v: Views) -> DataFrame:
    """Origin of each spill from the stored particles of its backward runs."""
    return drift.origin_summary(_stored(v))


@query(ENDS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY spill_id, particle_id ORDER BY ts, simulation_id) - 1 AS step FROM ends)
SELECT spill_id, particle_id, epoch_us(ts) AS ts_us, {R('lon', 5)} AS lon, {R('lat', 5)} AS lat FROM n WHERE particle_id < 5 AND step % 2 = 0""")
def stored_waypoints(v: Views) -> DataFrame:
    w = drift.sampled_waypoints(_stored(v), 11, first_particles=5)
    return w.select("spill_id", "particle_id", us("ts", "ts_us"), "lon", "lat")


# An edge of the hull has no point to its right and none beyond its ends; a line has one edge, a lone point none.
@query(ENDS + """, p AS (SELECT DISTINCT spill_id, lon, lat FROM ends),
e AS (SELECT a.spill_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM p a JOIN p b ON a.spill_id = b.spill_id AND (a.lon <> b.lon OR a.lat <> b.lat)),
bad AS (SELECT DISTINCT e.spill_id, x0, y0, x1, y1 FROM e JOIN p c ON c.spill_id = e.spill_id
 WHERE (x1 - x0)*(c.lat - y0) - (y1 - y0)*(c.lon - x0) < 0 OR ((x1 - x0)*(c.lat - y0) - (y1 - y0)*(c.lon - x0) = 0
  AND ((c.lon - x0)*(x1 - x0) + (c.lat - y0)*(y1 - y0) < 0 OR (c.lon - x1)*(x0 - x1) + (c.lat - y1)*(y0 - y1) < 0))),
edge AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.spill_id = e.spill_id AND bad.x0 = e.x0 AND bad.y0 = e.y0 AND bad.x1 = e.x1 AND bad.y1 = e.y1)),
n AS (SELECT spill_id, count(*) AS n FROM edge GROUP BY 1)
SELECT edge.spill_id, x0, y0, x1, y1, CASE WHEN n = 2 THEN 0.03e0 ELSE 0.02e0 END AS buffer_deg FROM edge JOIN n ON n.spill_id = edge.spill_id WHERE n > 2 OR x0 < x1 OR (x0 = x1 AND y0 < y1)
UNION ALL SELECT spill_id, max(lon), max(lat), NULL, NULL, 0.04e0 FROM p GROUP BY spill_id HAVING count(*) = 1""")
def drift_origin_region(v: Views) -> DataFrame:
    """Edges of the hull of the stored particles of each spill's backward runs."""
    region = drift.origin_region(_stored(v))
    n = F.size("ring")
    ends = F.when(n > 1, F.arrays_zip(F.slice("ring", F.lit(1), F.greatest(n - 1, F.lit(1))).alias("a"), F.slice("ring", F.lit(2), F.greatest(n - 1, F.lit(1))).alias("b"))
                  ).otherwise(F.arrays_zip(F.col("ring").alias("a"), F.slice("ring", 2, 1).alias("b")))
    flat = region.select("spill_id", "buffer_deg", F.inline(ends))
    return flat.select("spill_id", F.col("a.lon").alias("x0"), F.col("a.lat").alias("y0"), F.col("b.lon").alias("x1"), F.col("b.lat").alias("y1"), "buffer_deg")


@query(sql_views("ais") + f"SELECT position_id, {R('(speed*100)/(111320e0*greatest(abs(cos(radians(lat))), 0.1e0))', 8)} AS dlon, {R('(course*10)/110574e0', 8)} AS dlat FROM ais")
def metres_to_degrees(v: Views) -> DataFrame:
    return v.ais.select("position_id", rnd(geo.metres_to_dlon(F.col("speed") * 100, F.col("lat")), 8).alias("dlon"),
                        rnd(geo.metres_to_dlat(F.col("course") * 10), 8).alias("dlat"))


ORIGINS = sql_views("ais", "spills", "simulations") + """, ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spill_id ORDER BY created_at DESC, simulation_id DESC) AS rn FROM simulations WHERE simulation_type = 'BACKWARD') WHERE rn = 1),
org AS (SELECT s.spill_id, s.lat AS clat, s.lon AS clon, ns.spill_id IS NOT NULL AS has_hindcast, coalesce(ns.start_time, s.detected_at - INTERVAL 6 HOUR) AS origin_time,
 CASE WHEN ns.spill_id IS NULL THEN 0.05e0 ELSE 0.04e0 END AS half, coalesce(ns.buffer_deg, 0e0) AS buf, detected_at, area_km2 FROM spills s LEFT JOIN ns USING (spill_id))
"""


@query(ORIGINS + "SELECT spill_id, epoch_us(origin_time) AS origin_us, has_hindcast, buf AS buffer_deg FROM org")
def spill_origins(v: Views) -> DataFrame:
    return _origins(v).select("spill_id", us("origin_time", "origin_us"), "has_hindcast", F.coalesce("origin_buffer", lit_f(0)).alias("buffer_deg"))


def _origins(v: Views) -> DataFrame:
    return attribution.spill_origins(v.ringed_spills, v.ringed_simulations)


def score_sql(near_only: bool, spills: str = "org") -> str:
    keep = "WHERE inside OR d <= 50" if near_only else ""
    dx, dy = "greatest(greatest((clon-half)-lon, lon-(clon+half)), 0e0)", "greatest(greatest((clat-half)-lat, lat-(clat+half)), 0e0)"
    box = "(lon > clon-half AND lon < clon+half AND lat > clat-half AND lat < clat+half)"
    bearing = MOD360("degrees(atan2(clon - lon, clat - lat))")
    return STEPS + f""", pr AS (SELECT vessel_id, max(speed) AS mx, min(speed) AS mn, avg(speed) AS mean_speed, coalesce(bool_or(speed < 4), false) AS slow, coalesce(max(gap_h), 0) AS max_gap FROM steps GROUP BY 1),
pq AS (SELECT o.*, a.vessel_id, a.ts, a.position_id, a.course, a.lon, a.lat, {HAV('clat', 'clon', 'a.lat', 'a.lon')} AS d FROM ais a, {spills} o),
pi AS (SELECT *, {box} OR (buf > 0 AND ({dx})*({dx}) + ({dy})*({dy}) < buf*buf) AS isin FROM pq),
ps AS (SELECT *, bool_or(isin) OVER (PARTITION BY spill_id, vessel_id) AS inside, row_number() OVER (PARTITION BY spill_id, vessel_id ORDER BY d, ts, position_id) AS rn FROM pi),
cp AS (SELECT *, {HOURS('ts', 'origin_time')} AS dts, {ANG('coalesce(course, 0e0)', bearing)} AS turn FROM ps WHERE rn = 1),
fc AS (SELECT *, abs(dts) AS dt, greatest(0e0, (1e0 - turn/180e0)*85e0) AS base, (coalesce(mx, 0) > 8 AND coalesce(mn, 0) <= 0.65e0*coalesce(mx, 0)) OR slow AS dropped, max_gap > 1.5 AND d < 25 AS gap, coalesce(mean_speed, 12e0) AS avg_speed
 FROM cp JOIN pr USING (vessel_id) {keep}),
sc AS (SELECT *, CASE WHEN inside THEN 98e0 ELSE greatest(0e0, (1e0 - d/50e0)*95e0) END AS s, greatest(0e0, (1e0 - dt/12e0)*100e0) AS t,
 CASE WHEN inside OR d < 5 THEN 92e0 WHEN d < 15 THEN greatest(base, 78e0) ELSE base END AS tr, CASE WHEN dropped THEN 90e0 ELSE 50e0 END AS b, CASE WHEN gap THEN 60e0 ELSE 92e0 END AS q FROM fc),
ov AS (SELECT *, {R('least(100e0, greatest(0e0, s*0.35e0 + t*0.3e0 + tr*0.2e0 + b*0.1e0 + q*0.05e0))', 1)} AS overall_score FROM sc),
cand AS (SELECT *, CASE WHEN overall_score >= 80 THEN 'HIGH' WHEN overall_score >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
 row_number() OVER (PARTITION BY spill_id ORDER BY overall_score DESC, vessel_id) AS rank FROM ov)
"""


SCORES = f"""SELECT spill_id, vessel_id, {R('s', 1)} AS spatial_score, {R('t', 1)} AS temporal_score, {R('tr', 1)} AS trajectory_score, {R('b', 1)} AS behaviour_score,
 {R('q', 1)} AS data_quality_score, overall_score, priority FROM cand"""


@query(ORIGINS + score_sql(True) + SCORES.replace("FROM cand", ", rank FROM cand"))
def vessel_attribution(v: Views) -> DataFrame:
    """All spills against the ships with spatial evidence, ranked."""
    scored = attribution.score_near(v.ais, _origins(v), in_run=attribution.IN_RUN).drop("explanation")
    return attribution.rank_candidates(scored, attribution.IN_RUN).withColumn("rank", F.col("rank").cast("bigint"))


WATERS = sql_views("ais") + """, w AS (SELECT o_orderkey % 3 AS ring_id, o_orderkey AS k, 0.25e0 + CAST(o_custkey % 100 AS DOUBLE)/400 AS r FROM orders),
n AS (SELECT ring_id, r, row_number() OVER (PARTITION BY ring_id ORDER BY k) AS seq, count(*) OVER (PARTITION BY ring_id) AS n FROM w),
vx AS (SELECT ring_id, seq, n, 72.3e0 + ring_id*0.2e0 + r*cos(2e0*pi()*seq/n) AS lon, 18.5e0 + r*sin(2e0*pi()*seq/n) AS lat FROM n),
ed AS (SELECT a.ring_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1, a.ring_id*0.004e0 AS buf FROM vx a JOIN vx b ON b.ring_id = a.ring_id AND b.seq = a.seq % a.n + 1),
cr AS (SELECT position_id, ring_id FROM ais JOIN ed ON (y0 > lat) <> (y1 > lat) WHERE lon < (x1 - x0)*(lat - y0)/(y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
nr AS (SELECT DISTINCT position_id, ring_id FROM (SELECT position_id, ring_id, lon, lat, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, buf FROM ais JOIN ed ON buf > 0
  AND lat BETWEEN least(y0, y1) - buf AND greatest(y0, y1) + buf AND lon BETWEEN least(x0, x1) - buf AND greatest(x0, x1) + buf) q,
 LATERAL (SELECT greatest(0e0, least(1e0, ((lon - x0)*dx + (lat - y0)*dy)/(dx*dx + dy*dy))) AS t) u
 WHERE (lon - (x0 + t*dx))*(lon - (x0 + t*dx)) + (lat - (y0 + t*dy))*(lat - (y0 + t*dy)) < buf*buf)
SELECT position_id, ring_id FROM cr UNION SELECT position_id, ring_id FROM nr"""


@query(WATERS)
def positions_in_waters(v: Views) -> DataFrame:
    """Reports inside three ragged regions, which have a vertex for every third order; two of them are grown by a buffer."""
    orders = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")
    corners = orders.select((F.col("o_orderkey") % 3).alias("ring_id"), F.col("o_orderkey").alias("k"), (lit_f(0.25) + (F.col("o_custkey") % 100) / lit_f(400)).alias("r"))
    numbered = number_rows(corners, ["ring_id"], F.floor(F.col("k") / 10_000), [F.col("k")], out="seq", total="n")
    turn = lit_f(2 * math.pi) * F.col("seq") / F.col("n")
    vertices = numbered.select("ring_id", "seq", (lit_f(72.3) + F.col("ring_id") * lit_f(0.2) + F.col("r") * F.cos(turn)).alias("lon"), (lit_f(18.5) + F.col("r") * F.sin(turn)).alias("lat"))
    buffers = v.spark.range(3).select(F.col("id").alias("ring_id"), (F.col("id") * lit_f(0.004)).alias("buffer_deg"))
    return regions.points_in_regions(v.ais, vertices, buffers)


@query(ORIGINS + score_sql(False) + SCORES.replace("FROM cand", ", rank FROM cand WHERE rank <= 5"))
def top_ships_per_spill(v: Views) -> DataFrame:
    """The five best of all ships for each spill, with or without spatial evidence."""
    best = top_ships.top_ships(v.ais, _origins(v), first=5)
    return best.drop("explanation").withColumn("rank", F.col("rank").cast("bigint"))


NEWEST = ", one AS (SELECT * FROM org ORDER BY detected_at DESC, spill_id LIMIT 1)"


@query(ORIGINS + NEWEST + score_sql(False, "one") + SCORES)
def vessel_attribution_newest_spill(v: Views) -> DataFrame:
    """Every ship with positions against the newest spill."""
    newest = v.ringed_spills.orderBy(F.col("detected_at").desc(), "spill_id").limit(1)
    spill = attribution.spill_origins(newest, v.ringed_simulations).first()
    return attribution.score_spill(v.ais, spill).drop("explanation")


@query(ORIGINS + score_sql(True) + f"""SELECT spill_id, vessel_id, {R('d', 2)} AS spatial_distance_km, {R('dt', 2)} AS temporal_delta_hours, {R('turn', 1)} AS trajectory_heading_match_deg, {R('avg_speed', 1)} AS speed_knots,
 dropped AS anomalous_behavior_flag, gap AS ais_gap_detected, concat_ws(' | ', CASE WHEN inside THEN '✓ Track directly intersects the estimated spill origin polygon'
  WHEN d < 15 THEN '✓ Passed within close proximity (' || {FIX('d', 1)} || ' km) of origin' ELSE '△ Moderate distance (' || {FIX('d', 1)} || ' km) to estimated origin' END,
 CASE WHEN dt < 2 THEN '✓ Highly synchronous with hindcast release window (Δt = ' || {FIX('dt', 1)} || ' hrs)' WHEN dt < 6 THEN '✓ Compatible with estimated origin window (Δt = ' || {FIX('dt', 1)} || ' hrs)'
  ELSE '△ Significant time delta (' || {FIX('dt', 1)} || ' hrs) relative to origin' END,
 CASE WHEN tr > 70 THEN '✓ Vessel transit trajectory aligns with drift track corridor' END, CASE WHEN dropped THEN '△ Anomalous speed reduction / loitering detected during transit' END,
 CASE WHEN gap THEN '△ AIS transmission gap / potential transponder blackout near origin' ELSE '✓ Continuous AIS transmission stream with nominal ping frequency' END) AS points,
 concat_ws(' | ', 'spatial ' || (s > 70) || ' ' || {FIX('d', 1)} || ' km closest approach', 'temporal ' || (t > 70) || ' ' || {FIX('dt', 1)} || ' hrs delta to hindcast',
  'trajectory ' || (tr > 60) || ' ' || {FIX('turn', 0)} || '° relative heading', 'behaviour ' || (NOT dropped) || ' Avg speed ' || {FIX('avg_speed', 1)} || ' kts', 'data_quality ' || (NOT gap) || ' Max gap ' || {FIX('max_gap', 1)} || ' hrs') AS breakdown FROM cand""")
def attribution_evidence(v: Views) -> DataFrame:
    flat = F.transform("evidence_breakdown", lambda e: F.concat_ws(" ", e["key"], e["passed"].cast("string"), e["detail"]))
    return (attribution.score_near(v.ais, _origins(v)).select("spill_id", "vessel_id", "explanation.*")
            .withColumn("points", F.array_join("explanation_points", " | ")).withColumn("breakdown", F.array_join(flat, " | "))
            .drop("explanation_points", "evidence_breakdown"))


@query(sql_views("candidates") + "SELECT spill_id, vessel_id, row_number() OVER (PARTITION BY spill_id ORDER BY overall_score DESC, vessel_id) AS rank, CASE WHEN overall_score >= 70 THEN 'High' WHEN overall_score >= 45 THEN 'Medium' ELSE 'Low' END AS rating FROM candidates")
def candidate_rank_and_rating(v: Views) -> DataFrame:
    return attribution.rank_candidates(v.candidates).select("spill_id", "vessel_id", F.col("rank").cast("bigint").alias("rank"),
                                                            attribution.rating(F.col("overall_score")).alias("rating"))


@query(sql_views("candidates", "spills") + "SELECT spill_id, count(*) AS n, CAST(sum(CASE WHEN status = 'ACCEPTED' THEN vessel_id + 1 ELSE vessel_id END) AS BIGINT) AS ids FROM candidates JOIN spills USING (spill_id) WHERE status <> 'REJECTED' GROUP BY 1")
def candidates_replaced(v: Views) -> DataFrame:
    """Store all candidates, run the accepted and the rejected spills again, the latter without any ship, read back."""
    path = new_path(v.spark, "candidates")
    rows = v.candidates.select("spill_id", "vessel_id", "overall_score")
    replace_candidates(rows, v.spills, path)
    accepted = v.spills.filter("status = 'ACCEPTED'").select("spill_id")
    again = v.spills.filter("status IN ('ACCEPTED', 'REJECTED')")
    replace_candidates(rows.join(accepted, "spill_id", "left_semi").withColumn("vessel_id", F.col("vessel_id") + 1), again, path)
    return read_candidates(v.spark, path).groupBy("spill_id").agg(F.count("*").alias("n"), F.sum("vessel_id").alias("ids"))


def _age_sql(elong: str, area: str, wind: str, multi: str) -> str:
    base = f"(sqrt({area})*4e0/(CASE WHEN {wind} > 0 THEN least(greatest({wind}/6e0, 0.6e0), 2e0) ELSE 1e0 END))"
    off = f"least(12e0, {elong}*1.5e0)"
    lo = f"greatest(1e0, {R(f'{base}*0.5e0 + {off}*0.3e0', 1)})"
    hi = f"greatest({lo} + 3e0, {R(f'{base}*1.8e0 + {off}*1.2e0', 1)})"
    k = f"{area} > 0"
    return f"""CASE WHEN {k} THEN 'ESTIMATED_RANGE' ELSE 'AGE_UNAVAILABLE' END AS age_status, CASE WHEN {k} THEN {lo} ELSE 0e0 END AS min_hours, CASE WHEN {k} THEN {hi} ELSE 0e0 END AS max_hours,
 CASE WHEN NOT ({k}) THEN 'UNAVAILABLE' WHEN {multi} OR {elong} BETWEEN 3 AND 15 THEN 'MODERATE' ELSE 'LOW' END AS age_confidence,
 CASE WHEN {k} THEN CASE WHEN {elong} > 4 THEN 'SHEARED_TRAILING_SLICK' ELSE 'LOCALIZED_RADIAL_POOL' END END AS regime"""


@query(sql_views("spills") + f", w AS (SELECT *, CASE WHEN spill_id % 3 = 0 THEN NULL ELSE confidence*10 END AS wind FROM spills) SELECT spill_id, {_age_sql('elongation', 'area_km2', 'wind', 'status = {q}ACCEPTED{q}'.format(q=chr(39)))} FROM w")
def spill_age(v: Views) -> DataFrame:
    wind = F.when(F.col("spill_id") % 3 != 0, F.col("confidence") * 10)
    return v.spills.select("spill_id", physics.spill_age(F.col("area_km2"), F.col("elongation"), wind, F.col("status") == "ACCEPTED").alias("a")).select("spill_id", "a.*")
