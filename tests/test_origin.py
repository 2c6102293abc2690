import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import geo, scalar
from tidemark.operators import attribution, drift, forcing, hull, ordering, top_ships
from tidemark.plans.hindcast import hindcast, rank_ships

T0 = datetime(2026, 9, 14, 4)
POS = "position_id bigint, vessel_id bigint, ts timestamp, lon double, lat double, speed double, course double"


def ring(x0, y0, x1, y1):
    return [Row(lon=a, lat=b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def positions(spark, tracks):
    rows, i = [], 0
    for v, pts in tracks.items():
        for lon, lat, hours, speed, course in pts:
            rows.append((i, v, T0 + timedelta(hours=hours), round(lon, 4), round(lat, 4), speed, course))
            i += 1
    return spark.createDataFrame(rows, POS)


def spill(lat, lon, area=None):
    return Row(spill_id=1, centre_lat=lat, centre_lon=lon, origin_time=T0, origin_ring=area, origin_buffer=None)


def test_tanker_golden(spark):
    p = positions(spark, {99: [(72.78, 18.88, -1, 13.5, 150.0), (72.80, 18.90, 0, 13.0, 150.0), (72.82, 18.92, 1, 13.2, 150.0)]})
    r = attribution.score_spill(p, spill(18.90, 72.80, ring(72.75, 18.85, 72.85, 18.95))).first()
    assert (r.spatial_score, r.temporal_score, r.trajectory_score, r.behaviour_score, r.data_quality_score) == (98, 100, 92, 50, 92)
    assert (r.overall_score, r.priority) == (92.3, "HIGH")
    assert len(r.explanation.explanation_points) == 4 and len(r.explanation.evidence_breakdown) == 5
    assert r.explanation.evidence_breakdown[0].label == "Spatial Proximity (35%)"


OX, OY, SX, SY = 72.25, 18.75, 72.48, 18.96
# Way points of five ships about the spill and its origin.
DEMO = {
    1: [(OX - .25, OY - .20, -2.5, 14.2, 50.0), (OX - .10, OY - .08, -1, 14.0, 50.0), (OX + .01, OY + .01, 0, 7.8, 55.0),
        (OX + .12, OY + .10, 1.5, 13.5, 52.0), (OX + .30, OY + .25, 3.5, 14.1, 50.0)],
    2: [(OX - .20, OY + .12, -1, 12.5, 65.0), (OX, OY + .11, 1, 12.4, 65.0), (OX + .20, OY + .10, 3, 12.3, 65.0)],
    3: [(SX - .05, SY - .35, 0, 4.2, 10.0), (SX - .02, SY - .20, 4, 4.5, 15.0), (SX + .02, SY + .02, 8, 3.8, 20.0)],
    4: [(OX - .30, OY - .25, 10, 19.5, 45.0), (OX, OY, 11.5, 19.2, 45.0), (OX + .30, OY + .25, 13, 19.0, 45.0)],
    5: [(OX - .15, OY - .12, -2, 13.0, 52.0), (OX + .18, OY + .14, 1.5, 12.8, 52.0)],
}


@pytest.mark.parametrize("area,want", [
    (None, {1: 92.6, 2: 76.2, 3: 57.4, 4: 62.5, 5: 69.4}),
    (ring(71.0, 18.0, 74.0, 20.0), {1: 94.7, 2: 88.2, 3: 84.7, 4: 63.6, 5: 85.7})])
def test_demo_goldens(spark, area, want):
    p = positions(spark, DEMO)
    one = {r.vessel_id: r.overall_score for r in attribution.score_spill(p, spill(OY, OX, area)).collect()}
    assert one == pytest.approx(want)
    origins = spark.createDataFrame([(1, OY, OX, T0, area, None)], "spill_id bigint, centre_lat double, centre_lon double, origin_time timestamp, "
                                    "origin_ring array<struct<lon:double,lat:double>>, origin_buffer double")
    many = {r.vessel_id: r.overall_score for r in attribution.score_near(p, origins).collect()}
    assert many == pytest.approx(one)  # all five come within 50 km


def test_ties_take_the_earliest_report(spark):
    p = positions(spark, {1: [(72.9, 18.9, 5, 9.0, 10.0), (72.9, 18.9, 2, 9.0, 20.0)]})
    assert attribution.score_spill(p, spill(18.9, 72.8)).first().temporal_score == pytest.approx(83.3)


def test_null_speed_and_course(spark):
    p = positions(spark, {1: [(72.9, 18.9, 0, None, None)]})
    e = attribution.score_spill(p, spill(18.9, 72.8)).first().explanation
    assert e.speed_knots == 12.0 and not e.anomalous_behavior_flag and not e.ais_gap_detected


def test_origins_fall_back(spark):
    spills = spark.createDataFrame([(1, None, None, T0, ring(0., 0., 1., 1.)), (2, 70.0, 10.0, T0, ring(0., 0., 1., 1.))],
                                   "spill_id bigint, lon double, lat double, detected_at timestamp, ring array<struct<lon:double,lat:double>>")
    sims = spark.createDataFrame([(9, 2, "BACKWARD", T0 - timedelta(hours=12), T0, ring(5., 5., 6., 6.), 0.02), (10, 2, "FORWARD", T0, T0 + timedelta(1), None, None)],
                                 "simulation_id bigint, spill_id bigint, simulation_type string, start_time timestamp, created_at timestamp, ring array<struct<lon:double,lat:double>>, buffer_deg double")
    a, b = attribution.spill_origins(spills, sims).orderBy("spill_id").collect()
    assert (a.centre_lat, a.centre_lon, a.origin_time, a.has_hindcast) == (19.0, 72.5, T0 - timedelta(hours=6), False)
    assert (b.origin_time, b.origin_ring[0].lon, b.has_hindcast) == (T0 - timedelta(hours=12), 5.0, True)


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def test_region_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(0, 0.1, (200, 2)) + [72, 19]
    finals = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "spill_id bigint, particle_id int, lon double, lat double")
    whole, cut = (drift.origin_region(finals, size=n).first() for n in (10_000, 20))
    assert whole == cut and whole.buffer_deg == 0.02
    hull = [(p.lon, p.lat) for p in whole.ring]
    assert hull[0] == hull[-1]
    for a, b in zip(hull, hull[1:]):
        assert min(cross(a, b, p) for p in pts) > -1e-12
    probes = rng.normal(0, 0.2, (400, 2)) + [72, 19]
    edges = list(zip(hull, hull[1:]))

    def truth(p):
        if all(cross(a, b, p) > 0 for a, b in edges):
            return True
        best = 9.0
        for (ax, ay), (bx, by) in edges:
            t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, np.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))
        return best < 0.02
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(probes)], "id int, x double, y double")
    region = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in hull])
    got = {r.id: r.v for r in df.select("id", geo.inside_region(F.col("x"), F.col("y"), region, F.lit(0.02)).alias("v")).collect()}
    assert got == {i: truth(p) for i, p in enumerate(probes)}


def test_small_hulls_and_boundary(spark):
    finals = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 1.0, 1.0), (2, 0, 1.0, 1.0), (2, 1, 2.0, 2.0), (2, 2, 1.5, 1.5)], "spill_id bigint, particle_id int, lon double, lat double")
    a, b = drift.origin_region(finals).orderBy("spill_id").collect()
    assert (len(a.ring), a.buffer_deg, len(b.ring), b.buffer_deg) == (1, 0.04, 2, 0.03)
    sq = F.array(*[F.struct(F.lit(p.lon).alias("lon"), F.lit(p.lat).alias("lat")) for p in ring(0., 0., 1., 1.)])
    for x, y, want in ((0.5, 0.5, True), (0.0, 0.5, False), (1.0, 0.5, False), (0.5, 1.0, False), (0.5, 0.0, False), (2.0, 0.5, False)):
        assert spark.range(1).select(geo.inside_ring(F.lit(x), F.lit(y), sq).alias("v")).first().v is want


def spills(spark, n=1):
    return spark.createDataFrame([(i, 72.5, 19.0, T0) for i in range(n)], "spill_id bigint, lon double, lat double, detected_at timestamp")


def test_calm_path_equals_step_loop(spark):
    cfg = drift.DriftConfig(noise=0.0, particles=1)
    vel = drift.step_velocities(spills(spark), None, cfg).orderBy("step").collect()
    got = drift.particle_paths(drift.step_velocities(spills(spark), None, cfg), cfg).orderBy("step").collect()
    lon, lat = 72.5, 19.0
    for v, g in zip(vel, got):
        lon, lat = lon + v.u * 900 / (111320 * max(abs(np.cos(np.radians(lat))), .1)), lat + v.v * 900 / 110574
        assert (g.lon, g.lat) == pytest.approx((lon, lat), abs=1e-12)
    assert len(got) == 49


def test_noise_spread_and_repeatability(spark):
    cfg = drift.DriftConfig(particles=1500)
    f = drift.final_positions(drift.simulate(spills(spark), None, cfg), cfg)
    pdf = f.toPandas()
    metres = pdf["lat"].std() * 110574
    want = np.sqrt(2 * 2.5 * 900 * 48 + 300 ** 2 / 2)
    assert abs(metres / want - 1) < 0.08
    again = drift.final_positions(drift.simulate(spills(spark).repartition(3), None, cfg), cfg).toPandas()
    assert pdf.sort_values("particle_id").reset_index(drop=True).equals(again.sort_values("particle_id").reset_index(drop=True))


def test_noisy_path_equals_step_loop(spark):
    """Two blocks of particles and a spill without a number, against plain Python."""
    cfg = drift.DriftConfig(hours=2.0, particles=5, block=3)
    two = spills(spark, 2).select(F.when(F.col("spill_id") > 0, F.col("spill_id")).alias("spill_id"), "lon", "lat", "detected_at")
    vel = {(r.spill_id, r.step): r for r in drift.step_velocities(two, None, cfg).collect()}
    got = {(r.spill_id, r.particle_id, r.step): r for r in drift.simulate(two, None, cfg).collect()}
    assert len(got) == 2 * 5 * 9
    sigma = np.sqrt(2 * 2.5 * 900)
    for spill_id in (None, 1):
        for particle in range(5):
            lon, lat = 72.5, 19.0
            for step in range(9):
                text = ":".join(str(x) for x in (42, spill_id, particle, step) if x is not None)
                h = hashlib.md5(text.encode()).hexdigest()
                u0, u1, u2 = ((int(h[8 * i:8 * i + 8], 16) + 0.5) / 2 ** 32 for i in range(3))
                n1, n2 = (np.sqrt(-2 * np.log(u0)) * f(2 * np.pi * u1) for f in (np.cos, np.sin))
                v = vel[spill_id, step]
                dx, dy = (300 * n1 * np.cos(2 * np.pi * u2), 300 * n1 * np.sin(2 * np.pi * u2)) if step == 0 else (v.u * 900 + sigma * n1, v.v * 900 + sigma * n2)
                lon, lat = lon + dx / (111320 * max(abs(np.cos(np.radians(lat))), .1)), lat + dy / 110574
                g = got[spill_id, particle, step]
                assert (g.lon, g.lat) == pytest.approx((lon, lat), abs=1e-9) and g.ts == v.ts


def test_paths_take_two_windows_and_one_conversion_a_step(spark):
    cfg = drift.DriftConfig()
    plan = drift.particle_paths(drift.step_velocities(spills(spark), None, cfg), cfg)._jdf.queryExecution().executedPlan().toString()
    lines = [x.split("(")[0] for x in plan.split("Initial Plan")[-1].splitlines()]
    assert sum(x.strip(" +-:*").startswith("Window") for x in lines) == 2
    assert plan.count("conv(") == 3  # of both words at each step, and of the angle at the start, in x and in y


def test_word_pairs_give_the_same_numbers(spark):
    digests = ["0" * 32, "f" * 32, "7fffffff80000000" * 2, "80000000ffffffff" * 2, hashlib.md5(b"42:1:2:3").hexdigest()]
    rows = spark.createDataFrame([(d,) for d in digests], "d string")
    pair = scalar.hash_word_pair(F.col("d"))
    for r in rows.select(*[scalar.hash_uniform(F.col("d"), i).alias(f"a{i}") for i in range(2)], *[scalar.pair_uniform(pair, i).alias(f"b{i}") for i in range(2)]).collect():
        assert (r.a0, r.a1) == (r.b0, r.b1) and 0 < r.b0 < 1


def test_hour_fallback(spark):
    pts = spark.createDataFrame([(1, 19.0, 72.5, T0), (2, 19.0, 72.5, T0 + timedelta(hours=9)), (3, 10.0, 70.0, T0)], "id int, lat double, lon double, ts timestamp")
    series = spark.createDataFrame([(19.0, 72.5, T0 - timedelta(hours=1), 36.0, 90.0, None, None), (19.0, 72.5, T0, 18.0, 0.0, 3.6, 180.0)],
                                   "cell_lat double, cell_lon double, hour timestamp, wind_kmh double, wind_dir double, current_kmh double, current_dir double")
    a, b, c = forcing.conditions_at(pts, series).orderBy("id").collect()
    assert (a.hour_matched, a.cond.wind_v, a.cond.current_v, a.cond.is_demo) == (True, -5.0, -1.0, False)
    assert (b.hour_matched, b.cond.wind_u, b.cond.current_speed_mps, b.cond.current_dir_deg) == (False, -10.0, 0.1, 140.0)
    assert c.cond.is_demo and c.cond.current_speed_mps == 0.42


def test_source_cells_that_share_a_key(spark):
    rows = [(18.001, 72.5, T0, 36.0, 0.0, 1.0, 0.0), (18.004, 72.5, T0, 18.0, 0.0, 1.0, 0.0), (18.004, 72.5, T0 + timedelta(hours=1), 9.0, 0.0, 1.0, 0.0)]
    series = spark.createDataFrame(rows, "cell_lat double, cell_lon double, hour timestamp, wind_kmh double, wind_dir double, current_kmh double, current_dir double")
    pts = spark.createDataFrame([(1, 18.0, 72.5, T0), (2, 18.0, 72.5, T0 + timedelta(hours=1))], "id bigint, lat double, lon double, ts timestamp")
    got = [(r.id, r.wind_kmh) for r in forcing.lookup(pts, series).orderBy("id").collect()]
    assert got == [(1, 36.0), (2, 9.0)]


def test_hindcast_to_ranking(spark, tmp_path):
    s = spills(spark).withColumn("ring", F.lit(None).cast(attribution.RING_TYPE))
    sims = hindcast(s, None)
    r = sims.first()
    assert (r.start_time, r.end_time, r.simulation_type, r.particle_count) == (T0 - timedelta(hours=12), T0, "BACKWARD", 150)
    p = positions(spark, DEMO)
    ranked = rank_ships(s, sims, p, str(tmp_path / "c")).orderBy("rank").collect()
    assert [x.rank for x in ranked] == list(range(1, len(ranked) + 1))
    assert [x.overall_score for x in ranked] == sorted((x.overall_score for x in ranked), reverse=True)
    # A run without any ship near clears what the run before has stored.
    far = positions(spark, {7: [(10.0, 50.0, 0, 12.0, 0.0)]})
    assert rank_ships(s, sims, far, str(tmp_path / "c")).count() == 0


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(0, 1, 3000), 2: np.full(500, 7.0), 3: np.array([4.0]), 4: np.array([1.0, 2.0]),
              5: np.concatenate([np.zeros(900), 10.0 ** rng.uniform(-12, 9, 300)]), 6: np.repeat(rng.uniform(size=9), 60)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    for q in (0.0, 0.37, 0.9, 1.0):
        for settle, cells in ((4096, 256), (20, 4)):
            got = {r.k: r.quantile for r in ordering.group_quantile(df, ["k"], "v", q, settle=settle, cells=cells).collect()}
            assert got == {k: pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12) for k, v in groups.items()}


def test_hulls_of_circles_and_lines(spark):
    """All points are corners; all lie on a line; coordinates repeat."""
    turn = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    rows = [(1, float(np.cos(t)), float(np.sin(t))) for t in turn] + [(2, float(i % 50), float(i % 50)) for i in range(400)]
    rows += [(3, float(i % 7), float(i // 7)) for i in range(49)] * 2 + [(4, None, 1.0)]
    got = {r.k: [tuple(p) for p in r.hull] for r in hull.group_hulls(spark.createDataFrame(rows, "k int, lon double, lat double"), "k", size=10).collect()}
    assert len(got[1]) == 300 and got[2] == [(0.0, 0.0), (49.0, 49.0)] and got[3] == [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)] and 4 not in got


@pytest.mark.parametrize("first", [1, 3, 50])
def test_top_ships_equal_the_full_comparison(spark, first):
    """Spills among ships, in empty waters, and before any ship; boxes over the date line."""
    rng = np.random.default_rng(first)
    tracks = {}
    for v in range(40):
        lon, lat, start = rng.uniform(70, 75), rng.uniform(15, 22), rng.uniform(-30, 30)
        tracks[v] = [(lon + rng.normal(0, .3), lat + rng.normal(0, .3), start + 5 * k + rng.uniform(0, 4), float(rng.choice([2.0, 9.0, 14.0])), float(rng.uniform(0, 360)))
                     for k in range(rng.integers(1, 9))]
    tracks[90] = [(179.9, 0.0, 0, 9.0, 10.0), (-179.9, 0.1, 3, 9.0, 10.0)]
    p = positions(spark, tracks)
    spills_ = [(1, 18.0, 72.0, T0), (2, 40.0, -30.0, T0), (3, 19.0, 73.0, T0 - timedelta(days=900)), (4, 0.05, -179.5, T0), (5, 20.0, 74.0, T0 + timedelta(hours=20))]
    origins = spark.createDataFrame([(*s, ring(s[2] - .2, s[1] - .2, s[2] + .2, s[1] + .2) if s[0] == 1 else None, None) for s in spills_],
                                    f"spill_id bigint, centre_lat double, centre_lon double, origin_time timestamp, origin_ring {attribution.RING_TYPE}, origin_buffer double")
    got = top_ships.top_ships(p, origins, first=first)
    for o in origins.collect():
        want = sorted((-r.overall_score, r.vessel_id) for r in attribution.score_spill(p, o).collect())[:first]
        mine = sorted((r["rank"], -r.overall_score, r.vessel_id) for r in got.filter(F.col("spill_id") == o.spill_id).collect())
        assert [m[1:] for m in mine] == want and [m[0] for m in mine] == list(range(1, len(want) + 1))
