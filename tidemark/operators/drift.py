"""Drift of a particle ensemble as running sums over time steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km, metres_to_dlat, metres_to_dlon
from tidemark.functions.physics import drift_velocity
from tidemark.functions.scalar import clamp, hash_uniform, hash_word_pair, lit_f, pair_uniform, rnd
from tidemark.operators.forcing import conditions_at
from tidemark.operators.hull import group_hulls
from tidemark.operators.ordering import group_quantile, number_rows
from tidemark.sources.scratch import cut_lineage


@dataclass(frozen=True)
class DriftConfig:
    hours: float = 12.0
    step_minutes: int = 15
    particles: int = 150
    backward: bool = True
    windage: float = 0.03
    deflection_deg: float = 10.0
    diffusivity_m2s: float = 2.5
    start_spread_m: float = 300.0
    noise: float = 1.0
    seed: int = 42
    partitions: int | None = None
    block: int = 500

    @property
    def steps(self) -> int:
        return int(self.hours * 60 / self.step_minutes)

    @property
    def sign(self) -> int:
        return -1 if self.backward else 1


def step_times(spills: DataFrame, cfg: DriftConfig) -> DataFrame:
    """One row per spill and step (0 = start), at the spill centre."""
    shift = F.col("step").cast("bigint") * F.lit(cfg.sign * cfg.step_minutes * 60_000_000)
    return (spills.select("spill_id", "lon", "lat", "detected_at",
                          F.explode(F.sequence(F.lit(0), F.lit(cfg.steps))).alias("step"))
            .withColumn("ts", F.timestamp_micros(F.unix_micros("detected_at") + shift)).drop("detected_at"))


def step_velocities(spills: DataFrame, forcing: DataFrame | None, cfg: DriftConfig) -> DataFrame:
    """Velocity (m/s, signed by direction of time) per spill and step; step 0 does not move."""
    rows = conditions_at(step_times(spills, cfg), forcing)
    u, v = drift_velocity(F.col("cond.wind_u"), F.col("cond.wind_v"), F.col("cond.current_u"),
                          F.col("cond.current_v"), cfg.windage, cfg.deflection_deg)
    moving = F.col("step") > 0
    return rows.select("spill_id", "lon", "lat", "step", "ts",
                       F.when(moving, u * cfg.sign).otherwise(lit_f(0)).alias("u"),
                       F.when(moving, v * cfg.sign).otherwise(lit_f(0)).alias("v"),
                       F.col("cond.is_demo").alias("is_demo"))


def particle_paths(velocities: DataFrame, cfg: DriftConfig) -> DataFrame:
    """Positions of every particle at every step.

    The short velocity table is hash-partitioned by spill and block of particles
    *before* it is multiplied by the particles; the windows below then need no shuffle
    of the large table, and a spill with many particles spreads over several tasks.  The
    number of partitions is stated, because adaptive coalescing would size them by the
    rows before the multiplication.  A spill's steps travel as one list, so that its rows come
    out in the order of the windows and sorting them moves none.
    """
    partitions = cfg.partitions or int(velocities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dt = cfg.step_minutes * 60.0
    sigma = math.sqrt(2.0 * cfg.diffusivity_m2s * dt) * cfg.noise
    last = F.least((F.col("_block") + 1) * cfg.block, F.lit(cfg.particles)) - 1
    rows = (velocities.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((cfg.particles - 1) // cfg.block))))
            .repartition(partitions, "spill_id", "_block")
            .groupBy("spill_id", "_block").agg(F.sort_array(F.collect_list(
                F.struct("step", "ts", "lon", "lat", "u", "v", F.concat(F.lit(":"), F.col("step").cast("string")).alias("_tail")))).alias("_steps"))
            .withColumn("particle_id", F.explode(F.sequence(F.col("_block") * cfg.block, last)))
            .withColumn("_lead", F.concat_ws(":", F.lit(str(cfg.seed)), F.col("spill_id").cast("string"), F.col("particle_id").cast("string")))
            .select("spill_id", "_block", "particle_id", "_lead", F.inline("_steps")))
    # One digest gives three uniforms: two for a pair of normals (Box-Muller), one for the start angle.
    rows = rows.withColumn("_h", F.md5(F.concat("_lead", "_tail"))).withColumn("_x", hash_word_pair(F.col("_h")))
    rows = rows.withColumns({f"_u{i}": pair_uniform(F.col("_x"), i) for i in range(2)})
    turn = lit_f(2 * math.pi)
    rows = rows.withColumn("_r", F.sqrt(lit_f(-2) * F.log("_u0"))).withColumns({
        "_n1": F.col("_r") * F.cos(turn * F.col("_u1")), "_n2": F.col("_r") * F.sin(turn * F.col("_u1"))})
    n1, n2, theta = F.col("_n1"), F.col("_n2"), turn * hash_uniform(F.col("_h"), 2)
    # Start offset: a normal radius at a uniform angle; afterwards independent noise per axis.
    spread, start = lit_f(cfg.start_spread_m * cfg.noise), F.col("step") == 0
    rows = rows.select(
        "spill_id", "_block", "particle_id", "step", "ts", "lon", "lat",
        F.when(start, spread * n1 * F.cos(theta)).otherwise(F.col("u") * dt + lit_f(sigma) * n1).alias("dx"),
        F.when(start, spread * n1 * F.sin(theta)).otherwise(F.col("v") * dt + lit_f(sigma) * n2).alias("dy"))
    w = Window.partitionBy("spill_id", "_block", "particle_id").orderBy("step")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    dlat = metres_to_dlat(F.col("dy"))
    # The latitude one step earlier is a sum up to there, so that one pass over the window gives both.
    moved = rows.withColumns({"p_lat": F.col("lat") + F.sum(dlat).over(run), "_was": F.lag("lat").over(w) + F.sum(dlat).over(before)})
    moved = moved.withColumn("_dlon", metres_to_dlon(F.col("dx"), F.coalesce("_was", "lat")))
    return moved.withColumn("p_lon", F.col("lon") + F.sum("_dlon").over(run)).select(
        "spill_id", "particle_id", "step", "ts", F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"))


def final_positions(paths: DataFrame, cfg: DriftConfig) -> DataFrame:
    return paths.filter(F.col("step") == cfg.steps)


def origin_summary(finals: DataFrame, backward: bool = True, key: str = "spill_id") -> DataFrame:
    """Mean end position and 90th percentile spread of each group of end positions (2..50 km).  Runs actions."""
    finals = cut_lineage(finals.select(key, "lat", "lon"))  # read three times, and costly where paths lead to them
    means = finals.groupBy(key).agg(F.count("*").alias("particle_count"), F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    spread = finals.join(means, key).withColumn("d", haversine_km(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon")))
    return (means.join(group_quantile(spread, [key], "d", 0.9), key)
            .select(key, "particle_count", rnd(F.col("m_lat"), 5).alias("origin_lat"), rnd(F.col("m_lon"), 5).alias("origin_lon"),
                    clamp(rnd(F.col("quantile"), 2), 2.0, 50.0).alias("uncertainty_km"))
            .withColumn("confidence", lit_f(0.82 if backward else 0.88)))


def origin_region(finals: DataFrame, key: str = "spill_id", size: int = 512) -> DataFrame:
    """Hull ring (closed from three corners on) and buffer (degrees) of each group of end positions."""
    n = F.size("hull")
    return group_hulls(finals, key, size).select(
        key, F.when(n >= 3, F.concat("hull", F.slice("hull", 1, 1))).otherwise(F.col("hull")).alias("ring"),
        F.when(n == 1, lit_f(0.04)).when(n == 2, lit_f(0.03)).otherwise(lit_f(0.02)).alias("buffer_deg"))


def stored_paths(particles: DataFrame, simulations: DataFrame) -> DataFrame:
    """Stored particles of all backward runs of each spill, as paths: ``step`` numbers a particle's places in time, from 0."""
    runs = simulations.filter("simulation_type = 'BACKWARD'").select("simulation_id", "spill_id")
    rows = particles.join(runs, "simulation_id")
    month = F.date_trunc("month", F.col("ts"))
    return number_rows(rows, ["spill_id", "particle_id"], month, [F.col("ts"), F.col("simulation_id")], out="step").withColumn("step", F.col("step") - 1)


def sampled_waypoints(paths: DataFrame, steps: int, first_particles: int = 35) -> DataFrame:
    """Report subset: the first particles, every n-th waypoint from the first (n = a sixth of a path of ``steps``)."""
    every = max(1, (steps + 1) // 6)
    return (paths.filter((F.col("particle_id") < first_particles) & (F.col("step") % every == 0))
            .select("spill_id", "particle_id", "ts", rnd(F.col("lon"), 5).alias("lon"), rnd(F.col("lat"), 5).alias("lat")))


def simulate(spills: DataFrame, forcing: DataFrame | None = None, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Particle paths of every spill from its detection time."""
    return particle_paths(step_velocities(spills, forcing, cfg), cfg)


def simulation_records(paths: DataFrame, spills: DataFrame, cfg: DriftConfig, created_at: Column) -> DataFrame:
    """One simulation row per spill: time span, summary and origin region."""
    finals = final_positions(paths, cfg)
    minutes = cfg.steps * cfg.step_minutes
    other = F.timestamp_micros(F.unix_micros("detected_at") + F.lit(cfg.sign * minutes * 60_000_000))
    first, last = (other, F.col("detected_at")) if cfg.backward else (F.col("detected_at"), other)
    return (spills.select("spill_id", first.alias("start_time"), last.alias("end_time"))
            .join(origin_summary(finals, cfg.backward), "spill_id").join(origin_region(finals), "spill_id")
            .withColumn("simulation_type", F.lit("BACKWARD" if cfg.backward else "FORWARD"))
            .withColumn("duration_hours", lit_f(cfg.hours)).withColumn("created_at", created_at))
