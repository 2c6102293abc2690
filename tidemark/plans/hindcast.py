"""Backward run, origin region and ranked ships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import attribution, drift
from tidemark.sources.positions import read_candidates, replace_candidates


def hindcast(spills: DataFrame, forcing: DataFrame | None, cfg: drift.DriftConfig = drift.DriftConfig()) -> DataFrame:
    """Simulation records of all spills."""
    paths = drift.simulate(spills, forcing, cfg)
    return drift.simulation_records(paths, spills, cfg, F.current_timestamp()).withColumn("simulation_id", F.col("spill_id"))


def rank_ships(spills: DataFrame, simulations: DataFrame, positions: DataFrame, store: str,
               rules: attribution.ScoreRules = attribution.ScoreRules()) -> DataFrame:
    """Score ships with spatial evidence, replace their spills' stored candidates, and rank these from the store.

    Ranking reads its input twice (counts per score, then rows), so it starts from the
    stored table and not from the scoring plan.
    """
    origins = attribution.spill_origins(spills, simulations)
    replace_candidates(attribution.score_near(positions, origins, rules), spills, store)
    asked = spills.select(F.col("spill_id").cast("bigint").alias("spill_id")).distinct()
    return attribution.rank_candidates(read_candidates(positions.sparkSession, store).join(asked, "spill_id", "left_semi"))
