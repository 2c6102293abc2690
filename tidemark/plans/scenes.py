"""From calibrated pixels to slick figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.physics import spill_age
from tidemark.functions.scalar import lit_f
from tidemark.operators import components, detect, raster
from tidemark.sources.scratch import cut_lineage


def masked_scenes(pixels: DataFrame, scenes: DataFrame, wind: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pixels with probability and mask; ``scenes`` gives scene_id and ext, ``wind`` scene_id and wind_mps."""
    prob = detect.probability(raster.preprocess(pixels, scenes))
    # Probability feeds the look-alike test and the mask: computed once, then read twice.
    prob = cut_lineage(prob.select("scene_id", "row", "col", "prob"))
    return detect.masks(detect.apply_penalty(prob, detect.lookalike(prob, wind)), threshold)


def slick_figures(masked: DataFrame, bounds: DataFrame, min_area_km2: float = 0.01) -> DataFrame:
    """Shape, confidence and age range per scene; ``bounds`` gives scene_id, h, w and the geographic box.

    Shapes come from the mask without speckle, the total area from the whole mask.
    """
    labelled = cut_lineage(components.components(components.opened(masked, bounds)))
    figures = detect.component_figures(labelled, bounds, min_area_km2)
    area = masked.groupBy("scene_id").agg(F.count_if(F.col("mask") == 1).alias("mask_pixels"))
    spills = detect.spill_figures(figures, detect.boundary_km(labelled, bounds), area)
    age = spill_age(F.col("area_km2"), F.col("elongation_ratio"), F.lit(None).cast("double"), F.lit(False))
    return spills.withColumn("age", age).select("*", "age.*").drop("age")
