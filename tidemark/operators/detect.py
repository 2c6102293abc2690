"""Slick probability, look-alike test and shape figures from normalised scenes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import pixel_area_km2, pixel_lat, pixel_lon, scene_size_km
from tidemark.functions.radar import circularity, compactness, contrast_probability, mask_at
from tidemark.functions.scalar import clamp, lit_f, rnd
from tidemark.operators.raster import along, attach_scene, box_line, gauss_line, gradient


@dataclass(frozen=True)
class LookalikeRules:
    low_wind: float = 2.5
    high_wind: float = 12.0
    edge_gradient: float = 0.08
    min_pixels: int = 25


def probability(normalised: DataFrame, value: str = "norm", axes: tuple[str, str] = ("row", "col")) -> DataFrame:
    """Contrast probability per pixel.

    The 7x7 Gaussian and the 31x31 mean are both separable and act on different axes
    independently, so each axis is visited once: two shuffles instead of four.
    """
    reach = 3 + 15

    def work(src: str, src_box: str | None, out: str, out_box: str):
        def run(df: DataFrame, w) -> DataFrame:
            df = gauss_line(df, w, {out: src} if src_box is None else {out: src, "_t": src_box})
            return box_line(df, w, 15, {out_box: out if src_box is None else "_t"})
        return run
    dark = normalised.withColumn("_dark", lit_f(1) - F.col(value))
    one = along(dark, axes[0], reach, work("_dark", None, "_g", "_gb"))
    two = along(one, axes[1], reach, work("_g", "_gb", "_smooth", "_local"))
    return (two.withColumn("prob", contrast_probability(F.col("_smooth") - F.col("_local")))
            .drop("_dark", "_g", "_gb", "_t", "_smooth", "_local"))


def lookalike(probabilities: DataFrame, wind: DataFrame, rules: LookalikeRules = LookalikeRules(),
              axes: tuple[str, str] = ("col", "row")) -> DataFrame:
    """Per scene: look-alike score, flags, penalty; ``wind`` gives scene_id, wind_mps."""
    g = gradient(probabilities, "prob", axes=axes)
    scenes = g.groupBy("scene_id").agg(F.count("*").alias("n"), F.avg("gradient").alias("mean_gradient"),
                                       (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    return score_lookalike(scenes.join(wind.select("scene_id", "wind_mps"), "scene_id", "left"), rules)


def score_lookalike(scenes: DataFrame, rules: LookalikeRules = LookalikeRules()) -> DataFrame:
    wind = F.col("wind_mps")
    low, high = wind < rules.low_wind, wind > rules.high_wind
    soft = (F.col("n") > rules.min_pixels) & (F.col("mean_gradient") < rules.edge_gradient)
    total = (F.when(low, lit_f(0.55)).when(high, lit_f(0.25)).otherwise(lit_f(0))
             + F.when(soft, lit_f(0.20)).otherwise(lit_f(0)))
    flags = F.array(F.when(low, "LOW_WIND_CALM_ZONE_SUSPECTED").when(high, "HIGH_WIND_DISPERSION_SUSPECTED"),
                    F.when(soft, "FEATHERED_BOUNDARY_NATURAL_FILM_CANDIDATE"))
    p = F.least(total, lit_f(0.95))
    return scenes.select(
        "scene_id", "h", "w", rnd(F.col("mean_gradient"), 6).alias("mean_gradient"),
        rnd(p, 3).alias("lookalike_probability"), (p < 0.5).alias("is_probable_spill"),
        rnd(p * lit_f(0.4), 3).alias("confidence_penalty"),
        F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


def apply_penalty(probabilities: DataFrame, verdicts: DataFrame, axis: str = "row") -> DataFrame:
    """Lower the probability of scenes that look like natural films."""
    full = attach_scene(probabilities, verdicts, ["is_probable_spill", "confidence_penalty"], axis)
    lowered = F.greatest(F.col("prob") - F.col("confidence_penalty"), lit_f(0))
    return (full.withColumn("prob", F.when(F.col("is_probable_spill"), F.col("prob")).otherwise(lowered))
            .drop("is_probable_spill", "confidence_penalty"))


def masks(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    return probabilities.withColumn("mask", mask_at(F.col("prob"), threshold))


def inference_summary(masked: DataFrame) -> DataFrame:
    """Per scene: spill pixels and mean probability inside the mask."""
    on = F.col("mask") == 1
    return masked.groupBy("scene_id").agg(F.count_if(on).alias("spill_pixel_count"),
                                          F.coalesce(F.avg(F.when(on, F.col("prob"))), lit_f(0)).alias("mean_spill_confidence"))


def component_figures(labelled: DataFrame, scenes: DataFrame, min_area_km2: float = 0.01) -> DataFrame:
    """Per component: pixels, area, probability, bounds and centroid.

    ``scenes`` gives scene_id, h, w and the geographic bounds.  All sums combine before
    the shuffle; the moments give the axes later without another pass.
    """
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    agg = labelled.groupBy("scene_id", "component").agg(
        F.count("*").alias("pixels"), F.avg("prob").alias("mean_prob"), F.min("col").alias("min_col"),
        F.max("col").alias("max_col"), F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy"))
    full = agg.join(scenes, "scene_id").withColumn("area_km2", F.col("pixels") * _pixel_area())
    return full.filter(F.col("area_km2") >= min_area_km2)


def _bounds() -> list[Column]:
    return [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]


def _pixel_area() -> Column:
    return pixel_area_km2(*_bounds(), F.col("w"), F.col("h"))


def _pixel_scale() -> Column:
    w_km, h_km = scene_size_km(*_bounds())
    return (w_km / F.col("w") + h_km / F.col("h")) / lit_f(2)


def boundary_km(labelled: DataFrame, scenes: DataFrame) -> DataFrame:
    """Outline length per component, in steps between pixels times the pixel scale.

    Each square of 2 x 2 pixels that the outline crosses adds a straight step or, where it
    cuts a corner, half a diagonal, so slanted edges are not measured along both sides.
    """
    # A pixel is one corner of four squares; the sum of the corners' bits tells the square's form.
    corners = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(1 << (2 * r + c)).alias("bit")) for r in (0, 1) for c in (0, 1)]))
    votes = labelled.select("scene_id", "component", "row", "col", corners.alias("s"))
    squares = votes.groupBy("scene_id", "component", (F.col("row") - F.col("s.dr")).alias("r"), (F.col("col") - F.col("s.dc")).alias("c")).agg(F.sum("s.bit").alias("form"))
    form = F.col("form")
    straight, corner, crossed = form.isin(3, 5, 10, 12), form.isin(1, 2, 4, 8, 7, 11, 13, 14), form.isin(6, 9)
    steps = squares.groupBy("scene_id", "component").agg(F.count_if(straight).alias("n"), (F.count_if(corner) + 2 * F.count_if(crossed)).alias("halves"))
    length = F.col("n") + F.col("halves") * lit_f(math.sqrt(0.5))
    return steps.join(scenes, "scene_id").select("scene_id", "component", (length * _pixel_scale()).alias("perimeter_km"))


def spill_figures(figures: DataFrame, outlines: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """Per scene: area of the whole mask, confidence, bounds, centroid, axes and shape class.

    ``mask_pixels`` gives scene_id and the number of mask pixels.  Axes come from the
    covariance of the largest component.
    """
    rows = figures.join(outlines, ["scene_id", "component"]).withColumn("px", _pixel_scale()).withColumn("px_area", _pixel_area())
    big = F.max_by(F.struct("vx", "vy", "cxy"), F.struct("pixels", -F.col("component")))
    agg = rows.groupBy("scene_id").agg(
        F.count("*").alias("components"), F.avg("mean_prob").alias("conf"), F.sum("perimeter_km").alias("perimeter_km"),
        F.min("min_col").alias("c0"), F.max("max_col").alias("c1"), F.min("min_row").alias("r0"), F.max("max_row").alias("r1"),
        (F.sum(F.col("cx") * F.col("pixels")) / F.sum("pixels")).alias("cx"),
        (F.sum(F.col("cy") * F.col("pixels")) / F.sum("pixels")).alias("cy"), big.alias("m"),
        *[F.first(c).alias(c) for c in ("h", "w", "min_lon", "min_lat", "max_lon", "max_lat", "px", "px_area")])
    half, diff = (F.col("m.vx") + F.col("m.vy")) / lit_f(2), (F.col("m.vx") - F.col("m.vy")) / lit_f(2)
    root = F.sqrt(diff * diff + F.col("m.cxy") * F.col("m.cxy"))
    major = lit_f(4) * F.sqrt(half + root) * F.col("px")
    minor = lit_f(4) * F.sqrt(F.greatest(half - root, lit_f(0))) * F.col("px")
    a, b, c, d = _bounds()
    full = (agg.join(mask_pixels, "scene_id").withColumn("area_km2", F.col("mask_pixels") * F.col("px_area"))
            .withColumn("major_axis_km", major).withColumn("minor_axis_km", minor)
            .withColumn("elongation", F.col("major_axis_km") / F.greatest("minor_axis_km", lit_f(1e-4))))
    return full.select(
        "scene_id", "components", rnd(clamp(F.col("conf"), 0.5, 0.99), 3).alias("confidence"),
        rnd(F.col("area_km2"), 3).alias("area_km2"), rnd(F.col("perimeter_km"), 3).alias("perimeter_km"),
        rnd(F.col("major_axis_km"), 3).alias("major_axis_km"), rnd(F.col("minor_axis_km"), 3).alias("minor_axis_km"),
        rnd(F.degrees(F.atan2(lit_f(2) * F.col("m.cxy"), F.col("m.vx") - F.col("m.vy")) / lit_f(2)), 1).alias("orientation_deg"),
        rnd(circularity(F.col("area_km2"), F.col("perimeter_km")), 3).alias("circularity"),
        rnd(F.col("elongation"), 2).alias("elongation_ratio"), compactness(F.col("elongation")).alias("compactness"),
        rnd(pixel_lon(F.col("cx"), F.col("w"), a, c), 5).alias("lon"), rnd(pixel_lat(F.col("cy"), F.col("h"), b, d), 5).alias("lat"),
        pixel_lon(F.col("c0"), F.col("w"), a, c).alias("box_min_lon"), pixel_lat(F.col("r1"), F.col("h"), b, d).alias("box_min_lat"),
        pixel_lon(F.col("c1"), F.col("w"), a, c).alias("box_max_lon"), pixel_lat(F.col("r0"), F.col("h"), b, d).alias("box_max_lat"))
