"""Mask quality against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, lit_f, rnd

EPS = 1e-7


def join_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pixels present in both; the key spreads one scene over many tasks."""
    return predicted.join(truth, ["scene_id", "row", "col"])


def confusion(pixels: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    p, t = F.col("value") >= threshold, F.col("truth") >= 0.5
    return pixels.groupBy(*keys).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))


def quality() -> dict[str, Column]:
    """Unrounded ratios from tp, fp, fn; a tiny constant keeps empty scenes defined."""
    tp, fp, fn, eps = F.col("tp"), F.col("fp"), F.col("fn"), lit_f(EPS)
    precision, recall = (tp + eps) / (tp + fp + eps), (tp + eps) / (tp + fn + eps)
    return {"iou": (tp + eps) / (tp + fp + fn + eps), "dice": (lit_f(2) * tp + eps) / (lit_f(2) * tp + fp + fn + eps),
            "precision": precision, "recall": recall, "f1": lit_f(2) * (precision * recall) / (precision + recall + eps)}


def scene_metrics(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    counts = confusion(pixels, ["scene_id"], threshold)
    return counts.select("scene_id", "tp", "fp", "tn", "fn", *[rnd(c, 4).alias(n) for n, c in quality().items()])


def overall_metrics(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same ratios over all pixels as one set."""
    return confusion(pixels, [], threshold).select("tp", "fp", "tn", "fn", *[rnd(c, 4).alias(n) for n, c in quality().items()])


def dataset_report(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Means over scenes and totals over pixels, in one row."""
    per_scene = scene_metrics(pixels, threshold)
    names = list(quality())
    sums = per_scene.agg(F.count("*").alias("total_samples"), *[rnd(F.avg(n), 4).alias(f"mean_{n}") for n in names],
                         *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return sums.withColumns({
        "pixel_accuracy": rnd((tp + tn) / F.greatest(tp + fp + tn + fn, F.lit(1)), 4),
        "specificity": rnd(tn / F.greatest(tn + fp, F.lit(1)), 4)})


def losses(pixels: DataFrame, keys: list[str], bce_weight: float = 0.5, dice_weight: float = 0.5) -> DataFrame:
    """Cross entropy (clipped), soft Dice and their weighted sum."""
    p, t = F.col("value"), F.col("truth").cast("double")
    c = clamp(p, EPS, 1 - EPS)
    sums = pixels.groupBy(*keys).agg(
        (-F.avg(t * F.log(c) + (lit_f(1) - t) * F.log(lit_f(1) - c))).alias("bce"),
        F.sum(p * t).alias("_pt"), F.sum(p).alias("_p"), F.sum(t).alias("_t"))
    dice = lit_f(1) - (lit_f(2) * F.col("_pt") + lit_f(EPS)) / (F.col("_p") + F.col("_t") + lit_f(EPS))
    return (sums.withColumn("dice_loss", dice)
            .withColumn("combined", lit_f(bce_weight) * F.col("bce") + lit_f(dice_weight) * F.col("dice_loss"))
            .drop("_pt", "_p", "_t"))
