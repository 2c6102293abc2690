"""Scenes as pixel tables (scene_id, row, col, value): statistics, filters, tiles.

Neighbourhood work runs along one axis at a time, partitioned by (scene, row) or
(scene, col): a large scene spreads over as many tasks as it has lines.  The order of
the two passes is free for separable filters, so chained filters alternate axes and
reuse the partitioning the previous one left behind.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.radar import hann2d, normalise_db, sigma0_db
from tidemark.functions.scalar import clamp, lit_f

AXES = ("col", "row")


def other(axis: str) -> str:
    return "row" if axis == "col" else "col"


def scene_stats(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Size, range, mean and variance per scene."""
    v = F.col(value)
    return pixels.groupBy("scene_id").agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count("*").alias("n"),
        F.min(v).alias("min_val"), F.max(v).alias("max_val"), F.avg(v).alias("mean_val"), F.var_pop(v).alias("variance"))


def attach_scene(pixels: DataFrame, stats: DataFrame, columns: Sequence[str], axis: str = "row") -> DataFrame:
    """Bring per-scene figures to the pixels.

    ``stats`` (with h and w) is listed once per line, so the join key is (scene, line):
    it matches the partitioning of the line windows and has no hot scene.
    """
    size = "h" if axis == "row" else "w"
    per_line = stats.select("scene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1)).alias(axis), *columns)
    return pixels.join(per_line, ["scene_id", axis])


def _line(axis: str) -> Window:
    return Window.partitionBy("scene_id", other(axis))


def along(pixels: DataFrame, axis: str, reach: int, work: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """Run ``work`` on lines extended by mirrored pixels (the edge pixel is not repeated)."""
    i, n = F.col(axis), F.col("_n")
    period = F.greatest(n * 2 - 2, F.lit(1).cast("bigint"))
    turns = F.ceil(lit_f(reach) / period).cast("bigint") + 1
    copies = F.array_distinct(F.flatten(F.transform(
        F.sequence(-turns, turns), lambda t: F.array(i + period * t, -i + period * t))))
    copies = F.filter(copies, lambda p: (p >= -reach) & (p <= n - 1 + reach))
    # Only pixels near an end have mirror images; all others pass through as themselves.
    places = F.when((i <= reach) | (i >= n - 1 - reach), copies).otherwise(F.array(i))
    padded = (pixels.withColumn("_n", (F.max(axis).over(_line(axis)) + 1).cast("bigint"))
              .withColumn("_at", F.explode(places)))
    done = work(padded, _line(axis).orderBy("_at"))
    return done.filter(F.col("_at") == i).drop("_at", "_n")


def box_line(df: DataFrame, w: Window, half: int, columns: dict[str, str]) -> DataFrame:
    frame = w.rowsBetween(-half, half)
    return df.withColumns({out: F.avg(src).over(frame) for out, src in columns.items()})


def gauss_weights(size: int = 7, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def gauss_line(df: DataFrame, w: Window, columns: dict[str, str], size: int = 7, sigma: float = 1.5) -> DataFrame:
    half, weights = size // 2, gauss_weights(size, sigma)

    def blur(src: str) -> Column:
        total = lit_f(weights[half]) * F.col(src)
        for k in range(1, half + 1):
            total = total + lit_f(weights[half + k]) * (F.lag(src, k).over(w) + F.lead(src, k).over(w))
        return total
    return df.withColumns({out: blur(src) for out, src in columns.items()})


def box_mean(pixels: DataFrame, size: int, value: str = "value", out: str = "mean", axes: Sequence[str] = AXES) -> DataFrame:
    """size x size mean with mirrored borders, as two line passes."""
    half = size // 2
    first = along(pixels, axes[0], half, lambda d, w: box_line(d, w, half, {"_b": value}))
    return along(first, axes[1], half, lambda d, w: box_line(d, w, half, {out: "_b"})).drop("_b")


def gaussian(pixels: DataFrame, value: str = "value", out: str = "smooth", size: int = 7, sigma: float = 1.5,
             axes: Sequence[str] = AXES) -> DataFrame:
    half = size // 2
    first = along(pixels, axes[0], half, lambda d, w: gauss_line(d, w, {"_g": value}, size, sigma))
    return along(first, axes[1], half, lambda d, w: gauss_line(d, w, {out: "_g"}, size, sigma)).drop("_g")


def lee(pixels: DataFrame, size: int = 5, damping: float = 1.0, value: str = "value", out: str = "despeckled",
        stats: DataFrame | None = None, axes: Sequence[str] = AXES) -> DataFrame:
    """Adaptive speckle filter: local mean plus a variance-weighted share of the difference.

    ``stats`` may bring the scene variance from an earlier pass.
    """
    half = size // 2
    squares = pixels.withColumn("_q", F.col(value) * F.col(value))
    one = along(squares, axes[0], half, lambda d, w: box_line(d, w, half, {"_m1": value, "_s1": "_q"}))
    two = along(one, axes[1], half, lambda d, w: box_line(d, w, half, {"_m": "_m1", "_s": "_s1"}))
    noise = (scene_stats(pixels, value) if stats is None else stats).select("scene_id", "h", "w", F.col("variance").alias("_noise"))
    full = attach_scene(two, noise, ["_noise"], axis=other(axes[1]))
    var = F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), lit_f(1e-6))
    weight = clamp(var / (var + F.col("_noise") * lit_f(damping) + lit_f(1e-6)), 0, 1)
    return (full.withColumn(out, F.col("_m") + weight * (F.col(value) - F.col("_m")))
            .drop("_q", "_m1", "_s1", "_m", "_s", "_noise"))


def gradient(pixels: DataFrame, value: str = "value", out: str = "gradient", axes: Sequence[str] = AXES) -> DataFrame:
    """Gradient magnitude: central differences, one-sided at the edges."""
    def slope(df: DataFrame, axis: str, name: str) -> DataFrame:
        w = _line(axis).orderBy(axis)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        d = (F.when(before.isNull(), after - here).when(after.isNull(), here - before)
             .otherwise((after - before) / lit_f(2)))
        return df.withColumn(name, F.coalesce(d, lit_f(0)))
    both = slope(slope(pixels, axes[0], "_d0"), axes[1], "_d1")
    return both.withColumn(out, F.sqrt(F.col("_d0") * F.col("_d0") + F.col("_d1") * F.col("_d1"))).drop("_d0", "_d1")


# --- calibration -------------------------------------------------------------

EIGHT_BIT = (".png", ".jpg", ".jpeg", ".webp")


# The names of the routes.
PREVIEW, NORMALISED, CALIBRATED, RAW = "8BIT_VISUAL_PROXY", "PRE_CALIBRATED_NUMPY", "RADIOMETRIC_SIGMA0_DB", "RAW_DN"


def calibration_route(ext: Column, max_val: Column, calibrate: bool = True) -> Column:
    return (F.when(ext.isin(*EIGHT_BIT), PREVIEW).when((max_val <= 1) & (ext == ".npy"), NORMALISED)
            .otherwise(CALIBRATED if calibrate else RAW))


def preprocess(pixels: DataFrame, scenes: DataFrame, despeckle: bool = True, calibrate: bool = True) -> DataFrame:
    """Normalised [0,1] pixels per scene by its route; ``scenes`` gives scene_id, ext.

    8-bit previews: scaled, 3x3 Lee; pre-normalised arrays: unchanged; others: dB (without
    ``calibrate`` their values as they are), 5x5 Lee, clipped range.  One column "x" carries the value that the filter has to see, so
    each route is one filter over its own scenes.
    """
    routes = scene_stats(pixels).join(scenes.select("scene_id", "ext"), "scene_id").select(
        "scene_id", "h", "w", calibration_route(F.col("ext"), F.col("max_val"), calibrate).alias("calibration_method"))
    tagged = attach_scene(pixels, routes, ["calibration_method"])
    route = F.col("calibration_method")
    ready = tagged.filter(route == NORMALISED).withColumn("norm", F.col("value"))
    eight = tagged.filter(route == PREVIEW).withColumn("x", F.col("value") / lit_f(255))
    db = tagged.filter(route.isin(CALIBRATED, RAW)).withColumn("x", sigma0_db(F.col("value")) if calibrate else F.col("value"))
    if despeckle:
        eight, db = lee(eight, 3, value="x", out="x2"), lee(db, 5, value="x", out="x2")
    else:
        eight, db = eight.withColumn("x2", F.col("x")), db.withColumn("x2", F.col("x"))
    eight = eight.withColumn("norm", clamp(F.col("x2"), 0, 1)).drop("x", "x2")
    db = db.withColumn("norm", normalise_db(F.col("x2"))).drop("x", "x2")
    return ready.unionByName(eight).unionByName(db)


def value_kind(pixels: DataFrame) -> DataFrame:
    """Per scene: DB, NORMALISED or DN.

    The sign of the median comes from counts: it is below zero when more than half of
    the values are, and with exactly half it is the middle of the two inner values.
    """
    v = F.col("value")
    s = pixels.groupBy("scene_id").agg(
        F.count("*").alias("n"), F.count_if(v < 0).alias("neg"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.max(F.when(v < 0, v)).alias("top_neg"), F.min(F.when(v >= 0, v)).alias("low_pos"))
    below = (F.col("neg") * 2 > F.col("n")) | ((F.col("neg") * 2 == F.col("n")) & (F.col("top_neg") + F.col("low_pos") < 0))
    return s.select("scene_id", F.when(below | ((F.col("lo") < -5) & (F.col("hi") <= 10)), "DB")
                    .when((F.col("lo") >= 0) & (F.col("hi") <= 1), "NORMALISED").otherwise("DN").alias("value_kind"))


def binarise_masks(masks: DataFrame, spill_class: int = 1) -> DataFrame:
    """Masks to 0/255 by what values the scene holds: 0/1, 0/255, or a class id."""
    v = F.col("value")
    kinds = masks.groupBy("scene_id").agg(
        F.bool_and(v.isin(0.0, 1.0)).alias("is01"), F.bool_and(v.isin(0.0, 255.0)).alias("is255"),
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    full = attach_scene(masks, kinds, ["is01", "is255"])
    near_class = F.abs(v - spill_class) <= lit_f(1e-8 + 1e-5 * abs(spill_class))
    on = F.when(F.col("is01"), v > 0.5).when(F.col("is255"), v >= 128).otherwise(near_class)
    return full.withColumn("mask", F.when(on, 255).otherwise(0)).drop("is01", "is255")


def scan(pixels: DataFrame) -> DataFrame:
    """Per scene: shape, NaN / Inf present, values all in {0, 1, 255}."""
    v = F.col("value")
    return pixels.groupBy("scene_id").agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.bool_or(F.isnan(v)).alias("has_nan"),
        F.bool_or(F.abs(v) == float("inf")).alias("has_inf"), F.bool_and(v.isin(0.0, 1.0, 255.0)).alias("is_binary"))


# --- tiles -------------------------------------------------------------------

def _origins(pos: Column, tile: int, stride: int, last: Column | None) -> Column:
    """Multiples of the stride whose tile covers ``pos``, up to ``last`` if given."""
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor((pos - tile) / F.lit(stride)) + 1)
    hi = F.floor(pos / F.lit(stride))
    if last is not None:
        hi = F.least(hi, F.floor(last / F.lit(stride)))
    ids = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(ids, lambda k: k * stride)


def tile_pixels(pixels: DataFrame, tile: int = 256, stride: int = 256) -> DataFrame:
    """Each pixel in every tile that covers it; edge tiles keep their true extent."""
    return (pixels.withColumn("r0", F.explode(_origins(F.col("row"), tile, stride, None)))
            .withColumn("c0", F.explode(_origins(F.col("col"), tile, stride, None))))


def full_tile_pixels(pixels: DataFrame, dims: DataFrame, tile: int = 256, stride: int = 256) -> DataFrame:
    """As :func:`tile_pixels`, but only tiles that lie wholly inside the scene (``dims`` has h, w)."""
    sized = attach_scene(pixels, dims.select("scene_id", "h", "w", F.col("h").alias("_h"), F.col("w").alias("_w")), ["_h", "_w"])
    return (sized.withColumn("r0", F.explode(_origins(F.col("row"), tile, stride, F.col("_h") - tile)))
            .withColumn("c0", F.explode(_origins(F.col("col"), tile, stride, F.col("_w") - tile))).drop("_h", "_w"))


def tile_counts(tiles: DataFrame, min_spill_pixels: int = 16) -> DataFrame:
    """Spill pixels per tile (mask = 255), positive flag and tile name."""
    return (tiles.groupBy("scene_id", "r0", "c0").agg(F.count_if(F.col("mask") == 255).alias("spill_pixels"))
            .withColumn("has_spill", F.col("spill_pixels") >= min_spill_pixels)
            .withColumn("tile_name", tile_name(F.concat(F.lit("scene_"), F.col("scene_id").cast("string")))))


def tile_name(scene: Column) -> Column:
    return F.format_string("%s_r%04d_c%04d", scene, F.col("r0"), F.col("c0"))


def tile_arrays(tiles: DataFrame, tile: int, value: str = "value") -> DataFrame:
    """Tiles as zero-padded row-major arrays of tile x tile floats; a group never exceeds one tile."""
    zero = F.lit(0).cast("float")
    line = F.transform(F.array_sort(F.collect_list(F.struct("col", F.col(value).cast("float").alias("v")))), lambda p: p["v"])
    lines = tiles.groupBy("scene_id", "r0", "c0", "row").agg(line.alias("l"))
    lines = lines.withColumn("l", F.concat("l", F.array_repeat(zero, F.lit(tile) - F.size("l"))))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "l"))), lambda p: p["l"]))
    return (lines.groupBy("scene_id", "r0", "c0").agg(body.alias("a"))
            .select("scene_id", "r0", "c0", F.concat("a", F.array_repeat(zero, F.lit(tile * tile) - F.size("a"))).alias("values")))


def blend_tiles(tiles: DataFrame, tile: int, value: str = "value") -> DataFrame:
    """Full scene from overlapping tiles: Hann-weighted mean, clipped to [0,1]."""
    weight = hann2d(F.col("row") - F.col("r0"), F.col("col") - F.col("c0"), tile)
    sums = tiles.withColumn("_w", weight).groupBy("scene_id", "row", "col").agg(
        F.sum(F.col(value) * F.col("_w")).alias("_p"), F.sum("_w").alias("_t"))
    return sums.select("scene_id", "row", "col", clamp(F.col("_p") / F.greatest("_t", lit_f(1e-6)), 0, 1).alias("value"))
