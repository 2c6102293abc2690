"""Pairing, checking, splitting and sampling of scene collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import lit_f, rnd
from tidemark.operators.ordering import hash_order, number_rows

# Accepted formats and name endings.
IMAGE_EXT = (".tif", ".tiff", ".png", ".jpg", ".jpeg", ".npy", ".webp")
SCENE_EXT = (".tif", ".tiff", ".png", ".jpg", ".jpeg", ".npy", ".nc", ".webp")
MASK_MARKS = ("_mask", "-mask", "_label", "-label", "_gt")
MASK_ENDINGS = (".tif", ".tiff", ".png", ".npy", "_mask.png", "_mask.tif", "_label.png", "_gt.png")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]+$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def intake_check(files: DataFrame, allowed: tuple[str, ...] = IMAGE_EXT, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """``reject_reason`` per file (path, length): format, size, emptiness; null = accepted."""
    reason = F.when(~extension(F.col("path")).isin(*allowed), "UNSUPPORTED_FORMAT")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "TOO_LARGE").when(F.col("length") == 0, "EMPTY")
    return files.withColumn("reject_reason", reason)


def prefer_arrays(files: DataFrame) -> DataFrame:
    """Image files without the .png preview of an array of the same name in the same folder."""
    tagged = (files.withColumns({"ext": extension(F.col("path")), "basename": base_name(F.col("path")), "_folder": folder(F.col("path"))})
              .filter(F.col("ext").isin(*IMAGE_EXT)))
    arrays = tagged.filter("ext = '.npy'").select("_folder", "basename").distinct().withColumn("_has", F.lit(True))
    return (tagged.join(arrays, ["_folder", "basename"], "left")
            .filter((F.col("ext") != ".png") | F.col("_has").isNull()).drop("_has", "_folder"))


def pair_scene_mask(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with the mask of the highest-priority name; both sides are file paths.

    Each mask is turned into the (basename, priority) pairs it can serve, so this is one
    equi-join and one small minimum per image.  Of masks of one priority (equal names in two
    folders) the least path serves.
    """
    image = (images.select("path").distinct().withColumn("name", file_name(F.col("path")))
             .filter(extension(F.col("path")).isin(*[e for e in IMAGE_EXT if e != ".webp"])))
    marks = F.array(*[F.contains(F.lower("name"), F.lit(m)) for m in MASK_MARKS])
    image = image.filter(~F.exists(marks, lambda x: x)).select(base_name(F.col("path")).alias("scene"), F.col("path").alias("image_path"))
    name = file_name(F.col("path"))
    served = F.array(*[F.when(F.endswith(name, F.lit(end)), F.struct(
        F.substring(name, F.lit(1), F.length(name) - len(end)).alias("scene"), F.lit(i).alias("priority")))
        for i, end in enumerate(MASK_ENDINGS)])
    offers = (masks.select("path").distinct()
              .withColumn("o", F.explode(F.filter(served, lambda x: x.isNotNull())))
              .select("o.scene", "o.priority", F.col("path").alias("mask_path")))
    best = offers.groupBy("scene").agg(F.min(F.struct("priority", "mask_path"))["mask_path"].alias("mask_path"))
    return image.join(best, "scene")


def missing_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks.select("split", "basename"), ["split", "basename"], "left_anti")


def orphan_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return masks.join(images.select("split", "basename"), ["split", "basename"], "left_anti")


def size_mismatches(images: DataFrame, masks: DataFrame) -> DataFrame:
    m = masks.select("split", "basename", F.col("h").alias("mask_h"), F.col("w").alias("mask_w"))
    return images.join(m, ["split", "basename"]).filter("h <> mask_h OR w <> mask_w")


def leaked_names(files: DataFrame) -> DataFrame:
    """Names that occur in two splits, once per pair of splits."""
    flags = files.groupBy("basename").agg(*[F.bool_or(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    pairs = F.array(*[F.when(F.col(a) & F.col(b), f"{a}-{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))])
    return flags.select("basename", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("pair"))


def _checked(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(split, basename, matched, found): every name of either side, with its errors and warnings."""
    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        bad = (F.col("has_nan") | F.col("has_inf")).alias("bad")
        return df.select("split", "basename", F.struct("h", "w", bad, *more).alias(name))

    def finding(cond: Column, level: str, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind")))
    i, m = F.col("i"), F.col("m")
    both = i.isNotNull() & m.isNotNull()
    sound = both & ~i["bad"] & ~m["bad"]
    found = F.array_compact(F.array(
        finding(m.isNull(), "ERROR", "MISSING_MASK"), finding(i.isNull(), "WARNING", "ORPHAN_MASK"),
        finding(both & i["bad"], "ERROR", "BAD_IMAGE_VALUES"), finding(both & ~i["bad"] & m["bad"], "ERROR", "BAD_MASK_VALUES"),
        finding(sound & ((i["h"] != m["h"]) | (i["w"] != m["w"])), "ERROR", "SIZE_MISMATCH"),
        finding(sound & ~m["is_binary"], "WARNING", "NOT_BINARY")))
    pairs = side(images, "i").join(side(masks, "m", "is_binary"), ["split", "basename"], "full")
    return pairs.select("split", "basename", both.alias("matched"), found.alias("found"))


def findings(images: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per error or warning of a split (images, masks: split, basename, h, w, and scan flags)."""
    told = _checked(images, masks).select("split", "basename", F.explode("found").alias("x"))
    return told.select("split", "x.level", "x.kind", "basename")


def split_verdicts(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Per split: matched pairs, error and warning counts, validity.  Details stay in :func:`findings`."""
    def total(level: str) -> Column:
        return F.sum(F.size(F.filter("found", lambda x: x["level"] == level))).cast("bigint")
    res = _checked(images, masks).groupBy("split").agg(
        F.count_if("matched").alias("matched"), total("ERROR").alias("errors"), total("WARNING").alias("warnings"))
    return res.withColumn("valid", (F.col("errors") == 0) & (F.col("matched") > 0))


def dataset_verdict(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Whole dataset in one row: counts, leaked names, verdict; train and val must not be empty."""
    sums = split_verdicts(images, masks).agg(
        F.sum("matched").alias("total_images"), F.sum("errors").alias("split_errors"), F.sum("warnings").alias("warnings"),
        F.count_if(F.col("split").isin("train", "val") & (F.col("matched") > 0)).alias("_filled"))
    leak = leaked_names(images).agg(F.count_distinct("pair").alias("leak_pairs"), F.count_distinct("basename").alias("leaked_names"))
    # Two one-row aggregates side by side.
    both = sums.withColumn("_k", F.lit(1)).join(leak.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select("total_images", (F.col("split_errors") + F.col("leak_pairs")).alias("errors"), "warnings", "leaked_names",
                       ((F.col("split_errors") + F.col("leak_pairs") == 0) & (F.col("_filled") == 2)).alias("valid"))


def scene_split(scenes: DataFrame, key: str, train: float = 0.7, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffled 70/20/10 split at scene level; counts by rounding, at least one in train and val."""
    n, i = F.col("_n"), F.col("_i")
    n_train = F.greatest(F.lit(1), F.rint(n * lit_f(train))).cast("bigint")
    n_val = F.greatest(F.lit(1), F.rint(n * lit_f(val))).cast("bigint")
    n_train = F.when(n - n_train - n_val < 0, F.greatest(F.lit(1).cast("bigint"), n_train - 1)).otherwise(n_train)
    split = (F.when(n == 1, "train").when(n == 2, F.when(i == 1, "train").otherwise("val"))
             .when(i <= n_train, "train").when(i <= n_train + n_val, "val").otherwise("test"))
    return _shuffled(scenes, key, seed).withColumn("split", split).drop("_h", "_i", "_n")


def flat_split(scenes: DataFrame, key: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffled 80/20 split; a lone scene serves both sides."""
    n, i = F.col("_n"), F.col("_i")
    cut = F.greatest(F.lit(1).cast("bigint"), F.floor(n * lit_f(1 - val)))
    both = F.when(n == 1, F.array(F.lit("train"), F.lit("val"))).otherwise(
        F.array(F.when(i <= cut, "train").otherwise("val")))
    return _shuffled(scenes, key, seed).withColumn("split", F.explode(both)).drop("_h", "_i", "_n")


def _shuffled(scenes: DataFrame, key: str, seed: int) -> DataFrame:
    # Position in hash order; the first three hex digits cut the table into 4096 even parts.
    hashed = scenes.withColumn("_h", hash_order(seed, key))
    return number_rows(hashed, [], F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], out="_i", total="_n")


def sample_negatives(tiles: DataFrame, ratio: float = 1.0, clean_keep: int = 4, seed: int = 42) -> DataFrame:
    """All positive tiles, and per scene a seeded choice of negatives in proportion.

    A scene without positives keeps up to ``clean_keep`` tiles.
    """
    pos = tiles.groupBy("scene_id").agg(F.count_if("has_spill").alias("_pos"))
    quota = F.when(F.col("_pos") > 0, F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_pos") * lit_f(ratio)))).otherwise(clean_keep)
    ordered = tiles.filter("NOT has_spill").withColumn("_h", hash_order(seed, "tile_name"))
    ordered = number_rows(ordered, ["scene_id"], F.substring("_h", 1, 2), [F.col("_h"), F.col("tile_name")], out="_i")
    kept = ordered.join(pos.withColumn("_q", quota), "scene_id").filter("_i <= _q").drop("_h", "_i", "_pos", "_q")
    return tiles.filter("has_spill").unionByName(kept.select(*tiles.columns))


def prep_report(tiles: DataFrame) -> DataFrame:
    """Tiles per split and in total (split null = total): scenes, positives, negatives, percentages."""
    pos = F.count_if("has_spill")
    agg = tiles.rollup("split").agg(F.count_distinct("scene_id").alias("scenes"), F.count("*").alias("total_patches"),
                                    pos.alias("positive_patches"), (F.count("*") - pos).alias("negative_patches"))
    def share(c: str) -> Column:
        return F.when(F.col("total_patches") > 0, rnd(F.col(c) / F.col("total_patches") * lit_f(100), 2)).otherwise(lit_f(0))
    return agg.withColumn("pos_percentage", share("positive_patches")).withColumn("neg_percentage", share("negative_patches"))


def skipped_scenes(image_scan: DataFrame, mask_scan: DataFrame) -> DataFrame:
    """Scenes the preparation leaves out, with the reason; checked in order size, NaN, Inf."""
    m = mask_scan.select("scene_id", F.col("h").alias("mh"), F.col("w").alias("mw"), F.col("has_nan").alias("mn"), F.col("has_inf").alias("mi"))
    reason = (F.when((F.col("h") != F.col("mh")) | (F.col("w") != F.col("mw")), "SIZE_MISMATCH")
              .when(F.col("has_nan") | F.col("mn"), "NAN").when(F.col("has_inf") | F.col("mi"), "INFINITE"))
    return image_scan.join(m, "scene_id").select("scene_id", reason.alias("reason")).filter("reason IS NOT NULL")


def spill_share(scenes: DataFrame) -> DataFrame:
    """Scenes in total, with and without spill."""
    return scenes.agg(F.count("*").alias("total"), F.count_if("has_spill").alias("with_spill"),
                      F.count_if(~F.col("has_spill")).alias("without_spill"))


def loader_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Pixels with their mask; a missing mask counts as all background."""
    m = masks.select("scene_id", "row", "col", F.when(F.col("value") > 127, 1).otherwise(0).alias("_m"))
    return (images.join(m, ["scene_id", "row", "col"], "left")
            .withColumn("mask", F.coalesce("_m", F.lit(0))).drop("_m"))
