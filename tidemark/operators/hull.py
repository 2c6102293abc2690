"""Convex hulls of groups of any size: partial hulls as folds over sorted arrays, merged level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut_lineage


def _turn(a: Column, b: Column, p: Column) -> Column:
    """Above zero where a, b, p turn left."""
    return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])


def _chain(points: Column) -> Column:
    """One side of the hull of points in order, the last point left out (monotone chain)."""
    def add(chain: Column, p: Column) -> Column:
        edges = F.greatest(F.size(chain) - 1, F.lit(0))
        left = F.zip_with(F.slice(chain, F.lit(1), edges), F.slice(chain, F.lit(2), edges), lambda a, b: _turn(a, b, p) > 0)
        # Points after the last left turn towards the new one lie inside.
        last = F.array_max(F.transform(left, lambda x, i: F.when(x, i + 1).otherwise(0)))
        return F.concat(F.slice(chain, F.lit(1), F.coalesce(last, F.lit(0)) + 1), F.array(p))
    whole = F.aggregate(points, F.slice(points, 1, 0), add)
    return F.slice(whole, F.lit(1), F.size(whole) - 1)


def hull_of(points: Column) -> Column:
    """Corners of different points (an array of lon, lat), counter-clockwise from the least, open; lines keep their two ends."""
    ordered = F.array_sort(points)
    return F.when(F.size(points) < 3, ordered).otherwise(F.concat(_chain(ordered), _chain(F.reverse(ordered))))


def group_hulls(points: DataFrame, key: str, size: int = 512) -> DataFrame:
    """(key, hull) of the rows (key, lon, lat); rows without a place are left out.

    Each group is cut into parts of about ``size`` points by hash; only a part's corners go on
    to the next level, until a group is one part.  The corners of all parts have the hull
    of all points.  Runs actions.
    """
    point = F.struct("lon", "lat")
    rows = points.select(key, "lon", "lat").filter("lon IS NOT NULL AND lat IS NOT NULL")
    before = None
    while True:
        counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
        if before is not None and most * 2 > before:
            size = max(size, most)  # nearly all points are corners: they are the result's own size
        part = F.pmod(F.xxhash64("lon", "lat"), F.ceil(F.col("_n") / size))
        hulls = (rows.join(counts, key).withColumn("_part", part).groupBy(key, "_part").agg(F.collect_set(point).alias("p"))
                 .select(key, hull_of(F.col("p")).alias("hull")))
        if most <= size:
            return hulls
        rows = cut_lineage(hulls.select(key, F.inline("hull")))
        before = most
