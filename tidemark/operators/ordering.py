"""Ordered work over groups of any size.

One ship, scene or spill may own a large share of a table.  A window partitioned by
that key alone would be one task, so the helpers here cut each group into buckets
along its order (time, score, hash), work inside the buckets, and stitch the buckets
together through a small table with one row per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut_lineage

BUCKET = "_bucket"


def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_next(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("vessel_id",),
              order: Sequence[str] = ("ts", "position_id"), bucket_seconds: int = 21_600) -> DataFrame:
    """Add struct ``nxt`` of the following row's columns per key, null on the last row.

    The bucket column stays in the result so later steps can reuse the partitioning.
    """
    keys = list(keys)
    cut = df.withColumn(BUCKET, time_bucket(order[0], bucket_seconds))
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    inner = cut.withColumn("_n", F.lead(F.struct(*columns)).over(w)).withColumn("_rn", F.row_number().over(w))
    # One row per (key, bucket): small next to the positions, bounded by the calendar.
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    heads = (inner.filter("_rn = 1").select(*keys, BUCKET, F.struct(*columns).alias("_head"))
             .withColumn("_after", F.lead("_head").over(across)).drop("_head"))
    return (inner.join(heads, [*keys, BUCKET], "left")
            .withColumn("nxt", F.coalesce("_n", "_after")).drop("_n", "_after", "_rn"))


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                out: str = "row_no", bucket_desc: bool = False, total: str | None = None) -> DataFrame:
    """``row_number`` over (keys, order) where ``bucket`` is a coarse prefix of the order.

    With no keys this is a whole-table numbering that no single task has to sort.
    """
    keys = list(keys)
    cut = df.withColumn(BUCKET, bucket)
    counts = cut.groupBy(*keys, BUCKET).agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = part.orderBy(F.col(BUCKET).desc() if bucket_desc else F.col(BUCKET).asc())
    offsets = counts.select(
        *keys, BUCKET,
        F.coalesce(F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(part).alias("_total"))
    rn = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    res = (cut.withColumn("_rn", rn).join(offsets, [*keys, BUCKET])
           .withColumn(out, F.col("_before") + F.col("_rn")))
    if total:
        res = res.withColumn(total, F.col("_total"))
    return res.drop(BUCKET, "_rn", "_before", "_total")


def hash_order(seed: int, *columns: str) -> Column:
    """Seeded shuffle key: hex md5 text, uniform and independent of partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def group_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile", settle: int = 4096, cells: int = 256) -> DataFrame:
    """(keys, out): the exact quantile of each group, interpolated between neighbouring ranks.

    Groups of more than ``settle`` values are narrowed first: the values around a rank are counted
    in ``cells`` equal cells, and the cell that holds the rank is the next range, until few
    values or one value are left.  Only those are ranked, so no task sorts a large group.
    Null values are left out.  Runs actions.
    """
    keys = list(keys)
    # Written once: a value computed from sums may come out otherwise in its last digit when computed again.
    rows = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"))
    groups = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    place = F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(place).cast("bigint"), F.ceil(place).cast("bigint"))))
    wanted = cut_lineage(groups.select(*keys, ranks.alias("_rank"), "_low", "_high", F.lit(0).cast("bigint").alias("_before"), F.col("_n").alias("_inside")))
    own = [*keys, "_rank"]
    within = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    wide = (F.col("_inside") > settle) & (F.col("_low") < F.col("_high"))
    while not wanted.filter(wide).isEmpty():
        cell = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))
        counted = (rows.join(wanted.filter(wide), keys).filter(within).groupBy(*own, "_before", cell.alias("_cell"))
                   .agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
        up = Window.partitionBy(*own).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(up), F.lit(0)))
        held = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_c"))
        narrow = placed.filter(held).select(*own, "_low", "_high", F.col("_first").alias("_before"), F.col("_c").alias("_inside"))
        wanted = cut_lineage(wanted.filter(~wide).unionAll(narrow))
    one = wanted.filter("_low = _high").select(*own, F.col("_low").alias("_v"))
    number = F.row_number().over(Window.partitionBy(*own).orderBy("_v")) - 1 + F.col("_before")
    few = (rows.join(wanted.filter("_low < _high"), keys).filter(within).withColumn("_no", number)
           .filter(F.col("_no") == F.col("_rank")).select(*own, "_v"))
    found = one.unionAll(few).groupBy(*keys).agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    return groups.join(found, keys).select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias(out))
