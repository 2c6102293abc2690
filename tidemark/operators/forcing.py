"""Wind and current series: lookups, fallbacks and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.physics import climatology, conditions, current_uv, kmh_to_mps_current, kmh_to_mps_wind, wind_uv
from tidemark.functions.scalar import lit_f, rnd

SERIES = ("wind_kmh", "wind_dir", "current_kmh", "current_dir")
# Defaults of a series with a missing entry.
DEFAULTS = {"wind_kmh": 18.0, "wind_dir": 225.0, "current_kmh": 0.35, "current_dir": 140.0}
MEASURED_SOURCE = "Open-Meteo Operational Marine API (ECMWF IFS / Global Ocean Physics)"


def cell_key(x: Column) -> Column:
    """0.01 degree cell as an integer, so joins never compare doubles."""
    return F.rint(x * lit_f(100)).cast("int")


def lookup(points: DataFrame, forcing: DataFrame, ts: str = "ts") -> DataFrame:
    """Measured series values at (lat, lon, hour of ts).

    Adds the four series columns, ``has_series`` (the cell is known) and ``hour_matched``.
    A known cell without that hour uses the first hour of its series.  Where several source
    cells or rows fall on one 0.01 degree cell and hour, the south-westernmost one counts (then the
    least values), so points are never multiplied.
    """
    source = F.struct("cell_lat", "cell_lon", F.struct(*SERIES).alias("series"))
    exact = (forcing.groupBy(cell_key(F.col("cell_lat")).alias("_y"), cell_key(F.col("cell_lon")).alias("_x"), F.col("hour").alias("_h"))
             .agg(F.min(source)["series"].alias("_exact")))
    first = (exact.groupBy("_y", "_x").agg(F.min_by("_exact", "_h").alias("_first")))
    keyed = (points.withColumn("_y", cell_key(F.col("lat"))).withColumn("_x", cell_key(F.col("lon")))
             .withColumn("_h", F.date_trunc("hour", F.col(ts))))
    both = keyed.join(exact, ["_y", "_x", "_h"], "left").join(first, ["_y", "_x"], "left")
    row = F.coalesce("_exact", "_first")
    return both.select(
        *points.columns, *[row[c].alias(c) for c in SERIES],
        F.col("_first").isNotNull().alias("has_series"), F.col("_exact").isNotNull().alias("hour_matched"))


def measured_conditions() -> Column:
    """Conditions struct from the series columns; speeds are rounded before u and v."""
    raw = {c: F.coalesce(F.col(c), lit_f(DEFAULTS[c])) for c in SERIES}
    ws, wd = rnd(kmh_to_mps_wind(raw["wind_kmh"]), 2), rnd(raw["wind_dir"], 1)
    cs, cd = rnd(kmh_to_mps_current(raw["current_kmh"]), 2), rnd(raw["current_dir"], 1)
    (wu, wv), (cu, cv) = wind_uv(ws, wd), current_uv(cs, cd)
    return conditions(wu, wv, ws, wd, cu, cv, cs, cd, lit_f(28.5), lit_f(1.4),
                      F.lit(MEASURED_SOURCE), F.lit(False))


def conditions_at(points: DataFrame, forcing: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Conditions per point and time: the measured series where the cell has one, else climatology."""
    if forcing is None:
        return points.withColumn("cond", climatology(F.col(ts)))
    found = lookup(points, forcing, ts)
    cond = F.when(F.col("has_series"), measured_conditions()).otherwise(climatology(F.col(ts)))
    return found.withColumn("cond", cond).drop(*SERIES, "has_series")


def history(points: DataFrame, forcing: DataFrame | None, start: str, end: str, step_hours: int = 3) -> DataFrame:
    """Conditions at every step of a closed interval per point."""
    times = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step_hours} HOURS")))
    return conditions_at(points.withColumn("ts", times), forcing)
