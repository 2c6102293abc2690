"""Wind, current and drift expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import lit_f, rnd, wrap360


@dataclass(frozen=True)
class Climatology:
    """Fixed values of the fallback climate series."""

    wind_mps: float = 6.8
    wind_dir: float = 235.0
    current_mps: float = 0.42
    current_dir: float = 145.0
    sea_temp_c: float = 28.4
    wave_height_m: float = 1.2
    source: str = "Climatological Monsoon Model (Validated Demo Engine)"


def wind_uv(speed: Column, from_dir: Column) -> tuple[Column, Column]:
    """Meteorological wind (direction it comes from) to u, v; 3 decimals."""
    rad = F.radians(from_dir)
    return rnd(-speed * F.sin(rad), 3), rnd(-speed * F.cos(rad), 3)


def current_uv(speed: Column, to_dir: Column) -> tuple[Column, Column]:
    """Ocean current (direction it flows to) to u, v; 3 decimals."""
    rad = F.radians(to_dir)
    return rnd(speed * F.sin(rad), 3), rnd(speed * F.cos(rad), 3)


def kmh_to_mps_wind(kmh: Column) -> Column:
    return kmh / lit_f(3.6)


def kmh_to_mps_current(kmh: Column) -> Column:
    return kmh * lit_f(1000.0 / 3600.0)


def climatology(ts: Column, c: Climatology = Climatology()) -> Column:
    """Conditions struct for an hour of day; u and v come from the unrounded speed."""
    h = F.hour(ts).cast("double")
    speed = F.greatest(lit_f(1.5), lit_f(c.wind_mps) + lit_f(0.8) * F.sin(h * lit_f(math.pi) / lit_f(12)))
    direction = wrap360(lit_f(c.wind_dir) + lit_f(5) * F.cos(h * lit_f(math.pi) / lit_f(6)))
    wu, wv = wind_uv(speed, direction)
    cu, cv = current_uv(lit_f(c.current_mps), lit_f(c.current_dir))
    return conditions(wu, wv, rnd(speed, 2), rnd(direction, 1), cu, cv,
                      lit_f(c.current_mps), lit_f(c.current_dir),
                      lit_f(c.sea_temp_c), lit_f(c.wave_height_m), F.lit(c.source), F.lit(True))


def conditions(wu, wv, wspeed, wdir, cu, cv, cspeed, cdir, temp, wave, source, is_demo) -> Column:
    return F.struct(
        wu.alias("wind_u"), wv.alias("wind_v"), wspeed.alias("wind_speed_mps"), wdir.alias("wind_dir_deg"),
        cu.alias("current_u"), cv.alias("current_v"), cspeed.alias("current_speed_mps"), cdir.alias("current_dir_deg"),
        temp.alias("sea_temp_c"), wave.alias("wave_height_m"), source.alias("source"), is_demo.alias("is_demo"))


def drift_velocity(wind_u: Column, wind_v: Column, cur_u: Column, cur_v: Column,
                   windage: float = 0.03, deflection_deg: float = 10.0) -> tuple[Column, Column]:
    """Surface velocity: current plus a deflected share of the wind."""
    cos_d, sin_d = lit_f(math.cos(math.radians(deflection_deg))), lit_f(math.sin(math.radians(deflection_deg)))
    share = lit_f(windage)
    return (cur_u + share * (wind_u * cos_d - wind_v * sin_d),
            cur_v + share * (wind_u * sin_d + wind_v * cos_d))


def spill_age(area_km2: Column, elongation: Column, wind_mps: Column, multi_pass: Column) -> Column:
    """Plausible age bounds of a slick from its area, elongation and wind."""
    factor = F.when(wind_mps > 0, F.least(F.greatest(wind_mps / lit_f(6), lit_f(0.6)), lit_f(2))).otherwise(lit_f(1))
    base = F.sqrt(area_km2) * lit_f(4) / factor
    off = F.least(lit_f(12), elongation * lit_f(1.5))
    lo = F.greatest(lit_f(1), rnd(base * lit_f(0.5) + off * lit_f(0.3), 1))
    hi = F.greatest(lo + lit_f(3), rnd(base * lit_f(1.8) + off * lit_f(1.2), 1))
    known = area_km2 > 0
    return F.struct(
        F.when(known, "ESTIMATED_RANGE").otherwise("AGE_UNAVAILABLE").alias("age_status"),
        F.when(known, lo).otherwise(lit_f(0)).alias("min_hours"),
        F.when(known, hi).otherwise(lit_f(0)).alias("max_hours"),
        F.when(~known, "UNAVAILABLE").when(multi_pass | elongation.between(3.0, 15.0), "MODERATE")
         .otherwise("LOW").alias("age_confidence"),
        F.when(known, F.when(elongation > 4, "SHEARED_TRAILING_SLICK").otherwise("LOCALIZED_RADIAL_POOL"))
         .alias("regime"))
