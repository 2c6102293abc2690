"""Per-pixel radar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, lit_f


def sigma0_db(dn: Column, eps: float = 1e-6) -> Column:
    return lit_f(10) * F.log10(F.greatest(dn * dn, lit_f(eps)))


def normalise_db(db: Column, lo: float = -30.0, hi: float = 0.0) -> Column:
    return (clamp(db, lo, hi) - lit_f(lo)) / lit_f(hi - lo)


def contrast_probability(diff: Column) -> Column:
    """Sigmoid of the local darkness contrast."""
    return lit_f(1) / (lit_f(1) + F.exp(-((diff - lit_f(0.05)) * lit_f(15))))


def mask_at(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob >= lit_f(threshold), 1).otherwise(0)


def hann(i: Column, size: int) -> Column:
    if size == 1:
        return lit_f(1)
    return lit_f(0.5) - lit_f(0.5) * F.cos(lit_f(2 * math.pi) * i / lit_f(size - 1))


def hann2d(r: Column, c: Column, size: int) -> Column:
    """Blending weight of an in-tile pixel, floored so corners still count."""
    return F.greatest(hann(r, size) * hann(c, size), lit_f(1e-4))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.least(lit_f(1), lit_f(4 * math.pi) * area / F.greatest(perimeter * perimeter, lit_f(1e-5)))


def compactness(elongation: Column) -> Column:
    return F.when(elongation > 3, "ELONGATED_SLICK").otherwise("COMPACT_FORMATION")
