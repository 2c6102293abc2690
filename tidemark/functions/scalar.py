"""Small numeric and text expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_f(x: float) -> Column:
    """A DOUBLE literal (a bare 10000.0 next to a BIGINT would become DECIMAL)."""
    return F.lit(float(x)).cast("double")


def rnd(x: Column, digits: int) -> Column:
    """Half-even rounding in double arithmetic.

    ``round`` on DOUBLE goes through BigDecimal per value; ``rint`` stays a single
    machine operation inside generated code and follows the half-even rule.
    """
    k = lit_f(10.0 ** digits)
    return F.rint(x * k) / k


def wrap360(x: Column) -> Column:
    """Floored modulus: -10 -> 350."""
    return F.pmod(x, lit_f(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest absolute angle between two headings, 0..180."""
    return F.abs(F.pmod(a - b + lit_f(180.0), lit_f(360.0)) - lit_f(180.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, lit_f(lo)), lit_f(hi))


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours as double, microsecond exact."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / lit_f(3.6e9)


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals; rounded first so ties print one way."""
    return F.format_string(f"%.{digits}f", rnd(x, digits))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def hash_uniform(digest: Column, part: int = 0) -> Column:
    """Uniform number in (0,1) from an md5 text; ``part`` picks one of its four 32-bit words.

    md5 does not depend on partitioning or task retries, and any SQL engine can
    repeat it, so seeded sampling stays checkable.
    """
    word = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double")
    return (word + lit_f(0.5)) / lit_f(4294967296.0)


def hash_word_pair(digest: Column) -> Column:
    """The first two words of an md5 text as the bits of one BIGINT, from a single conversion."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def pair_uniform(pair: Column, part: int) -> Column:
    """``hash_uniform`` of part 0 or 1 from ``hash_word_pair``."""
    word = F.shiftrightunsigned(pair, 32) if part == 0 else pair.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return (word.cast("double") + lit_f(0.5)) / lit_f(4294967296.0)
