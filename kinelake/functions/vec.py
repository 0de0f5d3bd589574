"""Scalar and 3-vector arithmetic on columns.

Vectors are arrays of doubles at the boundary. The helpers spell the three
components out, so the work stays in generated code and the order of additions
is fixed (both matter when results are compared to another engine).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(arr: Column, i: int) -> Column:
    """Element i (from 0) as a double; NULL past the end."""
    return F.get(arr, F.lit(i)).cast("double")


def dot3(a: Column, b: Column, i: int = 0, j: int = 0) -> Column:
    """Dot product of a[i:i+3] and b[j:j+3]."""
    x, y, z = (at(a, i + k) * at(b, j + k) for k in range(3))
    return x + y + z


def norm3(a: Column, i: int = 0) -> Column:
    """Length of a[i:i+3]."""
    return F.sqrt(dot3(a, a, i, i))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled binary value: rint(x * 10^d) / 10^d."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def steady(x: Column, digits: int = 6) -> Column:
    """Floor-rounded value for results that differ in the last bits between engines."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def tilt_degrees(q: Column, i: int = 0, normalise: bool = False) -> Column:
    """Angle between body z and world z for the quaternion (w, x, y, z) at q[i:i+4].

    A zero quaternion gives NULL when normalising.
    """
    w, x, y, z = (at(q, i + k) for k in range(4))
    cosine = w * w - x * x - y * y + z * z
    if normalise:
        size = w * w + x * x + y * y + z * z
        cosine = F.when(size != 0, cosine / size)
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """abs(top / bottom), and 0 where bottom is 0 (ANSI division would raise)."""
    return F.when(bottom != 0, F.abs(top / bottom)).otherwise(F.lit(0.0))
