"""Shape arithmetic: volumes, resting heights, half-extent strings, polygon areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes with their simulator geometry.
SHAPES = ("ball", "cylinder", "cube", "block")
GEOM_TYPES = {"ball": "sphere", "cylinder": "cylinder", "cube": "box", "block": "box"}
LEAST_MASS = 1e-6


def by_shape(shape: Column, **values: Column) -> Column:
    """The value of the row's shape; NULL for any other shape."""
    out = None
    for name, value in values.items():
        out = F.when(shape == name, value) if out is None else out.when(shape == name, value)
    return out


def volume(shape: Column, radius: Column, height: Column, side: Column, length: Column, width: Column) -> Column:
    """Volume by shape. Powers are written as products: these are the same in every engine."""
    return by_shape(
        shape,
        ball=F.lit(4.0 / 3.0 * math.pi) * radius * radius * radius,
        cylinder=F.lit(math.pi) * radius * radius * height,
        cube=side * side * side,
        block=length * width * height,
    )


def base_z(shape: Column, radius: Column, height: Column, side: Column) -> Column:
    """Height of the centre of a body that rests on the floor."""
    return by_shape(shape, ball=radius, cylinder=height / 2, cube=side / 2, block=height / 2)


def geom_type(shape: Column) -> Column:
    return by_shape(shape, **{k: F.lit(v) for k, v in GEOM_TYPES.items()})


def size_string(shape: Column, radius: Column, height: Column, side: Column, length: Column, width: Column) -> Column:
    """Radius and half extents with four decimals, space-separated."""
    half = side / 2
    return by_shape(
        shape,
        ball=F.format_string("%.4f", radius),
        cylinder=F.format_string("%.4f %.4f", radius, height / 2),
        cube=F.format_string("%.4f %.4f %.4f", half, half, half),
        block=F.format_string("%.4f %.4f %.4f", length / 2, width / 2, height / 2),
    )


def mass(density: Column, vol: Column) -> Column:
    return F.greatest(density * vol, F.lit(LEAST_MASS))


def shoelace(xy: Column, points: int) -> Column:
    """Area of a polygon given as an array x0, y0, x1, y1, ... of `points` points."""
    x, y = ([F.get(xy, F.lit(2 * i + k)).cast("double") for i in range(points)] for k in range(2))
    twice = None
    for i in range(points):
        j = (i + 1) % points
        term = x[i] * y[j] - x[j] * y[i]
        twice = term if twice is None else twice + term
    return F.abs(twice) / 2
