"""Points, rectangles and affine maps as column expressions. A rectangle is four columns or a struct of min_x, min_y, max_x, max_y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("min_x", "min_y", "max_x", "max_y")


def rectangle(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((min_x, min_y, max_x, max_y), SIDES, strict=True)])


def transform_point(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """(x, y) under the six numbers of an affine map."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def flip(y: Column, size: Column, height: Column) -> tuple[Column, Column]:
    """Top and bottom on a page whose vertical axis grows downwards."""
    return height - y, height - y + size


def contains(a: Column, b: Column) -> Column:
    """Whether a holds b, edges included."""
    return (a["min_x"] <= b["min_x"]) & (a["min_y"] <= b["min_y"]) & (a["max_x"] >= b["max_x"]) & (a["max_y"] >= b["max_y"])


def gap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Distance along one axis; 0 where they touch or overlap."""
    return F.greatest(F.lit(0.0), b_min - a_max, a_min - b_max)


def distance(a: Column, b: Column) -> Column:
    """A struct of dx and dy."""
    return F.struct(gap(a["min_x"], a["max_x"], b["min_x"], b["max_x"]).alias("dx"), gap(a["min_y"], a["max_y"], b["min_y"], b["max_y"]).alias("dy"))


def bounding() -> list[Column]:
    """Aggregates of the four side columns; null over no rows."""
    return [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]


def format_rectangle(r: Column, digits: int = 0) -> Column:
    """``[min_x, min_y, max_x, max_y]`` with halves rounded away from zero."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string(f"%.{digits}f", F.round(r[s], digits)) for s in SIDES]), F.lit("]"))


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """The affine map that applies ``m`` first."""
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]
