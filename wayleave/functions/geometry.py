"""Rings and arcs as Column functions. A vertex is a struct (x, y) or (x, y, bulge); bulge is the tangent of a quarter of the arc to the next vertex."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f names it, in functions over arrays too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def signed_area(ring: Column) -> Column:
    """Positive against the clock; coordinates count from the first corner."""
    o = F.element_at(ring, 1)
    term = lambda i: (F.element_at(ring, i)["x"] - o["x"]) * (F.element_at(ring, i + 1)["y"] - o["y"]) - (F.element_at(ring, i + 1)["x"] - o["x"]) * (F.element_at(ring, i)["y"] - o["y"])
    return F.when(F.size(ring) > 2, F.aggregate(F.sequence(F.lit(2), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2).otherwise(F.lit(0.0))


def signed_area_with_arcs(ring: Column) -> Column:
    """signed_area() of a ring with a bulge at each vertex: the polygon, and between each arc and its chord a circular segment (null bulges are straight). Two vertices make a ring if an arc joins them."""

    def segment(i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, F.when(i == F.size(ring), F.lit(1)).otherwise(i + 1))
        b = F.when(F.abs(p["bulge"]) > 1e-12, p["bulge"])
        chord2 = (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])
        radius2, angle = chord2 * F.pow((1 + b * b) / (4 * b), 2), 4 * F.atan(b)
        return F.coalesce(radius2 * (angle - F.sin(angle)) / 2, F.lit(0.0))

    arcs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring), F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= F.size(ring), segment(i)).otherwise(F.lit(0.0)))
    return signed_area(ring) + F.when(F.size(ring) > 1, arcs).otherwise(F.lit(0.0))


def clockwise(ring: Column) -> Column:
    """The ring with the clock, the first corner kept."""
    turned = lambda r: F.concat(F.slice(r, 1, 1), F.reverse(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))))
    return bound(ring, lambda r: F.when(signed_area(r) > 0, turned(r)).otherwise(r))


def centre(ring: Column) -> Column:
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def by_angle(ring: Column) -> Column:
    """Corners by their angle around the mean, against the clock."""
    c = centre(ring)
    keyed = F.transform(ring, lambda p: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y")))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def normal_angle(a: Column) -> Column:
    return F.pmod(a, F.lit(2 * math.pi))


def bisector(a: Column, b: Column) -> Column:
    return F.atan2(F.sin(a) + F.sin(b), F.cos(a) + F.cos(b))


def corners_match(corners: Column, ring: Column, tolerance: float = 0.01) -> Column:
    return F.forall(corners, lambda c: F.exists(ring, lambda v: F.hypot(c["x"] - v["x"], c["y"] - v["y"]) <= tolerance))


def arc_length(chord: Column, bulge: Column) -> Column:
    """Length of an arc over a chord; a straight piece for bulge 0."""
    angle = 4 * F.atan(F.abs(bulge))
    return F.when(bulge == 0, chord).otherwise(chord / F.when(bulge != 0, 2 * F.sin(angle / 2)) * angle)


def arc_points(x0: Column, y0: Column, x1: Column, y1: Column, bulge: Column, parts: Column) -> Column:
    """Points of an arc at equal steps, without its end: (x, y) structs; one point, the start, for a straight piece."""
    angle = 4 * F.atan(bulge)
    mx, my, dx, dy = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
    off = (1 / F.when(bulge != 0, bulge) - bulge) / 4
    cx, cy = mx - dy * off, my + dx * off
    turn = lambda t: F.struct((cx + (x0 - cx) * F.cos(t) - (y0 - cy) * F.sin(t)).alias("x"), (cy + (x0 - cx) * F.sin(t) + (y0 - cy) * F.cos(t)).alias("y"))
    return F.when(bulge == 0, F.array(F.struct(x0.alias("x"), y0.alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: turn(angle * i / parts)))


def arc_parts(chord: Column, bulge: Column, sagitta: float = 0.001, most: int = 4096) -> Column:
    """How many chords keep within a sagitta of an arc."""
    angle = 4 * F.atan(F.abs(bulge))
    radius = chord / (2 * F.sin(angle / 2))
    step = 2 * F.acos(F.greatest(1 - sagitta / radius, F.lit(-1.0)))
    return F.when(bulge == 0, F.lit(1)).otherwise(F.least(F.greatest(F.ceil(angle / step).cast("int"), F.lit(1)), F.lit(most)))


def decimal_places(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"[.,]([0-9]*)\s*$", 1))
