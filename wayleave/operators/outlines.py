"""Drawn outlines made ready: retraced ends, vertices along arcs, checks of them, straight rings, markers along both sides.

An outline is a row with `verts`, an array of (x, y, bulge), and `closed`. All but the check and the markers work inside the row, without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wayleave.functions import geometry
from wayleave.operators import edges, overlay

# Fixed values.
RETRACE_M, RETRACE_BULGE = 0.001, 1e-6
STRAIGHT_M, NO_BULGE = 0.001, 1e-10
CUT_M, LAST_M = 20.0, 1e-6
DENSE_M, REST_M, MICRO_M, EXACT_M = 50.0, 10.0, 0.05, 1e-6
CLOSED_M, NOTED_M, SAME_M = 0.01, 2.0, 1e-6
MARK_M, MARK_REST_M, LEFT, RIGHT = 20.0, 15.0, 5001, 1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a long expression as a column of one computation: what reads it does not take the expression over."""
    return df.withColumn(name, F.explode(F.array(value)))


def _with(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _apart(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def _retraced(verts: Column, turn, last) -> Column:
    """The largest m for which the m vertices after vertex turn(m), counted from 1, lie on those before it, arcs bent the other way.

    Only those m are looked at for which the outermost pair, vertex last(m) and its image, and the innermost one agree: on a line that does not run back
    over itself none, so that the time grows with its length. They are tried from the largest on, up to the first that holds.
    """
    half = F.floor((F.size(verts) - 1) / 2).cast("int")
    at = lambda i: F.element_at(verts, i.cast("int"))
    alike = lambda i, j: (_apart(at(i), at(j)) <= RETRACE_M) & (F.abs(at(i - 1)["bulge"] + at(j)["bulge"]) < RETRACE_BULGE)

    def ends(m: Column) -> Column:
        far = F.lit(last) * m  # from the turn to the free end, and its image as far on the other side
        return F.when(m <= half, (_apart(at(turn(m) + far), at(turn(m) - far)) <= RETRACE_M) & alike(turn(m) + 1, turn(m) - 1)).otherwise(False)

    some = F.filter(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), ends)
    whole = lambda m: F.forall(F.sequence(F.lit(1), m), lambda k: alike(turn(m) + k, turn(m) - k))
    return F.aggregate(F.reverse(some), F.lit(0), lambda found, m: F.when(found > 0, found).when(whole(m), m).otherwise(F.lit(0)))


def remove_retraced_ends(outlines: DataFrame) -> DataFrame:
    """Open lines without the tail, then the head, that runs back over the line; adds removed_start, removed_end. Closed ones stay."""
    n = F.size("verts")
    out = _once(outlines, "removed_end", F.when(F.col("closed"), F.lit(0)).otherwise(_retraced(F.col("verts"), lambda m: n - m, 1)))
    last = F.element_at("verts", n - F.col("removed_end"))
    cut = F.concat(F.slice("verts", F.lit(1), n - F.col("removed_end") - 1), F.array(last.withField("bulge", F.lit(0.0))))
    out = _once(out, "verts", F.when(F.col("removed_end") > 0, cut).otherwise(F.col("verts")))
    out = _once(out, "removed_start", F.when(F.col("closed"), F.lit(0)).otherwise(_retraced(F.col("verts"), lambda m: m + 1, -1)))
    return out.withColumn("verts", F.slice("verts", F.col("removed_start") + 1, F.greatest(F.size("verts"), F.lit(1))))


def _after(verts: Column, closed: Column) -> Column:
    """The vertex after each vertex; one less if the line is open."""
    return F.concat(F.slice(verts, F.lit(2), F.greatest(F.size(verts), F.lit(1))), F.slice(verts, F.lit(1), F.when(closed, 1).otherwise(0)))


def length_of(a: Column, b: Column) -> Column:
    return geometry.arc_length(_apart(a, b), F.when(F.abs(a["bulge"]) < NO_BULGE, F.lit(0.0)).otherwise(a["bulge"]))


def line_length(verts: Column, closed: Column) -> Column:
    steps = F.zip_with(verts, _after(verts, closed), lambda a, b: F.coalesce(length_of(a, b), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _place(a: Column, b: Column, t: Column) -> tuple[Column, Column]:
    """The point at a fraction of the way from a to b, along the arc if there is one; counted from a, so that large coordinates keep their digits."""
    bulge = F.when(F.abs(a["bulge"]) >= NO_BULGE, a["bulge"])
    dx, dy, off = b["x"] - a["x"], b["y"] - a["y"], (1 / bulge - bulge) / 4
    cx, cy, turn = dx / 2 - dy * off, dy / 2 + dx * off, 4 * F.atan(bulge) * t
    x = cx - cx * F.cos(turn) + cy * F.sin(turn)
    y = cy - cx * F.sin(turn) - cy * F.cos(turn)
    return a["x"] + F.coalesce(x, dx * t), a["y"] + F.coalesce(y, dy * t)


def _cut(a: Column, b: Column, stops: Column) -> Column:
    """Vertices of the way from a to b: a, and one at each of the stops (fractions), every one with the bulge of the piece after it."""
    starts, ends = F.concat(F.array(F.lit(0.0)), stops), F.concat(stops, F.array(F.lit(1.0)))

    def vertex(s: Column, e: Column) -> Column:
        x, y = _place(a, b, s)
        bulge = F.when(F.abs(a["bulge"]) < NO_BULGE, F.lit(0.0)).otherwise(F.tan(F.atan(a["bulge"]) * (e - s)))
        return F.struct(F.when(s == 0, a["x"]).otherwise(x).alias("x"), F.when(s == 0, a["y"]).otherwise(y).alias("y"), bulge.alias("bulge"), (s > 0).alias("inserted"))

    return F.zip_with(starts, ends, vertex)


def _whole(a: Column, bulge: Column) -> Column:
    return F.array(F.struct(a["x"].alias("x"), a["y"].alias("y"), bulge.alias("bulge"), F.lit(False).alias("inserted")))


def segment_arcs(outlines: DataFrame, distance: float = CUT_M) -> DataFrame:
    """Outlines with vertices on their arcs every `distance`; straight parts and the given vertices stay. verts gain `inserted`.

    An arc no longer than that gets its midpoint. The last cut is left out if less than a third of the distance remains after it.
    """

    def way(a: Column, b: Column) -> Column:
        flat = b.isNull() | (F.abs(a["bulge"]) < NO_BULGE) | (F.abs(a["bulge"]) * _apart(a, b) / 2 < STRAIGHT_M)
        return F.when(flat, _whole(a, a["bulge"])).otherwise(_with(_with(length_of(a, b), stops), lambda at: _cut(a, b, at)))

    def stops(length: Column) -> Column:
        many = F.when(length <= distance, F.lit(0)).otherwise(F.ceil((length - LAST_M) / distance).cast("int") - 1)
        many = many - F.when(length - many * distance < distance / 3, 1).otherwise(0)
        return F.when(many < 1, F.array(F.lit(0.5))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda k: k * F.lit(distance) / length))

    return _once(outlines, "verts", F.flatten(F.zip_with("verts", _after(F.col("verts"), F.col("closed")), way)))


def sanitized(outlines: DataFrame) -> DataFrame:
    """Outlines with no way longer than DENSE_M between vertices (a rest under REST_M goes with the one before), then without straight ways under MICRO_M.

    This changes the drawn shape; only legacy_corridor_areas() asks for it.
    """

    def way(a: Column, b: Column) -> Column:
        parts = lambda length: F.when(length <= DENSE_M, _whole(a, a["bulge"])).otherwise(_with(stops(length), lambda at: _cut(a, b, at)))
        return F.when(b.isNull(), _whole(a, F.lit(0.0))).otherwise(_with(length_of(a, b), parts))

    def stops(length: Column) -> Column:
        whole = F.floor(length / DENSE_M).cast("int")
        most = whole - F.when(F.abs(length - whole * DENSE_M) < EXACT_M, 1).otherwise(0)
        kept = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda j: (j <= most) & (length - j * DENSE_M >= REST_M))
        return F.transform(kept, lambda j: j * F.lit(DENSE_M) / length)

    dense = _once(outlines, "verts", F.flatten(F.zip_with("verts", _after(F.col("verts"), F.col("closed")), way)))
    v, n = F.col("verts"), F.size("verts")
    micro = lambda p, q: (_apart(p, q) < MICRO_M) & (F.abs(p["bulge"]) < NO_BULGE)
    kept = F.filter(v, lambda p, i: (i + 1 < n) & ~F.coalesce(micro(p, F.get(v, i + 1)), F.lit(False)))
    dense = _once(dense, "_kept", kept)
    last, first = F.get(v, n - 1), F.coalesce(F.get("_kept", F.lit(0)), F.get(v, F.lit(0)))
    end = F.when((n > 0) & ~(F.col("closed") & micro(last, first)), F.array(last)).otherwise(F.slice(v, 1, 0))
    return _once(dense, "verts", F.transform(F.concat("_kept", end), lambda p: p.dropFields("inserted"))).drop("_kept")


def straight_ring(verts: Column, sagitta: float = 0.001) -> Column:
    """The ring (x, y) of a closed outline, arcs as chords that keep within a sagitta: what the overlay takes."""
    way = lambda a, b: geometry.arc_points(a["x"], a["y"], b["x"], b["y"], _bend(a, b), geometry.arc_parts(_apart(a, b), _bend(a, b), sagitta))
    return F.flatten(F.zip_with(verts, _after(verts, F.lit(True)), way))


def _bend(a: Column, b: Column) -> Column:
    return F.when((F.abs(a["bulge"]) < NO_BULGE) | (_apart(a, b) == 0), F.lit(0.0)).otherwise(a["bulge"])


def legacy_corridor_areas(corridors: DataFrame, shapes: DataFrame, cell: float = 50.0) -> DataFrame:
    """(corridor_id, parcel_id, sqm): shared areas of sanitised outlines. Of a parcel's shapes the last one picked (`pick`) with an area stands for all.

    corridors: (corridor_id, closed, verts); shapes: (parcel_id, pick, closed, verts).
    """
    ring = lambda df: _once(sanitized(df), "ring", straight_ring(F.col("verts"))).drop("closed", "verts")
    met = overlay.overlap_areas(ring(corridors), ring(shapes), ["corridor_id"], ["parcel_id", "pick"], cell=cell)
    return met.groupBy("corridor_id", "parcel_id").agg(F.max_by("sqm", "pick").alias("sqm"))


def segmentation_check(source: DataFrame, result: DataFrame, by: list[str]) -> DataFrame:
    """One row for each outline: (by, same_length, n_source, n_kept, n_off, n_backwards, gap) of segment_arcs() against what it was given.

    n_kept: vertices of the source that stand in the result in their order; n_off: added ones beside the outline; n_backwards: those before the
    one before them along it; gap: between the ends of an open line, where it is seen as a slip, else null.
    """
    total = line_length(F.col("verts"), F.col("closed"))
    first, last = F.get("verts", F.lit(0)), F.get("verts", F.size("verts") - 1)
    gap = _apart(first, last)
    gap = F.when(~F.col("closed") & (gap > CLOSED_M) & (gap < NOTED_M), gap)
    own = source.select(*by, total.alias("length"), F.size("verts").alias("n_source"), gap.alias("gap"))

    order = Window.partitionBy(*by).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ways = source.select(*by, F.posexplode(F.zip_with("verts", _after(F.col("verts"), F.col("closed")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "way")).select(*by, "i", "way.*")
    ways = ways.withColumn("way", F.coalesce(length_of(F.col("a"), F.col("b")), F.lit(0.0)))
    ways = ways.withColumn("station", F.coalesce(F.sum("way").over(upto), F.lit(0.0))).withColumnRenamed("i", "k")

    seen = result.select(*by, F.posexplode("verts").alias("i", "p"))
    seen = seen.withColumn("k", F.sum((~F.col("p.inserted")).cast("int")).over(order) - 1)
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    bulge = F.when((F.abs(a["bulge"]) >= NO_BULGE) & b.isNotNull(), a["bulge"])
    off = (1 / bulge - bulge) / 4
    cx, cy = (a["x"] + b["x"]) / 2 - (b["y"] - a["y"]) * off, (a["y"] + b["y"]) / 2 + (b["x"] - a["x"]) * off
    radius = F.hypot(a["x"] - cx, a["y"] - cy)
    turned = (F.atan2(p["y"] - cy, p["x"] - cx) - F.atan2(a["y"] - cy, a["x"] - cx)) * F.signum(bulge)
    kept = ~p["inserted"] & (_apart(p, a) <= 1e-9)
    beside = p["inserted"] & F.coalesce(F.abs(F.hypot(p["x"] - cx, p["y"] - cy) - radius) > SAME_M, F.lit(True))
    along = F.when(kept, F.col("station")).when(p["inserted"] & ~beside, F.col("station") + radius * F.pmod(turned, F.lit(2 * math.pi)))
    met = seen.join(ways, [*by, "k"], "left").select(*by, "i", F.coalesce(kept, F.lit(False)).alias("kept"), beside.alias("beside"), along.alias("along"))
    back = F.col("along") < F.last("along", ignorenulls=True).over(upto) - SAME_M
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    told = met.withColumn("back", back).groupBy(*by).agg(count(F.col("kept")).alias("n_kept"), count(F.col("beside")).alias("n_off"), count(F.col("back")).alias("n_backwards"))
    new = result.select(*by, total.alias("_new"))
    same = F.coalesce(F.abs(F.col("_new") - F.col("length")) <= SAME_M, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(new, by, "left").join(told, by, "left").select(*by, same.alias("same_length"), "n_source", zero("n_kept"), zero("n_off"), zero("n_backwards"), "gap")


def _turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


@F.pandas_udf(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())]))
def _farthest(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Places of the two vertices furthest apart, the first such pair of several. Both are corners of the convex hull, so only those are compared."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        p = np.column_stack([x, y]).astype(float)
        corner, first = np.unique(p, axis=0, return_index=True)
        hull: set[int] = set()
        for turn in (range(len(corner)), range(len(corner) - 1, -1, -1)):
            chain: list[int] = []
            for c in turn:
                while len(chain) > 1 and _turn(*corner[[chain[-2], chain[-1], c]]) <= 0:
                    chain.pop()
                chain.append(c)
            hull.update(chain)
        at = np.sort(first[sorted(hull)])
        best = (0.0, -1, -1)
        for n, i in enumerate(at[:-1]):
            d = np.hypot(*(p[at[n + 1 :]] - p[i]).T)
            if d.max() > best[0]:
                best = (d.max(), i, at[n + 1 + int(d.argmax())])
        out.append(best[1:])
    return pd.DataFrame(out, columns=["i", "j"]).astype("int32")


def corridor_markers(outlines: DataFrame, by: list[str]) -> DataFrame:
    """(by, side, number, x, y, text_angle): a point every MARK_M along both ways between an outline's two vertices furthest apart.

    Arcs count as straight, and a vertex within CLOSED_M (in x and in y) of the one before it is left out. No point stands where less than MARK_REST_M remain. Numbers start at LEFT and RIGHT.
    """
    of = lambda c: F.transform("verts", lambda p: p[c])
    found = outlines.where(F.size("verts") > 1).withColumn("_f", _farthest(of("x"), of("y"))).where("_f.i >= 0")
    i, j, n = F.col("_f.i"), F.col("_f.j"), F.size("verts")
    there = F.slice("verts", i + 1, j - i + 1)
    back = F.concat(F.reverse(F.slice("verts", F.lit(1), i + 1)), F.reverse(F.slice("verts", j + 1, n - j)))
    side = lambda name, start, v: F.struct(F.lit(name).alias("side"), F.lit(start).alias("start"), edges.dedupe_vertices(v, CLOSED_M).alias("v"))
    sides = found.select(*by, F.explode(F.array(side("left", LEFT, there), side("right", RIGHT, back))).alias("s")).select(*by, "s.*")
    ways = sides.select(*by, "side", "start", F.posexplode(F.arrays_zip(F.slice("v", F.lit(1), F.size("v") - 1).alias("a"), F.slice("v", F.lit(2), F.size("v")).alias("b"))).alias("i", "w")).select(*by, "side", "start", "i", "w.a", "w.b")
    ways = ways.withColumn("way", _apart(F.col("a"), F.col("b")))
    of_side = Window.partitionBy(*by, "side")
    ways = ways.withColumn("upto", F.sum("way").over(of_side.orderBy("i"))).withColumn("total", F.sum("way").over(of_side)).withColumn("begin", F.col("upto") - F.col("way"))
    first, last = F.greatest(F.ceil(F.col("begin") / MARK_M), F.lit(1)), F.floor(F.least("upto", F.col("total") - MARK_REST_M) / MARK_M)
    marks = ways.where((F.col("way") > 0) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last))).where(F.col("k") * MARK_M < F.col("upto"))
    t = (F.col("k") * MARK_M - F.col("begin")) / F.col("way")
    at = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t
    angle = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")) + math.pi / 2
    return marks.select(*by, "side", (F.col("start") + F.col("k") - 1).alias("number"), at("x").alias("x"), at("y").alias("y"), angle.alias("text_angle"))
