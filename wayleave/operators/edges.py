"""A corridor's edges: its outline cut into a left and a right edge along the axis, and where these meet parcels. The walk along them is in walk.py.

Segments, outlines and axes of any number of corridors are one job. What meets what is found by equi-joins on cells: segments and ring
edges go to the cells along them, never to those of their box.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.functions import geometry
from wayleave.functions.keys import pole_key
from wayleave.operators.lines import along_cells, containing, located, split_parameters
from wayleave.operators.overlay import by_cell
from wayleave.operators.shapes import ring_edges
from wayleave.sources.saved import saved

SAME_M = 1e-9


# --- outlines and axes -------------------------------------------------------------------------------------------------


def dedupe_vertices(verts: Column, tolerance: float = SAME_M) -> Column:
    """Vertices (x, y, ...) without those that repeat the one before them, nor a closing one that repeats the first."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    kept = lambda v: F.filter(v, lambda p, i: (i == 0) | ~near(p, F.get(v, i - 1)))
    # Of the first vertex and what repeats it at the end only the first stays.
    last = lambda k: F.array_max(F.transform(k, lambda p, i: F.when((i == 0) | ~near(p, F.get(k, F.lit(0))), i + 1).otherwise(F.lit(0))))
    return geometry.bound(verts, lambda v: geometry.bound(kept(v), lambda k: F.slice(k, F.lit(1), F.coalesce(last(k), F.lit(0)))))


class Ends:
    """The free ends of pieces, in cells of about one piece each, for the one nearest to a point."""

    #: So many rings of cells are looked through before all ends that are left are.
    RINGS = 6

    def __init__(self, ends: np.ndarray):
        """ends: start and end of each piece, (n, 2, 2)."""
        self.ends, self.left = ends, np.ones(len(ends), bool)
        self.low = ends.min(axis=(0, 1))
        self.cell = max(float((ends.max(axis=(0, 1)) - self.low).max()) / math.sqrt(len(ends)), SAME_M)
        self.cells: dict[tuple[int, int], list[int]] = {}
        for (x, y), i in zip(((ends - self.low) // self.cell).astype(np.int64).reshape(-1, 2).tolist(), np.repeat(np.arange(len(ends)), 2).tolist(), strict=True):
            self.cells.setdefault((x, y), []).append(i)

    def take(self, i: int) -> None:
        self.left[i] = False
        for x, y in ((self.ends[i] - self.low) // self.cell).astype(np.int64).tolist():
            self.cells[x, y].remove(i)

    def nearest(self, p: np.ndarray) -> tuple[int, bool]:
        """The piece with an end nearest to p (the first of equals), and whether that is its start, which goes first of equals."""
        cx, cy = ((p - self.low) // self.cell).astype(np.int64).tolist()
        some: list[int] = []
        for r in range(self.RINGS):
            ring = [(x, y) for x in range(cx - r, cx + r + 1) for y in ((cy - r, cy + r) if abs(x - cx) < r else range(cy - r, cy + r + 1))]
            some += [i for c in dict.fromkeys(ring) for i in self.cells.get(c, ())]
            found = self._best(np.unique(some), p) if some else None
            if found and found[0] <= r * self.cell:  # whatever lies that near has been looked at
                return found[1:]
        return self._best(np.flatnonzero(self.left), p)[1:]

    def _best(self, of: np.ndarray, p: np.ndarray) -> tuple[float, int, bool]:
        far = np.hypot(*np.moveaxis(self.ends[of] - p, 2, 0))
        i = int(far.min(axis=1).argmin())
        return float(far[i].min()), int(of[i]), bool(far[i, 0] <= far[i, 1])


def chain_axis(pieces: DataFrame) -> DataFrame:
    """pieces (corridor_id, ord, verts) in pick order -> (corridor_id, verts): joined from the first piece on, each time by the piece whose start or end is nearest to the tail, the start preferred.

    Each piece depends on where the one before it ends, so an axis is one task's work; its pieces' ends stand in cells, so that a step looks at a few of them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.array([(p["x"], p["y"]) for p in v]) for v in pdf.sort_values("ord").verts]
        ends = Ends(np.array([(v[0], v[-1]) for v in parts]))
        line, i = [parts[0]], 0
        for _ in parts[1:]:
            ends.take(i)
            i, forth = ends.nearest(line[-1][-1])
            nxt = parts[i] if forth else parts[i][::-1]
            line.append(nxt[1:] if len(nxt) > 1 and math.dist(line[-1][-1], nxt[0]) <= SAME_M else nxt)
        return pd.DataFrame({"corridor_id": [pdf.corridor_id.iloc[0]], "verts": [[{"x": x, "y": y} for x, y in np.concatenate(line).tolist()]]})

    rows = pieces.where(F.size("verts") > 0).select(F.col("corridor_id").cast("long"), "ord", F.transform("verts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("verts"))
    return rows.groupBy("corridor_id").applyInPandas(run, "corridor_id long, verts array<struct<x:double,y:double>>")


def orient_axis(axes: DataFrame, poles: DataFrame) -> DataFrame:
    """axes (corridor_id, verts) with `reversed`: turned so that they run from the lowest pole (corridor_id, pole_no, x, y) to the highest; as drawn where there are fewer than two."""
    at, key = F.struct("x", "y"), pole_key(F.col("pole_no"))
    ends = poles.groupBy("corridor_id").agg(F.min_by(at, key).alias("low"), F.max_by(at, key).alias("high"), F.count(F.lit(1)).alias("n"))
    start = F.element_at("verts", 1)
    far = lambda p: F.hypot(start["x"] - F.col(f"{p}.x"), start["y"] - F.col(f"{p}.y"))
    turned = F.coalesce((F.col("n") > 1) & (far("high") < far("low")), F.lit(False))
    rows = axes.join(ends, "corridor_id", "left").withColumn("reversed", turned)
    return rows.select("corridor_id", F.when(F.col("reversed"), F.reverse("verts")).otherwise(F.col("verts")).alias("verts"), "reversed")


def line_segments(lines: DataFrame, by: list[str], verts: str = "verts") -> DataFrame:
    """(by, ord, x0, y0, x1, y1, bulge): the segments of open lines, with bulge 0 where vertices have none."""
    has = "bulge" in lines.schema[verts].dataType.elementType.fieldNames()
    rows = lines.select(*by, F.col(verts).alias("_v"), F.posexplode(verts).alias("ord", "_p")).where(F.col("ord") + 1 < F.size("_v"))
    q = F.element_at("_v", F.col("ord") + 2)
    return rows.select(*by, "ord", F.col("_p.x").alias("x0"), F.col("_p.y").alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"), (F.col("_p.bulge") if has else F.lit(0.0)).alias("bulge"))


def split_edges(outlines: DataFrame, axes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two edges of each outline, and the outlines that do not have exactly one of each kind.

    outlines (corridor_id, verts with bulge), axes (corridor_id, verts). Returns (corridor_id, side, ord, x, y, bulge,
    station) in order of station, and (corridor_id, left_runs, right_runs). Vertices go round; a run is a stretch of one
    side of the axis, and vertices on the axis part runs. An edge against the axis is turned, its arcs with it.
    """
    # Saved, as Spark would else ask for the size of v before whatever makes outlines distinct, row by row of what they are made from.
    v = saved(outlines.select("corridor_id", dedupe_vertices(F.col("verts")).alias("v")), "outlines").where(F.size("v") > 3)
    v = v.select("corridor_id", F.size("v").alias("n"), F.posexplode("v").alias("i", "p")).select("corridor_id", "n", "i", "p.x", "p.y", "p.bulge")
    segments = line_segments(axes.where(F.size("verts") > 1), ["corridor_id"]).drop("bulge")
    at = located(v.select("corridor_id", "i", "x", "y"), segments, ["corridor_id"], ["i"])
    v = v.join(at, ["corridor_id", "i"]).withColumn("s", F.signum("offset").cast("int"))
    ring = Window.partitionBy("corridor_id").orderBy("i")
    whole = Window.partitionBy("corridor_id")
    before = F.coalesce(F.lag("s").over(ring), F.last("s").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    v = v.withColumn("new", F.col("s") != before)
    v = v.withColumn("start", F.coalesce(F.min(F.when(F.col("new"), F.col("i"))).over(whole), F.lit(0)))
    v = v.withColumn("r", F.pmod(F.col("i") - F.col("start"), F.col("n")))
    turn = Window.partitionBy("corridor_id").orderBy("r")
    v = v.withColumn("run", F.sum(F.col("new").cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, 0))).where("s <> 0")
    v = saved(v, "sides")
    runs = v.groupBy("corridor_id").agg(F.countDistinct(F.when(F.col("s") > 0, F.col("run"))).alias("left_runs"), F.countDistinct(F.when(F.col("s") < 0, F.col("run"))).alias("right_runs"))
    good = v.join(runs.where("left_runs = 1 and right_runs = 1").select("corridor_id"), "corridor_id", "left_semi")
    along = Window.partitionBy("corridor_id", "s").orderBy("r")
    ends = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    good = good.withColumn("back", F.last("station").over(ends) < F.first("station").over(ends))
    # A bulge belongs to the segment to the next vertex; against the run it is that of the segment before, turned.
    bulge = F.when(F.col("back"), -F.coalesce(F.lag("bulge").over(along), F.lit(0.0))).otherwise(F.when(F.lead("r").over(along).isNull(), F.lit(0.0)).otherwise(F.col("bulge")))
    good = good.withColumn("b", bulge + 0.0)
    order = Window.partitionBy("corridor_id", "s").orderBy(F.when(F.col("back"), -F.col("r")).otherwise(F.col("r")))
    edges = good.withColumn("ord", F.row_number().over(order)).select("corridor_id", F.when(F.col("s") > 0, "left").otherwise("right").alias("side"), "ord", "x", "y", F.col("b").alias("bulge"), "station")
    all_ = outlines.select("corridor_id").join(runs, "corridor_id", "left").na.fill(0, ["left_runs", "right_runs"])
    return edges, all_.where("left_runs <> 1 or right_runs <> 1")


# --- where segments meet parcels ----------------------------------------------------------------------------------------


def chords(segments: DataFrame, keys: list[str], sagitta: float = 0.001) -> DataFrame:
    """segments (keys, x0, y0, x1, y1, bulge) as chords (keys, x0, y0, x1, y1, t0, t1): arcs in chords within a sagitta, t from 0 to 1 along the segment."""
    chord = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    parts = geometry.arc_parts(chord, F.col("bulge"), sagitta)
    rows = segments.withColumn("_n", F.when((F.col("bulge") == 0) | (chord <= SAME_M), F.lit(1)).otherwise(parts))
    points = F.concat(geometry.arc_points(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.when(F.col("_n") > 1, F.col("bulge")).otherwise(F.lit(0.0)), F.col("_n")), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    rows = rows.select(*keys, "_n", points.alias("_p")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    p, q = F.element_at("_p", F.col("_i")), F.element_at("_p", F.col("_i") + 1)
    return rows.select(*keys, p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"), ((F.col("_i") - 1) / F.col("_n")).alias("t0"), (F.col("_i") / F.col("_n")).alias("t1"))


def boundary_hits(segments: DataFrame, shapes: DataFrame, keys: list[str], cell: float = 50.0) -> DataFrame:
    """(keys, cuts): for each segment that meets the boundary of a shape (ring), the sorted fractions where it does, without its ends and repeats."""
    s = along_cells(chords(segments, keys), cell)
    e = along_cells(ring_edges(shapes.where(F.size("ring") > 2).select("ring")), cell, "ax", "ay", "bx", "by")
    met = by_cell(s, e, ["_cx", "_cy"]).drop("_cx", "_cy")
    rx, ry, ux, uy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    cross = rx * uy - ry * ux
    qx, qy = F.col("ax") - F.col("x0"), F.col("ay") - F.col("y0")
    t, u = (qx * uy - qy * ux) / F.when(cross != 0, cross), (qx * ry - qy * rx) / F.when(cross != 0, cross)
    hits = met.withColumn("_t", t).where(F.col("_t").between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9))
    hits = hits.select(*keys, (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("_t")).alias("_t")).distinct()
    return hits.groupBy(*keys).agg(split_parameters(F.collect_list("_t"), 0.0, 1.0, 1e-6).alias("cuts")).where(F.size("cuts") > 0)


def point_at(t: Column) -> tuple[Column, Column]:
    """The point at fraction t of a segment (x0, y0, x1, y1, bulge)."""
    x0, y0, x1, y1, b = (F.col(c) for c in ("x0", "y0", "x1", "y1", "bulge"))
    angle, mx, my = 4 * F.atan(b) * t, (x0 + x1) / 2, (y0 + y1) / 2
    off = (1 / F.when(b != 0, b) - b) / 4
    cx, cy = mx - (y1 - y0) * off, my + (x1 - x0) * off
    arc_x = cx + (x0 - cx) * F.cos(angle) - (y0 - cy) * F.sin(angle)
    arc_y = cy + (x0 - cx) * F.sin(angle) + (y0 - cy) * F.cos(angle)
    return F.when(b == 0, x0 + (x1 - x0) * t).otherwise(arc_x), F.when(b == 0, y0 + (y1 - y0) * t).otherwise(arc_y)


def classified_pieces(segments: DataFrame, hits: DataFrame, shapes: DataFrame, keys: list[str], name: str, cell: float = 50.0) -> DataFrame:
    """(keys, a, b, length, <name>): segments cut at their hits, in fractions, each piece with the first shape (by `ord`) that holds its midpoint, else null."""
    s = segments.join(hits, keys, "left")
    bounds = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    s = s.withColumn("length", geometry.arc_length(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.col("bulge")))
    s = s.withColumn("_b", bounds).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_b") - 1)))
    s = s.withColumn("a", F.element_at("_b", F.col("_i"))).withColumn("b", F.element_at("_b", F.col("_i") + 1)).where((F.col("b") - F.col("a")) * F.col("length") > SAME_M)
    x, y = point_at((F.col("a") + F.col("b")) / 2)
    s = s.select(*keys, "a", "b", "length", x.alias("x"), y.alias("y"))
    home = containing(s, shapes.select("ring", F.col("ord").alias("_ord"), name), cell).groupBy(*keys, "a").agg(F.min_by(name, "_ord").alias(name))
    return s.drop("x", "y").join(home, [*keys, "a"], "left")


def axis_lengths(segments: DataFrame, parcels: DataFrame, by: list[str], cell: float = 50.0) -> DataFrame:
    """(by, parcel_id, metres): length of each axis (by, ord, x0, y0, x1, y1, bulge) in each parcel (parcel_id, ord, ring); parcel_id null is outside of all."""
    keys = [*by, "ord"]
    hits = boundary_hits(segments, parcels, keys, cell)
    pieces = classified_pieces(segments, hits, parcels, keys, "parcel_id", cell)
    return pieces.groupBy(*by, "parcel_id").agg(F.sum((F.col("b") - F.col("a")) * F.col("length")).alias("metres"))
